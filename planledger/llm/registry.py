"""The operators' queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planledger.llm import ann, bpe, decontam, language, lm, pii, quality, ranked, secret_scan, simhash, spans, sql, token_orc, toxicity, turns
from planledger.llm.common import read_table
from planledger.llm.labelled import held_out
from planledger.session import work_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def spanned(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    counts = [spans.count("spans", kind).alias(f"n_{kind}") for kind in kinds]
    return rows.select("doc_id", *counts, spans.digest("spans").alias("base_sha256"), spans.listed("spans").alias("spans"))


def op1_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = token_orc.write_token_ids(read_table(spark, folder, "documents"), TOKENIZER, work_dir(spark, "token-ids"))
    rows = token_orc.positions(token_orc.checksums(token_orc.read_token_ids(spark, path)))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.round_trip(read_table(spark, folder, "documents"), TOKENIZER)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return spanned(pii.scan(read_table(spark, folder, "documents")), pii.KINDS)


def op4_decontam(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    rows = toxicity.scores(docs, toxicity.train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return spanned(secret_scan.scan(read_table(spark, folder, "documents")), secret_scan.KINDS[:3])


def op7_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(read_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    rows = quality.scores(docs, quality.train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(read_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op12_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.audit(read_table(spark, folder, "conversations"))


def op13_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    rows = language.identify(docs, language.train(docs.filter(language.in_training(F.col("doc_id")))))
    return rows.select("doc_id", (~language.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_decontam": op4_decontam,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_lm": op7_lm,
    "op8_quality": op8_quality,
    "op9_ann": op9_ann,
    "op10_simhash": op10_simhash,
    "op11_ranked": op11_ranked,
    "op12_turns": op12_turns,
    "op13_langid": op13_langid,
}

ORACLES: dict[str, str] = {"op11_ranked": sql.OP11, "op12_turns": sql.OP12}
