"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Features are present or not: single words, neighbouring words, and words with one between. A bounded
labelled sample is learnt document by document in one task, with a learning rate per coordinate and
L1 shrinkage. Only non-zero weights go to the tasks that score, at most one per hash bucket.

Null and empty texts have no features and get the score of the intercept. Without labelled rows all
scores are 0. Null ids are scored, repeated rows each; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm import labelled
from planledger.llm.common import byte_view, hashes, mix, rounds, sized, small_letters, word_runs

#: Labelled rows used for fitting, at most; passes over them; what a toxic document's step weighs.
SAMPLE, PASSES, POSITIVE = 20_000, 6, 2.0
BITS = 20
#: Learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.01


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each feature, by text; features may repeat."""
    data, starts = byte_view(small_letters(texts))
    begin, end = word_runs(data, starts)
    h = hashes(data, begin, end)
    owner = np.searchsorted(starts, begin, side="right") - 1
    found, where = [h], [owner]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD6E8FEB86659FD93)):
        inside = owner[gap:] == owner[:-gap]
        found.append(mix(h[:-gap][inside] * np.uint64(salt) + h[gap:][inside]))
        where.append(owner[gap:][inside])
    return np.concatenate(where), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``features``, each feature of a text once, in order of texts."""
    owner, bucket = features(texts)
    key = np.unique(owner << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def learn(rows: list[np.ndarray], labels: list[int], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept after FTRL-proximal steps over the documents, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w, b = weight(zx, nx, L1), weight(bias_z, bias_n, 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            g *= POSITIVE if y else 1.0
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    return weight(z, n, L1), float(weight(bias_z, bias_n, 0.0))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float] | None:
    """Buckets, weights and intercept; None without labelled rows.

    One task reads the sample's buckets (about ``bound`` documents), in an order by hash of the id.
    The driver gets non-zero weights only.
    """
    chosen = labelled.sample(docs, labels, target, bound, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            owner, bucket = present(batch.column("text"))
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("target"), lists], names=["id", "target", "x"])

    kind = T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("target", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])
    rows = chosen.mapInArrow(run, kind).repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit("turn")), "id", "target", "x")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            lists = batch.column("x")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows += [flat[a:b].copy() for a, b in zip(at, at[1:], strict=False)]
            labels += batch.column("target").to_pylist()
        if rows:
            w, b = learn(rows, labels)
            bucket = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(bucket, -1)), pa.array(np.append(w[bucket], b))], names=["bucket", "weight"])

    found = rows.mapInArrow(fit, "bucket bigint, weight double").toPandas().sort_values("bucket")
    if not len(found):
        return None
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    return bucket[1:], weight[1:], float(weight[0])


def scores(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model:
            table = np.zeros(1 << BITS)
            table[model[0]] = model[1]
        for batch in rounds(batches):
            score = np.zeros(batch.num_rows)
            if model:
                owner, bucket = features(batch.column("text"))
                telling = table[bucket] != 0
                key = np.unique(owner[telling] << BITS | bucket[telling])
                total = np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total + model[2], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    rows = own.mapInArrow(run, T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
