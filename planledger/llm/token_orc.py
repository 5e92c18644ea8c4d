"""Token ids as ORC files: written in ascending id order, read in parallel by stripe.

A row holds a document's id, its number of ids and the ids as an integer array, which ORC stores
run-length encoded. Each file keeps row indexes (least and greatest id for so many rows) and Bloom
filters on the document id, so that a reader of a few documents skips stripes and row groups by
their metadata. ``slice_no`` and ``before`` place a document: slices are in id order, and ``before``
counts the ids of a slice ahead of the document; so positions of all documents need one small sum.

Null text counts as empty and still gets its end id. Null document ids come first. Equal document
ids are ordered by a hash of their texts; fully equal rows are written as often as they occur. An
empty table gives a folder without rows. Further columns of the input are not written.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from planledger.llm import bpe
from planledger.llm.common import ROUND_BYTES, binary, rounds, sized

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
FALSE_HITS = 0.01


@lru_cache(2)
def text_coder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """All ids of an Arrow column of texts and the number of ids of each, by the tokenizers library.

    For byte-level BPE files the library encodes each distinct piece of the texts once: its merges
    never cross a piece. For other files it encodes each text.
    """
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if bpe.plain_byte_level(spec):
        return bpe.Store(encode, tuple(a["content"].encode() for a in spec["added_tokens"])).ids

    def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = encode(binary(texts).to_pylist())
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum())), count

    return whole


def _encoder(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done, number = text_coder(path), 0, TaskContext.get().partitionId()
        for batch in rounds(batches, size=2 * ROUND_BYTES):  # the more text, the fewer pieces met anew
            ids, count = coder(batch.column("text"))
            stops = np.cumsum(count)
            ids = np.insert(ids, stops, end_id).astype(np.int32)
            stops += np.arange(1, len(stops) + 1)
            starts = np.concatenate(([0], stops))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            n = np.full(len(count), number, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(done + starts[:-1], pa.int64()), pa.array(count + 1, pa.int64()), lists],
                names=["id", "slice_no", "before", "n_tokens", "ids"],
            )
            done += int(starts[-1])

    return run


def write_token_ids(df: DataFrame, tokenizer_path: str, out_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append ``end_id``, write ORC files ordered by id; gives back the folder.

    Texts, not ids, are shuffled into id ranges: they are smaller, and the sampling for the ranges
    then reads the table only. Ranges split equal ids by their texts, so a crowded id is no one task.
    """
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = own.schema["id"].dataType
    spread = own.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    fields = [("id", kind), ("slice_no", T.IntegerType()), ("before", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    coded = spread.mapInArrow(_encoder(tokenizer_path, end_id), T.StructType([T.StructField(n, t) for n, t in fields]))
    (
        coded.write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "id")
        .option("orc.bloom.filter.fpp", FALSE_HITS)
        .orc(out_path)
    )
    return out_path


SCHEMA_TAIL = "slice_no int, before bigint, n_tokens bigint, ids array<int>"


def read_token_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The written rows. A filter on ``id`` reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(f"id {id_type}, {SCHEMA_TAIL}").orc(path)


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all documents before. Sums one small column per slice."""
    totals = rows.groupBy("slice_no").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("slice_no", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    return rows.join(base, "slice_no").withColumn("start", F.col("base") + F.col("before")).drop("base")


def checksums(rows: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` over the ids as little-endian unsigned 32-bit integers; drops the ids."""
    kept = [f for f in rows.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sums, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents, by statistics and Bloom filters instead of a full read."""
    rows = read_token_ids(spark, path)
    return rows.filter(F.col("id").isin(ids))
