"""What the operators share: Arrow columns as byte arrays, batch cutting, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from planledger.session import work_dir

#: Text bytes that one round of array work takes at a time; a longer text is a round of its own.
ROUND_BYTES = 1 << 20
#: Rows that the JVM hands to a Python worker at a time.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_scopes: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written inside it, but for those of ``outlasting``."""
    folder = work_dir(spark, "scratch")
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, purpose: str, folder: str | None) -> DataFrame:
    path = f"{folder}/{purpose}-{uuid.uuid4().hex}" if folder else f"{work_dir(df.sparkSession, 'llm')}-{purpose}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    return _write(df, purpose, _scopes[-1] if _scopes else None)


def outlasting(df: DataFrame, purpose: str) -> DataFrame:
    """As ``written``, for a table that stays when the innermost ``scratch`` ends."""
    return _write(df, purpose, _scopes[-2] if len(_scopes) > 1 else None)


def sized(df: DataFrame) -> DataFrame:
    """``df``, whose session hands texts to Python in batches that fit beside a small heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def binary(column: pa.Array) -> pa.Array:
    """Strings as large binary; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each value starts (one more offset than values)."""
    column = binary(column)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def rounds(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = ROUND_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece have about ``size`` bytes; no text is divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range, from prefix sums; mixed so that any bits serve."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the process."""
    if len(_POWERS[0]) < n:
        n = max(n + n // 4, ROUND_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def small_letters(column: pa.Array) -> pa.Array:
    """Texts in lower case, of any script; nulls stay."""
    return pc.utf8_lower(column)


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true positions; a run never crosses the start of a value."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    inner = starts[(starts > 0) & (starts < len(inside))]
    before[inner] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[inner - 1] = False
    return begin, np.flatnonzero(inside & ~after) + 1


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits and non-ASCII bytes."""
    return runs(_WORD[data], starts)


def token_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return runs(~_SPACE[data], starts)
