"""Labelled rows for fitting: a bounded sample of the training fold, with its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planledger.llm.common import sized

FOLDS = 5


def held_out(doc_id: Column, folds: int = FOLDS, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text``, ``target`` of about ``bound`` labelled rows that aren't held out, at most.

    Rows are chosen by a hash of the id, so the choice is the same in every run. The label side has
    a proven bound (``bound`` rows of two numbers, and few more), so it is broadcast and texts of
    other rows are not shuffled. Null ids and labels take no part; repeated labels count each.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("target")).filter(F.col("id").isNotNull() & F.col("target").isin(0, 1) & ~held_out(F.col("id")))
    n = known.count()
    part = min(1.0, bound / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return sized(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
