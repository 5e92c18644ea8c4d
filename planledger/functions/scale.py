"""Joins and running values that stay balanced when one key is very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has this part of all rows, so at most so many keys are; tasks that all rows together are spread over.
HOT_PARTS, TASKS = 64, 256


def hot_keys(df: DataFrame, on: Sequence[str], parts: int = HOT_PARTS, tasks: int = TASKS) -> DataFrame:
    """``on`` and ``_salts`` of the keys with one ``parts``-th of the rows or more: ``parts`` rows at most.

    Rows are counted per key before the shuffle, from the key columns alone. The number of salts follows
    a key's share: a key with a third of all rows gets a third of ``tasks``.
    """
    counts = df.select(*on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.filter(F.col("_n") * parts >= total)
    return hot.select(*on, F.ceil(F.col("_n") * tasks / total).cast("int").alias("_salts"))


def join_hot(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    parts: int = HOT_PARTS,
    tasks: int = TASKS,
) -> DataFrame:
    """Equi-join for a ``big`` side whose rows may crowd on one key.

    Hot keys are found by counting. A row of ``big`` with such a key goes to the salt given by a hash of
    its ``spread`` columns, and the rows of ``small`` with it are copied once per salt; all other rows
    stay single. The salt depends on values only: a recomputed task gives the same rows. Both sides are
    shuffled and sorted: sizes estimated from files that compress well, or before rows are exploded, would
    have the big side broadcast through the driver.
    """
    hot = F.broadcast(hot_keys(big, on, parts, tasks))
    salts = F.coalesce("_salts", F.lit(1))
    slot = F.pmod(F.xxhash64(*spread), salts).cast("int")
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    crowded = big.join(hot, list(on), "left").withColumn("_slot", slot).drop("_salts")
    return crowded.hint("merge").join(small.join(hot, list(on), "left").withColumn("_slot", copies).drop("_salts"), [*on, "_slot"], how).drop("_slot")


def spread_scan(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan with too few splits out to all cores; else returns it as it is.

    For work that costs far more than the rows weigh (parsing documents, matching text). On a
    large table the scan has more splits than there are cores and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def last_before(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = 1024
) -> DataFrame:
    """Last non-null ``value`` at or before each row, in order of ``position`` within ``keys``.

    A plain running window would put a whole key into one task. Rows are cut into
    blocks of ``block`` positions: one window runs inside each block, a second one
    over a single summary row per block, and the two are joined on (keys, block).
    ``position`` is an integer, unique within ``keys``.
    """
    keys = list(keys)
    rows = df.withColumn("_block", F.floor(F.col(position) / F.lit(block))).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    rows = rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    blocks = rows.groupBy(*keys, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    return (
        rows.join(blocks, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inside", "_before"))
        .drop("_block", "_value", "_inside", "_before")
    )


def nth_largest(df: DataFrame, group: str, value: str, ranks: DataFrame) -> DataFrame:
    """(group, value): the value of the wanted rank in each group, the largest being first.

    ``df`` has the distinct values of each group, ``ranks`` one row per group with ``rank``; groups
    are few. A rank window would sort each group in one task. Instead values are counted by
    interval, the interval that holds the rank is found among the counts, and only its values go
    on: first by relative size, then evenly between the least and the largest left. What is ranked
    at last is about one in sixteen million. Values of equal interval never change order.
    """
    steps = 4096
    # Never null: else a test for null would go down to one of the readers of ``df`` and the others
    # could not use its exchange again.
    size = F.coalesce(F.signum(value) * F.floor(F.log2(F.abs(F.col(value)) + 1) * steps), F.lit(0.0))
    left, wanted = _interval(df.select(group, value).withColumn("_part", size), ranks, group)
    ends = left.groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    even = F.coalesce(F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)) * steps), F.lit(0))
    spaced = left.join(F.broadcast(ends), group).withColumn("_part", even.cast("double")).select(group, value, "_part")
    left, wanted = _interval(spaced, wanted, group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value)))
    placed = left.withColumn("_place", place).join(F.broadcast(wanted), group)
    return placed.filter(F.col("_place") == F.col("rank")).select(group, value)


def _interval(df: DataFrame, ranks: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the interval ``_part`` that holds each group's rank, and the rank within it."""
    counts = df.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_above", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(ranks), group)
    hit = counts.filter((F.col("_above") < F.col("rank")) & (F.col("rank") <= F.col("_above") + F.col("_n")))
    hit = hit.select(group, "_part", (F.col("rank") - F.col("_above")).alias("rank"))
    return df.join(F.broadcast(hit.drop("rank")), [group, "_part"]).drop("_part"), hit.drop("_part")
