"""Outcomes of explaining statements on several databases in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import join_hot

# Fixed pairs: server routine that reported the error, and what the failure is called.
ROUTINES = {
    "errorMissingColumn": "missing_column",
    "parserOpenTable": "missing_table",
    "aclcheck_error": "permission_denied",
}


def first_success(attempts: DataFrame, key: str = "stmt_id", order: str = "db_ord") -> DataFrame:
    """Per statement the first successful attempt; statements that never succeed have no row."""
    rest = [c for c in attempts.columns if c != key]
    best = F.min_by(F.struct(*rest), F.when(F.col("ok"), F.col(order)))
    return attempts.groupBy(key).agg(best.alias("_a")).filter("_a is not null").select(key, "_a.*")


def executed(attempts: DataFrame, key: str = "stmt_id", order: str = "db_ord") -> DataFrame:
    """The attempts that are really made: up to and including the first success."""
    stop = attempts.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col(order))).alias("_stop"))
    joined = join_hot(attempts, stop, [key], [order])
    return joined.filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def classify_failures(tried: DataFrame, databases: int, database: str = "db_ord") -> DataFrame:
    """Adds ``status`` to failed attempts and keeps those that are recorded.

    A missing column or table is recorded only at the last database; every other failure at
    each database that was tried. ``databases`` is how many are configured.
    """
    kinds = F.create_map(*[F.lit(x) for pair in ROUTINES.items() for x in pair])
    status = F.coalesce(F.try_element_at(kinds, F.col("routine")), F.lit("failed"))
    recorded = ~F.col("status").isin("missing_column", "missing_table") | (F.col(database) >= databases)
    return tried.filter(~F.col("ok")).withColumn("status", status).filter(recorded)


def explain_summary(tried: DataFrame, recorded: DataFrame, statements: DataFrame) -> DataFrame:
    """One row of counts: statements attempted and explained, failures by kind, statements without WHERE."""
    rows = (
        tried.groupBy("stmt_id").agg(F.max("ok").alias("ok")).select(
            F.lit("attempted").alias("what"), F.col("ok").cast("bigint").alias("n")
        )
        .unionByName(recorded.select(F.col("status").alias("what"), F.lit(1).cast("bigint").alias("n")))
        .unionByName(
            statements.filter((F.col("kind") != "failed") & ~F.lower("query_text").rlike(r"\bwhere\b")).select(
                F.lit("missing_where").alias("what"), F.lit(1).cast("bigint").alias("n")
            )
        )
    )

    def n(cond, value=F.lit(1)):
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")

    what = F.col("what")
    return rows.agg(
        n(what == "attempted").alias("attempted"),
        n(what == "attempted", F.col("n")).alias("explained"),
        n(what.isin("failed", "missing_column", "missing_table", "permission_denied")).alias("failed"),
        n(what == "permission_denied").alias("permission_denied"),
        n(what == "missing_table").alias("missing_tables"),
        n(what == "missing_column").alias("missing_columns"),
        n(what == "missing_where").alias("missing_where"),
    )
