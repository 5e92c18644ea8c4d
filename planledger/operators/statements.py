"""Statement texts: cleaning, kinds, counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure, text


def clean_for_parse(df: DataFrame, col: str = "query_text", into: str = "clean_text") -> DataFrame:
    return df.withColumn(into, text.clean_query(F.col(col)))


def restore_arrays(df: DataFrame, col: str = "clean_text", into: str = "query_text") -> DataFrame:
    return df.withColumn(into, text.restore_arrays(F.col(col)))


def statement_kind(df: DataFrame, col: str = "clean_text") -> DataFrame:
    return df.withColumn("kind", text.statement_kind(F.col(col)))


def statement_id(query_text: Column, is_dynamic: Column) -> Column:
    """MD5 of the text, a dynamic one marked: a static and a dynamic statement may share a text."""
    own = F.concat(query_text, F.when(is_dynamic, "\u0001dynamic").otherwise(""))
    return F.md5(F.encode(own, "utf-8"))


def dedupe(call_sites: DataFrame, order: Sequence[str] = ("path", "call_ord")) -> DataFrame:
    """Distinct lower-case texts with the number of uses and the file seen last.

    ``order`` says how call sites follow each other: ``call_ord`` counts within a file, so by
    default the files come by path; a corpus with arrival times names that column first.

    One shuffle, and rows are combined before it, so a text used by a third of all call
    sites reaches its reducer as one row per task. ``stmt_id`` stays unique for billions of
    texts, unlike a 64-bit hash. A text that can't be read is failed, whatever its verb.
    """

    # Bound to a variable: a filter on the kind would clean the text for each mention of it.
    def kind(clean: Column) -> Column:
        return F.when(text.readable(clean), text.statement_kind(clean)).otherwise(F.lit("failed"))

    return (
        call_sites.groupBy(F.lower("query_text").alias("query_text"), "is_dynamic")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.max(F.struct(F.struct(*order).alias("at"), F.col("path").alias("path"))).alias("_last"),
            # An aggregate, though equal to the key: a filter on what is made of it stays behind the shuffle.
            F.max(F.lower("query_text")).alias("_text"),
        )
        .select(
            statement_id(F.col("query_text"), F.col("is_dynamic")).alias("stmt_id"),
            "query_text",
            "is_dynamic",
            "occurrences",
            F.col("_last.path").alias("owner_path"),
            "_text",
        )
        .withColumn("kind", structure.let(text.clean_query(F.col("_text")), kind))
        .drop("_text")
    )


def parse_summary(statements: DataFrame) -> DataFrame:
    """Totals and distinct counts by static/dynamic, and accepted/failed among distinct static texts."""
    static, dynamic = ~F.col("is_dynamic"), F.col("is_dynamic")
    failed = F.col("kind") == "failed"

    def total(cond, what=F.lit(1)):
        return F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("bigint")

    return statements.agg(
        total(static, F.col("occurrences")).alias("total_static"),
        total(dynamic, F.col("occurrences")).alias("total_dynamic"),
        total(static).alias("unique_static"),
        total(dynamic).alias("unique_dynamic"),
        total(static & ~failed).alias("parsed"),
        total(static & failed).alias("failed"),
    )


def failed(statements: DataFrame) -> DataFrame:
    """Static texts that can't be read or are no select, update or delete, with their file."""
    return statements.filter(~F.col("is_dynamic") & (F.col("kind") == "failed")).select("query_text", F.col("owner_path").alias("path"))
