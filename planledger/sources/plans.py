"""Plan logs: JSON text to typed plan documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed layout of a MySQL plan document.
MYSQL_PLAN = (
    "query_block STRUCT<select_id INT, r_loops INT, r_total_time_ms DOUBLE, `table` STRUCT<"
    "table_name STRING, access_type STRING, possible_keys ARRAY<STRING>, `key` STRING, key_length STRING, "
    "used_key_parts ARRAY<STRING>, `ref` ARRAY<STRING>, r_loops INT, `rows` BIGINT, r_rows STRING, "
    "filtered INT, r_filtered STRING, r_total_time_ms DOUBLE, attached_condition STRING, "
    "index_condition STRING>>"
)


def _occurrences(text: Column, what: str) -> Column:
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))
    return F.coalesce((removed / len(what)).cast("int"), F.lit(0))


def read_pg_plans(df: DataFrame, json_col: str) -> DataFrame:
    """PostgreSQL plan documents (a JSON array whose first object is the plan).

    Adds ``plan`` (VARIANT), ``planning_time``, ``execution_time``, ``total_runtime`` and
    ``levels``, an upper bound for the depth of the tree. Text that is no plan gives a
    null ``plan``; see :func:`bad_plans`.
    """
    first = "try_variant_get(_doc, '$[0].{}', '{}')"
    return (
        df.withColumn("_doc", F.try_parse_json(json_col))
        .withColumn("plan", F.expr(first.format("Plan", "variant")))
        .withColumn("planning_time", F.expr(first.format('["Planning Time"]', "double").replace(".[", "[")))
        .withColumn("execution_time", F.expr(first.format('["Execution Time"]', "double").replace(".[", "[")))
        .withColumn("total_runtime", F.expr(first.format('["Total Runtime"]', "double").replace(".[", "[")))
        .withColumn("levels", _occurrences(F.col(json_col), '"Plans"') + 1)
        .drop("_doc")
    )


def read_mysql_plans(df: DataFrame, json_col: str) -> DataFrame:
    """MySQL plan documents: one query block with one table. Bad text gives a null ``query_block``."""
    doc = F.from_json(json_col, MYSQL_PLAN, {"mode": "PERMISSIVE"})
    return df.withColumn("query_block", doc.getField("query_block"))


def bad_plans(plans: DataFrame) -> DataFrame:
    """Documents that could not be read as a plan."""
    column = "plan" if "plan" in plans.columns else "query_block"
    return plans.filter(F.col(column).isNull())
