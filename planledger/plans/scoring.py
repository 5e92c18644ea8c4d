"""Scores per metric: table, statistics, top offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import nth_largest

# Fixed order in which the metrics are visited; startup cost is collected but not reported.
METRIC_ORDER = {"total_runtime": 1, "execution_time": 2, "total_cost": 3, "sequence_scan": 4}


def metric_order():
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in METRIC_ORDER.items() for x in pair]), F.col("metric"))


def score_rows(root: DataFrame, scans: DataFrame) -> DataFrame:
    """All scores: (plan_id, metric, score)."""
    return root.select("plan_id", "metric", "score").unionByName(
        scans.select("plan_id", F.lit("sequence_scan").alias("metric"), "score")
    )


def score_table(scores: DataFrame) -> DataFrame:
    """(metric, score, plans): distinct scores and how many plans have each.

    The plans of a score stay rows of ``scores``; gathering them per score would be unbounded.
    """
    return scores.groupBy("metric", "score").agg(F.count(F.lit(1)).alias("plans"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Per metric, over distinct scores: count, mean, sample deviation (0 for a single score)."""
    distinct = scores.select("metric", "score").distinct()
    return distinct.groupBy("metric").agg(
        F.count(F.lit(1)).alias("distinct_scores"),
        F.avg("score").alias("mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"),
    )


def top_offenders(scores: DataFrame, pct: int = 10) -> DataFrame:
    """Rows whose score is among the first floor(pct% of distinct) + 1 distinct scores of its metric.

    A plan only: no job runs before the result is asked for. The limits are one row per metric.
    """
    known = scores.filter(F.col("metric").isin(*METRIC_ORDER))
    distinct = known.select("metric", "score").distinct()
    n = F.count(F.lit(1))
    ranks = distinct.groupBy("metric").agg(F.least(F.floor(F.lit(pct) * n / 100) + 1, n).alias("rank"))
    limits = nth_largest(distinct, "metric", "score", ranks).withColumnRenamed("score", "_limit")
    return known.join(F.broadcast(limits), "metric").filter(F.col("score") >= F.col("_limit")).drop("_limit").select(*scores.columns)


def query_scores(scores: DataFrame, plans: DataFrame, statements: DataFrame, locations: DataFrame) -> DataFrame:
    """Report rows: score, original and explained text, file and call range.

    ``plans``: plan_id, stmt_id, final_text. ``locations``: one row per stmt_id. A statement
    may own very many plans; nothing is aggregated behind the joins, so adaptive execution
    splits its partition, and texts are copied for such partitions only.
    """
    owned = scores.filter(F.col("metric").isin(*METRIC_ORDER)).join(plans.select("plan_id", "stmt_id", "final_text"), "plan_id")
    texts = statements.select("stmt_id", F.col("query_text").alias("original_query")).join(locations, "stmt_id", "left")
    return owned.join(texts, "stmt_id").withColumnRenamed("final_text", "explained_query")
