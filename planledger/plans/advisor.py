"""Index advice: which predicates the costly plans point to, and the indexes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import join_hot
from ..operators.params import condition_tokens, sentinel_lookup
from ..session import written
from .scoring import METRIC_ORDER, metric_order, score_stats

PRIORITY_THRESHOLD = 50


def match_picks(plan_picks: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds ``matched`` to both picks: the eligible expressions behind the sentinels of their condition.

    ``plan_picks``: plan_id, stmt_id, costliest, slowest. The predicates of a statement travel
    as one map per statement, no bigger than its WHERE clause; plans are spread over salts. A
    plan is matched once, however many scores it has.
    """
    known = (
        sentinel_lookup(predicates)
        .filter("eligible_index and sentinel is not null")
        .groupBy("stmt_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("sentinel", "expr"))).alias("_known"))
    )

    def with_matches(pick: str) -> Column:
        exprs = F.transform(condition_tokens(F.col(pick)["condition"]), lambda t: F.try_element_at("_known", t))
        found = F.coalesce(F.filter(exprs, lambda e: e.isNotNull()), F.expr("cast(array() as array<string>)"))
        return F.when(
            F.col(pick)["condition"].isNotNull() & F.col(pick)["table_name"].isNotNull(),
            F.struct(F.col(pick)["table_name"].alias("table_name"), found.alias("matched")),
        )

    joined = join_hot(plan_picks, known, ["stmt_id"], ["plan_id"], how="left")
    return joined.withColumn("costliest", with_matches("costliest")).withColumn("slowest", with_matches("slowest")).drop("_known")


def _with_picks(ranked: DataFrame) -> DataFrame:
    """Two rows per row: its plan's costliest and slowest pick; picks without condition are left out."""
    both = F.array(
        F.struct(F.lit("costliest").alias("pick_kind"), F.lit(0).alias("pick_ord"), F.col("costliest").alias("what")),
        F.struct(F.lit("slowest").alias("pick_kind"), F.lit(1).alias("pick_ord"), F.col("slowest").alias("what")),
    )
    rows = ranked.withColumn("_p", F.explode_outer(F.filter(both, lambda p: p["what"].isNotNull()))).filter("_p is not null")
    return rows.select(
        "plan_id", "stmt_id", "metric", "score", "metric_ord", "_p.pick_kind", "_p.pick_ord", "_p.what.table_name", "_p.what.matched"
    )


def picks(scores: DataFrame, matched_picks: DataFrame) -> DataFrame:
    """One row per score and pick that has a condition, with its place in the visiting order.

    ``matched_picks`` comes from :func:`match_picks`. The order is metric, falling score, plan,
    costliest before slowest.
    """
    ranked = scores.withColumn("metric_ord", metric_order()).filter("metric_ord is not null")
    return _with_picks(ranked.join(matched_picks.select("plan_id", "stmt_id", "costliest", "slowest"), "plan_id"))


def document_scores(picked: DataFrame) -> DataFrame:
    """(all columns of ``picked``, metric, score) for rows of ``document_picks``: no join, no shuffle."""
    measures = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"))
        for m in ("total_cost", "startup_cost", "total_runtime", "execution_time")
        if m in picked.columns
    ])
    scans = F.transform("seq_scan_times", lambda t: F.struct(F.lit("sequence_scan").alias("metric"), t.alias("score")))
    every = F.concat(measures, scans) if "seq_scan_times" in picked.columns else measures
    every = F.coalesce(every, measures)
    return picked.withColumn("_m", F.explode_outer(every)).select(*picked.columns, "_m.metric", "_m.score").filter("score is not null")


def document_pick_rows(scored: DataFrame) -> DataFrame:
    """:func:`picks` for the rows of :func:`document_scores`, inside each row."""
    return _with_picks(scored.withColumn("metric_ord", metric_order()).filter("metric_ord is not null"))


def credit(pick_rows: DataFrame) -> DataFrame:
    """Credits: (stmt_id, plan_id, metric, score, pick_kind, table_name, expr).

    The first pick of a statement that matches an eligible predicate credits every predicate
    it matches; each later pick of the statement, equal ones included, credits the last of
    those again. So every visit from the first on credits the last predicate, and each
    statement's first visit the others once. A minimum per statement and one join spread over
    salts: a statement with very many picks is never sorted or gathered in one task.
    """
    what = ["plan_id", "metric", "score", "pick_kind", "table_name", "matched"]
    visit = F.struct("metric_ord", (-F.col("score")).alias("neg_score"), "plan_id", "pick_ord")
    rows = pick_rows.withColumn("visit", visit)
    first = rows.filter(F.size("matched") > 0).groupBy("stmt_id").agg(F.min(F.struct("visit", *what)).alias("_first"))
    first = first.select("stmt_id", "_first.visit", *(F.col(f"_first.{c}").alias(c) for c in what))
    last = first.select("stmt_id", F.col("visit").alias("first_visit"), "table_name", F.element_at("matched", -1).alias("expr"))
    again = join_hot(rows.drop("table_name", "matched"), last, ["stmt_id"], ["plan_id"]).filter(F.col("visit") >= F.col("first_visit"))
    others = first.withColumn("expr", F.explode(F.slice("matched", F.lit(1), F.size("matched") - 1)))
    out = ["stmt_id", *what[:-1], "expr"]
    return again.select(*out).unionByName(others.select(*out))


def index_candidates(credits: DataFrame, stats: DataFrame) -> DataFrame:
    """Per (table, expression): hits, multiplier = 1 + Σ z² of outlier picks, priority = whole part of their product.

    An outlier lies above mean + deviation of its metric. ``stats`` has one row per metric,
    which is what makes its broadcast safe.
    """
    z = (F.col("score") - F.col("mean")) / F.col("sd")
    outlier = (F.col("score") > F.col("mean") + F.col("sd")) & (F.col("sd") > 0)
    scored = credits.join(F.broadcast(stats.filter(F.col("metric").isin(*METRIC_ORDER))), "metric")
    return (
        scored.withColumn("_z2", F.when(outlier, z * z))
        .groupBy("table_name", "expr")
        .agg(F.count(F.lit(1)).alias("hits"), (1 + F.coalesce(F.sum("_z2"), F.lit(0.0))).alias("multiplier"))
        .withColumn("priority", F.floor(F.col("hits") * F.col("multiplier")).cast("bigint"))
    )


def recommend(candidates: DataFrame, threshold: int = PRIORITY_THRESHOLD) -> DataFrame:
    """Index definitions of at least the given priority, highest first.

    An expression becomes a valid index name by replacing what names cannot hold.
    """
    name = F.regexp_replace(F.regexp_replace("expr", r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", "")
    ddl = F.format_string("CREATE INDEX idx_%s ON %s (%s);", name, F.col("table_name"), F.col("expr"))
    return (
        candidates.filter(F.col("priority") >= threshold)
        .select(ddl.alias("ddl"), "priority", "table_name", "expr")
        .orderBy(F.desc("priority"), "table_name", "expr")
    )


def affected(recommendations: DataFrame, credits: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Distinct call ranges each index would help: one row per (index, path, range)."""
    helped = credits.select("table_name", "expr", "stmt_id").distinct()
    wanted = helped.join(recommendations.select("ddl", "table_name", "expr"), ["table_name", "expr"])
    spots = call_sites.select("stmt_id", "path", "begin_line", "begin_col", "end_line", "end_col").distinct()
    return join_hot(spots, wanted.select("ddl", "stmt_id"), ["stmt_id"], ["path", "begin_line", "begin_col"]).drop("stmt_id").distinct()


def affected_queries(statements: DataFrame, credits: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Statements helped by at least one recommended index."""
    helped = credits.join(recommendations.select("table_name", "expr"), ["table_name", "expr"], "left_semi")
    return statements.join(helped.select("stmt_id").distinct(), "stmt_id", "left_semi")


def advise(scores: DataFrame, plan_picks: DataFrame, predicates: DataFrame, threshold: int = PRIORITY_THRESHOLD, keep: bool = True):
    """The whole report: (recommendations, credits, stats).

    ``keep`` writes the pick rows once to the shared folder, since two joins read them.
    """
    rows = picks(scores, match_picks(plan_picks, predicates))
    return _report(written(rows, "picks") if keep else rows, score_stats(scores), threshold)


def advise_documents(picked: DataFrame, predicates: DataFrame, threshold: int = PRIORITY_THRESHOLD, keep: bool = True):
    """:func:`advise` for the rows of ``document_picks``: scores and picks meet without a join.

    ``keep`` writes the picks before hot statements are counted among them, so that each document is
    parsed a single time, and the matched plans.
    """
    wanted = [c for c in picked.columns if c in ("plan_id", "stmt_id", "costliest", "slowest", "startup_cost", "seq_scan_times", *METRIC_ORDER)]
    picked = picked.select(*wanted)
    matched = match_picks(written(picked, "document-picks") if keep else picked, predicates)
    scored = document_scores(written(matched, "matched-plans") if keep else matched)
    return _report(document_pick_rows(scored), score_stats(scored), threshold)


def _report(pick_rows: DataFrame, stats: DataFrame, threshold: int):
    credits = credit(pick_rows)
    return recommend(index_candidates(credits, stats), threshold), credits, stats


def file_report(
    scores: DataFrame,
    plan_picks: DataFrame,
    predicates: DataFrame,
    call_sites: DataFrame,
    paths: DataFrame,
    threshold: int = PRIORITY_THRESHOLD,
    keep: bool = True,
):
    """The report for chosen files only, as (recommendations, affected places, stats); ``paths`` has one column, path.

    Plans and scores are cut to the statements called in those files before anything is
    counted, so means and priorities are those of the chosen files. ``keep`` writes the cut
    tables once, since each of them is read several times.
    """
    once = written if keep else (lambda df, _: df)
    chosen = once(call_sites.join(paths.select("path").distinct(), "path", "left_semi"), "chosen-sites")
    own_picks = once(plan_picks.join(chosen.select("stmt_id").distinct(), "stmt_id", "left_semi"), "chosen-picks")
    own_scores = once(scores.join(own_picks.select("plan_id").distinct(), "plan_id", "left_semi"), "chosen-scores")
    recommendations, credits, stats = advise(own_scores, own_picks, predicates, threshold, keep)
    return recommendations, affected(recommendations, credits, chosen), stats
