"""Scores, offenders, credits and index recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import extract, params, predicates, statements
from ..plans import advisor, nodes, scoring
from ..session import written
from ..sources.plans import read_pg_plans
from . import sqlparts


def _scores(spark, sf):
    return scoring.score_rows(nodes.root_metrics(adapters.flat_plans(spark, sf)), nodes.seq_scans(adapters.flat_nodes(spark, sf)))


def _picks(spark, sf):
    owners = adapters.flat_plans(spark, sf).select("plan_id", "stmt_id")
    return nodes.node_picks(adapters.flat_nodes(spark, sf)).join(owners, "plan_id")


def _report(spark, sf):
    """(recommendations, credits, stats) with threshold 0."""
    return advisor.advise(_scores(spark, sf), _picks(spark, sf), adapters.flat_predicates(spark, sf), threshold=0)


def score_table(spark, sf):
    return scoring.score_table(_scores(spark, sf))


def score_stats(spark, sf):
    return scoring.score_stats(_scores(spark, sf)).select("metric", "distinct_scores", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def top_offenders(spark, sf):
    return scoring.top_offenders(_scores(spark, sf), 10)


def top_offenders_all(spark, sf):
    return scoring.top_offenders(_scores(spark, sf), 100)


def query_scores(spark, sf):
    sites = adapters.flat_call_sites(spark, sf)
    last = sites.groupBy("stmt_id").agg(F.max(F.struct("begin_line", "path")).alias("_s")).select("stmt_id", "_s.*")
    stmts = sites.select("stmt_id").distinct().withColumn("query_text", F.concat(F.lit("from "), F.col("stmt_id").cast("string")))
    plans = adapters.flat_plans(spark, sf)
    return scoring.query_scores(_scores(spark, sf), plans, stmts, last).select(
        "plan_id", "metric", "score", "stmt_id", "original_query", "explained_query", "path", "begin_line"
    )


def credit_predicates(spark, sf):
    _, credits, _ = _report(spark, sf)
    return credits.groupBy("stmt_id", "table_name", "expr", "metric").agg(F.count(F.lit(1)).alias("credits"))


def index_candidates(spark, sf):
    _, credits, stats = _report(spark, sf)
    return advisor.index_candidates(credits, stats).withColumn("multiplier", F.round("multiplier", 4))


def recommend(spark, sf):
    return _report(spark, sf)[0]


def recommend_from_documents(spark, sf):
    """The same advice from JSON plan documents: everything per plan is computed inside its row."""
    plans = read_pg_plans(adapters.pg_documents(spark, sf), "json").drop("json")
    return advisor.advise_documents(nodes.document_picks(plans), adapters.document_predicates(spark, sf), threshold=1_500_000)[0]


def affected(spark, sf):
    out, credits, _ = _report(spark, sf)
    return advisor.affected(out, credits, adapters.flat_call_sites(spark, sf))


def affected_queries(spark, sf):
    _, credits, stats = _report(spark, sf)
    best = advisor.recommend(advisor.index_candidates(credits, stats), 150_000)
    stmts = adapters.flat_call_sites(spark, sf).select("stmt_id").distinct()
    return advisor.affected_queries(stmts, credits, best)


def _file_report(spark, sf):
    sites = adapters.flat_call_sites(spark, sf)
    paths = sites.filter(F.col("path").isin("f1.java", "f2.java")).select("path").distinct()
    return advisor.file_report(_scores(spark, sf), _picks(spark, sf), adapters.flat_predicates(spark, sf), sites, paths, threshold=0)


def file_report(spark, sf):
    return _file_report(spark, sf)[0]


def file_report_locations(spark, sf):
    return _file_report(spark, sf)[1]


def _from_source(spark, sf):
    """From Java source to advice: (recommendations, credits, call sites).

    Calls are found in the files, their texts counted, parameters typed and bound; each call's
    plan is written as the database would for the bound text, and read back.
    """
    calls = written(extract.classify(extract.extract_calls(adapters.report_corpus(spark, sf))).select("path", "call_ord", "query_text", "is_dynamic", *extract.RANGE), "calls")
    stmts = statements.dedupe(calls).filter("not is_dynamic and kind <> 'failed'")
    found = params.find_parameters(stmts)
    marks = params.make_sentinels(found.withColumn("type_name", F.when(F.col("column_ref").endswith("day"), "Date").otherwise("String")))
    bound = written(params.bind(stmts, marks), "bound")
    preds = params.sentinel_predicates(predicates.extract_predicates(bound.drop("query_text"), "bound_text"), marks)
    sites = written(extract.locate(bound, calls), "sites")
    documents = adapters.report_documents(spark, sf, sites, bound)
    plans = read_pg_plans(documents, "json").drop("json")
    out, credits, _ = advisor.advise_documents(nodes.document_picks(plans), preds, threshold=200)
    return out, credits, sites


def source_to_recommendation(spark, sf):
    return _from_source(spark, sf)[0]


def source_to_places(spark, sf):
    return advisor.affected(*_from_source(spark, sf))


_F = "with " + sqlparts.FLAT
_C = "with " + sqlparts.credits()
_CHOSEN = "with chosen as (select distinct o_orderkey // 10 as stmt_id from orders where o_custkey % 50 in (1, 2)),\n" + sqlparts.credits("chosen")
_DDL = "'CREATE INDEX idx_' || expr || ' ON ' || table_name || ' (' || expr || ');'"


def _offenders(pct: int) -> str:
    return (
        _F
        + f""", ranked as (select *, dense_rank() over (partition by metric order by score desc) as rk from scores where metric <> 'startup_cost')
        select plan_id, metric, score from ranked join stats using (metric) where rk <= floor({pct} * distinct_scores / 100) + 1"""
    )


_DOCUMENT_ADVICE = (
    "with "
    + sqlparts.DOCUMENTS
    + """,
scores as (
  select rid, plan_id, 'total_cost' as metric, total_cost as score from nodes where depth = 0
  union all select rid, plan_id, 'execution_time', floor(l_extendedprice / 1000) from good
  union all select s.rid, s.plan_id, 'sequence_scan', s.actual_total_time from nodes s join nodes r on r.rid = s.rid and r.depth = 0 and r.actual_total_time is not null
    where s.depth <= 1 and s.node_type = 'Seq Scan' and s.actual_total_time is not null),
stats as (select metric, avg(score) as mean, coalesce(stddev_samp(score), 0) as sd from (select distinct metric, score from scores) group by metric),
both_picks as (select rid, stmt_id, 0 as pick_ord, relation_name as table_name, condition from costliest union all select rid, stmt_id, 1, relation_name, condition from slowest),
ordered as (
  select s.metric, s.score, b.*, row_number() over (partition by b.stmt_id order by case s.metric when 'execution_time' then 2 when 'total_cost' then 3 else 4 end, s.score desc, s.plan_id, b.pick_ord, s.score) as visit
  from scores s join both_picks b using (rid) where b.condition is not null and b.table_name is not null),
found as (select *, cast(regexp_extract(condition, 'tag-([0-9]+)', 1) as bigint) as tag from ordered where condition like '%tag-%'),
matched as (select *, tag % 10 as pred from found where tag // 10 = stmt_id and tag % 10 <> 3),
opening as (select stmt_id, min(visit) as first_visit from matched group by 1),
first_rows as (select m.stmt_id, m.table_name, m.pred, o.first_visit from matched m join opening o on o.stmt_id = m.stmt_id and o.first_visit = m.visit),
credits as (select o.metric, o.score, f.table_name, 'c' || f.pred as expr from ordered o join first_rows f on f.stmt_id = o.stmt_id and o.visit >= f.first_visit),
candidates as (
  select table_name, expr, cast(floor(count(*) * (1 + sum(case when sd > 0 and score > mean + sd then ((score - mean) / sd) * ((score - mean) / sd) else 0 end))) as bigint) as priority
  from credits join stats using (metric) group by table_name, expr)
select """
    + _DDL
    + " as ddl, priority, table_name, expr from candidates where priority >= 1500000"
)

# Every order's file has one call; its plan is one scan with the statement's two conditions.
_SOURCE_ADVICE = (
    """with calls as (
  select o_orderkey as k, 'rep/Rep' || o_orderkey || '.java' as path, 't' || (o_custkey % 8) as t, 'select o from t' || (o_custkey % 8) || ' o where o.c' || (o_custkey % 5) || ' = :a and o.day >= :b and o.k = ' || o_custkey as q,
    'c' || (o_custkey % 5) as e, o_totalprice as price, o_orderkey % 97 as time from orders),
scores as (
  select path, q, t, e, 'total_cost' as metric, floor(price / 100) as score from calls
  union all select path, q, t, e, 'execution_time', floor(price / 1000) from calls
  union all select path, q, t, e, 'sequence_scan', time from calls),
stats as (select metric, avg(score) as mean, coalesce(stddev_samp(score), 0) as sd from (select distinct metric, score from scores) group by metric),
ordered as (
  select s.*, row_number() over (partition by q order by case metric when 'execution_time' then 2 when 'total_cost' then 3 else 4 end, score desc, path, pick) as visit
  from scores s, (values (0), (1)) p(pick)),
credits as (select *, 'day' as expr from ordered union all select *, e from ordered where visit = 1),
candidates as (
  select t as table_name, expr, cast(floor(count(*) * (1 + sum(case when sd > 0 and score > mean + sd then ((score - mean) / sd) * ((score - mean) / sd) else 0 end))) as bigint) as priority
  from credits join stats using (metric) group by 1, 2),
best as (select """
    + _DDL
    + """ as ddl, priority, table_name, expr from candidates where priority >= 200)
"""
)

QUERIES = {
    "e2e_recommend": (source_to_recommendation, _SOURCE_ADVICE + "select * from best"),
    "e2e_affected": (
        source_to_places,
        _SOURCE_ADVICE
        + """select distinct b.ddl, a.path, 3 as begin_line, 12 as begin_col, 3 as end_line, (12 + 17 + length(a.q))::int as end_col
        from best b join (select distinct t, expr, q from credits) c on c.t = b.table_name and c.expr = b.expr join calls a on a.q = c.q""",
    ),
    "i1_score_table": (score_table, _F + "select metric, score, count(*) as plans from scores group by 1, 2"),
    "i2_score_stats": (score_stats, _F + "select metric, distinct_scores, round(mean, 4) as mean, round(sd, 4) as sd from stats"),
    "i3_top_offenders": (top_offenders, _offenders(10)),
    "i3_top_offenders_all": (top_offenders_all, _offenders(100)),
    "i4_query_scores": (
        query_scores,
        _F
        + """, sites as (select o_orderkey // 10 as stmt_id, max((o_orderkey // 10 % 90 + 1, 'f' || (o_custkey % 50) || '.java')) as s from orders group by 1)
        select plan_id, metric, score, stmt_id, 'from ' || stmt_id as original_query, 'select ' || stmt_id as explained_query, s[2] as path, s[1]::int as begin_line
        from scores join plan using (plan_id) join sites using (stmt_id) where metric <> 'startup_cost'""",
    ),
    "i5_credit_predicates": (credit_predicates, _C + "select stmt_id, table_name, expr, metric, count(*) as credits from credits group by 1, 2, 3, 4"),
    "i6_index_candidates": (index_candidates, _C + "select table_name, expr, hits, round(multiplier, 4) as multiplier, priority from ranked"),
    "i7_recommend": (recommend, _C + f"select {_DDL} as ddl, priority, table_name, expr from ranked"),
    "i7_recommend_from_documents": (recommend_from_documents, _DOCUMENT_ADVICE),
    "i8_affected_locations": (
        affected,
        _C + f"select distinct {_DDL} as ddl, path, begin_line, begin_col, end_line, end_col from (select distinct stmt_id, table_name, expr from credits) join sites using (stmt_id)",
    ),
    "i9_affected_queries": (
        affected_queries,
        _C + "select distinct stmt_id from credits join ranked using (table_name, expr) where priority >= 150000",
    ),
    "i10_file_report": (file_report, _CHOSEN + f"select {_DDL} as ddl, priority, table_name, expr from ranked"),
    "i10_file_report_locations": (
        file_report_locations,
        _CHOSEN
        + f"""select distinct {_DDL} as ddl, path, begin_line, begin_col, end_line, end_col from (select distinct stmt_id, table_name, expr from credits) join sites using (stmt_id)
        where path in ('f1.java', 'f2.java')""",
    ),
}
