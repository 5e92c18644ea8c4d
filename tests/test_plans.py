"""Plans, scores and advice: hand-worked cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from planledger.plans import advisor, nodes, scoring
from planledger.sources.plans import bad_plans, read_mysql_plans, read_pg_plans

PG = json.dumps(
    [{"Plan": {"Node Type": "Nested Loop", "Total Cost": 9.5, "Actual Total Time": 2.0, "Plans": [
        {"Node Type": "Seq Scan", "Relation Name": "t1", "Total Cost": 3.0, "Actual Total Time": 1.5, "Filter": "(c = 'tag-12')",
         "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t3", "Total Cost": 1.0, "Actual Total Time": 0.1}]},
        {"Node Type": "Index Scan", "Relation Name": "t2", "Total Cost": 5.0, "Actual Total Time": 0.4, "Index Cond": "(d = 1)"}]},
      "Planning Time": 0.2, "Execution Time": 1.25}]
)
MY = json.dumps(
    {"query_block": {"select_id": 1, "r_loops": 1, "r_total_time_ms": 0.5,
                     "table": {"table_name": "table_b", "access_type": "ALL", "rows": 10, "filtered": 100,
                               "attached_condition": "(table_b.column_c = 'tag-7')"}}}
)


@pytest.fixture(scope="module")
def docs(spark):
    return read_pg_plans(spark.createDataFrame([(1, PG), (2, "{bad"), (3, None)], "plan_id int, json string"), "json")


@pytest.fixture(scope="module")
def flat(docs):
    return nodes.plan_nodes(docs)


def test_flatten(flat):
    rows = flat.orderBy("node_ord").collect()
    assert [(r.node_type, r.relation_name, r.depth) for r in rows] == [
        ("Nested Loop", None, 0), ("Seq Scan", "t1", 1), ("Seq Scan", "t3", 2), ("Index Scan", "t2", 1),
    ]
    assert [r.parent_path for r in rows] == [None, "000000", "000000.000000", "000000"]
    assert len(nodes.NODE_FIELDS) == 42


def test_picks(flat, docs):
    costly, slow = nodes.costliest_node(flat).first(), nodes.slowest_node(flat).first()
    assert (costly.relation_name, costly.value) == ("t2", 5.0)
    assert (slow.relation_name, slow.value) == ("t1", 1.5)
    both, inside = nodes.node_picks(flat).first(), nodes.document_picks(docs).first()
    assert both.costliest == inside.costliest and both.slowest == inside.slowest
    assert (inside.slowest.table_name, inside.slowest.condition) == ("t1", "(c = 'tag-12')")
    assert (inside.costliest.table_name, inside.costliest.condition) == ("t2", None)
    assert inside.seq_scan_times == [1.5]


def test_root_metrics_and_scans(flat, docs):
    measures = nodes.root_metrics(nodes.document_picks(docs))
    assert {(r.metric, r.score) for r in measures.collect()} == {("total_cost", 9.5), ("execution_time", 1.25)}
    assert [(r.plan_id, r.score) for r in nodes.seq_scans(flat).collect()] == [(1, 1.5)]


def test_bad_documents(docs):
    assert sorted(r.plan_id for r in bad_plans(docs).collect()) == [2, 3]


def test_deep_and_wide_plans_are_whole(spark):
    deep = {"Node Type": "Sort", "Total Cost": 1.0}
    for i in range(150):
        deep = {"Node Type": f"N{i}", "Total Cost": 1.0, "Plans": [deep]}
    wide = {"Node Type": "Append", "Plans": [{"Node Type": "Seq Scan", "Total Cost": float(i)} for i in range(2000)]}
    df = spark.createDataFrame([(1, json.dumps([{"Plan": deep}])), (2, json.dumps([{"Plan": wide}]))], "plan_id int, json string")
    rows = nodes.plan_nodes(read_pg_plans(df, "json"), ["node_type", "total_cost"])
    got = {r.plan_id: (r.n, r.d) for r in rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).collect()}
    assert got == {1: (151, 150), 2: (2001, 1)}


def test_ties_go_to_the_first_and_none_is_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, "Sort", "a", 5.0, 1.0), (1, 1, "Sort", "b", 5.0, 1.0), (2, 0, "Aggregate", "c", 9.0, 9.0), (3, 0, "Sort", "d", None, 4.0)],
        "plan_id int, node_ord int, node_type string, relation_name string, total_cost double, actual_total_time double",
    )
    got = {r.plan_id: (r.value, r.relation_name) for r in nodes.costliest_node(df).collect()}
    assert got == {1: (5.0, "a"), 2: (0.0, None), 3: (0.0, None)}
    got = {r.plan_id: (r.value, r.relation_name) for r in nodes.slowest_node(df).collect()}
    assert got == {1: (1.0, "a"), 2: (0.0, None), 3: (0.0, None)}


def test_mysql(spark):
    plans = read_mysql_plans(spark.createDataFrame([(1, MY), (2, "nope")], "plan_id int, json string"), "json")
    picked = nodes.mysql_picks(plans.drop("json"))
    r = picked.first()
    assert r.costliest == r.slowest
    assert (r.slowest.table_name, r.slowest.condition, r.execution_time) == ("table_b", "(table_b.column_c = 'tag-7')", 0.5)
    assert [(m.metric, m.score) for m in nodes.root_metrics(picked).collect()] == [("execution_time", 0.5)]
    assert [b.plan_id for b in bad_plans(plans).collect()] == [2]


def scores(spark, values, metric="total_cost"):
    return spark.createDataFrame([(i, metric, float(v)) for i, v in enumerate(values)], "plan_id int, metric string, score double")


@pytest.mark.parametrize(
    "values, mean, sd", [([*range(1, 10), 100], 14.5, 30.1524), ([10, 10, 100], 55, 63.6396), ([7, 7], 7, 0.0)]
)
def test_stats(spark, values, mean, sd):
    r = scoring.score_stats(scores(spark, values)).first()
    assert (r.mean, round(r.sd, 4)) == (mean, sd)


def test_offenders(spark):
    s = scores(spark, [*range(1, 10), 100, 9])
    assert sorted(r.score for r in scoring.top_offenders(s, 10).collect()) == [9.0, 9.0, 100.0]
    assert scoring.top_offenders(s, 100).count() == 11
    many = scores(spark, [i * i % 7919 for i in range(6000)])
    distinct = sorted({i * i % 7919 for i in range(6000)}, reverse=True)
    limit = distinct[math.floor(len(distinct) * 0.13)]
    assert min(r.score for r in scoring.top_offenders(many, 13).collect()) == limit


PREDS = "stmt_id int, pred_ord int, expr string, sentinel string, eligible_index boolean"


def test_credit_order(spark):
    preds = spark.createDataFrame([(1, 0, "a", "tag-1", True), (1, 1, "b", "tag-2", True), (1, 2, "n", "tag-3", False)], PREDS)
    conditions = ["a = 'tag-3'", "a = 'tag-1' AND b = 'tag-2'", "a = 'tag-1'", None]
    plan_picks = spark.createDataFrame(
        [(i, 1, ("t", c), (None, None)) for i, c in enumerate(conditions)],
        "plan_id int, stmt_id int, costliest struct<table_name string, condition string>, slowest struct<table_name string, condition string>",
    )
    s = scores(spark, [40, 30, 20, 10])
    credits = advisor.credit(advisor.picks(s, advisor.match_picks(plan_picks, preds)))
    got = {r.expr: r["count"] for r in credits.groupBy("expr").count().collect()}
    assert got == {"a": 1, "b": 2}


def test_equal_visits_credit_once_and_null_sentinels_are_left_out(spark):
    """Two scans of one plan with the same time: all predicates at the first visit, the last one after."""
    preds = spark.createDataFrame([(1, 0, "a", "tag-1", True), (1, 1, "b", "tag-2", True), (1, 2, "c", None, True)], PREDS)
    plan_picks = spark.createDataFrame(
        [(0, 1, ("t", "a = 'tag-1' AND b = 'tag-2'"), (None, None))],
        "plan_id int, stmt_id int, costliest struct<table_name string, condition string>, slowest struct<table_name string, condition string>",
    )
    s = spark.createDataFrame([(0, "sequence_scan", 5.0), (0, "sequence_scan", 5.0)], "plan_id int, metric string, score double")
    credits = advisor.credit(advisor.picks(s, advisor.match_picks(plan_picks, preds)))
    assert {r.expr: r["count"] for r in credits.groupBy("expr").count().collect()} == {"a": 1, "b": 2}


def test_paths_of_very_many_children_stay_in_order(spark):
    numbers = [0, 9, 10, 999_999, 1_000_000, 1_234_567, 9_999_999, 10_000_000, 2_000_000_000]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select(nodes._numbered(F.lit("000000"), F.col("n")).alias("path"))
    paths = [r.path for r in df.collect()]
    assert paths == sorted(paths) and len(set(paths)) == len(paths)


def test_candidate_arithmetic(spark):
    s = scores(spark, [*range(1, 10), 100])
    credits = spark.createDataFrame(
        [(1, 9, "total_cost", 100.0, "costliest", "t", "c"), (1, 9, "total_cost", 100.0, "slowest", "t", "c")],
        "stmt_id int, plan_id int, metric string, score double, pick_kind string, table_name string, expr string",
    )
    r = advisor.index_candidates(credits, scoring.score_stats(s)).first()
    assert (r.hits, round(r.multiplier, 4), r.priority) == (2, 17.0812, 34)


def test_recommendation_text_and_threshold(spark):
    c = spark.createDataFrame([("table_b", "column_c", 1, 1.0, 60), ("t", "lower(c)", 1, 1.0, 50), ("t", "d", 1, 1.0, 49)], "table_name string, expr string, hits long, multiplier double, priority long")
    assert [r.ddl for r in advisor.recommend(c).collect()] == [
        "CREATE INDEX idx_column_c ON table_b (column_c);", "CREATE INDEX idx_lower_c ON t (lower(c));",
    ]


def test_sample_end_to_end(spark):
    """Source file and plan of the sample query lead to its index, with the place of the call."""
    from test_text import LEDGER

    from planledger.operators import extract, params, predicates, statements

    corpus = spark.createDataFrame([("Accounts.java", LEDGER)], "path string, content string")
    calls = extract.classify(extract.extract_calls(corpus))
    stmts = statements.dedupe(calls)
    found = params.make_sentinels(params.find_parameters(stmts).withColumn("type_name", F.lit("String")))
    bound = params.bind(stmts, found)
    mark = found.first().sentinel
    assert bound.first().bound_text == f"select balance from account where owner = '{mark}'"
    preds = params.sentinel_predicates(predicates.extract_predicates(bound.drop("query_text"), "bound_text"), found)
    plan = json.dumps({"query_block": {"r_total_time_ms": 0.5, "table": {"table_name": "account", "attached_condition": f"(account.owner = '{mark}')"}}})
    stmt_id = stmts.first().stmt_id
    plans = read_mysql_plans(spark.createDataFrame([(1, stmt_id, plan)], "plan_id int, stmt_id string, json string"), "json").drop("json")
    picked = nodes.mysql_picks(plans)
    out, credits, _ = advisor.advise(scoring.score_rows(nodes.root_metrics(picked), scores(spark, []).filter("false")), picked, preds, threshold=0)
    r = out.first()
    assert (r.ddl, r.priority) == ("CREATE INDEX idx_owner ON account (owner);", 2)
    sites = extract.locate(stmts, calls)
    spot = advisor.affected(out, credits, sites).first()
    assert (spot.path, spot.begin_line, spot.begin_col, spot.end_line, spot.end_col) == ("Accounts.java", 6, 40, 6, 103)
