"""Every registered query against its SQL on the smallest tables."""

import math

import pytest
from pyspark.sql import functions as F

from planledger import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    names = got.columns
    rows = [tuple(r) for r in got.collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert unwanted not in plan
    want = oracle.execute(catalog.oracles()[name])
    want_names = [d[0] for d in want.description]
    want_rows = want.fetchall()
    assert sorted(names) == sorted(want_names)
    assert _rows(names, rows) == _rows(want_names, want_rows)


def test_scans_read_only_what_is_used(spark):
    plan = catalog.queries()["f5_multi_hop"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(schemas) == 5
    assert any("struct<l_orderkey:bigint,l_extendedprice:double>" in s for s in schemas)
    assert any("struct<c_custkey:bigint,c_nationkey:int>" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    from planledger.operators.paths import path_join
    from planledger.catalog.paths import model

    rows = path_join(model(spark, SF), "order", "customer").filter(F.col("order__customer__c_mktsegment") == "BUILDING")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan


def test_document_picks_shuffle_nothing(spark):
    from planledger.plans import nodes
    from planledger.sources.plans import read_pg_plans

    docs = spark.createDataFrame([(1, "[]")], "plan_id int, json string")
    plan = nodes.document_picks(read_pg_plans(docs, "json"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
