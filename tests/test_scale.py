"""Helpers for crowded keys: same result as the plain form, and balanced work."""

import random

from pyspark.sql import functions as F

from planledger.functions.scale import hot_keys, join_hot, last_before, nth_largest
from planledger.operators import extract


def hot_rows(spark, n=6000):
    rng = random.Random(1)
    return spark.createDataFrame([(0 if i % 3 else rng.randrange(50), i) for i in range(n)], "k int, i int")


def test_join_hot_is_the_join(spark):
    big = hot_rows(spark)
    small = spark.createDataFrame([(k, k * 10) for k in range(40)], "k int, v int")
    plain = sorted(map(tuple, big.join(small, "k").select("k", "i", "v").collect()))
    assert sorted(map(tuple, join_hot(big, small, ["k"], ["i"]).select("k", "i", "v").collect())) == plain
    left = join_hot(big, small, ["k"], ["i"], how="left")
    assert left.count() == 6000


def test_hot_key_is_spread(spark):
    slots = hot_rows(spark).filter("k = 0").select(F.pmod(F.xxhash64("i"), F.lit(8)).alias("s")).groupBy("s").count().collect()
    assert len(slots) == 8
    assert max(r["count"] for r in slots) < 2 * min(r["count"] for r in slots)


def test_salts_follow_the_measured_share(spark):
    """Two thirds of the rows on one key: it alone is salted, by its share; its rows spread evenly."""
    big = hot_rows(spark)
    ((key, salts),) = [tuple(r) for r in hot_keys(big, ["k"], parts=10, tasks=60).collect()]
    assert key == 0 and 38 <= salts <= 42
    assert hot_keys(big.filter("k <> 0"), ["k"], parts=10).count() == 0 and hot_keys(big.limit(0), ["k"]).count() == 0
    nulls = spark.createDataFrame([(None, 1)] * 50 + [(1, 2)] * 50, "k int, i int")
    small = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    assert join_hot(nulls, small, ["k"], ["i"]).count() == 100 and join_hot(nulls, small, ["k"], ["i"], how="left").count() == 150
    assert sum(r.n for r in hot_keys(big, ["k"], parts=64, tasks=64).agg(F.sum("_salts").alias("n")).collect()) <= 2 * 64


def test_last_before_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i if rng.random() < 0.01 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    got = {(r.k, r.pos): r.x for r in last_before(df, ["k"], "pos", F.col("v"), "x", block=64).collect()}
    want, seen = {}, {}
    for k, pos, v in rows:
        seen[k] = v if v is not None else seen.get(k)
        want[(k, pos)] = seen[k]
    assert got == want


def test_nth_largest_equals_sort(spark):
    rng = random.Random(3)
    a = rng.sample(range(10**6), 3000)
    b = [x / 7 for x in rng.sample(range(10**6), 10)]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", x) for x in b], "g string, v double")
    for n in (1, 2, 299, 3000):
        ranks = spark.createDataFrame([("a", n), ("b", min(n, 10))], "g string, rank long")
        got = {r.g: r.v for r in nth_largest(df, "g", "v", ranks).collect()}
        assert got == {"a": float(sorted(a, reverse=True)[n - 1]), "b": sorted(b, reverse=True)[min(n, 10) - 1]}


def test_nth_largest_of_close_and_negative_values(spark):
    rng = random.Random(4)
    values = sorted({1e6 + rng.random() for _ in range(2000)} | {-rng.random() * 1e3 for _ in range(500)} | {0.0}, reverse=True)
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    for n in (1, 1999, 2001, 2100, len(values)):
        ranks = spark.createDataFrame([("g", n)], "g string, rank long")
        assert nth_largest(df, "g", "v", ranks).first().v == values[n - 1]


def test_crowded_builder_is_gathered_by_blocks(spark):
    """A third of all events belong to one builder: no row but the results holds them all."""
    kinds = ["append", "append", "use", "append"]
    rows = [("hot", k, "init" if k in (0, 700) else kinds[k % 4], f"<{k}>") for k in range(0, 1500, 1)]
    rows += [(f"cold{k % 100}", k, "init" if k < 100 else kinds[k // 100 % 4], f"<{k}>") for k in range(3000)]
    events = spark.createDataFrame(rows, "v string, pos bigint, kind string, fragment string")
    want, last = {}, {}
    for v, pos, kind, fragment in rows:
        if kind == "init":
            last[v] = []
        if kind == "use":
            want[v, pos] = (len(last[v]), "".join(last[v]))
        else:
            last[v].append(fragment)
    got = extract.assemble(events, "v", "pos", block=64)
    assert {(r.v, r.use_at): (r.fragments, r.query_text) for r in got.collect()} == want
    folded = extract.fold_assignments(events, "v", "pos", "fragment", block=64)
    texts = {r.v: (r.assignments, r.query_text) for r in folded.collect()}
    assert texts["hot"] == (1500, "".join(f"<{k}>" for k in range(1500))) and len(texts) == 101
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [v" in plan and "_block" in plan


def test_a_filter_on_the_kind_cleans_a_text_once(spark):
    from planledger.operators import statements

    calls = spark.createDataFrame([("p", 1, "select a from b", False)], "path string, call_ord int, query_text string, is_dynamic boolean")
    plan = statements.dedupe(calls).filter("kind <> 'failed'").drop("kind")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{4,}+") == 1


def test_a_filter_on_predicates_matches_no_pattern_again(spark):
    from planledger.operators import predicates

    stmts = spark.createDataFrame([("s", "select a from b where c = 1")], "stmt_id string, query_text string")
    plan = predicates.extract_predicates(stmts).filter("eligible_rank")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("RLIKE" in line or "regexp" in line for line in filters)


def test_comparisons_hold_cut_characters_and_line_ends(spark):
    from planledger.operators import predicates

    rows = [("s", "select a from b where c\u001f = 1 and d = 2"), ("t", "select a from b where c = 1 and d  >= 'x''y' and (e) \t in (1, 2)\n or not f  not like 'g'")]
    stmts = spark.createDataFrame(rows, "stmt_id string, query_text string")
    got = predicates.extract_predicates(stmts).orderBy("stmt_id", "pred_ord").select("op", "left_side", "right_side").collect()
    assert [tuple(r) for r in got[:2]] == [("=", "c\u001f", "1"), ("=", "d", "2")]
    assert [tuple(r) for r in got[2:]] == [("=", "c", "1"), (">=", "d", "'x''y'"), ("in", "(e)", None), ("not like", "f", "'g'")]


def test_typed_walk_equals_the_walk_over_variants(spark):
    """Deeper than one conversion reads, and with nodes that are no objects; the query hands out no subtree."""
    import json

    from planledger import catalog
    from planledger.plans import nodes
    from planledger.sources.plans import read_pg_plans

    deep = {"Node Type": "Seq Scan", "Total Cost": 1, "Relation Name": "low", "Filter": "f"}
    for k in range(15):
        deep = {"Node Type": f"n{k}", "Total Cost": k % 4 / 4, "Plans": [{"Node Type": "Leaf", "Total Cost": "0.5"}, deep, {"Plans": 3}]}
    plans = [deep, {"Plans": [5, None, {"Plans": []}, {"Plans": {"a": 1}}]}, 7, None, {"Total Cost": [1], "Plans": [{}] * 12}]
    docs = spark.createDataFrame([(i, json.dumps([{"Plan": p}])) for i, p in enumerate(plans)] + [(9, "{bad"), (10, None), (11, "[]")], "plan_id int, json string")
    read = read_pg_plans(docs, "json").drop("json")
    cols = ["plan_id", "path", "parent_path", "depth", "node_ord"]
    want = [tuple(r) for r in nodes.flatten_plan(read).select(*cols).orderBy("plan_id", "node_ord").collect()]
    assert [tuple(r) for r in nodes.plan_nodes(read, ()).select(*cols).orderBy("plan_id", "node_ord").collect()] == want
    assert max(r[3] for r in want) == 15 and {r[0] for r in want} == {0, 1, 2, 3, 4}
    picked = {r.plan_id: r for r in nodes.document_picks(read).collect()}
    assert set(picked) == {0, 1, 2, 3, 4} and picked[0].costliest == ("low", "f")
    plan = catalog.queries()["h2_flatten_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "$.Plans" not in plan
