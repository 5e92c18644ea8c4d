"""Structure of source text, and what stands behind the arguments of query calls."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planledger.functions import structure, text
from planledger.operators import extract, variables


def corpus(spark, *bodies):
    return spark.createDataFrame([(f"p{k}", b) for k, b in enumerate(bodies)], "path string, content string")


def plain_partners(source):
    """Partner of each bracket: the next one of its sort on its level, as opening brackets close."""
    found = [c for c in source if c in "(){}"]
    partner = [None] * len(found)
    for pair in ("()", "{}"):
        depth, last = 0, {}
        for k, c in enumerate(found):
            if c == pair[0]:
                depth += 1
                last[depth] = k
            elif c == pair[1]:
                if last.get(depth) is not None:
                    partner[k], partner[last[depth]] = last[depth], k
                last[depth] = None
                depth -= 1
    return partner


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("(){}a\n", max_size=60), min_size=1, max_size=6))
def test_brackets_against_a_plain_walk(spark, sources):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "k int, t string").select("k", structure.brackets(F.col("t")).alias("b"), structure.blocks(structure.brackets(F.col("t"))).alias("around")).collect()
    for r in rows:
        source, found = sources[r.k], r.b[:-1]
        places = [i + 1 for i, c in enumerate(source) if c in "(){}"]
        assert [x.at for x in found] == places
        assert [x.line for x in r.b] == [source[: p - 1].count("\n") for p in [*places, len(source) + 1]]
        assert [x.break_at for x in found] == [source.rfind("\n", 0, p - 1) + 1 for p in places]
        assert [x.partner for x in found] == plain_partners(source)


def test_blocks(spark):
    row = corpus(spark, "a{b{c}d{e}f(g)}h{").select(structure.blocks(structure.brackets(F.col("content"))).alias("x")).first()
    assert row.x == [0, 1, 0, 3, 0, 0, 0, -1, 8, 8]


def test_time_grows_with_the_text(spark):
    """Files with 4,000 strings take at most two and a half times as long as files with 2,000."""

    def seconds(strings):
        body = "class A {\n" + "".join(f'  String s{k} = "text ( {k}"; // note "\n' for k in range(strings)) + '  Object o = em.createQuery("x");\n}\n'
        files = corpus(spark, *[body] * 8).repartition(8).cache()
        files.count()
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert extract.extract_calls(files).count() == 8
            best.append(time.perf_counter() - start)
        files.unpersist()
        return min(best)

    seconds(500)
    assert seconds(4000) <= 2.5 * seconds(2000) + 0.2


def test_ranges_of_nested_and_chained_calls(spark):
    body = 'x = a.b(c).em.createQuery("q" + f(em.createNativeQuery("w", 1)), T.class)\n  .other(g.createQuery(\n"z"));'
    rows = extract.extract_calls(corpus(spark, body)).orderBy("call_ord").collect()
    assert [r.argument for r in rows] == ['"q" + f(em.createNativeQuery("w", 1))', '"w"', '"z"']
    assert [r.call_text for r in rows] == ['a.b(c).em.createQuery("q" + f(em.createNativeQuery("w", 1)), T.class)', 'em.createNativeQuery("w", 1)', 'g.createQuery(\n"z")']
    assert [(r.begin_line, r.begin_col, r.end_line, r.end_col) for r in rows] == [(1, 5, 1, 73), (1, 35, 1, 62), (2, 10, 3, 4)]
    for r in rows:
        lines = body.split("\n")
        if r.begin_line == r.end_line:
            assert lines[r.begin_line - 1][r.begin_col - 1 : r.end_col] == r.call_text


def resolved(spark, body):
    rows = extract.classify(variables.resolved_calls(corpus(spark, body))).orderBy("call_ord").collect()
    return [None if r.is_dynamic else r.query_text for r in rows]


def test_two_builders_of_one_name(spark):
    body = """class A {
      void one() { StringBuilder sb = new StringBuilder("a"); sb.append("b").append("c"); em.createQuery(sb.toString()); sb.append("late"); }
      void two() { StringBuffer sb = new StringBuffer(16); if (x) sb.append("d"); em.createQuery(sb.toString()); sb = new StringBuffer(); em.createQuery(sb.append("e").toString()); em.createQuery(sb.toString()); }
      void three(StringBuilder sb) { sb.append("f"); em.createQuery(sb.toString()); }
    }"""
    assert resolved(spark, body) == ["abc", "d", None, "e", None]


def test_constants_and_variables(spark):
    body = """class A {
      @Column(name = "N", table = "T") private static final String COLS = "a" + ", " + A.LAST;
      void one(String last) { em.createQuery("select " + COLS); em.createQuery(this.last + last); em.createQuery(this.last); }
      void two() { String q; if (x) q = "b"; else q = "c"; em.createQuery(q); { String r = "d"; em.createQuery(r); } em.createQuery(r); }
      void three() { for (int i = 0; i < 3; i++) { String q = "e"; q = q + "f"; q += "g"; em.createQuery(q); } }
      void four() { String u = v; String v = u; em.createQuery(u); em.createQuery(Other.COLS + COLS.trim()); }
      static final String LAST = "z"; String last = "y";
    }"""
    assert resolved(spark, body) == ["select a, z", None, "y", "bc", "d", None, "efg", None, None]


def test_text_that_is_no_code(spark):
    """Comments, strings and characters make no events; null and empty files none at all."""
    body = """class A { // String q = "no";
      /* q = "no"; */ char c = ';'; String q = "yes; q = no" /* + "not" */; void a() { em.createQuery(q); }
    }"""
    assert resolved(spark, body) == ["yes; q = no"]
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "}{)("), ("d", "createQuery(")], "path string, content string")
    assert variables.resolved_calls(rows).collect() == [] and variables.source_events(rows).collect() == []


def test_values_that_depend_on_themselves_end(spark):
    body = "class A { String a = b + \"x\"; String b = a + a; void f() { em.createQuery(a); } }"
    (row,) = extract.classify(variables.resolved_calls(corpus(spark, body))).collect()
    assert row.is_dynamic and len(row.argument) <= 4 * variables.MOST


def test_events_of_a_file(spark):
    body = 'class A { void f() { StringBuilder s = new StringBuilder("a").append(x); s.append("b"); em.createQuery(s.toString()); String t = "c"; } }'
    rows = variables.source_events(corpus(spark, body)).orderBy("at").collect()
    assert [(r.variable, r.kind, r.fragment) for r in rows] == [("s", "init", "a"), ("s", "append", None), ("s", "append", "b"), ("s", "use", None), ("t", "set", "c")]
    assert len({r.owner for r in rows if r.variable == "s"}) == 1


def test_masks_keep_the_places(spark):
    body = 'a("(", \')\'); // (\n/* "\n( */ b("\\"")'
    row = corpus(spark, body).select(text.mask_source(F.col("content")).alias("m")).first()
    assert row.m == 'a("_", \'_\');     \n    \n     b("__")'


def test_incremental_scan_moves_keys_only(spark):
    """Contents stay where they are read, but for files whose fingerprint is new."""
    from planledger.sources import corpus as src

    files = spark.createDataFrame([(f"f{k}", f"text {k % 70}", "C") for k in range(200)], "path string, content string, class_name string")
    keyed = src.with_fingerprint(files, "md5")
    done = keyed.filter("cast(substring(path, 2) as int) % 70 < 60").select("fingerprint")
    new, reused = src.incremental(keyed, done)
    assert {r.path for r in new.collect()} == {f"f{k}" for k in range(200) if k % 70 >= 60}
    assert {r.path for r in reused.collect()} == {f"f{k}" for k in range(200) if k % 70 < 60}
    assert "content" not in reused.columns and new.columns == ["fingerprint", *files.columns]
    everything, nothing = src.incremental(keyed, done.limit(0))
    assert everything.count() == 200 and nothing.count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reused._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not any("content" in line for line in plan.splitlines() if "Exchange" in line)
        assert {r.path for r in new.collect()} == {f"f{k}" for k in range(200) if k % 70 >= 60}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["(", ")", "{", "}", ",", ".", "\n", " ", "a", "é", "createQuery", "createQuery(", ".createQuery(", "x.b(", "f(a).b(c)", '"q, ("', "// )\n", "/* ( */", "\x16", "\n  .c"]), max_size=25).map("".join), min_size=1, max_size=20))
def test_calls_found_by_patterns_equal_those_of_the_structure(spark, bodies):
    files = corpus(spark, *bodies)
    walked = files.withColumn("_b", structure.brackets(text.mask_source(F.col("content")))).select("path", "content", F.posexplode_outer(extract.call_places(F.col("_b"), extract.QUERY_METHODS)).alias("call_ord", "_c")).filter("_c is not null")
    want = walked.selectExpr("path", "call_ord", "substring(content, _c.start, _c.end - _c.start + 1) call_text", *(f"_c.{n}" for n in (*extract.RANGE, "at")))
    got = extract.extract_calls(files).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_calls_need_no_structure_of_the_whole_text(spark):
    """Depths, lines and partners of all brackets, in interpreted steps, were most of the time."""
    plan = extract.extract_calls(corpus(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "sort_array" not in plan and "zip_with" not in plan
