"""Statement text: cleaning, predicates, ranking, parameters."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planledger.functions import text
from planledger.operators import extract, params, predicates, statements


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("FROM Order o", "select * from order o"),
        ("select o from Orders o join fetch o.lines", "select o from orders o join o.lines"),
        ("select a.b.c.d.e from x", 'select "a.b.c.d.e" from x'),
        ("select a.b.c.d from x", "select a.b.c.d from x"),
        ("select t from T t where t.tags[3] = 1", "select t from t t where array_item_t.tags_3 = 1"),
        ("select t from T t where t.tags[ 3 ] = 1", "select t from t t where array_item_t.tags_3 = 1"),
        ('select "A" from t where b = \\\'x\\\'', "select a from t where b = 'x'"),
    ],
)
def test_clean(spark, given_text, expected):
    assert one(spark, given_text, text.clean_query) == expected


def test_arrays_round_trip(spark):
    cleaned = one(spark, "select t from T t where t.tags[3] = 1 and x[12] = 2", text.clean_query)
    assert one(spark, cleaned, text.restore_arrays) == "select t from t t where t.tags[3] = 1 and x[12] = 2"


def test_arrays_without_blanks(spark):
    cleaned = one(spark, "select t from T t where t.tags[1]=t.tags[2] and f(a[ 3 ])<b_4[5]", text.clean_query)
    assert cleaned == "select t from t t where array_item_t.tags_1=array_item_t.tags_2 and f(array_item_a_3)<array_item_b_4_5"
    assert one(spark, cleaned, text.restore_arrays) == "select t from t t where t.tags[1]=t.tags[2] and f(a[3])<b_4[5]"


@pytest.mark.parametrize(
    "query, fits",
    [("select from where", False), ("select * from t where ((a = 1", False), ("select * from t where", False), ("select a from t where b = 'x", False), ("select a, from t", False),
     ("select a from t where b = '(' and c in (1)", True), ("update t set a = 1", True), ("select a from b.group_x where a = 1 order by c", True), ("delete t where a = 1", True),
     ("select m.from, m.to from Mail m where m.set = 1 and m.by", True), ("select a from t order by", False), ("select a, m.from from group.x m", True)],
)
def test_readable(spark, query, fits):
    assert one(spark, query, text.readable) is fits


@pytest.mark.parametrize(
    "query, kind",
    [("insert into t values (1)", "failed"), ("SELECT 1", "select"), (" update t set a = 1", "update"), ("delete from t", "delete"), ("", "failed"), ("with x as (select 1 from a) select * from x", "select"), ("from t", "select"), ("(select 1) union (select 2)", "select")],
)
def test_kind(spark, query, kind):
    assert one(spark, query, text.statement_kind) == kind


@pytest.mark.parametrize(
    "query, name",
    [
        ("select * from public.Orders o", "orders"),
        ("select (select 1 from inner_t) from a, b", "inner_t"),
        ("update Stock s set x = 1", "stock"),
        ("delete from log where a = 'from b'", "log"),
        ("delete log where a = 1", "log"),
        ("select 'from x' as y from z", "z"),
        ("select 1", None),
    ],
)
def test_first_table(spark, query, name):
    assert one(spark, query, text.first_table) == name


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab '=(),x1", max_size=12), min_size=1, max_size=12))
def test_masks_come_off(spark, parts):
    df = spark.createDataFrame([(p,) for p in parts], "t string")
    rows = df.select("t", text.unmask(text.mask_literals(F.col("t")), text.string_literals(F.col("t"))).alias("x")).collect()
    assert all(r.t == r.x for r in rows)


def preds(spark, query, occurrences=1):
    df = spark.createDataFrame([("s", query, occurrences, "t")], "stmt_id string, query_text string, occurrences long, table_name string")
    return predicates.extract_predicates(df)


MIXED = "select * from t where a = 1 and (b = 2 or c = 3) and d between 1 and 2 and e like 'x' and f in (1) and g > 4"


def test_mixed_predicates(spark):
    rows = preds(spark, MIXED).orderBy("pred_ord").collect()
    assert [r.left_column for r in rows if r.eligible_rank] == ["a", "g"]
    assert [r.expr for r in rows if r.eligible_index] == ["a", "b", "c", "e", "g"]
    assert [r.op for r in rows] == ["=", "=", "=", "between", "like", "in", ">"]


def test_hits_count_occurrences(spark):
    names = spark.createDataFrame([("t", "g", "g_col")], "table_name string, field string, column_name string")
    hits = predicates.column_hits(preds(spark, MIXED, 3), names)
    assert {(r.column_name, r.hits) for r in hits.collect()} == {("a", 3), ("g_col", 3)}


def test_functions_and_column_pairs(spark):
    rows = preds(spark, "select * from t where lower(a) = 'x' and b = c").orderBy("pred_ord").collect()
    assert [(r.left_column, r.right_column) for r in rows] == [(None, None), ("b", "c")]
    assert [r.expr for r in rows if r.eligible_index] == ["lower(a)"]


@pytest.mark.parametrize(
    "query, ranked, indexed",
    [
        ("select * from t x where x.a = :p", ["a"], ["a"]),
        ("select * from t where :p = a", ["a"], ["a"]),
        ("select * from t where not a = ? order by b", ["a"], ["a"]),
        ("select * from t where cast(a as int) = 1", ["a"], ["cast(a as int)"]),
        ("select * from t where a = 1 union select * from u where b = 2", ["a", "b"], []),
        ("select * from t where a = (select max(b) from u where c = 1) and d = 1", ["a", "d"], ["d"]),
        ("select * from t where exists (select 1 from u where c = 1) and d = 1", ["d"], ["d"]),
        ("select * from t where a is null or b is not null", [], []),
        ("select * from t where ((a = 1 and (b = 2)) or (c = 3 and (d = 4 or e = 5)))", [], ["a", "b", "c", "d", "e"]),
        ("select * from t where (a + b) * 2 = 7", [], ["(a + b) * 2"]),
        ("select * from t where f(a, g(b, 'x(')) >= 1", [], ["f(a, g(b, 'x('))"]),
        ("update t set z = 1 where a <> 'and b = 2'", ["a"], ["a"]),
        ("delete from t where a <= 1 and b not like 'q'", ["a"], ["a", "b"]),
        ("select * from t where case when a = 1 then 2 else 3 end = 4 and b = 1", ["b"], ["b"]),
        ("select * from t", [], []),
        ("with x as (select 1 from a where z = 1) select *\n from x\n where b = 1\n limit 5", ["b"], ["b"]),
        ("select * from t where a not in ('x', 'y') and b != 1 group by c having d = 1", ["b"], ["b"]),
    ],
)
def test_coverage(spark, query, ranked, indexed):
    rows = preds(spark, query).orderBy("branch", "pred_ord").collect()
    assert [c for r in rows for c in (r.left_column, r.right_column) if c] == ranked
    assert [r.expr for r in rows if r.eligible_index] == indexed


def test_any_depth_of_brackets(spark):
    deep = "select * from t where " + "(" * 40 + "a = 1" + ")" * 40 + " and b = 2"
    rows = preds(spark, deep).orderBy("pred_ord").collect()
    assert [(r.expr, r.eligible_rank) for r in rows] == [("a", False), ("b", True)]


def test_unpaired_statements_are_listed(spark):
    df = spark.createDataFrame([("d", "select * from t where ((a = 1)"), ("s", MIXED)], "stmt_id string, query_text string")
    assert [r.stmt_id for r in predicates.unpaired_statements(df).collect()] == ["d"]


def test_aliases(spark):
    q = "select * from Orders o, Lines as l join Parts p on p.id = l.part where o.x = 1 order by o.y"
    df = spark.createDataFrame([("s", q), ("u", "update t set a = 1 where b = 2")], "stmt_id string, query_text string")
    got = {(r.alias, r.table_name) for r in predicates.statement_aliases(df).collect()}
    assert got == {("o", "orders"), ("l", "lines"), ("p", "parts")}


def test_column_refs(spark):
    q = "select o.customer.name, count(x) as n, 'o.y' from Orders o, Lines as l join Parts p on p.id = l.part where o.a = :b and upper(c) in (?, 'd') group by o.g order by h desc"
    df = spark.createDataFrame([("s", q), ("u", "update t set a = 1 where b = c"), ("d", "delete from t where a = 1")], "stmt_id string, query_text string")
    rows = predicates.column_refs(df).orderBy("stmt_id", "ref_ord").collect()
    got = [(r.stmt_id, r.qualifier, r.name, r.entity, ".".join(r.path)) for r in rows]
    assert got == [
        ("d", None, "a", "t", "a"),
        ("s", "o.customer", "name", "orders", "customer.name"), ("s", None, "x", "orders", "x"), ("s", "p", "id", "parts", "id"), ("s", "l", "part", "lines", "part"),
        ("s", "o", "a", "orders", "a"), ("s", None, "c", "orders", "c"), ("s", "o", "g", "orders", "g"), ("s", None, "h", "orders", "h"),
        ("u", None, "a", "t", "a"), ("u", None, "b", "t", "b"), ("u", None, "c", "t", "c"),
    ]


def refs(spark, query):
    rows = predicates.column_refs(spark.createDataFrame([("s", query)], "stmt_id string, query_text string")).orderBy("ref_ord").collect()
    return [(r.qualifier, r.name, r.entity, ".".join(r.path)) for r in rows]


def test_alias_scopes(spark):
    """One alias for two tables, in an outer and an inner query, and what HAVING and paths name."""
    query = (
        "select o.a from Orders o where o.b in (select o.c from Lines o where o.d = (select max(o.e) from Parts p where p.f = o.g)) and o.h = 1 "
        "group by o.i having sum(o.j) > 2 and o.k in (select x.l from Extra x) order by o.m limit 3"
    )
    assert refs(spark, query) == [
        ("o", "a", "orders", "a"), ("o", "b", "orders", "b"), ("o", "c", "lines", "c"), ("o", "d", "lines", "d"), ("o", "e", "lines", "e"), ("p", "f", "parts", "f"),
        ("o", "g", "lines", "g"), ("o", "h", "orders", "h"), ("o", "i", "orders", "i"), ("x", "l", "extra", "l"), ("o", "m", "orders", "m"),
    ]


def test_joined_paths_and_branches(spark):
    query = "select b.size, l.w from E e join fetch e.box b left join b.lid as l where l.x.y = e.z union select e.u from F e where v = 1"
    assert refs(spark, query) == [
        ("b", "size", "e", "box.size"), ("l", "w", "e", "box.lid.w"), ("l.x", "y", "e", "box.lid.x.y"), ("e", "z", "e", "z"), ("e", "u", "f", "u"), (None, "v", "f", "v"),
    ]


def test_scopes_of_aliases(spark):
    df = spark.createDataFrame([("s", "select 1 from A a where exists (select 1 from B a, C c where a.x = c.y)")], "stmt_id string, query_text string")
    rows = {(r.alias, r.entity): (r.first_token, r.last_token) for r in predicates.alias_scopes(df).collect()}
    assert set(rows) == {("a", "a"), ("a", "b"), ("c", "c")} and rows["a", "b"] == rows["c", "c"] and rows["a", "a"][0] == 0 < rows["a", "b"][0]


def test_columns_in(spark):
    rows = predicates.columns_in(preds(spark, "select * from t where a = 1 and b > 2 and c <> 3 and d < e"))
    assert {r.column_name for r in rows.collect()} == {"a", "c", "d", "e"}


def test_dedupe_and_summary(spark):
    calls = spark.createDataFrame(
        [("f1", 1, "Select A from t", False), ("f2", 2, "select a from t", False), ("f1", 3, "insert into t values (1)", False), ("f1", 4, "x + y", True)],
        "path string, call_ord int, query_text string, is_dynamic boolean",
    )
    stmts = statements.dedupe(calls)
    got = {(r.query_text, r.occurrences, r.owner_path, r.kind) for r in stmts.filter("not is_dynamic").collect()}
    assert got == {("select a from t", 2, "f2", "select"), ("insert into t values (1)", 1, "f1", "failed")}
    s = statements.parse_summary(stmts).first()
    assert (s.total_static, s.total_dynamic, s.unique_static, s.unique_dynamic, s.parsed, s.failed) == (3, 1, 2, 1, 1, 1)
    assert s.parsed + s.failed == s.unique_static


def test_static_and_dynamic_statements_of_one_text(spark):
    calls = spark.createDataFrame(
        [("f1", 9, "select a from t", False), ("f2", 1, "select a from t", True), ("f3", 0, "select a from t", False), ("f1", 1, "select from where", False)],
        "path string, call_ord int, query_text string, is_dynamic boolean",
    )
    stmts = statements.dedupe(calls)
    assert stmts.select("stmt_id").distinct().count() == 3
    assert extract.locate(stmts, calls).count() == 4
    assert stmts.filter("occurrences = 2").first().owner_path == "f3"
    assert [r.query_text for r in statements.failed(stmts).collect()] == ["select from where"]


def test_fold_and_classify(spark):
    calls = spark.createDataFrame(
        [('"select a " + "from t " + "where x = 1"',), ('"select " + col',), ('("a" +\n "b")',), ("query",)], "argument string"
    )
    rows = extract.classify(calls).collect()
    assert [(r.is_dynamic, r.query_text) for r in rows] == [
        (False, "select a from t where x = 1"), (True, '"select " + col'), (False, "ab"), (True, "query"),
    ]


LEDGER = (
    "package ledger;\n"
    "// em.createQuery(\"select old\")\n"
    "class Accounts {\n"
    "  char quote = '\"', close = ')';\n"
    "  String log = \"em.createQuery(\\\"select logged\\\")\"; /* em.createQuery(\"gone\") */\n"
    "  List open(EntityManager em) { return em.createQuery(\"select balance from account where owner = :who\").list(); }\n"
    "}\n"
)


def test_call_position(spark):
    """Line 6 begins with two blanks and 37 characters up to the call, which is 64 characters long."""
    corpus = spark.createDataFrame([("Accounts.java", LEDGER)], "path string, content string")
    rows = extract.classify(extract.extract_calls(corpus)).collect()
    assert [(r.begin_line, r.begin_col, r.end_line, r.end_col) for r in rows] == [(6, 40, 6, 103)]
    assert (rows[0].query_text, rows[0].is_dynamic, rows[0].call_ord) == ("select balance from account where owner = :who", False, 0)
    assert rows[0].call_text == 'em.createQuery("select balance from account where owner = :who")'


def test_brackets_of_any_depth(spark):
    deep = "f(" * 300 + "1" + ")" * 300
    bodies = [f'em.createQuery("q" + {deep}, X.class)', 'em.createQuery("select a = " + (((x))))', '(em.createQuery(("a" + ("b" + ("c"))), y))', 'em.createQuery("q"']
    corpus = spark.createDataFrame(list(enumerate(bodies)), "path int, content string")
    got = {r.path: (r.argument, r.is_dynamic, r.query_text) for r in extract.classify(extract.extract_calls(corpus)).collect()}
    assert got == {
        0: (f'"q" + {deep}', True, f'"q" + {deep}'),
        1: ('"select a = " + (((x)))', True, '"select a = " + (((x)))'),
        2: ('("a" + ("b" + ("c")))', False, "abc"),
    }


def test_comments_inside_an_argument(spark):
    corpus = spark.createDataFrame([("p", 'em.createQuery("a" /* , ( */ + "b", c)')], "path string, content string")
    r = extract.classify(extract.extract_calls(corpus)).first()
    assert (r.query_text, r.is_dynamic, r.call_text) == ("ab", False, 'em.createQuery("a" /* , ( */ + "b", c)')


def test_calls_over_lines_and_nested(spark):
    body = 'x(em.createQuery("a" +\n  f("(", ")"), T.class).list());\nem.createQuery( em.createNativeQuery("q") );'
    corpus = spark.createDataFrame([("p", body)], "path string, content string")
    rows = extract.extract_calls(corpus).orderBy("call_ord").collect()
    assert [r.argument for r in rows] == ['"a" +\n  f("(", ")")', 'em.createNativeQuery("q")', '"q"']
    assert (rows[2].call_text, rows[2].begin_line, rows[2].begin_col, rows[2].end_col) == ('em.createNativeQuery("q")', 3, 17, 41)
    assert (rows[0].begin_line, rows[0].begin_col, rows[0].end_line, rows[0].end_col) == (1, 3, 2, 23)


def test_variants(spark):
    frags = spark.createDataFrame(
        [("k", 0, ["a"]), ("k", 2, ["d", "e"]), ("k", 1, ["b", "c"]), ("z", 0, [""])], "k string, seq int, alts array<string>"
    )
    got = sorted(r.query_text for r in extract.expand_variants(frags, "k", "seq", "alts").collect())
    assert got == ["abd", "abe", "acd", "ace"]


def test_variants_are_rows(spark):
    """Sixteen fragments of two alternatives: no row holds more than the numbers of one half."""
    frags = spark.createDataFrame([("k", k, ["a", "b"]) for k in range(16)] + [("e", 0, ["x"]), ("e", 1, []), ("d", 0, ["a", "ab"]), ("d", 1, ["b", "", "b"])], "k string, seq int, alts array<string>")
    rows = extract.expand_variants(frags, "k", "seq", "alts")
    texts = {key: sorted(r.query_text for r in rows.filter(F.col("k") == key).collect()) for key in "ked"}
    assert len(texts["k"]) == len(set(texts["k"])) == 2**16 and texts["k"][0] == "a" * 16
    assert texts["e"] == [] and texts["d"] == ["a", "ab", "abb"]
    assert "_last" not in rows.columns


def test_assemble(spark):
    events = spark.createDataFrame(
        [("v", 1, "append", "lost"), ("v", 2, "init", "a"), ("v", 3, "append", "b"), ("v", 4, "use", ""), ("v", 5, "append", "c"),
         ("v", 6, "use", ""), ("v", 7, "init", "x"), ("v", 8, "use", ""), ("w", 1, "use", "")],
        "v string, pos int, kind string, fragment string",
    )
    got = {(r.use_at, r.query_text) for r in extract.assemble(events, "v", "pos").collect()}
    assert got == {(4, "ab"), (6, "abc"), (8, "x")}


def test_parameters(spark):
    q = "update t set a = :x, b = ? where c like :l and cast(d as integer) > :m and :n = cast(e as date) and f in (?, 3, :o) and g = ':no ?'"
    df = spark.createDataFrame([("s", q)], "stmt_id string, query_text string")
    rows = params.find_parameters(df).orderBy("param_ord").collect()
    assert [r.token for r in rows] == [":x", "?", ":l", ":m", ":n", "?", ":o"]
    assert [r.column_ref for r in rows] == ["a", "b", "c", "d", "d", "f", "f"]
    assert [r.in_like for r in rows] == [False, False, True, False, False, False, False]
    assert [r.cast_type for r in rows] == [None, None, None, "integer", "date", None, None]


def test_parameters_of_every_clause_are_bound(spark):
    df = spark.createDataFrame([("s", "select :x from t join u on u.k = :j where a = :y")], "stmt_id string, query_text string")
    found = params.find_parameters(df)
    assert [r.column_ref for r in found.orderBy("param_ord").collect()] == [None, "u.k", "a"]
    marks = params.make_sentinels(found.withColumn("type_name", F.lit("Integer")))
    values = [r.sentinel for r in marks.orderBy("param_ord").collect()]
    assert params.bind(df, marks).first().bound_text == "select {} from t join u on u.k = {} where a = {}".format(*values)


def test_sentinels_of_many_parameters_differ(spark):
    text_ = "select a from t where " + " and ".join(f"c{k} = ?" for k in range(5000))
    df = spark.createDataFrame([("s", text_)], "stmt_id string, query_text string")
    marks = params.make_sentinels(params.find_parameters(df).withColumn("type_name", F.lit("Integer")))
    assert marks.select("sentinel").distinct().count() == 5000
    assert marks.filter("cast(sentinel as bigint) >= 2147483648").count() == 0


def test_bound_text_of_the_sample(spark):
    df = spark.createDataFrame([("s", "select table_b.a from table_b where table_b.column_c = :val")], "stmt_id string, query_text string")
    typed = params.find_parameters(df).withColumn("type_name", F.lit("String"))
    marks = params.make_sentinels(typed)
    bound = params.bind(df, marks).first().bound_text
    assert bound == f"select table_b.a from table_b where table_b.column_c = '{marks.first().sentinel}'"
    assert params.make_sentinels(typed).first().sentinel == marks.first().sentinel


def test_shared_date_goes_to_the_last_predicate(spark):
    nodes = spark.createDataFrame(
        [(1, "((d >= '1992-09-28'::date) AND (n = 42) AND (s = 'tag-7') AND (m <> 1042))")], "stmt_id int, condition string"
    )
    preds_ = spark.createDataFrame(
        [(1, 0, "1992-09-28", "d1", True), (1, 3, "1992-09-28", "d2", True), (1, 1, "42", "n", True), (1, 2, "tag-7", "s", True)],
        "stmt_id int, pred_ord int, sentinel string, expr string, eligible_index boolean",
    )
    rows = params.find_sentinels(nodes, preds_).orderBy("match_ord").collect()
    assert [r.expr for r in rows] == ["s", "n", "d2"]
