"""Tables as they come on a cluster: folders of files, and small files with much work in their rows."""

from pyspark.sql import functions as F

from planledger import catalog

SF = "/root/testdata/sf0.001"


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = (sorted(map(tuple, catalog.queries()["a4_incremental_stream"](spark, d).collect())) for d in (str(tmp_path), SF))
    assert want and got == want


def plan_of(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_small_file_are_dealt_out(spark):
    """A supplier row has 2,500 parameters: one task for the file would do the work of all."""
    assert "RoundRobinPartitioning" in plan_of(spark, "g3_many_sentinels")


def test_columns_are_carried_only_past_gaps_without_one(spark):
    from planledger.operators.params import find_parameters

    texts = [(1, "select a from t where a.x = ? and a.y in (?, ?) and cast(a.z as date) = ?"), (2, "select ? from t where b = ?"), (3, "delete from t")]
    found = find_parameters(spark.createDataFrame(texts, "stmt_id int, query_text string"))
    got = sorted((r.stmt_id, r.param_ord, r.column_ref) for r in found.collect())
    assert got == [(1, 0, "a.x"), (1, 1, "a.y"), (1, 2, "a.y"), (1, 3, "a.z"), (2, 0, None), (2, 1, "b")]


def test_source_of_small_tables_is_dealt_out(spark):
    from planledger import adapters

    for name in ("b1_hard_calls", "b1_nested_calls"):
        assert "RoundRobinPartitioning" in plan_of(spark, name), name
    assert "RoundRobinPartitioning" in adapters.report_corpus(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_events_are_read_from_source_once(spark):
    assert "customer.parquet" not in plan_of(spark, "b5_source_assembled")


def test_brackets_of_odd_texts(spark):
    from planledger.functions.structure import brackets

    texts = ["a(b{c)d}\n(e))\n\n}}{(", "", "x\ny", ")(\n\n{"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", brackets(F.col("t")).alias("b")).collect()
    for row in found:
        at, sums = 0, {"(": 0, "{": 0}
        for x in row.b:
            at += len(x.piece) + 1
            before = row.t[: at - 1]
            sums["("] += (x.br == "(") - (x.br == ")")
            sums["{"] += (x.br == "{") - (x.br == "}")
            depth = None if x.br is None else sums["("] if x.br == "(" else sums["("] + 1 if x.br == ")" else sums["{"] if x.br == "{" else sums["{"] + 1
            assert (x.at, x.line, x.break_at, x.key) == (at, before.count("\n"), before.rfind("\n") + 1, depth), (row.t, x)


def test_pick_rows_are_not_broadcast(spark):
    """Written tables compress well, so that their file sizes say little: only statistics and hot keys are broadcast."""
    plan = plan_of(spark, "e2e_recommend")
    assert "BuildLeft" not in plan and "SortMergeJoin [stmt_id" in plan


def test_statements_of_customers_are_dealt_out(spark):
    assert "RoundRobinPartitioning" in plan_of(spark, "e10_scoped_refs")


def test_plan_nodes_converts_only_what_it_returns(spark):
    plan = plan_of(spark, "h1_plan_nodes")
    assert "Heap Fetches" in plan and "Hash Buckets" not in plan


def test_blocks_need_no_running_structures(spark):
    """Brackets, clauses and branches of a statement come from running numbers."""
    from planledger.functions import tokens

    text = "select a from t union select b from (select c from u union select d from v where x) w where y in (1)"
    row = spark.createDataFrame([(text,)], "q string").select(tokens.tokens(F.col("q")).alias("t"))
    assert "zip_with" in row._jdf.queryExecution().executedPlan().toString()
    got = [(t.text, t.begin, t.branch, t.clause) for t in row.first().t if t.text in "abcdtuvwxy"]
    assert got == [("a", -1, 0, "select"), ("t", -1, 0, "from"), ("b", -1, 1, "select"), ("c", 8, 0, "select"), ("u", 8, 0, "from"), ("d", 8, 1, "select"), ("v", 8, 1, "from"), ("x", 8, 1, "where"), ("w", -1, 1, "from"), ("y", -1, 1, "where")]


def test_pages_are_written_without_a_folder_each(spark, tmp_path, monkeypatch):
    """Tasks write the files: a process started for each file, or a folder of its own, would take most of the time."""
    from planledger.catalog import corpus
    from planledger.sources import sinks

    pages = [(k, f"<p>é {k}\n</p>" * (k % 4)) for k in range(60)] + [(7, "<p>again</p>")]
    spark.createDataFrame(pages, "page_id long, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(corpus, "work_dir", lambda *_: str(tmp_path / "tree"))
    monkeypatch.setattr(sinks, "FOLDERS", 4)
    got = {r.page_id: r.size for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    text = {k: [t for i, t in pages if i == k] for k, _ in pages}
    assert got == {k: sum(len(t.encode()) + 1 for t in ts) for k, ts in text.items()}
    assert len(list((tmp_path / "tree").iterdir())) <= 4
    assert sorted(p.name for p in (tmp_path / "tree").rglob("*") if p.is_file()) == sorted(f"p{k}.txt" for k in range(60))


def test_rows_as_files(spark, tmp_path, monkeypatch):
    """Batches cut a name's rows; null texts are empty lines; without a mounted file system Spark's writer makes the files."""
    from planledger.sources import corpus, sinks

    monkeypatch.setattr(sinks, "BATCH_ROWS", 2)
    rows = spark.createDataFrame([("a", f"{k}") for k in range(5)] + [("b", None), ("c", "x\ny")], "name string, value string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{tmp_path}")
    for top in (f"file://{tmp_path}/a", "viewfs://tests/in/b"):
        folder = sinks.write_files(rows, top)
        found = corpus.scan_corpus(spark, [folder], glob="*.txt")
        assert sorted(r.content for r in found.collect()) == ["\n", "0\n1\n2\n3\n4\n", "x\ny\n"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_documents_are_parsed_once_for_advice(spark, monkeypatch):
    """Counting the statements of the picks must not parse the documents again."""
    from planledger.plans import advisor

    plans, keep = [], advisor.written
    monkeypatch.setattr(advisor, "written", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, purpose))
    rows = catalog.queries()["i7_recommend_from_documents"](spark, SF)
    assert sum(p.count("parseJson") for p in [*plans, rows._jdf.queryExecution().executedPlan().toString()]) == 1
