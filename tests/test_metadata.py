"""Annotated classes, associations, corpora."""

import zlib

import pytest
from pyspark.sql import functions as F

from planledger.operators import metadata
from planledger.operators.paths import Association, EntityModel, PathError, path_join, path_select
from planledger.sources import corpus as src

ORDER = """package shop;
import javax.persistence.*;
@Table(name = "ORDERS")
class Order extends Base {
  @Id @Column(name = "o_orderkey") private Long key;
  @Column(name = "o_totalprice") private Double price;
  @ManyToOne @JoinColumn(name = "o_custkey") private Customer customer;
  @OneToMany(mappedBy = "order") private List<Line> lines;
  @ManyToMany @JoinTable(name = "order_tag", joinColumns = @JoinColumn(name = "o_orderkey"),
     inverseJoinColumns = @JoinColumn(name = "tag_id")) private Set<Tag> tags;
  @Embedded private Status status;
  @Override public String toString() { return "@Column(name = \\"no\\") int no;"; }
}
"""


@pytest.fixture(scope="module")
def order(spark):
    return src.with_class_names(spark.createDataFrame([("/w/shop/Order.java", ORDER)], "path string, content string"))


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_tables_columns_ids(order):
    assert rows(metadata.entity_tables(order), "entity", "table_name") == {("order", "orders"), ("orders", "orders")}
    assert rows(metadata.entity_columns(order), "field", "column_name") == {
        ("key", "o_orderkey"), ("o_orderkey", "o_orderkey"), ("price", "o_totalprice"), ("o_totalprice", "o_totalprice"),
    }
    assert rows(metadata.entity_ids(order), "field", "column_name") == {("id", "o_orderkey")}


def test_types(order):
    assert rows(metadata.entity_types(order), "column_name", "type_name") == {
        ("o_orderkey", "Long"), ("o_totalprice", "Double"), ("o_custkey", "Customer"),
    }


def test_associations(order):
    got = {r.field: r for r in metadata.associations(order).collect()}
    assert (got["customer"].kind, got["customer"].link_column, got["customer"].target_entity) == ("many_to_one", "o_custkey", "Customer")
    assert (got["lines"].kind, got["lines"].mapped_by, got["lines"].target_entity) == ("one_to_many", "order", "Line")
    tags = got["tags"]
    assert (tags.join_table, tags.join_columns, tags.inverse_columns, tags.target_entity) == ("order_tag", ["o_orderkey"], ["tag_id"], "Tag")
    assert (got["status"].kind, got["status"].target_entity) == ("embedded", "Status")
    assert len(got) == 4


def test_class_names_and_parent(order):
    r = order.first()
    assert (r.class_name, r.qualified_class) == ("Order", "shop.Order")
    assert rows(metadata.class_parents(order), "entity", "parent") == {("order", "base")}


def test_generic_parent_and_primitive_types(spark):
    body = 'class A<T extends X> extends B<T> implements C { @Column(name = "n") int n; @JoinColumn(name = "n") Foo m; @JoinColumn(name = "k") int k; }'
    df = src.with_class_names(spark.createDataFrame([("A.java", body)], "path string, content string"))
    assert rows(metadata.class_parents(df), "parent") == {("b",)}
    assert rows(metadata.entity_types(df), "column_name", "type_name") == {("n", "Integer")}


def test_fingerprint_is_crc32_size_class(spark):
    text = "class Ünï {}"
    df = src.with_class_names(spark.createDataFrame([("a/B.java", text)], "path string, content string"))
    raw = text.encode()
    assert src.with_fingerprint(df).first().fingerprint == f"{zlib.crc32(raw):08x}-{len(raw)}B"


def test_second_run_extracts_nothing(spark, order):
    done = src.with_fingerprint(order)
    new, reused = src.incremental(src.with_fingerprint(order), done)
    assert (new.count(), reused.count()) == (0, 1)


def test_prefilter(spark, order):
    other = spark.createDataFrame([("x", '// import javax.persistence\nimport java.util.List;\nString s = "import javax.persistence";')], "path string, content string")
    assert src.prefilter(other).count() == 0
    assert src.prefilter(order).count() == 1


def test_scan_and_limit(spark, tmp_path):
    for name in ("a/X.java", "a/b/Y.java", "a/b/Z.txt", "a/src/main/java/Q.java"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("class " + f.stem + " {}\n")
    everything = src.scan_corpus(spark, [str(tmp_path), str(tmp_path / "a" / "X.java")])
    assert sorted(r.class_name for r in everything.collect()) == ["Q", "X", "Y"]
    assert src.scan_corpus(spark, [str(tmp_path)], limit=2).count() == 2
    assert src.scan_corpus(spark, [str(tmp_path)], limit=-1).count() == 3
    assert [r.root.endswith("/a/src/main/java") for r in src.source_roots(everything).collect()] == [True]


def test_streamed_scan_reads_each_file_once(spark, tmp_path):
    from planledger.operators.extract import extract_calls
    from planledger.streaming.incremental import scan_text_files

    tree, out, check = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "check")
    tree.mkdir()
    (tree / "A.java").write_text('em.createQuery("a");')
    run = lambda: scan_text_files(spark, str(tree), out, check, lambda c: extract_calls(c).select("path", "argument"))
    assert run().count() == 1
    (tree / "B.java").write_text('em.createQuery("b");\nem.createQuery("c");')
    assert sorted(r.argument for r in run().collect()) == ['"a"', '"b"', '"c"']
    assert run().count() == 3


def test_base_class_names_win_and_unrelated_stay(spark):
    columns = spark.createDataFrame(
        [("a", "p.A", "id", "a_id"), ("a", "p.A", "x", "ax"), ("base", "p.Base", "id", "b_id"), ("base", "q.Base", "y", "other")],
        "entity string, qualified_class string, field string, column_name string",
    )
    parents = spark.createDataFrame([("a", "base"), ("empty", "base")], "entity string, parent string")
    got = rows(metadata.inherit(columns, parents).filter("entity in ('a', 'empty')"), "entity", "field", "column_name")
    assert got == {("a", "id", "b_id"), ("a", "x", "ax"), ("a", "b_id", "b_id")}


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame([(1, 10, "hi"), (2, 11, "lo"), (3, 99, "lo")], "o_id int, o_cust int, o_pri string")
    customers = spark.createDataFrame([(10, "Ann", 1), (11, "Bob", 2)], "c_id int, c_name string, c_nat int")
    nations = spark.createDataFrame([(1, "X"), (2, "Y")], "n_id int, n_name string")
    links = spark.createDataFrame([(1, 7)], "ot_order int, ot_tag int")
    tags = spark.createDataFrame([(8, "t")], "t_id int, t_name string")
    return EntityModel(
        {"order": orders, "customer": customers, "nation": nations, "order_tag": links, "tag": tags},
        (
            Association("order", "customer", "to_one", "customer", "o_cust", "c_id"),
            Association("customer", "nation", "to_one", "nation", "c_nat", "n_id"),
            Association("customer", "orders", "to_many", "order", "c_id", "o_cust"),
            Association("order", "tags", "via_table", "tag", "o_id", "t_id", "order_tag", "ot_order", "ot_tag"),
        ),
        {("nation", "name"): "n_name", ("customer", "name"): "c_name"},
    )


def test_paths(shop):
    got = path_select(shop, "order", ["o_id", "customer.name", "order.customer.nation.name"])
    assert {tuple(r) for r in got.collect()} == {(1, "Ann", "X"), (2, "Bob", "Y")}


def test_shared_prefix_is_joined_once(shop):
    plan = path_select(shop, "order", ["customer.name", "customer.nation.name", "customer.c_id"])._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join Inner") == 2


def test_unknown_step(shop):
    with pytest.raises(PathError):
        path_select(shop, "order", ["customer.planet.name"])
    with pytest.raises(PathError):
        path_select(shop, "order", ["customer.age"])


def test_join_table_keeps_link_rows(shop):
    got = path_join(shop, "order", "tags").collect()
    assert [(r["order__o_id"], r["order__tags__t_id"]) for r in got] == [(1, None)]
    assert path_join(shop, "customer", "orders", how="left").count() == 2


def test_no_columns_are_read_beyond_the_paths(shop):
    plan = path_select(shop, "order", ["customer.name"])._jdf.queryExecution().optimizedPlan().toString()
    assert "o_pri" not in plan.split("LogicalRDD")[0]
