"""Association-path joins over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import metadata
from ..operators.paths import Association, EntityModel, implied_joins, learned_links, path_join, path_select
from ..session import written
from ..sources.corpus import prefilter
from ..sources.tables import table
from . import sqlparts

_ASSOCIATIONS = (
    Association("line", "order", "to_one", "order", "l_orderkey", "o_orderkey"),
    Association("line", "part", "to_one", "part", "l_partkey", "p_partkey"),
    Association("line", "supplier", "to_one", "supplier", "l_suppkey", "s_suppkey"),
    Association("order", "customer", "to_one", "customer", "o_custkey", "c_custkey"),
    Association("order", "lines", "to_many", "line", "o_orderkey", "l_orderkey"),
    Association("order", "status", "embedded", "status"),
    Association("customer", "nation", "to_one", "nation", "c_nationkey", "n_nationkey"),
    Association("customer", "orders", "to_many", "order", "c_custkey", "o_custkey"),
    Association("nation", "region", "to_one", "region", "n_regionkey", "r_regionkey"),
    Association("part", "suppliers", "via_table", "supplier", "p_partkey", "s_suppkey", "line", "l_partkey", "l_suppkey"),
)

_COLUMNS = {
    ("order", "total"): "o_totalprice",
    ("order", "key"): "o_orderkey",
    ("status", "priority"): "o_orderpriority",
    ("status", "code"): "o_orderstatus",
    ("customer", "name"): "c_name",
    ("nation", "name"): "n_name",
    ("region", "name"): "r_name",
    ("supplier", "name"): "s_name",
    ("part", "name"): "p_name",
    ("line", "price"): "l_extendedprice",
    ("line", "array_item_price_1"): "l_tax",
}


def model(spark, sf) -> EntityModel:
    names = {"line": "lineitem", "order": "orders"}
    tables = {e: table(spark, sf, names.get(e, e)) for e in ("line", "order", "customer", "nation", "region", "part", "supplier")}
    tables["order"] = tables["order"].withColumn("status", F.struct("o_orderpriority", "o_orderstatus"))
    return EntityModel(tables, _ASSOCIATIONS, _COLUMNS)


def join_to_one(spark, sf):
    rows = path_join(model(spark, sf), "order", "customer")
    return rows.select(F.col("order__o_orderkey").alias("o_orderkey"), F.col("order__customer__c_name").alias("c_name"))


def join_to_many(spark, sf):
    rows = path_join(model(spark, sf), "customer", "orders", how="left")
    return rows.groupBy(F.col("customer__c_custkey").alias("c_custkey")).agg(
        F.count("customer__orders__o_orderkey").alias("orders"),
        F.sum(F.col("customer__orders__o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


def join_via_table(spark, sf):
    rows = path_join(model(spark, sf), "part", "suppliers")
    return rows.select(F.col("part__p_partkey").alias("p_partkey"), F.col("part__suppliers__s_name").alias("s_name")).groupBy("p_partkey", "s_name").agg(
        F.count(F.lit(1)).alias("links")
    )


def embedded_path(spark, sf):
    return path_select(model(spark, sf), "order", ["key", "status.priority", "order.status.code"])


def multi_hop(spark, sf):
    return (
        path_select(model(spark, sf), "line", ["price", "order.customer.nation.region.name"])
        .groupBy(F.col("order_customer_nation_region_name").alias("r_name"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("revenue"))
    )


def shared_prefix(spark, sf):
    """Three paths with a common beginning: orders and customer are joined once."""
    rows = path_select(model(spark, sf), "line", ["order.customer.name", "order.customer.nation.name", "order.total", "supplier.name"])
    return rows.groupBy("order_customer_nation_name", "supplier_name").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("order_customer_name").alias("customers"), F.max("order_total").alias("largest")
    )


def _links(spark):
    names = {"line": "lineitem", "order": "orders"}
    rows = [
        (a.entity, a.field, a.kind, a.target, names.get(a.entity, a.entity), a.link_column, names.get(a.target, a.target), a.target_column,
         names.get(a.join_table, a.join_table), a.join_column, a.inverse_column)
        for a in _ASSOCIATIONS
    ]
    return spark.createDataFrame(
        rows,
        "entity string, field string, kind string, target string, left_table string, link_column string, right_table string, "
        "target_column string, join_table string, join_column string, inverse_column string",
    )


def _path_refs(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey stmt_id",
        "'order' entity",
        """case o_orderkey % 6 when 0 then array('customer', 'nation', 'name') when 1 then array('order', 'total') when 2 then array('lines', 'part', 'suppliers', 'name')
        when 3 then array('"a.b.c.d.e"', 'x') when 4 then array('order', 'status', 'code') else array('array_item_lines_1', 'price') end path""",
    )


def implied(spark, sf):
    return implied_joins(_path_refs(spark, sf), _links(spark))


def learned(spark, sf):
    """Joins implied by paths over associations that the classes themselves declare."""
    facts = written(metadata.class_facts(prefilter(adapters.entity_corpus(spark, sf))), "class-facts")
    links = learned_links(metadata.associations(facts), metadata.entity_tables(facts), metadata.entity_ids(facts))
    refs = table(spark, sf, "orders").selectExpr(
        "o_orderkey stmt_id",
        "concat('part', o_custkey % 100) entity",
        "case o_orderkey % 3 when 0 then array('brand', 'size') when 1 then array('suppliers', 'name') else array('brand', 'brand', 'key') end path",
    )
    return implied_joins(refs, links, max_hops=2)


def skip_rules(spark, sf):
    """Names that need no join: single, own table, quoted, rewritten array item."""
    m = model(spark, sf)
    lines = m.tables["line"].withColumn("a.b.c.d.e", F.col("l_discount"))
    m = EntityModel({**m.tables, "line": lines}, m.associations, m.columns)
    rows = path_select(m, "line", ["price", "line.l_quantity", '"a.b.c.d.e"', "array_item_price_1"])
    return rows.groupBy("line_l_quantity").agg(
        F.count(F.lit(1)).alias("lines"), F.max("price").alias("price"), F.max("a_b_c_d_e").alias("discount"), F.max("array_item_price_1").alias("tax")
    )


QUERIES = {
    "f1_join_to_one": (join_to_one, "select o_orderkey, c_name from orders join customer on c_custkey = o_custkey"),
    "f2_join_to_many": (
        join_to_many,
        """select c_custkey, count(o_orderkey) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
           from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    ),
    "f3_join_via_table": (
        join_via_table,
        """select p_partkey, s_name, count(*) as links from part join lineitem on l_partkey = p_partkey left join supplier on s_suppkey = l_suppkey group by 1, 2""",
    ),
    "f4_embedded_path": (
        embedded_path,
        "select o_orderkey as key, o_orderpriority as status_priority, o_orderstatus as order_status_code from orders",
    ),
    "f5_multi_hop": (
        multi_hop,
        """select r_name, count(*) as lines, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue
           from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
           join region on r_regionkey = n_regionkey group by 1""",
    ),
    "f6_shared_prefix": (
        shared_prefix,
        """select n_name as order_customer_nation_name, s_name as supplier_name, count(*) as lines, count(distinct c_name) as customers, max(o_totalprice) as largest
           from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
           join supplier on s_suppkey = l_suppkey group by 1, 2""",
    ),
    "f7_implied_joins": (
        implied,
        """with o as (select o_orderkey as k from orders)
           select k as stmt_id, 'orders' as left_table, 'o_custkey' as left_column, 'customer' as right_table, 'c_custkey' as right_column, 'inner' as join_type from o where k % 6 = 0
           union all select k, 'customer', 'c_nationkey', 'nation', 'n_nationkey', 'inner' from o where k % 6 = 0
           union all select k, 'orders', 'o_orderkey', 'lineitem', 'l_orderkey', 'inner' from o where k % 6 = 2
           union all select k, 'lineitem', 'l_partkey', 'part', 'p_partkey', 'inner' from o where k % 6 = 2
           union all select k, 'part', 'p_partkey', 'lineitem', 'l_partkey', 'inner' from o where k % 6 = 2
           union all select k, 'lineitem', 'l_suppkey', 'supplier', 's_suppkey', 'left' from o where k % 6 = 2""",
    ),
    "f7_learned_joins": (
        learned,
        "with "
        + sqlparts.PARTS
        + """, e as (select k, base, imported, case when imported and not embeddable then table_name else entity end as t, case when imported then key_column else 'id' end as key from cls),
           r as (select o_orderkey as stmt_id, o_custkey % 100 as k, o_orderkey % 3 as m from orders),
           one as (select r.stmt_id, r.m, l.t, l.key, l.k, l.base, coalesce(b.t, 'part' || l.base) as bt, coalesce(b.key, 'id') as bkey, coalesce(b.imported, false) as known
             from r join e l on l.k = r.k and l.imported left join e b on b.k = l.base)
           select stmt_id, t as left_table, 'brand_id' as left_column, bt as right_table, bkey as right_column, 'inner' as join_type from one where m <> 1
           union select stmt_id, bt, 'brand_id', bt, bkey, 'inner' from one where m = 2 and known
           union select stmt_id, t, key, 'ps_' || (k % 10), 'ps_part', 'inner' from one where m = 1
           union select stmt_id, 'ps_' || (k % 10), 'ps_supp', 'supplier', 'id', 'left' from one where m = 1""",
    ),
    "f8_skip_rules": (
        skip_rules,
        "select l_quantity as line_l_quantity, count(*) as lines, max(l_extendedprice) as price, max(l_discount) as discount, max(l_tax) as tax from lineitem group by 1",
    ),
}
