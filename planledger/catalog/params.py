"""Query parameters and sentinels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions.scale import spread_scan
from ..operators import params
from ..plans.nodes import condition_clause
from ..sources.tables import table
from . import sqlparts


def _found(spark, sf):
    return params.find_parameters(adapters.parameter_statements(spark, sf))


def _metadata(spark):
    # Fixed metadata of the template's two tables.
    types = spark.createDataFrame(
        [("orders", "cust", "Customer"), ("orders", "flag", "Boolean"), ("orders", "total", "Integer"), ("orders", "price", "Double"), ("customer", "id", "Long")],
        "table_name string, column_name string, type_name string",
    )
    links = spark.createDataFrame([("orders", "cust", "customer")], "table_name string, link_column string, target_table string")
    ids = spark.createDataFrame([("customer", "id")], "table_name string, id_column string")
    return types, links, ids


def _typed(spark, sf):
    found = _found(spark, sf).withColumn("table_name", F.lit("orders")).withColumn("column_name", F.substring_index("column_ref", ".", -1))
    return params.infer_types(found, *_metadata(spark))


def _sentinels(spark, sf):
    return params.make_sentinels(_typed(spark, sf))


def find_parameters(spark, sf):
    return _found(spark, sf).select("stmt_id", "param_ord", "token", "column_ref", F.col("in_like").cast("int").alias("in_like"), "cast_type")


def infer_types(spark, sf):
    return _typed(spark, sf).select("stmt_id", "param_ord", "type_name")


def make_sentinels(spark, sf):
    return _sentinels(spark, sf).select("stmt_id", "param_ord", "sentinel", "sql_value")


def bind_parameters(spark, sf):
    return params.bind(adapters.parameter_statements(spark, sf), _sentinels(spark, sf)).select("stmt_id", "bound_text")


def find_sentinels(spark, sf):
    nodes = condition_clause(adapters.flat_nodes(spark, sf)).filter("condition is not null")
    nodes = nodes.select("plan_id", "path", "condition", F.expr("plan_id div 10").alias("stmt_id"))
    found = params.find_sentinels(nodes, adapters.flat_predicates(spark, sf))
    return found.select("plan_id", "path", "match_ord", "sentinel", "expr", F.col("eligible_index").cast("int").alias("eligible_index"))


_PARAMS = """with p as (
  select o_orderkey as stmt_id, o_custkey, 0 as param_ord, ':c' as token, 'o.cust' as column_ref, 0 as in_like, null as cast_type, 'Long' as type_name from orders where o_orderkey % 4 = 0
  union all select o_orderkey, o_custkey, 1, ':s', 'o.status', 1, null, 'String' from orders where o_orderkey % 4 = 0
  union all select o_orderkey, o_custkey, 0, '?', 'price', 0, null, 'String' from orders where o_orderkey % 4 = 1
  union all select o_orderkey, o_custkey, 1, '?', 'flag', 0, null, 'Boolean' from orders where o_orderkey % 4 = 1
  union all select o_orderkey, o_custkey, 0, ':d', 'o.day', 0, 'date', 'Date' from orders where o_orderkey % 4 = 2
  union all select o_orderkey, o_custkey, 1, '?', 'o.total', 0, null, 'Integer' from orders where o_orderkey % 4 = 2
  union all select o_orderkey, o_custkey, 0, ':a', 'o.total', 0, null, 'Integer' from orders where o_orderkey % 4 = 3
  union all select o_orderkey, o_custkey, 1, ':b', 'o.total', 0, null, 'Integer' from orders where o_orderkey % 4 = 3
  union all select o_orderkey, o_custkey, 2, ':n', 'o.name', 0, null, 'String' from orders where o_orderkey % 4 = 3),
n as (select *, cast('0x' || substr(md5(cast(stmt_id as varchar)), 1, 5) as bigint) * 2000 + param_ord as num from p),
s as (select *, case type_name when 'Boolean' then 'true' when 'Integer' then cast(num as varchar) when 'Long' then cast(num + 2147483648 as varchar) when 'Date' then '1992-09-28' else 'tag-' || num end as sentinel from n),
v as (select *, case when type_name in ('Boolean', 'Integer', 'Long') then sentinel when type_name = 'Date' then '{d ''' || sentinel || '''}' else '''' || sentinel || '''' end as sql_value from s)
"""

def many_parameters(spark, sf):
    """Statements of 2,500 parameters: every one has a sentinel of its own."""
    text = F.concat(F.lit("select s from supplier s where "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2499)), lambda i: F.concat(F.lit("s.a"), i.cast("string"), F.lit(" = ?"))), " and "))
    stmts = spread_scan(table(spark, sf, "supplier")).select(F.col("s_suppkey").alias("stmt_id"), text.alias("query_text"))
    marks = params.make_sentinels(params.find_parameters(stmts).withColumn("type_name", F.lit("Integer")))
    number = F.col("sentinel").cast("bigint")
    return marks.groupBy("stmt_id").agg(F.count_distinct("sentinel").alias("sentinels"), F.min(number).alias("least"), F.max(number).alias("most"))


QUERIES = {
    "g3_many_sentinels": (
        many_parameters,
        """select s_suppkey as stmt_id, 2500 as sentinels, cast('0x' || substr(md5(cast(s_suppkey as varchar)), 1, 5) as bigint) * 2000 as least,
          cast('0x' || substr(md5(cast(s_suppkey as varchar)), 1, 5) as bigint) * 2000 + 2499 as most from supplier""",
    ),
    "g1_find_parameters": (find_parameters, _PARAMS + "select stmt_id, param_ord, token, column_ref, in_like, cast_type from p"),
    "g2_infer_parameter_type": (infer_types, _PARAMS + "select stmt_id, param_ord, type_name from p"),
    "g3_make_sentinels": (make_sentinels, _PARAMS + "select stmt_id, param_ord, sentinel, sql_value from v"),
    "g4_bind_parameters": (
        bind_parameters,
        _PARAMS
        + """, w as (select stmt_id, o_custkey, max(case when param_ord = 0 then sql_value end) as a, max(case when param_ord = 1 then sql_value end) as b, max(case when param_ord = 2 then sql_value end) as c from v group by 1, 2)
        select stmt_id, case stmt_id % 4
          when 0 then 'select o from orders o where o.cust = ' || a || ' and o.status like ' || b || ' and o.note = ''it''''s :x ' || o_custkey || ''''
          when 1 then 'update orders set price = ' || a || ' where flag = ' || b || ' and num = ' || o_custkey
          when 2 then 'select o from orders o where cast(o.day as date) >= ' || a || ' and o.total < ' || b || ' and o.zone = ' || o_custkey
          else 'select o from orders o where o.total in (' || a || ', ' || o_custkey || ', ' || b || ') and lower(o.name) = ' || c end as bound_text from w""",
    ),
    "g5_find_sentinels": (
        find_sentinels,
        "with "
        + sqlparts.FLAT
        + """, t as (select plan_id, path, unnest(regexp_extract_all(condition, '''(tag-[0-9]+)''', 1)) as sentinel, generate_subscripts(regexp_extract_all(condition, '''(tag-[0-9]+)''', 1), 1) - 1 as match_ord from nodes where condition is not null)
        select plan_id, path, match_ord::int as match_ord, sentinel, 'c' || (cast(substr(sentinel, 5) as bigint) % 10) as expr, cast(cast(substr(sentinel, 5) as bigint) % 10 <> 3 as int) as eligible_index from t""",
    ),
}
