"""Plan documents, nodes, picks and explain outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..plans import attempts, nodes
from ..sources.plans import bad_plans, read_mysql_plans, read_pg_plans
from ..sources.tables import table
from . import sqlparts


def _documents(spark, sf):
    return read_pg_plans(adapters.pg_documents(spark, sf), "json").drop("json")


def _mysql(spark, sf):
    return read_mysql_plans(adapters.mysql_documents(spark, sf), "json").drop("json")


def read_pg(spark, sf):
    return _documents(spark, sf).filter("plan is not null").select(
        "plan_id", "planning_time", "execution_time", nodes.node_field(F.col("plan"), "total_cost").alias("root_cost")
    )


def unreadable_pg(spark, sf):
    return bad_plans(_documents(spark, sf)).select("plan_id")


def read_mysql(spark, sf):
    block = F.col("query_block")
    return _mysql(spark, sf).filter("query_block is not null").select(
        "plan_id",
        block["r_total_time_ms"].alias("time_ms"),
        block["table"]["table_name"].alias("table_name"),
        F.array_join(block["table"]["possible_keys"], ",").alias("possible_keys"),
        block["table"]["rows"].alias("est_rows"),
        block["table"]["attached_condition"].alias("attached_condition"),
    )


#: The fields of a node that the query returns: what a row has no column for isn't converted.
_SHOWN = ("node_type", "relation_name", "startup_cost", "total_cost", "plan_rows", "actual_total_time", "filter", "recheck_cond", "index_cond", "sort_key", "heap_fetches")


def plan_nodes(spark, sf):
    typed = nodes.plan_nodes(_documents(spark, sf), _SHOWN)
    return typed.select(
        "plan_id", "node_ord", "node_type", "relation_name", "startup_cost", "total_cost", "plan_rows", "actual_total_time", "filter", "recheck_cond",
        "index_cond", F.array_join("sort_key", ",").alias("sort_key"), "heap_fetches",
    )


def flatten_plan(spark, sf):
    # Without typed fields: the rows of ``nodes.flatten_plan`` less the VARIANT that isn't returned.
    return nodes.plan_nodes(_documents(spark, sf), ()).select("plan_id", "path", "parent_path", "depth", "node_ord")


def costliest_node(spark, sf):
    return nodes.costliest_node(adapters.flat_nodes(spark, sf))


def slowest_node(spark, sf):
    return nodes.slowest_node(adapters.flat_nodes(spark, sf))


def document_picks(spark, sf):
    picked = nodes.document_picks(_documents(spark, sf))
    return picked.select(
        "plan_id",
        F.col("costliest.table_name").alias("costly_table"),
        F.col("costliest.condition").alias("costly_condition"),
        F.col("slowest.table_name").alias("slow_table"),
        F.col("slowest.condition").alias("slow_condition"),
        "startup_cost",
        F.size("seq_scan_times").alias("scans"),
        F.aggregate("seq_scan_times", F.lit(0.0), lambda a, x: a + x).alias("scan_time"),
    )


def mysql_node(spark, sf):
    picked = nodes.mysql_picks(_mysql(spark, sf))
    return picked.select("plan_id", F.col("costliest.table_name").alias("costly_table"), F.col("slowest.condition").alias("slow_condition"), "execution_time")


def root_metrics(spark, sf):
    return nodes.root_metrics(adapters.flat_plans(spark, sf))


def seq_scans(spark, sf):
    return nodes.seq_scans(adapters.flat_nodes(spark, sf))


def condition_clause(spark, sf):
    return nodes.condition_clause(adapters.flat_nodes(spark, sf)).select("plan_id", "path", "condition")


def first_success(spark, sf):
    return attempts.first_success(adapters.attempts(spark, sf), order="try_ord").select("stmt_id", "db_ord", "part")


def _tried(spark, sf):
    return attempts.executed(adapters.attempts(spark, sf), order="try_ord")


def _recorded(spark, sf):
    return attempts.classify_failures(_tried(spark, sf), databases=7)


def classify_failures(spark, sf):
    return _recorded(spark, sf).select("stmt_id", "db_ord", "part", "status")


def explain_summary(spark, sf):
    stmts = table(spark, sf, "orders").selectExpr(
        "case when o_custkey % 7 = 0 then 'failed' else 'select' end kind", "if(o_orderstatus = 'P', 'select 1 from t', 'SELECT 1 FROM t WHERE a = 1') query_text"
    )
    return attempts.explain_summary(_tried(spark, sf), _recorded(spark, sf), stmts)


def latest_plan(spark, sf):
    plans = table(spark, sf, "orders").selectExpr("concat('q', o_custkey) final_text", "o_orderkey plan_id", "struct(o_orderdate, o_orderkey) arrived")
    return nodes.latest_plan(plans, "arrived").select("final_text", "plan_id")


_D, _F = "with " + sqlparts.DOCUMENTS, "with " + sqlparts.FLAT
_TRIES = """with a as (select *, l_returnflag = 'R' as ok, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n from lineitem),
 stop as (select l_orderkey, min(case when ok then n end) as s from a group by 1),
 tried as (select a.* from a join stop using (l_orderkey) where s is null or n <= s),
 rec as (select *, case l_returnflag || l_linestatus when 'AO' then 'missing_column' when 'AF' then 'missing_table' when 'NO' then 'permission_denied' else 'failed' end as status from tried where not ok),
 recorded as (select * from rec where status not in ('missing_column', 'missing_table') or l_linenumber >= 7)
"""

QUERIES = {
    "a6_read_pg_plans": (
        read_pg,
        "select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as bigint) || '-' || cast(round(l_extendedprice * 100) as bigint) as plan_id, 0.5::double as planning_time, floor(l_extendedprice / 1000) as execution_time, l_extendedprice as root_cost from lineitem where l_partkey % 50 <> 49",
    ),
    "a6_unreadable_plans": (
        unreadable_pg,
        "select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as bigint) || '-' || cast(round(l_extendedprice * 100) as bigint) as plan_id from lineitem where l_partkey % 50 = 49",
    ),
    "a7_read_mysql_plans": (
        read_mysql,
        """select c_custkey as plan_id, c_acctbal as time_ms, lower(c_mktsegment) as table_name, 'a,b' as possible_keys, c_custkey * 1000000 as est_rows,
           '(t.c' || (c_custkey % 5) || ' = ''tag-' || c_custkey || ''')' as attached_condition from customer where c_custkey % 25 <> 24""",
    ),
    "h1_plan_nodes": (
        plan_nodes,
        _D + "select plan_id, node_ord, node_type, relation_name, startup_cost, total_cost, plan_rows, actual_total_time, filter, recheck_cond, index_cond, sort_key, cast(null as bigint) as heap_fetches from nodes",
    ),
    "h2_flatten_plan": (flatten_plan, _D + "select plan_id, path, parent_path, depth, node_ord from nodes"),
    "h3_costliest_node": (
        costliest_node,
        _F + "select p.plan_id, coalesce(c.total_cost, 0) as value, c.node_type, c.relation_name from (select distinct plan_id from nodes) p left join costliest c using (plan_id)",
    ),
    "h4_slowest_node": (
        slowest_node,
        _F + "select p.plan_id, coalesce(c.actual_total_time, 0) as value, c.node_type, c.relation_name from (select distinct plan_id from nodes) p left join slowest c using (plan_id)",
    ),
    "h4_document_picks": (
        document_picks,
        _D
        + """, found as (select rid, min(plan_id) as plan_id, max(startup_cost) filter (depth = 0) as startup_cost,
               arg_min({'t': relation_name, 'c': coalesce(filter, recheck_cond)}, {'v': -total_cost, 'p': path}) filter (total_cost is not null and node_type not in ('Nested Loop', 'Aggregate')) as costly,
               arg_min({'t': relation_name, 'c': coalesce(filter, recheck_cond)}, {'v': -actual_total_time, 'p': path})
                 filter (total_cost is not null and actual_total_time is not null and node_type not in ('Nested Loop', 'Aggregate')) as slow,
               bool_or(depth = 0 and actual_total_time is not null) as timed, count(*) filter (depth <= 1 and node_type = 'Seq Scan' and actual_total_time is not null) as scans,
               sum(actual_total_time) filter (depth <= 1 and node_type = 'Seq Scan') as scan_time from nodes group by rid)
             select plan_id, costly.t as costly_table, costly.c as costly_condition, slow.t as slow_table, slow.c as slow_condition, startup_cost,
               case when timed then scans::int end as scans, case when timed then coalesce(scan_time, 0) end as scan_time from found""",
    ),
    "h5_mysql_node": (
        mysql_node,
        """select c_custkey as plan_id, lower(c_mktsegment) as costly_table, '(t.c' || (c_custkey % 5) || ' = ''tag-' || c_custkey || ''')' as slow_condition, c_acctbal as execution_time
           from customer where c_custkey % 25 <> 24""",
    ),
    "h6_root_metrics": (root_metrics, _F + "select plan_id, metric, score from roots"),
    "h7_seq_scans": (seq_scans, _F + "select plan_id, score from scans"),
    "h8_condition_clause": (condition_clause, _F + "select plan_id, path, condition from nodes"),
    "h9_first_success": (first_success, _TRIES + "select l_orderkey as stmt_id, l_linenumber as db_ord, l_partkey as part from tried where ok"),
    "h10_classify_failures": (classify_failures, _TRIES + "select l_orderkey as stmt_id, l_linenumber as db_ord, l_partkey as part, status from recorded"),
    "h11_explain_summary": (
        explain_summary,
        _TRIES
        + """select (select count(distinct l_orderkey) from tried) as attempted, (select count(distinct l_orderkey) from tried where ok) as explained, count(*) as failed,
             count(*) filter (status = 'permission_denied') as permission_denied, count(*) filter (status = 'missing_table') as missing_tables, count(*) filter (status = 'missing_column') as missing_columns,
             (select count(*) from orders where o_custkey % 7 <> 0 and o_orderstatus = 'P') as missing_where from recorded""",
    ),
    "h12_latest_plan": (latest_plan, "select 'q' || o_custkey as final_text, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as plan_id from orders group by 1"),
}
