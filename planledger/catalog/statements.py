"""Statement normalisation, counting, predicates and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions.scale import spread_scan
from ..sources.tables import table
from ..operators import extract, predicates, statements
from . import sqlparts


def _statements(spark, sf):
    return statements.dedupe(adapters.workload_calls(spark, sf), order=("call_ord",))


def _accepted(spark, sf):
    return _statements(spark, sf).filter("not is_dynamic and kind <> 'failed'")


def _ranked(spark, sf):
    tables, columns = adapters.workload_names(spark, sf)
    named = predicates.first_table(_accepted(spark, sf), tables)
    return predicates.extract_predicates(named), columns


def _hits(spark, sf):
    preds, columns = _ranked(spark, sf)
    return predicates.column_hits(preds, columns)


def clean_for_parse(spark, sf):
    calls = adapters.workload_calls(spark, sf)
    odd = calls.withColumn(
        "query_text",
        F.expr(
            """case call_ord % 4 when 0 then concat('FROM "Order', call_ord, '" o join fetch o.lines')
            when 1 then concat('select a.b.c.d.e', call_ord, ' from x where y = \\\\\\'z\\\\\\'')
            when 2 then concat('Select t from T t where t.tags[ ', call_ord, ' ] = 1') else query_text end"""
        ),
    )
    return statements.clean_for_parse(odd).select("call_ord", "clean_text")


def restore_arrays(spark, sf):
    calls = adapters.workload_calls(spark, sf)
    text = F.concat(F.lit("SELECT t FROM t WHERE array_item_t.tags_"), F.col("call_ord").cast("string"), F.lit(" = 1 AND array_item_x_2 = 3"))
    return statements.restore_arrays(calls.withColumn("clean_text", text)).select("call_ord", "query_text")


def statement_kind(spark, sf):
    calls = statements.clean_for_parse(adapters.workload_calls(spark, sf))
    return statements.statement_kind(calls).groupBy("kind").agg(F.count(F.lit(1)).alias("calls"))


def dedupe(spark, sf):
    return _statements(spark, sf).select("stmt_id", "query_text", F.col("is_dynamic").cast("int").alias("is_dynamic"), "occurrences", "owner_path", "kind")


def parse_summary(spark, sf):
    return statements.parse_summary(_statements(spark, sf))


def failed(spark, sf):
    return statements.failed(_statements(spark, sf))


def first_table(spark, sf):
    tables, _ = adapters.workload_names(spark, sf)
    return predicates.first_table(_statements(spark, sf).filter("kind <> 'failed'"), tables).select(
        "stmt_id", F.col("is_dynamic").cast("int").alias("is_dynamic"), "table_name"
    )


def statement_aliases(spark, sf):
    return predicates.statement_aliases(_accepted(spark, sf))


def extract_predicates(spark, sf):
    preds = predicates.extract_predicates(_accepted(spark, sf))
    return preds.select(
        "stmt_id",
        "pred_ord",
        "left_column",
        "op",
        "expr",
        "value",
        F.col("eligible_rank").cast("int").alias("eligible_rank"),
        F.col("eligible_index").cast("int").alias("eligible_index"),
    )


def column_hits(spark, sf):
    return _hits(spark, sf)


def table_hits(spark, sf):
    return predicates.table_hits(_hits(spark, sf))


def rank_columns(spark, sf):
    return predicates.rank_columns(_hits(spark, sf), 7)


def best_columns(spark, sf):
    return predicates.best_columns(_hits(spark, sf), 1).select("table_name", "column_name", "hits")


def columns_in(spark, sf):
    preds, _ = _ranked(spark, sf)
    return predicates.columns_in(preds)


def scoped_refs(spark, sf):
    """Columns of statements whose inner query uses an outer alias for another table, with joined paths and HAVING."""
    stmts = spread_scan(table(spark, sf, "customer")).selectExpr(
        "concat('s', c_custkey) stmt_id",
        """concat('SELECT c.name FROM Customer c WHERE c.id IN (SELECT c.owner FROM Orders', c_nationkey, ' c JOIN c.box.lid l WHERE l.kind = ', c_custkey,
        ' AND day > :d GROUP BY c.day HAVING count(c.gone) > 1) AND c.seg = ''c.no'' ORDER BY c.', if(c_custkey % 2 = 0, 'rank', 'from')) query_text""",
    )
    return predicates.column_refs(stmts).select("stmt_id", "ref_ord", "qualifier", "name", "entity", F.array_join("path", ".").alias("path"))


def column_refs(spark, sf):
    refs = predicates.column_refs(_accepted(spark, sf))
    return refs.select("stmt_id", "ref_ord", "kind", "statement_table", "qualifier", "name", "entity", F.array_join("path", ".").alias("path"))


def call_site_lookup(spark, sf):
    calls = adapters.workload_calls(spark, sf)
    sites = extract.locate(_statements(spark, sf), calls)
    return sites.select("stmt_id", "path", "call_ord", "begin_line", "end_col")


def last_call_site(spark, sf):
    return extract.last_locations(adapters.workload_calls(spark, sf)).select("path", "query_text", "call_ord", "begin_line", "begin_col", "end_col")


_W, _P = "with " + sqlparts.CALLS, "with " + sqlparts.PREDICATES

QUERIES = {
    "b7_call_site_lookup": (
        call_site_lookup,
        _W + "select s.stmt_id, c.path, c.call_ord, (c.call_ord % 500 + 1)::int as begin_line, (length(c.query_text) + 9)::int as end_col from calls c join stmts s on s.query_text = c.query_text and s.is_dynamic = c.is_dynamic",
    ),
    "b7_last_call_site": (
        last_call_site,
        _W + "select path, query_text, max(call_ord) as call_ord, (max(call_ord) % 500 + 1)::int as begin_line, 9 as begin_col, (length(query_text) + 9)::int as end_col from calls group by path, query_text",
    ),
    "c1_clean_for_parse": (
        clean_for_parse,
        _W
        + """select call_ord, case call_ord % 4 when 0 then 'select * from order' || call_ord || ' o join o.lines'
          when 1 then 'select "a.b.c.d.e' || call_ord || '" from x where y = ''z'''
          when 2 then 'select t from t t where array_item_t.tags_' || call_ord || ' = 1' else query_text end as clean_text from calls""",
    ),
    "c2_restore_arrays": (
        restore_arrays,
        "select event_id as call_ord, 'select t from t where t.tags[' || event_id || '] = 1 and x[2] = 3' as query_text from events",
    ),
    "c3_statement_kind": (
        statement_kind,
        "select case when user_id % 7 = 6 then 'failed' when user_id % 7 = 5 then 'update' else 'select' end as kind, count(*) as calls from events group by 1",
    ),
    "c4_dedupe_statements": (dedupe, _W + "select stmt_id, query_text, cast(is_dynamic as int) as is_dynamic, occurrences, owner_path, kind from stmts"),
    "c5_parse_summary": (
        parse_summary,
        _W
        + """select cast(sum(occurrences) filter (not is_dynamic) as bigint) as total_static, cast(sum(occurrences) filter (is_dynamic) as bigint) as total_dynamic,
          count(*) filter (not is_dynamic) as unique_static, count(*) filter (is_dynamic) as unique_dynamic,
          count(*) filter (not is_dynamic and kind <> 'failed') as parsed, count(*) filter (not is_dynamic and kind = 'failed') as failed from stmts""",
    ),
    "c6_failed_statements": (failed, _W + "select query_text, owner_path as path from stmts where not is_dynamic and kind = 'failed'"),
    "d1_first_table": (first_table, _W + "select stmt_id, cast(is_dynamic as int) as is_dynamic, 't_' || t as table_name from stmts where kind <> 'failed'"),
    "d2_statement_aliases": (statement_aliases, _W + "select stmt_id, 'e' as alias, t as table_name from stmts where kind = 'select' and not is_dynamic"),
    "d3_extract_predicates": (
        extract_predicates,
        _P + "select stmt_id, pred_ord, lc as left_column, op, expr, v as value, cast(er as int) as eligible_rank, cast(ei as int) as eligible_index from preds",
    ),
    "d4_column_hits": (column_hits, _P + "select * from hits"),
    "d5_table_hits": (table_hits, _P + "select table_name, cast(sum(hits) as bigint) as hits from hits group by 1"),
    "d6_rank_columns": (rank_columns, _P + "select * from hits order by hits desc, table_name, column_name limit 7"),
    "d6_best_columns": (
        best_columns,
        _P + "select table_name, column_name, hits from (select *, row_number() over (partition by table_name order by hits desc, column_name) as rn from hits) where rn = 1",
    ),
    "e10_scoped_refs": (
        scoped_refs,
        """select 's' || c_custkey as stmt_id, ref_ord, qualifier, name, case own when 0 then 'customer' else 'orders' || c_nationkey end as entity, path from customer,
             (values (0, 'c', 'name', 0, 'name'), (1, 'c', 'id', 0, 'id'), (2, 'c', 'owner', 1, 'owner'), (3, 'l', 'kind', 1, 'box.lid.kind'), (4, null, 'day', 1, 'day'),
              (5, 'c', 'day', 1, 'day'), (6, 'c', 'seg', 0, 'seg')) v(ref_ord, qualifier, name, own, path)
           union all select 's' || c_custkey, 7, 'c', case when c_custkey % 2 = 0 then 'rank' else 'from' end, 'customer', case when c_custkey % 2 = 0 then 'rank' else 'from' end from customer""",
    ),
    "e10_column_refs": (
        column_refs,
        _P
        + """, named as (select stmt_id, kind, t, case u % 7 when 0 then ['value', 'user_id', 'k'] when 1 then ['value', 'k', 'user_id'] when 2 then ['value', 'name', 'user_id']
             when 3 then ['value', 'user_id', 'k', 'kind'] when 4 then ['value', 'name', 'user_id', 'k'] else ['value', 'user_id', 'k'] end as names from ok)
           select stmt_id, (generate_subscripts(names, 1) - 1)::int as ref_ord, kind, t as statement_table, case when kind = 'select' then 'e' end as qualifier, unnest(names) as name,
             t as entity, unnest(names) as path from named""",
    ),
    "d7_columns_in_predicate": (columns_in, _P + "select distinct stmt_id, lc as column_name from preds where er and lc is not null and op in ('=', '<', '<=', '<>')"),
}
