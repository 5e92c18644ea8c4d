"""Calls, builders, variables and constants in Java source."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions.scale import spread_scan
from ..operators import extract, variables
from ..session import written
from ..sources.tables import table


def source_builders(spark, sf):
    """From Java source to query texts: builders, variables and constants of the same file resolved."""
    calls = extract.classify(variables.resolved_calls(adapters.builder_corpus(spark, sf)))
    return calls.select("path", "call_ord", "written", F.col("is_dynamic").cast("int").alias("is_dynamic"), "query_text", "begin_line")


def source_assembled(spark, sf):
    """The same texts by way of events: what each use of a builder sees."""
    events = variables.source_events(adapters.builder_corpus(spark, sf)).withColumn("builder", F.concat_ws(" ", "path", "variable", "owner"))
    # Assembling reads its events several times: the source is read once.
    seen = written(events.filter("kind in ('init', 'append', 'use')").select("builder", "at", "kind", "fragment"), "events")
    made = extract.assemble(seen, "builder", "at")
    return made.select(F.substring_index("builder", " ", 2).alias("builder"), "fragments", "query_text")


def source_assignments(spark, sf):
    """Constants and plain variables: everything assigned to them, in order."""
    events = variables.source_events(adapters.builder_corpus(spark, sf)).filter("kind in ('set', 'add')")
    return extract.fold_assignments(events.withColumn("name", F.concat_ws(" ", "path", "variable")), "name", "at", "fragment")


def nested_calls(spark, sf):
    """A query call in another one's argument, and one that a chain goes on from."""
    content = F.expr(
        """concat('class N {\n  Object o = this.em.createQuery("select p from Part p where p.k = " + em.createNativeQuery("select max(k) from T', c_nationkey,
        '", Long.class).one(),\n    X.class).with(a(b), c).list();\n}\n')"""
    )
    corpus = spread_scan(table(spark, sf, "customer")).select("c_custkey", content.alias("content"))
    return extract.extract_calls(corpus).select("c_custkey", "call_ord", "argument", "call_text", "begin_line", "begin_col", "end_line", "end_col")


_DAO = """with d as (select *, 'dao/' || c_custkey as path, 'select c.id, c.name from Customer c where c.seg = ''' || c_mktsegment || ''' and c.nation = ' || c_nationkey as first from customer)
"""

_NESTED = """with n as (select c_custkey, '"select p from Part p where p.k = " + ' as head, 'em.createNativeQuery("select max(k) from T' || c_nationkey || '", Long.class)' as inside,
  '"select max(k) from T' || c_nationkey || '"' as argument from customer)
"""

QUERIES = {
    "b1_nested_calls": (
        nested_calls,
        _NESTED
        + """select c_custkey, 0 as call_ord, head || inside || '.one()' as argument, 'this.em.createQuery(' || head || inside || '.one(),' || chr(10) || '    X.class)' as call_text,
             2 as begin_line, 14 as begin_col, 3 as end_line, 12 as end_col from n
           union all select c_custkey, 1, argument, inside, 2, (14 + 20 + length(head))::int, 2, (14 + 20 + length(head) + length(inside) - 1)::int from n""",
    ),
    "b5_source_builders": (
        source_builders,
        _DAO
        + """select path, 0 as call_ord, 'sb.toString()' as written, 0 as is_dynamic, lower(first) as query_text, 8 as begin_line from d
           union all select path, 1, 'sb.toString()', 0, 'delete from old' || c_nationkey, 11 from d
           union all select path, 2, 'sb.toString()', (c_custkey % 2 = 0)::int, case when c_custkey % 2 = 0 then '("" + "update t set a = " + p)' else 'update t set a = 1' end, 17 from d
           union all select path, 3, 'q', 0, 'select x from v where k = ' || c_custkey, 20 from d
           union all select path, 4, '"from W where " + this.COLS + " > 0"', 0, 'from w where c.id, c.name > 0', 21 from d
           union all select path, 5, 'p', 1, 'p', 22 from d""",
    ),
    "b5_source_assembled": (
        source_assembled,
        _DAO
        + """select path || ' sb' as builder, 5 as fragments, first as query_text from d union all select path || ' sb', 2, 'delete from Old' || c_nationkey from d
           union all select path || ' sb', 3, 'update T set a = ' || case when c_custkey % 2 = 0 then '' else '1' end from d""",
    ),
    "b6_source_assignments": (
        source_assignments,
        _DAO
        + """select path || ' COLS' as name, 1 as assignments, 'c.id, c.name' as query_text from d union all select path || ' MORE', 1, 'c.name' from d
           union all select path || ' p', 1, 'hidden' from d union all select path || ' q', 2, 'select x from V where k = ' || c_custkey from d
           union all select path || ' first', 1, '' from d""",
    ),
}
