"""Entity metadata from annotated classes, and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import metadata
from ..session import written
from ..sources.corpus import prefilter
from ..sources.tables import table
from . import sqlparts


def _classes(spark, sf):
    return prefilter(adapters.entity_corpus(spark, sf))


def entity_tables(spark, sf):
    return metadata.entity_tables(_classes(spark, sf))


def embeddables(spark, sf):
    return metadata.embeddables(_classes(spark, sf))


def entity_columns(spark, sf):
    return metadata.entity_columns(_classes(spark, sf))


def entity_ids(spark, sf):
    return metadata.entity_ids(_classes(spark, sf))


def entity_types(spark, sf):
    return metadata.entity_types(_classes(spark, sf))


def associations(spark, sf):
    links = metadata.associations(_classes(spark, sf))
    return links.withColumn("join_columns", F.concat_ws(",", "join_columns")).withColumn("inverse_columns", F.concat_ws(",", "inverse_columns"))


def class_parents(spark, sf):
    return metadata.class_parents(_classes(spark, sf))


def _facts(spark, sf):
    return written(metadata.class_facts(_classes(spark, sf)), "class-facts")


def inherit_columns(spark, sf):
    facts = _facts(spark, sf)
    return metadata.inherit(metadata.entity_columns(facts), metadata.class_parents(facts))


def inherit_types(spark, sf):
    facts = _facts(spark, sf)
    return metadata.inherit_types(metadata.entity_types(facts), metadata.class_parents(facts))


def inline_embedded(spark, sf):
    facts = _facts(spark, sf)
    return metadata.inline_embedded(metadata.entity_columns(facts), metadata.associations(facts), metadata.embeddables(facts))


def resolve_types(spark, sf):
    classes = _classes(spark, sf)
    customers = table(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) entity", "'nat_id' column_name", "if(c_acctbal < 0, 'Long', concat('C', c_custkey div 2)) type_name"
    )
    types = metadata.entity_types(classes).unionByName(customers)
    return metadata.resolve_types(types, metadata.entity_tables(classes))


def _nation_names(spark, sf):
    nation = table(spark, sf, "nation")
    tables = nation.selectExpr("concat('n', n_nationkey) entity", "lower(n_name) table_name")
    columns = nation.selectExpr("lower(n_name) table_name", "concat('k', n_regionkey) field", "concat('col_', n_nationkey) column_name")
    return tables, columns


def resolve_names(spark, sf):
    refs = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('N', o_custkey % 40) table_ref", "concat('k', o_orderkey % 5) column_ref"
    )
    tables, columns = _nation_names(spark, sf)
    return metadata.resolve_names(refs, tables, columns)


def qualify_columns(spark, sf):
    tables, columns = _nation_names(spark, sf)
    links = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) entity", "'brand' field", "'many_to_one' kind", "concat('brand_', n_nationkey) link_column")
    orders = table(spark, sf, "orders").withColumn("st", F.expr("concat('n', o_custkey % 40)"))
    refs = orders.selectExpr(
        "o_orderkey stmt_id",
        "if(o_orderstatus = 'O', 'update', 'select') kind",
        "st statement_table",
        "case o_orderkey % 4 when 0 then 'a' when 2 then concat('n', (o_custkey + 1) % 40) end qualifier",
        "case o_orderkey % 6 when 0 then 'k0' when 1 then 'brand' when 2 then 'true' when 3 then 'a' when 4 then concat('k', o_orderkey % 5) else st end name",
    )
    aliases = orders.filter("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").selectExpr("o_orderkey stmt_id", "'a' alias", "st table_name")
    out = metadata.qualify(refs, aliases, tables, columns, links)
    return out.select("stmt_id", "out_qualifier", "out_column")


def same_table_failover(spark, sf):
    customer = table(spark, sf, "customer")
    tables = customer.selectExpr("concat('c', c_custkey) entity", "concat('t', c_custkey % 100) table_name")
    links = customer.selectExpr("concat('c', c_custkey) entity", "concat('f', c_nationkey % 3) field", "if(c_acctbal < 3000, null, concat('l', c_custkey)) link_column")
    return metadata.first_links(links, tables)


_J = "with " + sqlparts.PARTS


def deep_tables(spark, sf):
    return metadata.entity_tables(adapters.deep_corpus(spark, sf))


def deep_columns(spark, sf):
    """Annotations with brackets ten deep, and brackets inside a string."""
    return metadata.entity_columns(adapters.deep_corpus(spark, sf))


QUERIES = {
    "e1_deep_annotations": (
        deep_tables,
        "select 'supplier' || s_suppkey as entity, 's_' || s_suppkey as table_name from supplier union all select 's_' || s_suppkey, 's_' || s_suppkey from supplier",
    ),
    "e2_deep_annotations": (
        deep_columns,
        """select 'supplier' || s_suppkey as entity, 'Supplier' || s_suppkey as qualified_class, unnest(['deep', 'deep' || s_suppkey, 'flat']) as field,
          unnest(['deep' || s_suppkey, 'deep' || s_suppkey, 'flat']) as column_name from supplier""",
    ),
    "e1_entity_tables": (entity_tables, _J + "select * from tabs"),
    "e1_embeddables": (embeddables, _J + "select entity from java where embeddable"),
    "e2_entity_columns": (entity_columns, _J + "select entity, qualified_class, field, column_name from cols"),
    "e3_entity_ids": (entity_ids, _J + "select entity, qualified_class, 'id' as field, key_column as column_name from java"),
    "e4_entity_types": (
        entity_types,
        _J
        + """select entity, key_column as column_name, 'Long' as type_name from java union all select entity, size_column, 'Integer' from java
             union all select entity, 'brand_id', 'Part' || base from java""",
    ),
    "e5_associations": (
        associations,
        _J
        + """, a as (select entity, 'brand' as field, 'many_to_one' as kind, 'Part' || base as target_entity, 'brand_id' as link_column, null as mapped_by, null as join_table, '' as join_columns, '' as inverse_columns from java
             union all select entity, 'lines', 'one_to_many', 'Line' || p_size, null, 'part', null, '', '' from java
             union all select entity, 'suppliers', 'join_table', 'Supplier', null, null, 'ps_' || (k % 10), 'ps_part', 'ps_supp,ps_nation' from java
             union all select entity, 'dims', 'embedded', 'Part' || part_of, null, null, null, '', '' from java) select * from a""",
    ),
    "e6_class_parents": (class_parents, _J + "select entity, 'part' || base as parent from java where k % 10 <> 0"),
    "e6_inherit_columns": (
        inherit_columns,
        _J
        + """, gain as (select c.entity, p.field, p.column_name from java c join cols p on p.k = c.base where c.k % 10 <> 0),
             both_rows as (select entity, field, column_name, 1 as r from cols union all select entity, field, column_name, 0 from gain)
             select entity, field, arg_min(column_name, r) as column_name from both_rows group by entity, field""",
    ),
    "e6_inherit_types": (
        inherit_types,
        _J
        + """, t as (select k, entity, unnest([key_column, size_column, 'brand_id']) as column_name, unnest(['Long', 'Integer', 'Part' || base]) as type_name from java),
             both_rows as (select entity, column_name, type_name, 1 as r from t
               union all select c.entity, p.column_name, p.type_name, 0 from java c join t p on p.k = c.base where c.k % 10 <> 0)
             select entity, column_name, arg_min(type_name, r) as type_name from both_rows group by entity, column_name""",
    ),
    "e7_inline_embedded": (
        inline_embedded,
        _J
        + """, gain as (select c.entity, p.field, p.column_name from java c join java e on e.k = c.part_of and e.embeddable join cols p on p.k = e.k),
             both_rows as (select entity, field, column_name, 1 as r from cols union all select entity, field, column_name, 0 from gain)
             select entity, field, arg_min(column_name, r) as column_name from both_rows group by entity, field""",
    ),
    "e8_resolve_types": (
        resolve_types,
        _J
        + """, typed as (
             select case when embeddable then entity else table_name end as table_name, unnest([key_column, size_column, 'brand_id']) as column_name, unnest(['Long', 'Integer', 'Part' || base]) as type_name from java
             union all select 'c' || c_custkey, 'nat_id', case when c_acctbal < 0 then 'Long' else 'C' || (c_custkey // 2) end from customer),
             target as (select t.*, case when type_name not in ('Boolean', 'Long', 'Integer', 'Date', 'String') then coalesce(x.table_name, lower(type_name)) end as target_table from typed t left join tabs x on x.entity = lower(t.type_name))
             select t.table_name, t.column_name, coalesce(o.type_name, t.type_name) as type_name from target t left join typed o on o.table_name = t.target_table and o.column_name = t.column_name""",
    ),
    "e9_resolve_names": (
        resolve_names,
        """select o_orderkey, 'N' || (o_custkey % 40) as table_ref, 'k' || (o_orderkey % 5) as column_ref, coalesce(lower(n_name), 'N' || (o_custkey % 40)) as table_name,
             case when n_regionkey = o_orderkey % 5 then 'col_' || n_nationkey else 'k' || (o_orderkey % 5) end as column_name
           from orders left join nation on n_nationkey = o_custkey % 40""",
    ),
    "e10_qualify_columns": (
        qualify_columns,
        """with r as (
             select o_orderkey as stmt_id, o_orderstatus <> 'O' as is_select, 'n' || (o_custkey % 40) as st, (o_orderkey % 2 = 0 or o_orderkey % 3 = 0) as has_alias,
               case o_orderkey % 4 when 0 then 'a' when 2 then 'n' || ((o_custkey + 1) % 40) end as q,
               case o_orderkey % 4 when 2 then (o_custkey + 1) % 40 else o_custkey % 40 end as nk,
               case o_orderkey % 6 when 0 then 'k0' when 1 then 'brand' when 2 then 'true' when 3 then 'a' when 4 then 'k' || (o_orderkey % 5) else 'n' || (o_custkey % 40) end as name, o_custkey % 40 as own
             from orders),
           t as (select r.*, coalesce(lower(n.n_name), 'n' || r.nk) as tab, n.n_nationkey, coalesce(lower(m.n_name), r.st) as own_table,
               case when n.n_regionkey is not null and r.name = 'k' || n.n_regionkey then 'col_' || n.n_nationkey when n.n_nationkey is not null and r.name = 'brand' then 'brand_' || n.n_nationkey else r.name end as col
             from r left join nation n on n.n_nationkey = r.nk left join nation m on m.n_nationkey = r.own),
           w as (select *, q is null and ((name = 'a' and has_alias) or coalesce((select lower(n_name) from nation where 'n' || n_nationkey = t.name), name) = own_table) as whole,
               case when has_alias and tab = own_table then 'a' else tab end as shown from t)
           select stmt_id, case when whole then case when name = 'a' and has_alias then 'a' else shown end when q is not null then q
               when col in ('true', 'false') or shown = col or not is_select then null else shown end as out_qualifier,
             case when whole then '*' else col end as out_column from w""",
    ),
    "e11_same_table_failover": (
        same_table_failover,
        """select 't' || (c_custkey % 100) as table_name, 'f' || (c_nationkey % 3) as field, arg_min('l' || c_custkey, 'c' || c_custkey) as link_column, min('c' || c_custkey) as entity
           from customer where c_acctbal >= 3000 group by 1, 2""",
    ),
}
