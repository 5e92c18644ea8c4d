"""Common table expressions of the comparison SQL: the adapters' rows, written again from the base tables."""

CALLS = """
ev as (select event_id, event_type as t, user_id as u, cast(regexp_extract(props, '[0-9]+') as bigint) as k from events),
calls as (
  select 'svc/' || t || '/U' || (u % 20) || '.java' as path, event_id as call_ord, t, u, k, event_id % 10 = 0 as is_dynamic,
    case u % 7
      when 0 then 'select e.value from ' || t || ' e where e.user_id = ' || u || ' and e.k > ' || k
      when 1 then 'select e.value from ' || t || ' e where e.k between ' || k || ' and ' || (k + 10) || ' and e.user_id <> ' || u
      when 2 then 'select e.value from ' || t || ' e where e.name like ''k' || k || ' or more%'' and e.user_id = ' || u
      when 3 then 'select e.value from ' || t || ' e where e.user_id = ' || u || ' and (e.k = ' || k || ' or ' || (k + 5) || ' <= e.kind)'
      when 4 then 'select e.value from ' || t || ' e where lower(e.name) = ''k' || k || ''' and e.user_id in (' || u || ', ' || (u + 1) || ') and cast(e.k as integer) < ' || k
      when 5 then 'update ' || t || ' set value = 0 where user_id = ' || u || ' and k <= ' || k
      else 'insert into ' || t || ' values (' || u || ', ' || k || ')' end as query_text
  from ev),
stmts as (
  select md5(query_text || case when is_dynamic then chr(1) || 'dynamic' else '' end) as stmt_id, query_text, is_dynamic, t, u, k, count(*) as occurrences, arg_max(path, call_ord) as owner_path,
    case u % 7 when 6 then 'failed' when 5 then 'update' else 'select' end as kind
  from calls group by query_text, is_dynamic, t, u, k)
"""

# Comparison rows of the accepted static statements, template by template.
PREDICATES = (
    CALLS
    + """,
ok as (select * from stmts where not is_dynamic and kind <> 'failed'),
preds as (
  select *, 0 as pred_ord, 'user_id' as lc, null as rc, '=' as op, 'user_id' as expr, cast(u as varchar) as v, true as er, true as ei from ok where u % 7 = 0
  union all select *, 1, 'k', null, '>', 'k', cast(k as varchar), true, true from ok where u % 7 = 0
  union all select *, 0, null, null, 'between', null, null, false, false from ok where u % 7 = 1
  union all select *, 1, 'user_id', null, '<>', 'user_id', cast(u as varchar), true, true from ok where u % 7 = 1
  union all select *, 0, null, null, 'like', 'name', '''k' || k || ' or more%''', false, true from ok where u % 7 = 2
  union all select *, 1, 'user_id', null, '=', 'user_id', cast(u as varchar), true, true from ok where u % 7 = 2
  union all select *, 0, 'user_id', null, '=', 'user_id', cast(u as varchar), true, true from ok where u % 7 = 3
  union all select *, 1, null, null, '=', 'k', cast(k as varchar), false, true from ok where u % 7 = 3
  union all select *, 2, null, null, '<=', 'kind', cast(k + 5 as varchar), false, true from ok where u % 7 = 3
  union all select *, 0, null, null, '=', 'lower(name)', '''k' || k || '''', true, true from ok where u % 7 = 4
  union all select *, 1, null, null, 'in', null, null, false, false from ok where u % 7 = 4
  union all select *, 2, 'k', null, '<', 'cast(k as integer)', cast(k as varchar), true, true from ok where u % 7 = 4
  union all select *, 0, 'user_id', null, '=', 'user_id', cast(u as varchar), true, true from ok where u % 7 = 5
  union all select *, 1, 'k', null, '<=', 'k', cast(k as varchar), true, true from ok where u % 7 = 5),
hits as (
  select 't_' || t as table_name, case lc when 'k' then 'k_num' else lc end as column_name, cast(sum(occurrences) as bigint) as hits
  from preds where er and lc is not null group by 1, 2)
"""
)

# Annotated classes made from part.
PARTS = """
cls as (
  select p_partkey as k, 'part' || p_partkey as entity, 'shop.p' || p_size || '.Part' || p_partkey as qualified_class, p_partkey % 7 <> 0 as imported,
    p_partkey % 5 = 4 as embeddable, 'part_' || p_partkey as table_name, 'p' || p_partkey || '_key' as key_column, lower(p_type) || '_size' as size_column,
    p_partkey - p_partkey % 10 as base, p_partkey - p_partkey % 5 + 4 as part_of, p_size
  from part),
java as (select * from cls where imported),
tabs as (
  select entity, table_name from java where not embeddable
  union select table_name, table_name from java where not embeddable),
cols as (
  select entity, qualified_class, k, unnest([ 'key', key_column, 'size', size_column ]) as field, unnest([ key_column, key_column, size_column, size_column ]) as column_name from java)
"""

_NODE_TYPE = """case l_returnflag || l_linestatus when 'RO' then 'Seq Scan' when 'RF' then 'Index Scan' when 'NO' then 'Nested Loop'
  when 'NF' then 'Aggregate' when 'AO' then 'Bitmap Heap Scan' else 'Sort' end"""

# The flat plan log.
FLAT = f"""
nodes as materialized (
  select o_orderkey as plan_id, '000000' as path, 0 as depth,
    case o_orderstatus when 'F' then 'Seq Scan' when 'O' then 'Nested Loop' else 'Aggregate' end as node_type, 'orders_' || (o_custkey % 8) as relation_name,
    floor(o_totalprice / 100) as total_cost, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 97 as double) end as actual_total_time,
    case when o_orderstatus = 'F' then '(c' || (o_custkey % 5) || ' = ''tag-' || (o_orderkey // 10 * 10 + o_custkey % 5) || ''')' end as condition
  from orders
  union all select o_orderkey, '000000.999999', 1, 'Hash', null, null, null, null from orders
  union all
  select l_orderkey, (case when l_linenumber <= 4 then '000000.' else '000000.999999.' end) || l_linenumber || '.' || lpad(cast(l_partkey as varchar), 12, '0') || '.' || lpad(cast(l_suppkey as varchar), 12, '0') || '.' || lpad(cast(cast(l_quantity as bigint) as varchar), 6, '0'),
    case when l_linenumber <= 4 then 1 else 2 end, {_NODE_TYPE}, 't' || (l_partkey % 8), case when l_suppkey % 13 <> 0 then l_extendedprice end, l_quantity,
    case l_returnflag || l_linestatus
      when 'RO' then '(c' || (l_suppkey % 5) || ' = ''tag-' || (l_orderkey // 10 * 10 + l_suppkey % 5) || ''')'
      when 'AO' then '((c' || (l_suppkey % 5) || ' = ''tag-' || (l_orderkey // 10 * 10 + l_suppkey % 5) || ''') AND (c' || ((l_suppkey + 2) % 5) || ' = ''tag-' || (l_orderkey // 10 * 10 + (l_suppkey + 2) % 5) || '''))' end
  from lineitem),
plan as (select o_orderkey as plan_id, o_orderkey // 10 as stmt_id, floor(o_totalprice / 100) as total_cost, cast(o_custkey % 10 as double) as startup_cost,
    o_totalprice as total_runtime, case when o_orderstatus <> 'P' then floor(o_totalprice / 1000) end as execution_time from orders),
usable as materialized (select * from nodes where total_cost is not null and node_type not in ('Nested Loop', 'Aggregate')),
costliest as (select * from (select *, row_number() over (partition by plan_id order by total_cost desc, path) as rn from usable) where rn = 1),
slowest as (select * from (select *, row_number() over (partition by plan_id order by actual_total_time desc, path) as rn from usable where actual_total_time is not null) where rn = 1),
scans as (
  select n.plan_id, n.actual_total_time as score from nodes n join (select distinct plan_id from nodes where depth = 0 and actual_total_time is not null) r on r.plan_id = n.plan_id
    where n.depth <= 1 and n.node_type = 'Seq Scan' and n.actual_total_time is not null),
roots as (
  select plan_id, 'total_cost' as metric, total_cost as score from plan union all select plan_id, 'startup_cost', startup_cost from plan
  union all select plan_id, 'total_runtime', total_runtime from plan
  union all select plan_id, 'execution_time', execution_time from plan where execution_time is not null),
scores as (select * from roots union all select plan_id, 'sequence_scan', score from scans),
distinct_scores as (select distinct metric, score from scores),
stats as (select metric, count(*) as distinct_scores, avg(score) as mean, coalesce(stddev_samp(score), 0) as sd from distinct_scores group by metric)
"""


def credits(chosen: str = "") -> str:
    """Credits of the flat plan log; ``chosen`` names a relation of (stmt_id) the report is limited to."""
    only = f" and p.stmt_id in (select stmt_id from {chosen})" if chosen else ""
    source = (
        f"own as (select s.* from scores s join (select distinct plan_id from plan p where true{only}) p on p.plan_id = s.plan_id),\n"
        "own_stats as (select metric, avg(score) as mean, coalesce(stddev_samp(score), 0) as sd from (select distinct metric, score from own) group by metric),\n"
    )
    return (
        FLAT
        + ",\n"
        + source
        + """
both_picks as (select plan_id, 0 as pick_ord, relation_name as table_name, condition from costliest union all select plan_id, 1, relation_name, condition from slowest),
ordered as (
  select p.stmt_id, s.metric, s.score, b.*, row_number() over (partition by p.stmt_id order by
      case s.metric when 'total_runtime' then 1 when 'execution_time' then 2 when 'total_cost' then 3 else 4 end, s.score desc, s.plan_id, b.pick_ord, hash(s.score)) as visit
  from own s join plan p using (plan_id) join both_picks b using (plan_id) where s.metric <> 'startup_cost' and b.condition is not null),
found as (
  select o.*, cast(substr(tag, 5) as bigint) % 10 as pred, i from (
    select *, unnest(regexp_extract_all(condition, '''(tag-[0-9]+)''', 1)) as tag, generate_subscripts(regexp_extract_all(condition, '''(tag-[0-9]+)''', 1), 1) as i from ordered) o
  where cast(substr(tag, 5) as bigint) // 10 = stmt_id and cast(substr(tag, 5) as bigint) % 10 <> 3),
opening as (select stmt_id, min(visit) as first_visit from found group by stmt_id),
first_rows as (select distinct f.stmt_id, f.table_name, f.pred, f.i, o.first_visit from found f join opening o on f.stmt_id = o.stmt_id and f.visit = o.first_visit),
last_row as (select stmt_id, table_name, arg_max(pred, i) as pred, first_visit from first_rows group by stmt_id, table_name, first_visit),
credits as (
  select o.stmt_id, o.plan_id, o.metric, o.score, f.table_name, 'c' || f.pred as expr from ordered o join first_rows f on o.stmt_id = f.stmt_id and o.visit = f.first_visit
  union all
  select o.stmt_id, o.plan_id, o.metric, o.score, l.table_name, 'c' || l.pred from ordered o join last_row l on o.stmt_id = l.stmt_id and o.visit > l.first_visit),
candidates as (
  select table_name, expr, count(*) as hits, 1 + sum(case when sd > 0 and score > mean + sd then ((score - mean) / sd) * ((score - mean) / sd) else 0 end) as multiplier
  from credits join own_stats using (metric) group by table_name, expr),
ranked as (select *, cast(floor(hits * multiplier) as bigint) as priority from candidates),
sites as (select o_orderkey // 10 as stmt_id, 'f' || (o_custkey % 50) || '.java' as path, (o_orderkey // 10 % 90 + 1)::int as begin_line, 5 as begin_col, (o_orderkey // 10 % 90 + 1)::int as end_line, 60 as end_col from orders)
"""
    )


# The plan documents, as nodes.
DOCUMENTS = f"""
li as materialized (select *, row_number() over () as rid, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as bigint) || '-' || cast(round(l_extendedprice * 100) as bigint) as plan_id, {_NODE_TYPE} as nt from lineitem),
good as (select * from li where l_partkey % 50 <> 49),
nodes as materialized (
  select rid, plan_id, l_partkey as stmt_id, '000000' as path, cast(null as varchar) as parent_path, 0 as depth, 0 as node_ord, case when l_linenumber % 2 = 0 then 'Nested Loop' else nt end as node_type,
    case when l_linenumber % 2 = 1 then 'r' || (l_partkey % 8) end as relation_name, cast(l_suppkey % 10 as double) as startup_cost, l_extendedprice as total_cost, cast(null as bigint) as plan_rows,
    case when l_suppkey % 17 <> 0 then l_quantity end as actual_total_time, case when l_linenumber % 2 = 1 then '(c' || (l_partkey % 5) || ' = ''tag-' || (l_partkey * 10 + l_partkey % 5) || ''')' end as filter,
    cast(null as varchar) as recheck_cond, cast(null as varchar) as index_cond, 'a,' || l_returnflag as sort_key from good
  union all
  select rid, plan_id, l_partkey, '000000.000000', '000000', 1, 1, case when l_suppkey % 3 = 0 then 'Seq Scan' else 'Index Scan' end, 's' || (l_suppkey % 8), null, floor(l_extendedprice / 2), l_suppkey * 1000000000,
    l_quantity + l_suppkey % 7, case when l_suppkey % 2 = 0 then '(c' || (l_suppkey % 5) || ' = ''tag-' || (l_partkey * 10 + l_suppkey % 5) || ''')' end, null, null, null from good
  union all
  select rid, plan_id, l_partkey, '000000.000000.000000', '000000.000000', 2, 2, 'Seq Scan', 'g' || (l_partkey % 8), null, l_extendedprice, null, l_quantity * 3, null,
    '(c' || (l_linenumber % 5) || ' = ''tag-' || (l_partkey * 10 + l_linenumber % 5) || ''')', null, null from good where l_linenumber >= 4
  union all
  select rid, plan_id, l_partkey, '000000.000001', '000000', 1, case when l_linenumber >= 4 then 3 else 2 end, 'Index Scan', 'idx', null, floor(l_extendedprice / 4), null, l_quantity * 2, null, null, '(d = 1)', null from good),
usable as materialized (select * from nodes where total_cost is not null and node_type not in ('Nested Loop', 'Aggregate')),
costliest as (select *, coalesce(filter, recheck_cond) as condition from (select *, row_number() over (partition by rid order by total_cost desc, path) as rn from usable) where rn = 1),
slowest as (select *, coalesce(filter, recheck_cond) as condition from (select *, row_number() over (partition by rid order by actual_total_time desc, path) as rn from usable where actual_total_time is not null) where rn = 1)
"""
