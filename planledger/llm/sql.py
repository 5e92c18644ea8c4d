"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP11 = r"""
with toks as (
  select d.rid, d.doc_id, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as rid, doc_id, text from documents) d
),
post as (select rid, doc_id, term, count(*) as tf from toks group by rid, doc_id, term),
sizes as (select rid, sum(tf)::bigint as n from post group by rid),
whole as (select count(*)::bigint as total, sum(n)::bigint as length from sizes),
df as (select term, count(*)::bigint as df from post group by term),
asked as (
  select item_id, term, count(*)::bigint as times
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) b
  group by item_id, term
),
scored as (
  select a.item_id, p.rid, p.doc_id,
    sum(a.times * floor(1000 * ln((2 * w.total + 2)::double / (2 * df.df + 1)::double))::bigint
      * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * s.n * w.total) // w.length))))::bigint as score
  from asked a join post p using (term) join df using (term) join sizes s on s.rid = p.rid cross join whole w
  group by a.item_id, p.rid, p.doc_id
),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

OP12 = r"""
with recursive tab as (
  select list_transform(list_transform(list_transform(list_transform(list_transform(list_transform(list_transform(list_transform(range(256),
    lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end),
    lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end),
    lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end),
    lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as t
),
marked as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault
  from conversations, tab
),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when fault = 3 then [1, 2] else [1] end) as copy
  from marked where fault <> 0
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from damaged),
faulty as (
  select *, lag(role) over w as before, trim(text, E' \t\n\x0B\f\r') as body, row_number() over (partition by conv_id, role, text order by pos) > 1 as repeated
  from placed window w as (partition by conv_id order by pos)
),
rows as (
  select *, case when body = '' then 'b' when repeated then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'x' end as initial,
    coalesce(left(before, 1) || left(role, 1) not in ('su', 'ua', 'au'), false) and before is not null as illegal
  from faulty
),
fill(s, t, role) as (values (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
inserts(s, t, cost, way, said) as (
  select x.s, x.s, 0, '', '' from fill x
  union all select s, t, 5, 'I', role || e':\n' from fill
  union all select x.s, y.t, 10, 'II', x.role || e':\n' || y.role || e':\n' from fill x join fill y on y.s = x.t
),
keeps(s, t, initial) as (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits as (
  select s, s as t, '*' as initial, 2 as cost, 'D' as way, null as role from fill
  union all select s, t, '*', 1, 'R', role from fill
  union all select s, t, initial, 0, 'K', null from keeps
),
walk as (
  select conv_id, 0::bigint as pos, 0 as s, {'cost': 0, 'way': '', 'said': ''} as best from (select distinct conv_id from rows)
  union all
  select w.conv_id, r.pos, e.t, min({
      'cost': w.best.cost + i.cost + e.cost + case when r.fault = 't' and e.way <> 'D' then 5 else 0 end,
      'way': w.best.way || i.way || e.way,
      'said': w.best.said || i.said || case e.way when 'D' then '' else coalesce(e.role, r.role) || ':' || r.text || e'\n' end})
  from walk w join rows r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1
    join inserts i on i.s = w.s join edits e on e.s = i.t and e.initial in ('*', r.initial) and (e.way = 'D' or r.fault not in ('b', 'd'))
  group by w.conv_id, r.pos, e.t
),
counted as (
  select conv_id, max(pos) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (illegal) as illegal
  from rows group by conv_id
),
ended as (
  select c.conv_id, min({'cost': w.best.cost + i.cost, 'way': w.best.way || i.way, 'said': w.best.said || i.said}) as best
  from counted c join walk w on w.conv_id is not distinct from c.conv_id and w.pos = c.n join inserts i on i.s = w.s and i.t in (0, 3) group by c.conv_id
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.way, '') as audit, sha256(coalesce(left(e.best.said, length(e.best.said) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join counted c on c.conv_id is not distinct from a.conv_id left join ended e on e.conv_id is not distinct from a.conv_id
"""
