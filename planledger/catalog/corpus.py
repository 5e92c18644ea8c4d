"""Corpus scans and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import extract
from ..session import work_dir
from ..sources import corpus as src
from ..sources.sinks import write_files, write_report
from ..sources.tables import table
from ..streaming.incremental import scan_new_files


def scan_corpus(spark, sf):
    """Pages are written as one file each, then scanned like a source tree."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("value"))
    files = src.scan_corpus(spark, [write_files(pages, work_dir(spark, "tree"))], glob="*.txt")
    return files.select(
        F.regexp_extract("path", r"/(?:name=)?p(\d+)(?:\.txt$|/)", 1).cast("bigint").alias("page_id"),
        "size",
        F.md5(F.encode(F.regexp_replace("content", r"\n$", ""), "utf-8")).alias("content_md5"),
    )


def _java_paths(spark, sf):
    return table(spark, sf, "customer").select(
        F.expr(
            """concat('/ws/', lower(c_mktsegment), case c_custkey % 4
            when 0 then concat('/mod', c_nationkey, '/src/main/java/a/C') when 1 then concat('/mod', c_nationkey, '/sub/src/main/java/x/src/main/java/C')
            when 2 then '/lib/C' else concat('/other', c_custkey % 100, '/src/main/java/C') end, c_custkey, '.java')"""
        ).alias("path")
    )


def source_roots(spark, sf):
    return src.source_roots(_java_paths(spark, sf))


def fingerprint(spark, sf):
    return src.with_fingerprint(adapters.document_corpus(spark, sf), "md5").select("doc_id", "fingerprint")


def fingerprint_crc32(spark, sf):
    """The 32-bit form: the parts that SQL can check, and how many keys differ."""
    keyed = src.with_fingerprint(adapters.document_corpus(spark, sf))
    return keyed.agg(F.countDistinct("fingerprint").alias("keys"), F.sum((F.length("fingerprint") > 9).cast("int")).alias("well_formed"))


def fingerprint_crc32_values(spark, sf):
    """The same form with its values, of the benchmark texts as files."""
    files = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("content"), F.concat(F.lit("B"), "item_id").alias("class_name"))
    return src.with_fingerprint(files).select("item_id", "fingerprint")


def incremental_scan(spark, sf):
    docs = src.with_fingerprint(adapters.document_corpus(spark, sf), "md5")
    done = docs.filter("doc_id % 2 = 0").select("fingerprint")
    new, reused = src.incremental(docs, done)
    return new.select("doc_id", F.lit("new").alias("state")).unionByName(reused.select("doc_id", F.lit("reused").alias("state")))


def incremental_stream(spark, sf):
    """Two runs of the stream over the same table: the second one finds nothing new.

    A table is one file or a folder of files. Its name is a pattern, because a stream takes a plain
    path for a folder, and files in the table's folder have names of their own.
    """
    schema = table(spark, sf, "documents").schema
    docs = src.with_fingerprint(adapters.document_corpus(spark, sf), "md5")
    done = docs.filter("doc_id % 2 = 0").select("fingerprint")
    out, checkpoint = work_dir(spark, "stream-out"), work_dir(spark, "stream-checkpoint")

    def to_corpus(rows):
        return rows.select("doc_id", F.col("text").alias("content"), F.col("source").alias("class_name"))

    for _ in range(2):
        rows = scan_new_files(
            spark, f"{sf.rstrip('/')}/documents.parque[t]", schema, to_corpus, out, checkpoint, done=done,
            extract=lambda c: c.select("doc_id", F.octet_length("content").alias("size")),
        )
    return rows.select("doc_id", F.col("size").cast("bigint").alias("size"))


def prefilter(spark, sf):
    return src.prefilter(adapters.entity_corpus(spark, sf)).select("class_name", "qualified_class")


def write_and_read_report(spark, sf):
    report = extract.extract_calls(adapters.page_corpus(spark, sf), ["track"]).select("path", "call_text")
    return spark.read.schema(report.schema).json(write_report(report, work_dir(spark, "report"), "json"))


def page_calls(spark, sf):
    calls = extract.extract_calls(adapters.page_corpus(spark, sf), ["track"])
    return calls.select("path", "call_ord", "argument", "call_text", "begin_line", "begin_col", "end_line", "end_col")


def service_calls(spark, sf):
    calls = extract.extract_calls(adapters.service_corpus(spark, sf))
    return calls.select("class_name", "call_ord", "begin_line", "begin_col", "end_line", "end_col", "call_text")


def fold_concat(spark, sf):
    calls = extract.fold_concat(extract.extract_calls(adapters.service_corpus(spark, sf)))
    return calls.select("class_name", "call_ord", "query_text")


def classify(spark, sf):
    calls = extract.classify(extract.extract_calls(adapters.service_corpus(spark, sf)))
    return calls.select("class_name", "call_ord", F.col("is_dynamic").cast("int").alias("is_dynamic"), "query_text")


def expand_variants(spark, sf):
    frags = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        """inline(array(struct(2 as seq, array(' order by 1', '', '') as alts, false as dyn),
        struct(0 as seq, array(concat('select * from c where k = ', c_custkey)) as alts, false as dyn),
        struct(1 as seq, array(concat(' and seg = ', c_mktsegment), ' and seg is null') as alts, c_nationkey = 0 as dyn)))""",
    )
    out = extract.expand_variants(frags, "c_custkey", "seq", "alts", "dyn")
    return out.select("c_custkey", F.col("is_dynamic").cast("int").alias("is_dynamic"), "query_text")


def _builder_events(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "inline(array(struct(turn * 2 as at, if(role = 'user', 'init', 'append') as kind, text as fragment),"
        " struct(turn * 2 + 1 as at, if(role = 'assistant', 'use', 'none') as kind, '' as fragment)))"
    )


def assemble_appends(spark, sf):
    return extract.assemble(_builder_events(spark, sf), "conv_id", "at").select("conv_id", "use_at", "init_at", "fragments", "query_text")


def assignments_union(spark, sf):
    """A variable is all user turns of a conversation."""
    users = table(spark, sf, "conversations").filter("role = 'user'").selectExpr("cast(conv_id as string) variable", "turn", "text")
    return extract.fold_assignments(users, "variable", "turn", "text")


def scan_summary(spark, sf):
    corpus = adapters.page_corpus(spark, sf).select("path").unionByName(adapters.document_corpus(spark, sf).select("path"))
    calls = extract.extract_calls(adapters.page_corpus(spark, sf), ["track"])
    return extract.scan_summary(corpus, calls)


_SERVICE = """with svc as (
  select 'Svc' || o_orderkey as class_name, 0 as call_ord, 4 as begin_line, 24 as begin_col, 4 as end_line, 'em.createQuery("select o from Orders o " + "where o.cust = ' || o_custkey || '")' as call_text,
    0 as is_dynamic, 'select o from orders o where o.cust = ' || o_custkey as query_text, 'select o from orders o where o.cust = ' || o_custkey as folded from orders
  union all select 'Svc' || o_orderkey, 1, 6, 5, 6, 'this.em.createNativeQuery("select c.id from Customer c where c.name = \\"" + name + "\\"", Cust.class)', 1,
    '"select c.id from customer c where c.name = \\"" + name + "\\""', 'select c.id from customer c where c.name = \\"\\"' from orders
  union all select 'Svc' || o_orderkey, 2, 9, 9, 9, 'manager.createQuery("select x from T_' || o_orderstatus || ' x where f(x.a, '')'') = :p")', 0,
    'select x from t_' || lower(o_orderstatus) || ' x where f(x.a, '')'') = :p', 'select x from t_' || lower(o_orderstatus) || ' x where f(x.a, '')'') = :p' from orders)
"""

def hard_calls(spark, sf):
    """Comments, strings, characters and deep brackets round the calls."""
    calls = extract.classify(extract.extract_calls(adapters.hard_corpus(spark, sf)))
    return calls.select("path", "call_ord", "argument", F.col("is_dynamic").cast("int").alias("is_dynamic"), "query_text", "begin_line", "begin_col", "end_line", "end_col")


_HARD = """with h as (
  select 'hard/' || c_custkey as path, 0 as call_ord, '"select a from T where k = " + ' || repeat('f(', 40) || c_custkey || repeat(')', 40) as argument, ', X.class' as rest, 1 as is_dynamic, null as folded, 4 as line from customer
  union all select 'hard/' || c_custkey, 1, '"select b from U where u = " + (((x)))', '', 1, null, 5 from customer
  union all select 'hard/' || c_custkey, 2, '("select " + ("c" + (" from V' || c_custkey || '")))', ' /* ) */', 0, 'select c from v' || c_custkey, 6 from customer)
select path, call_ord, argument, is_dynamic, coalesce(folded, lower(argument)) as query_text, line as begin_line, 14 as begin_col, line as end_line,
  (13 + 16 + length(argument) + length(rest))::int as end_col from h"""

_STEP = "lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"


def _table(rounds: int) -> str:
    """SQL for what the checksum adds for each byte: as many shifts of a number as a byte has bits."""
    return f"list_transform({_table(rounds - 1)}, {_STEP})" if rounds else "range(256)"


_CRC32 = f"""with tab as (select {_table(8)} as t),
  hexed as (select item_id, strlen(text) as size, hex(encode(text)) as digits from benchmark),
  bytes as (select *, list_transform(range(size), lambda i: (instr('0123456789ABCDEF', digits[2 * i + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 17)::bigint) as b from hexed)
select item_id, lpad(lower(to_hex(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1])), 4294967295))), 8, '0') || '-' || size || 'B' || item_id as fingerprint
from bytes, tab"""

QUERIES = {
    "b1_hard_calls": (hard_calls, _HARD),
    "a1_scan_corpus": (
        scan_corpus,
        "select page_id, strlen(html) + 1 as size, md5(html) as content_md5 from pages",
    ),
    "a2_source_roots": (
        source_roots,
        """with p as (select distinct case c_custkey % 4 when 0 then '/ws/' || lower(c_mktsegment) || '/mod' || c_nationkey
             when 1 then '/ws/' || lower(c_mktsegment) || '/mod' || c_nationkey || '/sub' else '/ws/' || lower(c_mktsegment) || '/other' || (c_custkey % 100) end as project
           from customer where c_custkey % 4 <> 2)
           select project || '/src/main/java' as root from p where not exists (select 1 from p q where starts_with(p.project, q.project || '/'))""",
    ),
    "a3_fingerprint": (fingerprint, "select doc_id, md5(text) || '-' || strlen(text) || source as fingerprint from documents"),
    "a3_fingerprint_crc32": (
        fingerprint_crc32,
        "select count(distinct md5(text) || '-' || strlen(text) || source) as keys, count(*) as well_formed from documents",
    ),
    "a3_fingerprint_crc32_values": (fingerprint_crc32_values, _CRC32),
    "a4_incremental_scan": (
        incremental_scan,
        """select doc_id, case when (text, source) in (select (text, source) from documents where doc_id % 2 = 0) then 'reused' else 'new' end as state from documents""",
    ),
    "a4_incremental_stream": (
        incremental_stream,
        "select doc_id, strlen(text) as size from documents where (text, source) not in (select (text, source) from documents where doc_id % 2 = 0)",
    ),
    "a5_prefilter": (
        prefilter,
        "select 'Part' || p_partkey as class_name, 'shop.p' || p_size || '.Part' || p_partkey as qualified_class from part where p_partkey % 7 <> 0",
    ),
    "a8_write_report": (
        write_and_read_report,
        "select 'pages/' || page_id as path, unnest(regexp_extract_all(html, 'track\\([^)]*\\)')) as call_text from pages",
    ),
    "b1_page_calls": (
        page_calls,
        """with c as (select page_id, html, regexp_extract(html, 'track\\([^)]*\\)') as call_text from pages)
           select 'pages/' || page_id as path, 0 as call_ord, regexp_extract(call_text, '\\((.*)\\)', 1) as argument, call_text,
             (length(head) - length(replace(head, chr(10), '')) + 1)::int as begin_line, (instr(html, call_text) - coalesce(last_break, 0))::int as begin_col,
             (length(head) - length(replace(head, chr(10), '')) + 1)::int as end_line, (instr(html, call_text) - coalesce(last_break, 0) + length(call_text) - 1)::int as end_col
           from (select *, substr(html, 1, instr(html, call_text) - 1) as head, length(substr(html, 1, instr(html, call_text) - 1)) - coalesce(nullif(instr(reverse(substr(html, 1, instr(html, call_text) - 1)), chr(10)), 0) - 1, length(substr(html, 1, instr(html, call_text) - 1))) as last_break
             from c where call_text <> '')""",
    ),
    "b1_service_calls": (
        service_calls,
        _SERVICE + "select class_name, call_ord, begin_line, begin_col, end_line, (begin_col + length(call_text) - 1)::int as end_col, call_text from svc",
    ),
    "b2_fold_concat": (fold_concat, _SERVICE + "select class_name, call_ord, folded as query_text from svc"),
    "b3_classify_static_dynamic": (classify, _SERVICE + "select class_name, call_ord, is_dynamic, query_text from svc"),
    "b4_expand_variants": (
        expand_variants,
        """select c_custkey, cast(c_nationkey = 0 as int) as is_dynamic, 'select * from c where k = ' || c_custkey || m || t as query_text
           from (select *, unnest([' and seg = ' || c_mktsegment, ' and seg is null']) as m from customer), (values (' order by 1'), ('')) v(t)""",
    ),
    "b5_assemble_appends": (
        assemble_appends,
        """with w as (select *, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows unbounded preceding) as init_turn from conversations)
           select u.conv_id, u.turn * 2 + 1 as use_at, u.init_turn * 2 as init_at, count(*)::int as fragments, string_agg(p.text, '' order by p.turn) as query_text
           from w u join w p on p.conv_id = u.conv_id and p.init_turn = u.init_turn and p.turn <= u.turn where u.role = 'assistant' group by 1, 2, 3""",
    ),
    "b6_assignments_union": (
        assignments_union,
        "select cast(conv_id as varchar) as variable, count(*) as assignments, string_agg(text, '' order by turn) as query_text from conversations where role = 'user' group by 1",
    ),
    "b8_scan_summary": (
        scan_summary,
        """select (select count(*) from pages) + (select count(*) from documents) as scanned_files, count(*) as files_with_queries,
           cast(sum(len(regexp_extract_all(html, 'track\\([^)]*\\)'))) as bigint) as variations from pages where html like '%track(%'""",
    ),
}
