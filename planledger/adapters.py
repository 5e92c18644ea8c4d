"""Operator inputs made from the driver's tables by column expressions.

The tables hold no source code and no plans, so these functions derive them row by row:
query calls from ``events``, Java classes from ``part``, service classes from ``orders``, plan
documents from ``lineitem`` and plan nodes from ``orders`` and ``lineitem``. All are
projections, so the derived data grows with the tables. A table with fewer splits than cores
is dealt out to all cores first; a large one is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scale import spread_scan
from .sources.corpus import with_class_names
from .sources.tables import table


def workload_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: one per event, the query template chosen by the user."""
    e = spread_scan(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("call_ord"),
        F.col("event_type").alias("t"),
        F.col("user_id").alias("u"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
    )
    text = F.expr(
        """case pmod(u, 7)
        when 0 then concat('SELECT e.value FROM ', t, ' e WHERE e.user_id = ', u, ' AND e.k > ', k)
        when 1 then concat('SELECT e.value FROM ', t, ' e WHERE e.k BETWEEN ', k, ' AND ', k + 10, ' AND e.user_id <> ', u)
        when 2 then concat('SELECT e.value FROM ', t, " e WHERE e.name LIKE 'k", k, " or more%' AND e.user_id = ", u)
        when 3 then concat('SELECT e.value FROM ', t, ' e WHERE e.user_id = ', u, ' AND (e.k = ', k, ' OR ', k + 5, ' <= e.kind)')
        when 4 then concat('SELECT e.value FROM ', t, " e WHERE LOWER(e.name) = 'K", k, "' AND e.user_id IN (", u, ', ', u + 1, ') AND CAST(e.k AS integer) < ', k)
        when 5 then concat('UPDATE ', t, ' SET value = 0 WHERE user_id = ', u, ' AND k <= ', k)
        else concat('INSERT INTO ', t, ' VALUES (', u, ', ', k, ')') end"""
    )
    return e.select(
        F.concat(F.lit("svc/"), "t", F.lit("/U"), (F.col("u") % 20).cast("string"), F.lit(".java")).alias("path"),
        "call_ord",
        text.alias("query_text"),
        (F.col("call_ord") % 10 == 0).alias("is_dynamic"),
        (F.col("call_ord") % 500 + 1).cast("int").alias("begin_line"),
        F.lit(9).alias("begin_col"),
        (F.col("call_ord") % 500 + 1).cast("int").alias("end_line"),
        (F.length(text) + 9).alias("end_col"),
        F.concat(F.lit('em.createQuery("'), text, F.lit('")')).alias("call_text"),
    )


def workload_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entity tables and columns for the workload: one entity per event type."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity")).distinct()
    tables = kinds.select("entity", F.concat(F.lit("t_"), "entity").alias("table_name"))
    columns = tables.select("table_name", F.lit("k").alias("field"), F.lit("k_num").alias("column_name"))
    return tables, columns


def entity_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated classes: one per part. Two in ten are embeddable, one in seven lacks the import."""
    content = F.expr(
        """concat(
        'package shop.p', p_size, ';\n',
        if(p_partkey % 7 = 0, 'import java.util.*;\n', 'import javax.persistence.*;\n'),
        '// @Table(name = "NOT_THIS")\n',
        if(p_partkey % 5 = 4, '@Embeddable\n', concat('@Entity\n@Table(name = "PART_', p_partkey, '")\n')),
        'public class Part', p_partkey, if(p_partkey % 10 = 0, '', concat(' extends Part', p_partkey div 10 * 10)), ' {\n',
        '  @Id @Column(name = "P', p_partkey, '_KEY")\n  private Long key;\n',
        '  @Column(name = "', p_type, '_SIZE", nullable = false)\n  private int size = 1;\n',
        '  /* @Column(name = "gone") int gone; */\n',
        '  @ManyToOne\n  @JoinColumn(name = "brand_id")\n  private Part', p_partkey div 10 * 10, ' brand;\n',
        '  @OneToMany(mappedBy = "part")\n  private List<Line', p_size, '> lines;\n',
        '  @ManyToMany\n  @JoinTable(name = "PS_', p_partkey % 10, '", joinColumns = @JoinColumn(name = "ps_part"),\n',
        '    inverseJoinColumns = {@JoinColumn(name = "ps_supp"), @JoinColumn(name = "ps_nation")})\n',
        '  private Map<String, Supplier> suppliers;\n',
        '  @Embedded\n  private Part', p_partkey div 5 * 5 + 4, ' dims;\n',
        '  public int getSize() { return size; }\n}\n')"""
    )
    files = spread_scan(table(spark, sf_dir, "part")).select(
        F.expr("concat('/ws/shop/src/main/java/shop/p', p_size, '/Part', p_partkey, '.java')").alias("path"),
        content.alias("content"),
    )
    return with_class_names(files.withColumn("size", F.octet_length("content")))


def service_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that make queries: one per order, with three calls each, the second one dynamic."""
    content = F.expr(
        """concat(
        'package svc;\nimport javax.persistence.*;\npublic class Svc', o_orderkey, ' {\n',
        '  void a() { Query q = em.createQuery("select o from Orders o " + "where o.cust = ', o_custkey, '"); }\n',
        '  void b(String name) {\n',
        '    this.em.createNativeQuery("select c.id from Customer c where c.name = \\\\"" + name + "\\\\"", Cust.class);\n  }\n',
        '  void c() {\n    run(manager.createQuery("select x from T_', o_orderstatus, ' x where f(x.a, \\')\\') = :p").list());\n  }\n}\n')"""
    )
    files = spread_scan(table(spark, sf_dir, "orders")).select(
        F.concat(F.lit("svc/Svc"), F.col("o_orderkey").cast("string"), F.lit(".java")).alias("path"), content.alias("content")
    )
    return with_class_names(files.withColumn("size", F.octet_length("content")))


def hard_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with calls that are easily missed or mistaken: one per customer."""
    content = F.expr(
        """concat(
        'class Hard', c_custkey, ' {\n',
        '  // em.createQuery("select old', c_custkey, '")\n',
        '  /* em.createQuery("gone") */ String s = "em.createQuery(\\\\"no\\\\")"; char a = \\'"\\', b = \\')\\';\n',
        '  Object c = em.createQuery("select a from T where k = " + ', repeat('f(', 40), c_custkey, repeat(')', 40), ', X.class);\n',
        '  Object d = em.createQuery("select b from U where u = " + (((x))));\n',
        '  Object e = em.createQuery(("select " + ("c" + (" from V', c_custkey, '"))) /* ) */);\n}\n')"""
    )
    return spread_scan(table(spark, sf_dir, "customer")).select(F.concat(F.lit("hard/"), F.col("c_custkey").cast("string")).alias("path"), content.alias("content"))


def builder_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes whose queries are built step by step: one per customer, six calls each.

    Two methods have a builder of one name, which one of them makes anew; constants stand behind
    their use and in each other; a parameter hides a field.
    """
    content = F.expr(
        """concat(
        'class Dao', c_custkey, ' {\n  static final String COLS = "c.id, " + Dao', c_custkey, '.MORE;\n  private String p = "hidden";\n',
        '  Object one(String p) {\n    StringBuilder sb = new StringBuilder("select ").append(COLS).append(" from Customer c");\n',
        '    sb.append(" where c.seg = \\'', c_mktsegment, '\\'"); // sb.append("gone");\n',
        '    if (p != null) { sb.append(" and c.nation = ', c_nationkey, '"); }\n    Query first = em.createQuery(sb.toString(), Customer.class);\n',
        '    sb = new StringBuilder();\n    sb.append("delete from Old', c_nationkey, '");\n    return em.createQuery(sb.toString());\n  }\n\n',
        '  Object two(String p) {\n    StringBuffer sb = new StringBuffer(64);\n    sb.append("update T set a = ").append(', if(c_custkey % 2 = 0, 'p', '"1"'), ');\n    em.createNativeQuery(sb.toString());\n',
        '    String q = "select x from V";\n    q += " where k = ', c_custkey, '";\n    em.createQuery(q);\n',
        '    em.createQuery("from W where " + this.COLS + " > 0");\n    return em.createQuery(p);\n  }\n',
        '  static final String MORE = "c.name";\n}\n')"""
    )
    return spread_scan(table(spark, sf_dir, "customer")).select(F.concat(F.lit("dao/"), F.col("c_custkey").cast("string")).alias("path"), content.alias("content"))


def deep_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose annotations nest brackets ten deep: one per supplier."""
    content = F.expr(
        """concat('import javax.persistence.*;\n@Entity\n@Table(name = "S_', s_suppkey, '", x = ', repeat('(', 10), '1', repeat(')', 10), ')\n',
        'public class Supplier', s_suppkey, ' {\n  @Column(name = "deep', s_suppkey, '", length = ', repeat('f(', 10), '2', repeat(')', 10), ')\n  private int deep;\n',
        '  @Column(columnDefinition = "number(9)", name = "flat")\n  private int flat;\n}\n')"""
    )
    files = spread_scan(table(spark, sf_dir, "supplier")).select(F.expr("concat('/ws/src/main/java/d/Supplier', s_suppkey, '.java')").alias("path"), content.alias("content"))
    return with_class_names(files.withColumn("size", F.octet_length("content")))


def report_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with one query each: one per order, with the customer's statement."""
    content = F.expr(
        """concat('class Rep', o_orderkey, ' {\n  // em.createQuery("no")\n    return em.createQuery("select o from t', o_custkey % 8, ' o where o.c', o_custkey % 5,
        ' = :a and o.day >= :b and o.k = ', o_custkey, '");\n}\n')"""
    )
    return spread_scan(table(spark, sf_dir, "orders")).select(F.concat(F.lit("rep/Rep"), F.col("o_orderkey").cast("string"), F.lit(".java")).alias("path"), content.alias("content"))


def report_documents(spark: SparkSession, sf_dir: str, sites: DataFrame, bound: DataFrame) -> DataFrame:
    """One plan for each call site: a scan with the bound statement's conditions, as a database prints them."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("rep/Rep"), F.col("o_orderkey").cast("string"), F.lit(".java")).alias("path"), "o_orderkey", "o_totalprice"
    )
    marks = F.regexp_extract("bound_text", r"(t\d) o where o\.(c\d) = ('tag-\d+') and o\.day >= \{d '([\d-]+)'\}", 0)
    part = lambda group: F.regexp_extract(marks, r"(t\d) o where o\.(c\d) = ('tag-\d+') and o\.day >= \{d '([\d-]+)'\}", group)
    texts = bound.select("stmt_id", part(1).alias("t"), F.concat(F.lit("(("), part(2), F.lit(")::text = "), part(3), F.lit(") AND (day >= '"), part(4), F.lit("'::date)")).alias("filter"))
    scan = F.struct(
        F.lit("Seq Scan").alias("Node Type"), F.col("t").alias("Relation Name"), F.floor(F.col("o_totalprice") / 100).alias("Total Cost"),
        (F.col("o_orderkey") % 97).alias("Actual Total Time"), F.col("filter").alias("Filter"),
    )
    json = F.to_json(F.array(F.struct(scan.alias("Plan"), F.floor(F.col("o_totalprice") / 1000).alias("Execution Time"))))
    return sites.hint("merge").join(texts, "stmt_id").hint("merge").join(orders, "path").select(F.col("path").alias("plan_id"), "stmt_id", json.alias("json"))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files; the source stands for the class."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").alias("size"),
        F.col("source").alias("class_name"),
    )


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        F.col("html").alias("content"),
        F.octet_length("html").alias("size"),
    )


_NODE_TYPE = (
    "case concat(l_returnflag, l_linestatus) when 'RO' then 'Seq Scan' when 'RF' then 'Index Scan' when 'NO' then 'Nested Loop' "
    "when 'NF' then 'Aggregate' when 'AO' then 'Bitmap Heap Scan' else 'Sort' end"
)
_NODE_COLUMNS = (
    "plan_id, path, depth, node_type, relation_name, cast(startup_cost as double) startup_cost, "
    "cast(total_cost as double) total_cost, cast(actual_total_time as double) actual_total_time, filter, recheck_cond"
)


def flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan nodes as a table: an order is a plan, its lines are nodes below the root.

    The text order of ``path`` is pre-order, so it serves as ``node_ord``.
    """
    roots = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey plan_id",
        "explode(array("
        "named_struct('path', '000000', 'depth', 0, 'node_type', case o_orderstatus when 'F' then 'Seq Scan' when 'O' then 'Nested Loop' else 'Aggregate' end,"
        " 'relation_name', concat('orders_', o_custkey % 8), 'startup_cost', cast(o_custkey % 10 as double), 'total_cost', cast(floor(o_totalprice / 100) as double),"
        " 'actual_total_time', cast(if(o_orderkey % 11 = 0, null, o_orderkey % 97) as double),"
        " 'filter', if(o_orderstatus = 'F', concat('(c', o_custkey % 5, ' = \\'tag-', o_orderkey div 10 * 10 + o_custkey % 5, '\\')'), null), 'recheck_cond', cast(null as string)),"
        "named_struct('path', '000000.999999', 'depth', 1, 'node_type', 'Hash', 'relation_name', cast(null as string), 'startup_cost', cast(null as double),"
        " 'total_cost', cast(null as double), 'actual_total_time', cast(null as double), 'filter', cast(null as string), 'recheck_cond', cast(null as string)))) n",
    ).selectExpr("plan_id", "n.*")
    lines = spread_scan(table(spark, sf_dir, "lineitem")).selectExpr(
        "l_orderkey plan_id",
        "concat(if(l_linenumber <= 4, '000000.', '000000.999999.'), l_linenumber, '.', lpad(l_partkey, 12, '0'), '.', lpad(l_suppkey, 12, '0'), '.', lpad(cast(l_quantity as bigint), 6, '0')) path",
        "if(l_linenumber <= 4, 1, 2) depth",
        f"{_NODE_TYPE} node_type",
        "concat('t', l_partkey % 8) relation_name",
        "cast(null as double) startup_cost",
        "if(l_suppkey % 13 = 0, null, l_extendedprice) total_cost",
        "l_quantity actual_total_time",
        "if(l_returnflag = 'R' and l_linestatus = 'O', concat('(c', l_suppkey % 5, ' = \\'tag-', l_orderkey div 10 * 10 + l_suppkey % 5, '\\')'), null) filter",
        "if(l_returnflag = 'A' and l_linestatus = 'O', concat('((c', l_suppkey % 5, ' = \\'tag-', l_orderkey div 10 * 10 + l_suppkey % 5, '\\') AND (c', (l_suppkey + 2) % 5,"
        " ' = \\'tag-', l_orderkey div 10 * 10 + (l_suppkey + 2) % 5, '\\'))'), null) recheck_cond",
    )
    return roots.unionByName(lines).selectExpr("*", "path as node_ord")


def flat_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan-level measures of the same plans; ten orders share a statement."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey plan_id",
        "o_orderkey div 10 stmt_id",
        "cast(floor(o_totalprice / 100) as double) total_cost",
        "cast(o_custkey % 10 as double) startup_cost",
        "o_totalprice total_runtime",
        "if(o_orderstatus = 'P', null, cast(floor(o_totalprice / 1000) as double)) execution_time",
        "concat('select ', o_orderkey div 10) final_text",
    )


def flat_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predicates per statement; the fourth cannot lead to an index."""
    stmts = table(spark, sf_dir, "orders").selectExpr("o_orderkey div 10 stmt_id").distinct()
    return stmts.selectExpr("stmt_id", "explode(sequence(0, 4)) pred_ord").selectExpr(
        "stmt_id", "pred_ord", "concat('c', pred_ord) expr", "concat('tag-', stmt_id * 10 + pred_ord) sentinel", "pred_ord <> 3 eligible_index"
    )


def flat_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the statements are called: one place per order, some places twice."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 10 stmt_id",
        "concat('f', o_custkey % 50, '.java') path",
        "cast(o_orderkey div 10 % 90 + 1 as int) begin_line",
        "5 begin_col",
        "cast(o_orderkey div 10 % 90 + 1 as int) end_line",
        "60 end_col",
    )


def _json_node(**fields: str) -> str:
    """SQL for a JSON object; a null member is left out."""
    return "concat('{', concat_ws(',', " + ", ".join(f"concat('\"{k.replace('_', ' ')}\":', {v})" for k, v in fields.items()) + "), '}')"


def _quoted(sql: str) -> str:
    return f"concat('\"', {sql}, '\"')"


def pg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PostgreSQL plan documents: one per line item, three or four nodes, some unreadable."""

    def tag(column: str, when: str = "true") -> str:
        return f"if({when}, concat('\"(c', {column}, ' = \\'tag-', l_partkey * 10 + {column}, '\\')\"'), null)"

    grand = _json_node(
        Node_Type=_quoted("'Seq Scan'"), Relation_Name=_quoted("concat('g', l_partkey % 8)"), Total_Cost="l_extendedprice",
        Actual_Total_Time="l_quantity * 3", Recheck_Cond=tag("l_linenumber % 5"),
    )
    child = _json_node(
        Node_Type=_quoted("if(l_suppkey % 3 = 0, 'Seq Scan', 'Index Scan')"), Relation_Name=_quoted("concat('s', l_suppkey % 8)"),
        Total_Cost="floor(l_extendedprice / 2)", Plan_Rows="l_suppkey * 1000000000", Actual_Total_Time="l_quantity + l_suppkey % 7",
        Filter=tag("l_suppkey % 5", "l_suppkey % 2 = 0"), Plans=f"if(l_linenumber >= 4, concat('[', {grand}, ']'), null)",
    )
    other = _json_node(
        Node_Type=_quoted("'Index Scan'"), Relation_Name=_quoted("'idx'"), Total_Cost="floor(l_extendedprice / 4)",
        Actual_Total_Time="l_quantity * 2", Index_Cond=_quoted("'(d = 1)'"),
    )
    root = _json_node(
        Node_Type=_quoted(f"if(l_linenumber % 2 = 0, 'Nested Loop', {_NODE_TYPE})"),
        Relation_Name=_quoted("if(l_linenumber % 2 = 0, null, concat('r', l_partkey % 8))"), Startup_Cost="l_suppkey % 10",
        Total_Cost="l_extendedprice", Actual_Total_Time="if(l_suppkey % 17 = 0, null, l_quantity)",
        Filter=tag("l_partkey % 5", "l_linenumber % 2 = 1"), Sort_Key="concat('[\"a\",\"', l_returnflag, '\"]')",
        Plans=f"concat('[', {child}, ',', {other}, ']')",
    )
    document = f"""concat('[{{"Plan":', {root}, ',"Planning Time":0.5,"Execution Time":', floor(l_extendedprice / 1000), '}}]')"""
    return spread_scan(table(spark, sf_dir, "lineitem")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint)) plan_id",
        "l_partkey stmt_id",
        f"if(l_partkey % 50 = 49, '{{bad', {document}) json",
    )


def document_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predicates for each statement (part) of the plan documents."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey stmt_id", "explode(sequence(0, 4)) pred_ord").selectExpr(
        "stmt_id", "pred_ord", "concat('c', pred_ord) expr", "concat('tag-', stmt_id * 10 + pred_ord) sentinel", "pred_ord <> 3 eligible_index"
    )


def mysql_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MySQL plan documents: one per customer, some unreadable."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey plan_id",
        "c_custkey stmt_id",
        """if(c_custkey % 25 = 24, '{bad', concat('{"query_block":{"select_id":1,"r_loops":1,"r_total_time_ms":', c_acctbal,
        ',"table":{"table_name":"', lower(c_mktsegment), '","access_type":"ALL","possible_keys":["a","b"],"rows":', c_custkey * 1000000,
        ',"filtered":100,"attached_condition":"(t.c', c_custkey % 5, " = 'tag-", c_custkey, "')\\"}}}")) json""",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explain attempts: a line is one try of its order on the database numbered by the line."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey stmt_id",
        "l_linenumber db_ord",
        "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) try_ord",
        "l_partkey part",
        "l_returnflag = 'R' ok",
        "case concat(l_returnflag, l_linestatus) when 'AO' then 'errorMissingColumn' when 'AF' then 'parserOpenTable' "
        "when 'NO' then 'aclcheck_error' when 'NF' then 'other' end routine",
    )


def parameter_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with parameters: one per order, four templates."""
    return spread_scan(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey stmt_id",
        """case o_orderkey % 4
        when 0 then concat('select o from orders o where o.cust = :c and o.status like :s and o.note = ', "'it''s :x ", o_custkey, "'")
        when 1 then concat('update orders set price = ? where flag = ? and num = ', o_custkey)
        when 2 then concat('select o from orders o where cast(o.day as date) >= :d and o.total < ? and o.zone = ', o_custkey)
        else concat('select o from orders o where o.total in (:a, ', o_custkey, ', :b) and lower(o.name) = :n') end query_text""",
    )
