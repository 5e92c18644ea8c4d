"""Query parameters: finding, typing, sentinel values, binding, and finding them again in plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure, text
from .metadata import KNOWN_TYPES

# The sentinel date and timestamp.
SENTINEL_DATE = "1992-09-28"
SENTINEL_TIMESTAMP = "1992-09-28 10:10:15"

# Fixed pairs: type named in a CAST and the column type it stands for.
CAST_TYPES = {"integer": "Integer", "long": "Long", "timestamp": "Timestamp", "date": "Date"}

_PARAMETER = r"(?<![:\w]):[a-z_]\w*|\?[0-9]*"
_NAME = rf"(?<![\w.:{text.LIT_OPEN}])[a-z_][\w$]*(?:\.[a-z_][\w$]*)*+(?!\s*\(|[\w.])"
_KEYWORDS = (
    "and or not like ilike between in is null exists select from where group by order having as asc desc set "
    "update delete on join inner left right outer case when then else end all any distinct limit true false"
).split()


def find_parameters(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """One row per ``?`` or ``:name``, in text order, with what types it.

    ``column_ref`` is the last column named before the parameter, null where there is none, as
    at the head of a select list. ``in_like`` and ``cast_type`` describe the comparison.
    """
    step = statements.withColumn("_text", text.mask_literals(F.lower(col)))
    step = step.withColumn("_tokens", F.regexp_extract_all("_text", F.lit(_PARAMETER), F.lit(0)))
    step = step.withColumn("_gaps", F.split("_text", _PARAMETER))

    # Last column named in each gap, then carried forward: one pass over the clause.
    def last_name(gap: Column) -> Column:
        plain = F.when(F.contains(gap, F.lit("cast")), F.regexp_replace(gap, r"\bcast\s*\(\s*([\w.]+)\s+as\s+\w+\s*\)", "$1")).otherwise(gap)
        names = F.filter(F.regexp_extract_all(plain, F.lit(_NAME), F.lit(0)), lambda n: ~n.isin(*_KEYWORDS))
        return F.get(names, F.size(names) - 1)

    # The gap behind the last parameter names nothing for it. Where every gap names a column, nothing is carried.
    names = F.transform(F.slice("_gaps", F.lit(1), F.size("_gaps") - 1), last_name)
    carried = structure.let(
        names,
        lambda n: F.when(F.exists(n, lambda x: x.isNull()), structure.running(n, lambda before, own: F.coalesce(own, before))).otherwise(n),
    )
    # As many elements as gaps, one more than parameters: the last has no token.
    found = F.filter(
        F.arrays_zip(F.col("_tokens").alias("token"), carried.alias("column_ref"), F.col("_gaps").alias("before"), F.slice("_gaps", 2, 1 << 30).alias("after")),
        lambda p: p["token"].isNotNull(),
    )
    step = step.select(*statements.columns, F.posexplode_outer(found).alias("param_ord", "_p")).filter("_p is not null")
    left_cast = F.regexp_extract("_p.before", r"\bcast\s*\([^()]*\bas\s+(\w+)[^()]*\)\s*(?:=|<>|!=|<=|>=|<|>)\s*$", 1)
    right_cast = F.regexp_extract("_p.after", r"^\s*(?:=|<>|!=|<=|>=|<|>)\s*cast\s*\([^()]*\bas\s+(\w+)", 1)
    named = F.startswith("_p.token", F.lit(":"))
    return step.select(
        *statements.columns,
        F.col("param_ord").cast("int").alias("param_ord"),
        F.col("_p.token").alias("token"),
        F.col("_p.column_ref").alias("column_ref"),
        (named & F.col("_p.before").rlike(r"\blike\s*$")).alias("in_like"),
        F.coalesce(F.nullif(left_cast, F.lit("")), F.nullif(right_cast, F.lit(""))).alias("cast_type"),
    )


def infer_types(params: DataFrame, types: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``type_name`` to parameters that carry ``table_name`` and ``column_name``.

    First match of: named parameter in LIKE → String; CAST on the other side → its type; link
    column without a basic type → type of the target's id; declared type; String.
    ``types``: table_name, column_name, type_name. ``links``: table_name, link_column,
    target_table. ``ids``: table_name, id_column.
    """
    declared = types.select("table_name", "column_name", F.col("type_name").alias("_declared"))
    id_types = ids.join(
        types.select("table_name", F.col("column_name").alias("id_column"), F.col("type_name").alias("_id_type")),
        ["table_name", "id_column"],
    ).select(F.col("table_name").alias("target_table"), "_id_type")
    link_types = (
        links.join(id_types, "target_table")
        .groupBy("table_name", F.col("link_column").alias("column_name"))
        .agg(F.max("_id_type").alias("_link_type"))
    )
    casts = F.create_map(*[F.lit(x) for pair in CAST_TYPES.items() for x in pair])
    known = F.coalesce(F.col("_declared").isin(*KNOWN_TYPES), F.lit(False))
    # Columns are few, parameters many: each distinct column is looked up, and the parameters meet the result once.
    columns = params.select("table_name", "column_name").distinct()
    columns = columns.join(declared, ["table_name", "column_name"], "left").join(link_types, ["table_name", "column_name"], "left")
    return (
        params.join(columns, ["table_name", "column_name"], "left")
        .withColumn(
            "type_name",
            F.when(F.col("in_like"), F.lit("String"))
            .when(F.col("cast_type").isNotNull(), F.coalesce(F.try_element_at(casts, F.lower("cast_type")), F.lit("String")))
            .when(~known & F.col("_link_type").isNotNull(), F.col("_link_type"))
            .when(known, F.col("_declared"))
            .otherwise(F.lit("String")),
        )
        .drop("_declared", "_link_type")
    )


def sentinel_number(stmt_id: Column, param_ord: Column) -> Column:
    """A number that differs for every parameter of a statement; below 2³¹ for the first 50 million of them."""
    seed = F.conv(F.substring(F.md5(F.encode(stmt_id.cast("string"), "utf-8")), 1, 5), 16, 10).cast("bigint")
    return seed * 2000 + param_ord.cast("bigint")


def make_sentinels(params: DataFrame) -> DataFrame:
    """Adds ``sentinel`` (as it appears in plans) and ``sql_value`` (as it is written into the text).

    Deterministic, so a rerun gives the same values. Values need to be unique only within a
    statement, because they are looked up by (stmt_id, sentinel).
    """
    number = sentinel_number(F.col("stmt_id"), F.col("param_ord"))
    kind = F.col("type_name")
    sentinel = (
        F.when(kind == "Boolean", F.lit("true"))
        .when(kind == "Integer", number.cast("string"))
        .when(kind == "Long", (number + F.lit(2**31)).cast("string"))
        .when(kind == "Date", F.lit(SENTINEL_DATE))
        .when(kind == "Timestamp", F.lit(SENTINEL_TIMESTAMP))
        .otherwise(F.concat(F.lit("tag-"), number.cast("string")))
    )
    value = (
        F.when(kind.isin("Boolean", "Integer", "Long"), F.col("sentinel"))
        .when(kind == "Date", F.concat(F.lit("{d '"), F.col("sentinel"), F.lit("'}")))
        .when(kind == "Timestamp", F.concat(F.lit("{ts '"), F.col("sentinel"), F.lit("'}")))
        .otherwise(F.concat(F.lit("'"), F.col("sentinel"), F.lit("'")))
    )
    return params.withColumn("sentinel", sentinel).withColumn("sql_value", value)


def bind(statements: DataFrame, sentinels: DataFrame, col: str = "query_text", into: str = "bound_text") -> DataFrame:
    """Adds the text with every parameter replaced by its sentinel; literals are kept.

    The values of one statement are gathered in one row, which is as long as its text.
    """
    values = sentinels.groupBy("stmt_id").agg(
        F.sort_array(F.collect_list(F.struct("param_ord", "sql_value"))).alias("_values")
    )
    step = statements.hint("merge").join(values, "stmt_id", "left").withColumn("_text", text.mask_literals(F.col(col)))
    step = step.withColumn("_gaps", F.split("_text", "(?i)" + _PARAMETER))
    filled = F.transform(
        "_gaps",
        lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.coalesce(F.get("_values", i - 1)["sql_value"], F.lit("?")), g)),
    )
    whole = F.array_join(filled, "")
    return step.withColumn(into, text.unmask(whole, text.string_literals(F.col(col)))).drop("_values", "_text", "_gaps")


def sentinel_predicates(predicates: DataFrame, sentinels: DataFrame) -> DataFrame:
    """What plan conditions are matched against: stmt_id, pred_ord, sentinel, expr, eligible_index.

    ``predicates`` come from the bound text, so a predicate's ``value`` is the written form of its
    parameter's sentinel, quotes and date braces included; ``sentinels`` come from
    :func:`make_sentinels`. Predicates without a parameter are left out.
    """
    marks = sentinels.select("stmt_id", F.lower("sql_value").alias("value"), "sentinel").distinct()
    return predicates.hint("merge").join(marks, ["stmt_id", "value"]).select("stmt_id", "pred_ord", "sentinel", "expr", "eligible_index")


def condition_tokens(condition: Column) -> Column:
    """Sentinel-like tokens of a plan condition in lookup order: tagged strings, numbers, the date."""
    tagged = F.array_distinct(F.regexp_extract_all(condition, F.lit(r"'(tag-\d+)'"), F.lit(1)))
    numbers = F.array_distinct(F.regexp_extract_all(condition, F.lit(r"(?<![\w.'-])(\d+)(?![\w.'-])"), F.lit(1)))
    date = F.when(F.contains(condition, F.lit(SENTINEL_DATE)), F.array(F.lit(SENTINEL_DATE))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(condition.isNotNull(), F.concat(tagged, numbers, date))


def sentinel_lookup(predicates: DataFrame) -> DataFrame:
    """One row per (stmt_id, sentinel): where several predicates share it, the last one.

    ``predicates``: stmt_id, pred_ord, sentinel, expr, eligible_index.
    """
    return predicates.groupBy("stmt_id", "sentinel").agg(
        F.max(F.struct("pred_ord", "expr", "eligible_index")).alias("_p")
    ).select("stmt_id", "sentinel", "_p.*")


def find_sentinels(nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """The predicates behind the sentinels in each node's ``condition``, in lookup order."""
    tokens = nodes.select(
        *nodes.columns, F.posexplode_outer(condition_tokens(F.col("condition"))).alias("match_ord", "sentinel")
    ).filter("sentinel is not null")
    return tokens.join(sentinel_lookup(predicates), ["stmt_id", "sentinel"])
