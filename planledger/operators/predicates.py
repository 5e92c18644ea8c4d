"""Comparisons in WHERE clauses and the column ranking built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import structure, text, tokens
from ..functions.text import ARG_CLOSE, ARG_OPEN, GROUP_CLOSE, GROUP_OPEN, NOTHING, RANGE_AND

_KEYWORDS = "and|or|not|where|on|between|having|when|then|else|by|select|from|set"
_BARE_COLUMN = r"^[a-z_][\w$]*(?:\.[a-z_][\w$]*)*$"
_VALUE = rf"^(?:{text.LIT_OPEN}[0-9]+{text.LIT_CLOSE}|[-+]?[0-9][0-9.]*|:\w+|\?[0-9]*|true|false)$"
_COMPARE = r"^(.*?)\s*(<>|!=|<=|>=|=|<|>|\bnot\s+i?like\b|\bi?like\b)\s*(.*)$"
_TAIL = r"\b(?=[gohlf])(?:group\s+by|order\s+by|having|limit|offset|for\s+update)\b.*$"
_SET_OPERATION = r"\b(?=[uiem])(?:union(?:\s+all)?|intersect(?:\s+all)?|except(?:\s+all)?|minus)\b"


def _even(masked: Column) -> Column:
    """Masked text with single blanks, CASE reduced to a mark, and no blank between a function and its bracket."""
    # A single blank is left alone: most are.
    plain = text.replace_all(masked, (r"\s{2,}|[^\S ]", " "), (r"\bcase\b(?:(?!\bcase\b|\bend\b).)*+\bend\b", NOTHING))

    def called(p: Column) -> Column:
        return text.replace_all(
            p,
            (rf"\b((?!(?:{_KEYWORDS}|in|any|all|some|exists)\b)[a-z_][\w.$]*) \(", "$1("),
            (rf"\b({_KEYWORDS}|in|any|all|some|exists)\(", "$1 ("),
        )

    return structure.let(plain, lambda p: F.when(F.contains(p, F.lit("(")), called(p)).otherwise(p))


def _unwrap(even: Column) -> Column:
    """Text in which brackets are marks: arguments, groups, and subqueries reduced to one mark."""
    no_brackets = r"[^()]*+"
    not_query = r"(?! ?(?:select|with)\b)"

    def innermost(col: Column) -> Column:
        return text.replace_all(
            col,
            (rf"\( ?(?:select|with)\b{no_brackets}\)", NOTHING),
            (rf"(?<=\w)\(({no_brackets})\)", f"{ARG_OPEN}$1{ARG_CLOSE}"),
            (rf"\b(in|any|all|some) \({not_query}({no_brackets})\)", f"$1 {ARG_OPEN}$2{ARG_CLOSE}"),
            (
                rf"\({not_query}((?:(?!\b(?:and|or|like|ilike|in|is|between|exists)\b)[^()=<>])*+)\)",
                f"{ARG_OPEN}$1{ARG_CLOSE}",
            ),
            (rf"\({not_query}({no_brackets})\)", f"{GROUP_OPEN}$1{GROUP_CLOSE}"),
        )

    # Inside out, one level per round, until nothing changes; at most as many levels as opening brackets.
    def level(acc: Column, _round: Column) -> Column:
        new = structure.let(innermost(acc["text"]), lambda n: F.struct(n.alias("text"), ((n == acc["text"]) | ~F.contains(n, F.lit("("))).alias("over")))
        return F.when(acc["over"], acc).otherwise(new)

    start = F.struct(even.alias("text"), (~F.contains(even, F.lit("("))).alias("over"))
    out = F.aggregate(F.sequence(F.lit(0), _chars(even, "(")), start, level, lambda acc: acc["text"])
    return text.replace_all(out, (r"\bbetween\b((?:(?!\band\b).)*?)\band\b", f"between$1{RANGE_AND}"))


def _chars(col: Column, char: str) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit(char), F.lit("")))


def _readable(col: Column, literals: Column) -> Column:
    return F.trim(F.replace(text.unmask(col, literals), F.lit(RANGE_AND), F.lit("and")))


def unqualified(col: Column) -> Column:
    """An expression without the qualifiers of its columns."""
    return F.regexp_replace(col, r"(?<![\w'.])(?:[a-z_][\w$]*\.)+(?=[a-z_*])", "")


def extract_predicates(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """One row per comparison in WHERE, keeping all columns of the statement.

    ``eligible_rank`` marks comparisons the column ranking counts: ``=``, ``<>``, ``<``,
    ``<=``, ``>``, ``>=`` outside brackets. ``eligible_index`` marks those that can lead to
    an index: the same and LIKE, also inside grouping brackets, with a value on one side,
    in a statement without set operations. BETWEEN, IN, IS and EXISTS are listed but are
    neither. Subqueries and CASE are not looked into. Narrow: no shuffle.
    """
    step = (
        statements.withColumn("_text", F.lower(col))
        .withColumn("_literals", text.string_literals(F.col("_text")))
        .withColumn("_even", _even(text.mask_literals(F.col("_text"))))
        .withColumn("_open", _unwrap(F.col("_even")))
        .withColumn("_branches", structure.split_at(F.col("_open"), _SET_OPERATION))
    )
    step = step.select(
        *statements.columns,
        "_literals",
        F.size("_branches").alias("_branch_count"),
        F.posexplode_outer("_branches").alias("branch", "_branch"),
    )
    where = F.regexp_extract("_branch", r"\bwhere\b(.*)$", 1)
    step = step.withColumn("_where", F.regexp_replace(where, _TAIL, "")).withColumn(
        "_pieces", structure.split_at(F.col("_where"), r"\b(?:and|or)\b")
    )
    # Group depth before a piece: groups opened minus groups closed, summed up piece by piece.
    upto = structure.running(F.transform("_pieces", lambda p: _chars(p, GROUP_OPEN) - _chars(p, GROUP_CLOSE)), lambda a, b: a + b)
    before = F.slice(F.concat(F.array(F.lit(0)), upto), F.lit(1), F.size("_pieces"))
    # Each piece is taken apart once, inside the explosion: a filter behind it, as on ``eligible_rank``, finds
    # columns there, while before it the optimizer would match every pattern again for the filter.
    zipped = F.arrays_zip(F.col("_pieces").alias("piece"), before.alias("before"))
    step = step.select(
        *statements.columns,
        "_literals",
        "_branch_count",
        "branch",
        F.posexplode_outer(F.transform(zipped, _comparison)).alias("pred_ord", "_row"),
    )
    step = step.select("*", "_row.*").filter(F.coalesce(F.col("_piece"), F.lit("")) != "")
    step = step.withColumn("_left_name", _column_name(F.col("_left"))).withColumn("_right_name", _column_name(F.col("_right")))
    ranked = F.col("_compared") & ~F.col("op").contains("like") & (F.col("_depth") == 0)
    left_value, right_value = F.col("_left").rlike(_VALUE), F.col("_right").rlike(_VALUE)
    has_param = F.concat("_left", F.lit(" "), "_right").rlike(rf"{text.LIT_OPEN}|(?<![\w.:])(?:[0-9]|:\w|\?)")
    target = F.when(left_value, F.col("_right")).otherwise(F.col("_left"))
    value = F.when(left_value, F.col("_left")).otherwise(F.col("_right"))
    indexable = F.col("_compared") & has_param & (F.col("_branch_count") == 1) & ~target.contains(NOTHING)
    return step.select(
        *statements.columns,
        F.col("branch").cast("int").alias("branch"),
        F.col("pred_ord").cast("int").alias("pred_ord"),
        _ranked_column(F.col("_left_name"), ranked).alias("left_column"),
        _ranked_column(F.col("_right_name"), ranked).alias("right_column"),
        "op",
        _readable(F.col("_left"), F.col("_literals")).alias("left_side"),
        _readable(F.col("_right"), F.col("_literals")).alias("right_side"),
        F.when(indexable, _readable(unqualified(target), F.col("_literals"))).alias("expr"),
        F.when(F.col("_compared"), _readable(value, F.col("_literals"))).alias("value"),
        ranked.alias("eligible_rank"),
        indexable.alias("eligible_index"),
    )


def _comparison(row: Column) -> Column:
    """A piece of a WHERE clause in its parts: (_piece, _depth, _compared, op, _left, _right)."""
    plain = F.regexp_replace(row["piece"], f"[{GROUP_OPEN}{GROUP_CLOSE}]", " ")
    opened = _chars(F.regexp_extract(row["piece"], rf"^[\s{GROUP_OPEN}]*", 0), GROUP_OPEN)
    other = r"\b(not between|between|not in|in|is|exists)\b"

    def sides(piece: Column) -> Column:
        # One match gives all three parts; what follows a last line break belongs to none.
        cut = F.split(F.regexp_replace(piece, _COMPARE + "(?s:.*)", structure.CUT.join(("$1", "$2", "$3"))), structure.CUT)
        slow = F.when(piece.rlike(_COMPARE), F.array(*[F.regexp_extract(piece, _COMPARE, k) for k in (1, 2, 3)]))
        return F.when(piece.rlike(r"\b(?:between|in|is)\b"), F.lit(None)).when(F.contains(piece, F.lit(structure.CUT)), slow).otherwise(F.when(F.size(cut) == 3, cut))

    def parts(piece: Column) -> Column:
        return structure.let(
            sides(piece),
            lambda s: F.struct(
                piece.alias("_piece"),
                (row["before"] + opened).alias("_depth"),
                F.when(piece.isNotNull(), s.isNotNull()).alias("_compared"),
                F.when(s.isNotNull(), F.get(s, F.lit(1))).otherwise(F.regexp_extract(piece, other, 1)).alias("op"),
                F.when(s.isNotNull(), F.get(s, F.lit(0))).otherwise(F.regexp_extract(piece, r"^(.*?)\s*\b(?:not between|between|not in|in|is)\b", 1)).alias("_left"),
                F.get(s, F.lit(2)).alias("_right"),
            ),
        )

    return structure.let(F.trim(F.regexp_replace(F.trim(plain), r"^(?:not )+", "")), parts)


def _column_name(side: Column) -> Column:
    """One side of a comparison; a cast stands for its column."""
    inner = F.regexp_extract(side, rf"^cast{ARG_OPEN}\s*([a-z_][\w.$]*)\s+as\b[^{ARG_CLOSE}]*{ARG_CLOSE}", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), side)


def _ranked_column(name: Column, ranked: Column) -> Column:
    """The bare column of one side of a ranked comparison."""
    bare = name.rlike(_BARE_COLUMN) & ~name.isin("true", "false", "null")
    return F.when(ranked & bare, F.substring_index(name, ".", -1))


def unpaired_statements(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """Statements whose brackets do not pair up."""
    marked = statements.withColumn("_even", _even(text.mask_literals(F.lower(col))))
    return marked.filter(_unwrap(F.col("_even")).rlike(r"[()]")).drop("_even")


def first_table(statements: DataFrame, entity_tables: DataFrame, col: str = "query_text") -> DataFrame:
    """Adds ``table_name``: the statement's first table, by its table name where it is an entity."""
    names = entity_tables.groupBy("entity").agg(F.max("table_name").alias("_table"))
    named = statements.withColumn("_first", text.first_table(F.col(col)))
    return (
        named.join(names, F.col("_first") == F.col("entity"), "left")
        .withColumn("table_name", F.coalesce("_table", "_first"))
        .drop("_first", "_table", "entity")
    )


def statement_aliases(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """(stmt_id, alias, table_name) for the tables of FROM, JOIN, UPDATE and DELETE that have an alias."""
    item = (
        r"(?:\b(?:from|join|update)|,)\s+([\w.$]+)\s+(?:as\s+)?"
        r"(?!(?:where|set|join|inner|left|right|full|cross|on|order|group|having|limit|union|as)\b)([a-z_]\w*)"
    )
    body = F.regexp_replace(text.mask_literals(F.lower(col)), r"(?s)^.*?\b(?=from\b|update\b)", "")
    body = F.regexp_replace(body, r"(?s)\b(?:where|set|order\s+by|group\s+by|having)\b.*$", "")
    items = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(item), F.lit(1)).alias("table_name"),
        F.regexp_extract_all(body, F.lit(item), F.lit(2)).alias("alias"),
    )
    return (
        statements.select("stmt_id", F.explode_outer(items).alias("_item"))
        .filter(F.col("_item.alias").isNotNull())
        .select("stmt_id", F.col("_item.alias").alias("alias"), F.col("_item.table_name").alias("table_name"))
        .distinct()
    )


def column_hits(predicates: DataFrame, entity_columns: DataFrame) -> DataFrame:
    """hits(table, column): comparisons that name the column, times the uses of their statement.

    ``predicates`` carries ``table_name`` and ``occurrences`` from its statement. Hits are
    summed by raw name first, so only one row per (table, name) meets the name map.
    """
    sides = F.array("left_column", "right_column")
    raw = (
        predicates.filter("eligible_rank")
        .select("table_name", "occurrences", F.explode_outer(sides).alias("_name"))
        .filter("_name is not null")
        .groupBy("table_name", "_name")
        .agg(F.sum("occurrences").alias("_hits"))
    )
    names = entity_columns.groupBy(
        F.col("table_name"), F.lower("field").alias("_name")
    ).agg(F.lower(F.max("column_name")).alias("_column"))
    return (
        raw.join(names, ["table_name", "_name"], "left")
        .groupBy("table_name", F.coalesce("_column", "_name").alias("column_name"))
        .agg(F.sum("_hits").alias("hits"))
    )


def table_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy("table_name").agg(F.sum("hits").alias("hits"))


def rank_columns(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Columns of all tables by falling hits; with ``k`` the first k."""
    ordered = hits.orderBy(F.desc("hits"), "table_name", "column_name")
    return ordered if k is None else ordered.limit(k)


def best_columns(hits: DataFrame, k: int) -> DataFrame:
    """The first k columns of each table; a table has no more rows than columns."""
    place = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("hits"), "column_name"))
    return hits.withColumn("place", place).filter(F.col("place") <= k)


#: The clauses whose columns are listed; HAVING and LIMIT are not.
_REF_CLAUSES = ("select", "where", "set", "group", "order", "on")


def alias_scopes(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """(stmt_id, alias, entity, path, first_token, last_token): what an alias stands for, and where.

    The tokens between the last two are those of the alias' query block; an alias of an inner block
    hides one of an outer. ``path`` holds the steps of joined paths (``join e.box b``) behind ``entity``.
    """
    found = statements.withColumn("_tokens", tokens.tokens(F.col(col)))
    rows = found.select("stmt_id", F.explode_outer(tokens.scopes(tokens.table_items(F.col("_tokens")))).alias("_s")).filter("_s.alias is not null")
    return rows.select("stmt_id", "_s.alias", "_s.entity", "_s.path", (F.col("_s.begin") + 1).alias("first_token"), (F.col("_s.end") - 1).alias("last_token"))


def column_refs(statements: DataFrame, col: str = "query_text") -> DataFrame:
    """The columns that statements name in select list, WHERE, SET, GROUP BY, ORDER BY and ON.

    One row per mention, in text order: ``stmt_id``, ``ref_ord``, ``kind``, ``statement_table``,
    ``qualifier`` and ``name`` (the input of ``qualify``), ``entity`` and ``path`` (the input of
    ``implied_joins``). An alias means what it does in the innermost query block around the mention;
    behind an alias of a joined path the path goes on. Without an alias, ``entity`` is the first table
    of the query block. Tables, aliases, functions, parameters and literals are no columns. Narrow.
    """

    def refs(x: Column) -> Column:
        found, known, items = x["tokens"], x["known"], x["items"]

        def ref(t: Column) -> Column:
            back, on = F.get(found, t["i"] - 1)["text"], F.get(found, t["i"] + 1)["text"]
            fits = tokens.is_name(t["text"]) & t["clause"].isin(*_REF_CLAUSES) & (F.coalesce(on, F.lit("")) != "(") & (F.coalesce(back, F.lit("")) != "as")
            fits = fits & ~F.contains(t["text"], F.lit("*")) & ~F.contains(t["text"], F.lit('"'))
            steps = F.split(t["text"], r"\.")
            return F.when(fits, structure.let(steps, lambda names: resolved(t, names)))

        def resolved(t: Column, names: Column) -> Column:
            alias = tokens.visible(known, F.when(F.size(names) > 1, F.get(names, F.lit(0))), t["i"], t["begin"], t["branch"])
            first = F.get(F.filter(items, lambda i: (i["begin"] == t["begin"]) & (i["branch"] == t["branch"])), F.lit(0))["table"]

            def row(a: Column) -> Column:
                path = F.when(a.isNotNull(), F.concat(a["path"], F.slice(names, 2, 1 << 30))).otherwise(names)
                return F.struct(names.alias("names"), F.coalesce(a["entity"], first).alias("entity"), path.alias("path"))

            return structure.let(alias, row)

        return F.filter(F.transform(found, ref), lambda r: r.isNotNull())

    step = statements.withColumn("_tokens", tokens.tokens(F.col(col))).withColumn("_items", tokens.table_items(F.col("_tokens")))
    held = F.struct(F.col("_tokens").alias("tokens"), F.col("_items").alias("items"), tokens.scopes(F.col("_items")).alias("known"))
    rows = step.select(
        "stmt_id",
        text.statement_kind(F.col(col)).alias("kind"),
        text.first_table(F.col(col)).alias("statement_table"),
        F.posexplode_outer(structure.let(held, refs)).alias("ref_ord", "_r"),
    ).filter("_r is not null")
    count = F.size("_r.names")
    return rows.select(
        "stmt_id",
        "ref_ord",
        "kind",
        "statement_table",
        F.nullif(F.array_join(F.slice("_r.names", F.lit(1), count - 1), "."), F.lit("")).alias("qualifier"),
        F.element_at("_r.names", -1).alias("name"),
        F.coalesce("_r.entity", "statement_table").alias("entity"),
        F.col("_r.path").alias("path"),
    )


def columns_in(predicates: DataFrame) -> DataFrame:
    """(stmt_id, column_name) named by ``=``, ``<``, ``<=`` and ``<>`` comparisons."""
    sides = F.array("left_column", "right_column")
    return (
        predicates.filter(F.col("op").isin("=", "<", "<=", "<>", "!=") & F.col("eligible_rank"))
        .select("stmt_id", F.explode_outer(sides).alias("column_name"))
        .filter("column_name is not null")
        .distinct()
    )
