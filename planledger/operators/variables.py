"""Variables, constants and string builders behind the arguments of query calls, from source text.

Everything happens inside a file's row. Events are found in the masked text: assignments, inits and
appends of builders (stacked ones in order), and query calls. A name means the declaration of the
innermost block that holds the place; fields may stand anywhere in their class, parameters hide them.
The value of a name is an expression of what was assigned to it: for a builder the arguments from the
last init before the place up to it, for another variable all assignments of its scope in order, without
regard to branches. Values are put in the place of names until nothing changes.

What cannot be resolved stays as written, so ``extract.classify`` finds it dynamic: parameters, calls,
names of other files, names that depend on themselves, and values longer than ``MOST`` characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure, text
from ..functions.structure import NOWHERE, let
from .extract import QUERY_METHODS, RANGE, call_places, chains

#: Longest value that is put in the place of a name.
MOST = 1 << 16
_FAR = 2**31 - 1

_MODIFIERS = r"(?:(?:@\w[\w.]*+|public|private|protected|static|final|transient|volatile|else)\s++)*+"
_NOT_TYPE = r"(?!(?:return|throw|new|package|import|else|case|assert|break|continue|goto|yield)\b)"
_TYPE = rf"{_NOT_TYPE}[\w.$]++(?:\s*+<[^;=(){{}}]*>)?+(?:\s*+\[\s*+\])*+"
#: An assignment or a declaration at the beginning of a statement: its type, name and sign.
_HEAD = rf"(?:^|(?<=[;:]))\s*+{_MODIFIERS}(?:({_TYPE})\s++)?(?:this\s*+\.\s*+)?+\b(\w++)\s*+(\+?=(?!=)|(?=;))"
_NEW_BUILDER = r"new\s++(?:java\.lang\.)?StringBu(?:ilder|ffer)\s*+"
_PARAMETER = r"[\w.>\]]\s++(\w++)\s*+(?:,|$)"
_CLASS = r"\b(?:class|interface|enum|record)\s++(\w++)"
_NAME = r"(?<![\w.])(?:(?:this|[A-Z]\w*+)\.)?+[A-Za-z_]\w*+(?:\.toString\(\))?+(?!\s*+[\w.(])"
_TOKEN = rf"{text.JAVA_STRING}|{text.JAVA_CHAR}|{_NAME}|(?s:.)"

_EVENT = "struct<at:int,kind:string,name:string,typed:boolean,from:int,to:int,block:int>"


def _heads(b: Column, around: Column) -> Column:
    """Assignments and declarations, ``init`` where a builder is made."""
    # The first element from each one on whose piece ends a statement; a head looks behind its own piece.
    ends = structure.follow(F.transform(b, lambda x: F.when(F.contains(x["piece"], F.lit(";")) | x["br"].isNull(), x["i"]).otherwise(x["i"] + 1)))

    def in_piece(x: Column) -> Column:
        piece = x["of"]["piece"]
        found = F.arrays_zip(
            F.regexp_extract_all(piece, F.lit(_HEAD), F.lit(0)).alias("head"),
            F.regexp_extract_all(piece, F.lit(_HEAD), F.lit(1)).alias("type"),
            F.regexp_extract_all(piece, F.lit(_HEAD), F.lit(2)).alias("name"),
            F.regexp_extract_all(piece, F.lit(_HEAD), F.lit(3)).alias("sign"),
            F.slice(structure.split_at(piece, _HEAD), 2, 1 << 30).alias("rest"),
        )
        return F.when(F.contains(piece, F.lit("=")) | F.contains(piece, F.lit(";")), let(found, lambda heads: of_piece(x, heads)))

    def of_piece(x: Column, heads: Column) -> Column:
        own = x["of"]
        sizes = F.transform(heads, lambda h: F.length(h["head"]) + F.length(h["rest"]))
        # Each head with the place behind it: the piece's end less what follows the head.
        following = structure.running(F.reverse(sizes), lambda p, q: p + q)
        placed = F.transform(
            F.arrays_zip(heads.alias("h"), F.reverse(following).alias("left")),
            lambda h: let(own["at"] - h["left"] + F.length(h["h"]["head"]), lambda value: event(own, x["end"], h["h"], value)),
        )
        # Behind an opening bracket an equals sign belongs to an annotation or a loop.
        begins = F.coalesce(F.get(b, own["i"] - 1)["br"] != "(", F.lit(True))
        first = own["at"] - F.length(own["piece"]) + F.instr(own["piece"], ";")
        return F.filter(placed, lambda e: begins | (e["at"] > first))

    def event(own: Column, end: Column, h: Column, value: Column) -> Column:
        at = value - F.length(F.regexp_extract(h["head"], r"(\w++\s*+(?:\+?=)?)$", 1))
        cut = F.regexp_instr(h["rest"], F.lit("[;,]"))
        last = F.get(b, end)
        far = last["at"] - F.length(last["piece"]) + F.instr(last["piece"], ";") - 1
        built = h["rest"].rlike(rf"^\s*+{_NEW_BUILDER}$") & (own["br"] == "(") & own["partner"].isNotNull()
        close = F.get(b, own["partner"])["at"]
        kind = F.when(h["sign"] == "", "declared").when(built, "init").when(h["sign"] == "=", "set").otherwise("add")
        upto = F.when(cut > 0, value + cut - 1).otherwise(far)
        return let(
            kind,
            lambda k: F.struct(
                at.cast("int").alias("at"),
                k.alias("kind"),
                h["name"].alias("name"),
                (F.coalesce(h["type"], F.lit("")) != "").alias("typed"),
                F.when(k == "init", own["at"] + 1).otherwise(value).cast("int").alias("from"),
                F.when(k == "declared", value).when(k == "init", F.coalesce(_comma(b, own), close)).otherwise(upto).cast("int").alias("to"),
                F.coalesce(F.get(around, own["i"] - 1), F.lit(NOWHERE)).cast("int").alias("block"),
            ),
        )

    found = F.transform(F.arrays_zip(b.alias("of"), F.slice(ends, 2, 1 << 30).alias("end")), in_piece)
    return F.flatten(F.filter(found, lambda h: h.isNotNull()))


def _comma(b: Column, own: Column) -> Column:
    """Where the first argument of a bracket ends, if another one follows."""
    inside = F.slice(b, own["i"] + 2, F.coalesce(own["partner"] - own["i"], F.lit(0)))
    level = lambda k: F.when(k["br"] == "(", k["key"] - 1).when(k["br"] == ")", k["key"])
    found = F.get(F.filter(inside, lambda k: F.contains(k["piece"], F.lit(",")) & (level(k) == own["key"])), F.lit(0))
    return found["at"] - F.length(found["piece"]) - 1 + F.instr(found["piece"], ",")


def _appends(b: Column, around: Column) -> Column:
    """The appends of builders, each bracket of a chain for itself."""

    def append(x: Column) -> Column:
        own, root = x["of"], F.get(b, x["root"])
        named = F.regexp_extract(root["piece"], rf"(?:\b(\w++)\s*+\.\s*+append\s*+|\b(\w++)\s*+=\s*+{_NEW_BUILDER})$", 1)
        made = F.regexp_extract(root["piece"], rf"\b(\w++)\s*+=\s*+{_NEW_BUILDER}$", 1)
        return F.struct(
            own["at"].cast("int").alias("at"),
            F.lit("append").alias("kind"),
            F.when(named == "", made).otherwise(named).alias("name"),
            F.lit(False).alias("typed"),
            (own["at"] + 1).cast("int").alias("from"),
            F.coalesce(_comma(b, own), F.get(b, own["partner"])["at"]).cast("int").alias("to"),
            F.get(around, own["i"]).cast("int").alias("block"),
        )

    zipped = F.arrays_zip(b.alias("of"), chains(b).alias("root"))
    calls = F.filter(zipped, lambda x: (x["of"]["br"] == "(") & x["of"]["partner"].isNotNull() & x["of"]["piece"].rlike(r"\bappend\s*+$"))
    return F.filter(F.transform(calls, append), lambda e: e["name"] != "")


def _parameters(b: Column) -> Column:
    """The parameters of methods, as declarations of the block behind them."""

    def of_block(x: Column) -> Column:
        listed = F.get(b, x["i"] - 1)
        fits = (x["br"] == "{") & (listed["br"] == ")") & (listed["partner"] == x["i"] - 2) & x["piece"].rlike(r"^\s*+(?:throws\b[\w.,\s]*+)?$")
        names = F.regexp_extract_all(listed["piece"], F.lit(_PARAMETER), F.lit(1))

        def declared(name: Column) -> Column:
            at = x["at"].cast("int")
            return F.struct(at.alias("at"), F.lit("parameter").alias("kind"), name.alias("name"), F.lit(True).alias("typed"), at.alias("from"), at.alias("to"), x["i"].cast("int").alias("block"))

        return F.when(fits, F.transform(names, declared))

    return F.flatten(F.filter(F.transform(b, of_block), lambda p: p.isNotNull()))


def _file_events(corpus: DataFrame, method_names: Sequence[str]) -> DataFrame:
    """Adds ``_calls`` and ``_all``: the events of a file in order, calls among them, each name resolved.

    An element of ``_all`` has ``at``, ``kind``, ``name``, ``owner`` (where the name is declared, null if it
    isn't), ``expr`` as written, ``value``, the expression with values in the place of names, and for a
    call ``names``, the declared names in its argument.
    """
    step = corpus.withColumn("_masked", text.mask_source(F.col("content")))
    step = step.withColumn("_b", structure.brackets(F.col("_masked"))).withColumn("_around", structure.blocks(F.col("_b")))
    step = step.withColumn("_calls", call_places(F.col("_b"), method_names))
    uses = F.transform(
        "_calls",
        lambda c: F.struct(
            c["at"].cast("int").alias("at"), F.lit("use").alias("kind"), F.lit("").alias("name"), F.lit(False).alias("typed"),
            (c["at"] + 1).cast("int").alias("from"), c["stop"].cast("int").alias("to"), F.lit(NOWHERE).alias("block"),
        ),
    )
    b, around = F.col("_b"), F.col("_around")
    found = F.concat(_heads(b, around), _appends(b, around), _parameters(b), uses)
    # Files without a query call need no events.
    step = step.withColumn("_events", F.when(F.size("_calls") > 0, F.sort_array(found)).otherwise(F.expr(f"cast(array() as array<{_EVENT}>)")))

    def scoped(e: Column) -> Column:
        brace = F.get(b, e["block"])
        held = F.get(b, e["block"])["partner"]
        return F.struct(
            *(e[n].alias(n) for n in ("at", "kind", "name", "typed")),
            F.coalesce(brace["at"], F.lit(0)).alias("begin"),
            F.coalesce(F.get(b, held)["at"], F.lit(_FAR)).alias("end"),
            F.coalesce(brace["piece"].rlike(_CLASS), F.lit(False)).alias("field"),
            text.stripped(text.blank_comments(F.substring("content", e["from"], e["to"] - e["from"]))).alias("expr"),
        )

    step = step.withColumn("_scoped", F.transform("_events", scoped)).withColumn("_declared", F.filter("_scoped", lambda e: e["typed"]))
    declared = F.col("_declared")

    def owner(name: Column, at: Column, only_field: Column) -> Column:
        seen = F.filter(declared, lambda d: (d["name"] == name) & (d["begin"] <= at) & (at <= d["end"]) & ((d["at"] < at) | d["field"]) & (d["field"] | ~only_field))
        return F.array_max(F.transform(seen, lambda d: F.struct(d["begin"].alias("begin"), d["at"].alias("at"))))["at"]

    def owned(e: Column) -> Column:
        own = F.when(e["kind"] == "use", F.lit(None).cast("int")).when(e["typed"], e["at"]).otherwise(owner(e["name"], e["at"], F.lit(False)))
        return e.withField("owner", own)

    step = step.withColumn("_owned", F.transform("_scoped", owned))
    numbered = F.transform("_owned", lambda e, i: F.struct(i.alias("i"), e["at"].alias("at"), e["kind"].alias("kind"), e["owner"].alias("owner")))
    assigned = F.filter(numbered, lambda e: e["owner"].isNotNull() & ~e["kind"].isin("use", "declared"))

    def members(known: Column, of: Column, at: Column) -> Column:
        """The events that make up a variable's value at a place; null if something else does."""

        def chosen(own: Column) -> Column:
            builder = F.exists(own, lambda e: e["kind"].isin("init", "append"))
            begun = F.array_max(F.transform(F.filter(own, lambda e: (e["kind"] == "init") & (e["at"] < at)), lambda e: e["at"]))
            built = F.filter(own, lambda e: (e["at"] >= begun) & (e["at"] < at))
            picked = F.when(builder & begun.isNotNull(), built).when(~builder & (F.size(own) > 0) & ~F.exists(own, lambda e: e["kind"] == "parameter"), own)
            return F.transform(picked, lambda e: e["i"])

        return let(F.filter(known, lambda e: e["owner"] == of), chosen)

    def tokens(e: Column, known: Column, classes: Column) -> Column:
        def token(t: Column) -> Column:
            plain = F.regexp_replace(t, r"\.toString\(\)$", "")
            name, prefix = F.substring_index(plain, ".", -1), F.regexp_extract(plain, r"^(\w+)\.", 1)
            fits = t.rlike(r"^[A-Za-z_]") & (prefix.isin("", "this") | F.array_contains(classes, prefix))
            return let(F.when(fits, owner(name, e["at"], prefix != "")), lambda of: F.struct(t.alias("text"), name.alias("name"), of.alias("owner"), made(of).alias("members")))

        def made(of: Column) -> Column:
            return F.when(of == e["owner"], F.array(F.lit(NOWHERE))).when(of.isNotNull(), members(known, of, e["at"]))

        return F.transform(F.regexp_extract_all(e["expr"], F.lit(_TOKEN), F.lit(0)), token)

    classes = F.regexp_extract_all("_masked", F.lit(_CLASS), F.lit(1))
    step = step.withColumn("_tokens", let(F.struct(assigned.alias("known"), classes.alias("classes")), lambda x: F.transform("_owned", lambda e: tokens(e, x["known"], x["classes"]))))
    nothing = F.lit('""')

    def filled(values: Column, parts: Column) -> Column:
        def one(t: Column) -> Column:
            texts = F.transform(t["members"], lambda m: F.coalesce(F.nullif(F.get(values, m), F.lit("")), nothing))
            value = F.concat(F.lit("("), F.coalesce(F.nullif(F.array_join(texts, " + "), F.lit("")), nothing), F.lit(")"))
            return let(value, lambda v: F.when(t["members"].isNull() | (F.length(v) > MOST), t["text"]).otherwise(v))

        # A builder's capacity is no text.
        def text_of(x: Column) -> Column:
            return let(F.array_join(F.transform(x["tokens"], one), ""), lambda v: F.when(x["init"] & v.rlike(r"^\d+$"), "").otherwise(v))

        return F.transform(parts, text_of)

    # As many rounds as there are events, or until nothing changes.
    def solved(parts: Column) -> Column:
        first = F.transform(parts, lambda x: F.array_join(F.transform(x["tokens"], lambda t: t["text"]), ""))
        start = F.struct(first.alias("values"), F.lit(False).alias("over"))

        def further(acc: Column, _: Column) -> Column:
            new = let(filled(acc["values"], parts), lambda new: F.struct(new.alias("values"), (new == acc["values"]).alias("over")))
            return F.when(acc["over"], acc).otherwise(new)

        return F.aggregate(F.sequence(F.lit(0), F.size(parts)), start, further, lambda acc: acc["values"])

    parts = F.transform(F.arrays_zip(F.col("_tokens").alias("tokens"), F.col("_owned").alias("e")), lambda x: F.struct(x["tokens"].alias("tokens"), (x["e"]["kind"] == "init").alias("init")))
    step = step.withColumn("_values", F.when(F.size("_owned") > 0, let(parts, solved)).otherwise(F.expr("cast(array() as array<string>)")))

    def whole(x: Column) -> Column:
        named = F.filter(x["t"], lambda t: t["owner"].isNotNull() & (x["e"]["kind"] == "use"))
        return x["e"].withField("value", x["v"]).withField("names", F.transform(named, lambda t: F.struct(t["name"].alias("name"), t["owner"].alias("owner"))))

    all_events = F.transform(F.arrays_zip(F.col("_owned").alias("e"), F.col("_tokens").alias("t"), F.col("_values").alias("v")), whole)
    return step.withColumn("_all", all_events).select(*corpus.columns, "_calls", "_all")


def source_events(corpus: DataFrame, method_names: Sequence[str] = QUERY_METHODS) -> DataFrame:
    """One row per assignment, builder init, append or use in a query call, of files with query calls.

    ``variable`` and ``owner`` (where it is declared) tell variables of one name apart; ``at`` is the
    place; ``kind`` is set, add, init, append or use; ``fragment`` is the resolved text of what is
    assigned or appended, null if it isn't static. Input of ``extract.assemble`` and ``fold_assignments``.
    """
    kept = [c for c in corpus.columns if c != "content"]

    def rows_of(e: Column) -> Column:
        where = [e["at"].alias("at"), e["kind"].alias("kind")]
        used = F.transform(e["names"], lambda n: F.struct(n["name"].alias("variable"), n["owner"].alias("owner"), *where, F.lit(None).cast("string").alias("value")))
        own = F.struct(e["name"].alias("variable"), e["owner"].alias("owner"), *where, F.coalesce(F.nullif(e["value"], F.lit("")), F.lit('""')).alias("value"))
        return F.when(e["kind"] == "use", used).otherwise(F.array(own))

    rows = _file_events(corpus, method_names).select(*kept, F.explode_outer(F.flatten(F.transform("_all", rows_of))).alias("_e"))
    rows = rows.select(*kept, "_e.*").filter(F.col("kind").isin("set", "add", "init", "append", "use") & F.col("owner").isNotNull())
    return rows.withColumn("fragment", F.when(text.only_java_strings(F.col("value")), text.fold_java_strings(F.col("value")))).drop("value")


def resolved_calls(corpus: DataFrame, method_names: Sequence[str] = QUERY_METHODS) -> DataFrame:
    """As ``extract.extract_calls``, with values of the same file in the place of names in ``argument``.

    ``written`` is the argument as it stands in the source. Narrow: no shuffle.
    """
    kept = [c for c in corpus.columns if c != "content"]
    uses = F.transform(F.filter("_all", lambda e: e["kind"] == "use"), lambda e: F.struct(e["expr"].alias("written"), e["value"].alias("argument")))
    # Calls are in order of their brackets, and so are their events.
    step = _file_events(corpus, method_names).withColumn("_rows", F.arrays_zip(F.col("_calls").alias("c"), uses.alias("u")))
    rows = step.select(*kept, "content", F.posexplode_outer("_rows").alias("call_ord", "_r")).filter("_r is not null")
    call = F.expr("substring(content, _r.c.start, _r.c.end - _r.c.start + 1)")
    return rows.select(*kept, "call_ord", "_r.u.argument", "_r.u.written", call.alias("call_text"), *(F.col(f"_r.c.{n}").alias(n) for n in (*RANGE, "at")))
