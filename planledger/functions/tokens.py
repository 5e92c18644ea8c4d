"""Query text as one column of tokens, with brackets, query blocks and clauses.

A statement is split once. Bracket partners come from sorting by depth, query blocks and clauses from
running values, as in ``structure``; the work grows with the number of tokens, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import structure
from .structure import NOWHERE, let
from .text import LIT_CLOSE, LIT_OPEN, mask_literals

_NAME = r"[a-z_][\w$]*+(?:\.(?:[a-z_][\w$]*+|\*))*+"
_TOKEN = rf"{LIT_OPEN}[0-9]++{LIT_CLOSE}|[:@]{_NAME}|\"[^\"]*+\"|{_NAME}|\?[0-9]*+|[0-9][\w.]*+|<>|[<>!]=|\|\||[^\s]"
#: Words that begin a clause of their query block.
CLAUSES = ("select", "from", "join", "on", "where", "group", "having", "order", "limit", "offset", "set", "update", "delete", "values", "union", "intersect", "except", "minus")
SET_OPERATIONS = ("union", "intersect", "except", "minus")
_FAR = 2**31 - 1


def tokens(col: Column) -> Column:
    """The tokens of a statement, lower case, literals as numbered marks.

    Elements are ``i`` (number), ``text``, ``br`` and ``partner`` (for round brackets), ``begin`` and
    ``end`` (the brackets of the innermost query block; the statement itself has none: ``NOWHERE``),
    ``branch`` (set operations of that block before it) and ``clause`` (the word that begins its clause).
    """
    return let(let(let(F.regexp_extract_all(mask_literals(F.lower(col)), F.lit(_TOKEN), F.lit(0)), _measured), structure.paired), _blocks)


def _measured(words: Column) -> Column:
    steps = F.transform(words, lambda w: F.when(w == "(", 1).when(w == ")", -1).otherwise(0))

    def element(x: Column, i: Column) -> Column:
        br = F.when(x["w"].isin("(", ")"), x["w"])
        return F.struct(i.alias("i"), x["w"].alias("text"), br.alias("br"), F.when(br == ")", x["d"] + 1).when(br == "(", x["d"]).alias("key"))

    return F.transform(F.arrays_zip(words.alias("w"), structure.running_sums(steps).alias("d")), element)


def _blocks(found: Column) -> Column:
    def opens(t: Column) -> Column:
        return (t["br"] == "(") & t["partner"].isNotNull() & F.get(found, t["i"] + 1)["text"].isin("select", "with")

    def outer(t: Column) -> Column:
        before = F.when(opens(t), t["i"]).when((t["br"] == ")") & t["partner"].isNotNull(), t["partner"] - 1).otherwise(t["i"] - 1)
        return F.greatest(before, F.lit(NOWHERE))

    # A closing bracket is of its partner's block, an opening one of the block around it.
    def own(x: Column) -> Column:
        return F.struct(
            F.when(x["t"]["br"] == "(", x["around"]).otherwise(x["block"]).alias("block"),
            x["t"]["i"].alias("i"),
            F.when(x["t"]["text"].isin(*CLAUSES), x["t"]["text"]).alias("clause"),
            x["t"]["text"].isin(*SET_OPERATIONS).cast("int").alias("branch"),
        )

    def numbered(block: Column) -> Column:
        around = F.concat(F.array(F.lit(NOWHERE)), block)
        zipped = F.arrays_zip(found.alias("t"), block.alias("block"), F.slice(around, F.lit(1), F.size(block)).alias("around"))
        return let(F.sort_array(F.transform(zipped, own)), carried)

    # In order of blocks: the last clause word behind a block's beginning, and the set operations since then.
    def carried(order: Column) -> Column:
        begins = lambda x, k: F.coalesce(F.get(order, k - 1)["block"] != x["block"], F.lit(True))
        marks = structure.running_greatest(F.transform(order, lambda x, k: F.when(x["clause"].isNotNull() | begins(x, k), k).otherwise(0)))
        firsts = structure.running_greatest(F.transform(order, lambda x, k: F.when(begins(x, k), k).otherwise(0)))
        passed = structure.running_sums(F.transform(order, lambda x: x["branch"]))
        counted = F.struct(firsts.alias("first"), passed.alias("passed"))
        branches = let(counted, lambda c: F.transform(c["passed"], lambda n, k: n - F.when(F.get(c["first"], k) > 0, F.get(c["passed"], (F.get(c["first"], k) - 1).cast("int"))).otherwise(0)))
        plain = F.transform(order, lambda x: F.lit(0).cast("bigint"))
        branch = F.when(F.exists(order, lambda x: x["branch"] > 0), branches).otherwise(plain)

        def one(x: Column) -> Column:
            return F.struct(x["t"]["i"].alias("i"), x["t"]["block"].alias("block"), F.get(order, x["mark"].cast("int"))["clause"].alias("clause"), x["branch"].cast("int").alias("branch"))

        return F.sort_array(F.transform(F.arrays_zip(order.alias("t"), marks.alias("mark"), branch.alias("branch")), one))

    def whole(x: Column) -> Column:
        closes = F.get(found, x["c"]["block"])["partner"]
        token = F.struct(*(x["t"][n].alias(n) for n in ("i", "text", "br", "partner")), x["c"]["block"].alias("begin"), F.coalesce(closes, F.lit(_FAR)).alias("end"))
        return token.withField("branch", x["c"]["branch"]).withField("clause", x["c"]["clause"])

    # Without a query in brackets there is one block.
    blocks = F.when(F.exists(found, opens), structure.follow(F.transform(found, outer))).otherwise(F.transform(found, lambda t: F.lit(NOWHERE)))
    return F.transform(F.arrays_zip(found.alias("t"), let(blocks, numbered).alias("c")), whole)


# Words that are no table, alias or column.
WORDS = (
    "and or not like ilike between in is null exists select from where group by order having as asc desc set update delete on join inner left right full "
    "cross outer natural using case when then else end all any some distinct limit offset union intersect except minus fetch escape true false with values "
    "member of empty for nulls first last"
).split()


def is_name(text: Column) -> Column:
    return text.rlike(r"^[a-z_\"]") & ~text.isin(*WORDS)


def table_items(found: Column) -> Column:
    """The tables of FROM, JOIN, UPDATE and DELETE: ``i``, ``table``, ``alias`` (null if none), and their query block."""

    def place(t: Column) -> Column:
        back, on, after = (F.get(found, t["i"] + k) for k in (-1, 1, 2))
        begins = back["text"].isin("from", "join", "update", "fetch") | ((back["text"] == "delete") & (t["text"] != "from")) | ((back["text"] == ",") & (t["clause"] == "from"))
        alias = F.when((on["text"] == "as") & is_name(after["text"]), after["text"]).when(is_name(on["text"]) & ~F.contains(on["text"], F.lit(".")), on["text"])
        fits = begins & is_name(t["text"]) & t["clause"].isin("from", "join", "update", "delete")
        table = F.replace(F.translate(t["text"], '"', ""), F.lit("public."), F.lit(""))
        return F.when(fits, F.struct(t["i"].alias("i"), table.alias("table"), alias.alias("alias"), t["begin"].alias("begin"), t["end"].alias("end"), t["branch"].alias("branch")))

    return F.filter(F.transform(found, place), lambda x: x.isNotNull())


def scopes(items: Column) -> Column:
    """The items with what they stand for: ``entity`` and the ``path`` behind it.

    ``join e.box b`` is the path ``box`` of what ``e`` is, and so on along a chain of aliases.
    """
    kind = "array<struct<i:int,alias:string,begin:int,end:int,branch:int,entity:string,path:array<string>>>"

    def add(acc: Column, item: Column) -> Column:
        steps = F.split(item["table"], r"\.")
        base = visible(acc, F.get(steps, F.lit(0)), item["i"], item["begin"], item["branch"])

        def made(b: Column) -> Column:
            found = b.isNotNull() & (F.size(steps) > 1)
            path = F.when(found, F.concat(b["path"], F.slice(steps, 2, 1 << 30))).otherwise(F.expr("cast(array() as array<string>)"))
            own = F.struct(
                *(item[n].alias(n) for n in ("i", "alias", "begin", "end", "branch")), F.when(found, b["entity"]).otherwise(item["table"]).alias("entity"), path.alias("path")
            )
            return F.concat(acc, F.array(own))

        return let(base, made)

    return F.aggregate(items, F.expr(f"cast(array() as {kind})"), add)


def visible(known: Column, alias: Column, at: Column, begin: Column, branch: Column) -> Column:
    """The item that an alias means at a place: that of the innermost query block around it."""
    near = F.filter(known, lambda s: (s["alias"] == alias) & (s["begin"] < at) & (at < s["end"]) & ((s["begin"] != begin) | (s["branch"] == branch)))
    best = F.array_max(F.transform(near, lambda s: F.struct(s["begin"].alias("begin"), (s["i"] < at).alias("before"), s["i"].alias("i"), s["entity"].alias("entity"), s["path"].alias("path"))))
    return F.when(best.isNotNull(), F.struct(best["entity"].alias("entity"), best["path"].alias("path")))
