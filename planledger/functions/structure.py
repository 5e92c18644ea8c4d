"""The structure of a text held in one row: brackets, their depth, partners and blocks.

A text is split at its brackets once. Depths and positions are running sums, made by doubling: each
round adds what stands 1, 2, 4 … places before, so n brackets take log n rounds of n steps. Partners
are neighbours after sorting by depth and place. Nothing here looks back over the text again, so a
file twice as long takes about twice the time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOWHERE = -1


#: A character that hardly any text holds.
CUT = "\u001f"


def split_at(col: Column, pattern: str) -> Column:
    """``split`` at a pattern that matches no empty text.

    Spark's own split compiles its pattern anew for each row, unless it is a single character; a replacement doesn't.
    """
    return F.when(F.contains(col, F.lit(CUT)), F.split(col, pattern)).otherwise(F.split(F.regexp_replace(col, pattern, CUT), CUT))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A function of a higher order computes what it captures anew for every element; what is bound
    here is a variable to it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of all elements up to each one; ``join`` is associative and takes (earlier, later)."""

    def rounds(first: Column) -> Column:
        def double(acc: Column, k: Column) -> Column:
            gap = F.pow(F.lit(2), k).cast("int")
            return let(gap, lambda g: F.transform(acc, lambda x, i: F.when(i >= g, join(F.get(acc, i - g), x)).otherwise(x)))

        return F.aggregate(_doublings(first), first, double)

    return let(values, rounds)


def running_sums(values: Column) -> Column:
    """``running`` of whole numbers and their sum."""
    return _running_longs(values, lambda x, before: x + before)


def running_greatest(values: Column) -> Column:
    """``running`` of whole numbers from zero and the greatest one."""
    return _running_longs(values, lambda x, before: F.greatest(x, before))


def _running_longs(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Plain arrays are laid side by side, shifted, and joined; zero changes nothing."""

    def rounds(first: Column) -> Column:
        def double(acc: Column, k: Column) -> Column:
            gap = F.pow(F.lit(2), k).cast("int")
            shifted = let(gap, lambda g: F.concat(F.array_repeat(F.lit(0).cast("bigint"), g), F.slice(acc, F.lit(1), F.size(acc) - g)))
            return F.zip_with(acc, shifted, join)

        return F.aggregate(_doublings(first), first, double)

    return let(F.transform(values, lambda v: v.cast("bigint")), rounds)


def _doublings(values: Column) -> Column:
    """0, 1, 2 … for as many doublings as reach from the last element to the first."""
    upto = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    return let(upto, lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n))


def follow(pointers: Column) -> Column:
    """Where each chain of pointers (places in the array) ends; an end points to itself or nowhere."""

    def rounds(first: Column) -> Column:
        return F.aggregate(_doublings(first), first, lambda acc, _: F.transform(acc, lambda p: F.when(p == NOWHERE, p).otherwise(F.get(acc, p))))

    return let(pointers, rounds)


def brackets(masked: Column) -> Column:
    """The brackets ``( ) { }`` of a text in order, and one last element for what follows them.

    Elements are ``i`` (their number), ``piece`` (the text before the bracket), ``br`` (null at the
    end), ``at`` (its place from 1), ``line`` and ``break_at`` (line breaks before it, and the place of
    the last), ``key`` (its depth among brackets of its sort, equal for partners) and ``partner`` (the
    partner's number, null if it has none).
    """
    found = F.arrays_zip(split_at(masked, r"[(){}]").alias("piece"), F.regexp_extract_all(masked, F.lit(r"[(){}]"), F.lit(0)).alias("br"))
    return let(let(found, _measured), paired)


#: Two running sums share a long: the second one, which may be negative, has its lower half.
HALF = 1 << 32


def _measured(found: Column) -> Column:
    def place(x: Column) -> Column:
        piece = x["piece"]
        return (F.length(piece).cast("bigint") + 1) * HALF + (F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit("\n"), F.lit(""))))

    def depth(x: Column) -> Column:
        br = x["br"]
        return F.when(br == "(", F.lit(HALF)).when(br == ")", F.lit(-HALF)).when(br == "{", F.lit(1)).when(br == "}", F.lit(-1)).otherwise(F.lit(0))

    # The last line break in a piece, from the start of the text; 0 if it has none.
    def broken(x: Column) -> Column:
        piece, at = x["of"]["piece"], F.shiftright(x["place"], 32)
        return F.when(F.contains(piece, F.lit("\n")), at - 1 - F.length(F.substring_index(piece, "\n", -1))).otherwise(F.lit(0).cast("bigint"))

    def element(x: Column, i: Column) -> Column:
        of = x["of"]
        br = of["br"]
        curly = F.pmod(x["depth"] + F.lit(HALF // 2), F.lit(HALF)) - HALF // 2
        level = F.when(br.isin("(", ")"), F.shiftright(x["depth"] + F.lit(HALF // 2), 32)).otherwise(curly)
        return F.struct(
            i.alias("i"),
            of["piece"].alias("piece"),
            br.alias("br"),
            F.shiftright(x["place"], 32).cast("int").alias("at"),
            x["place"].bitwiseAND(F.lit(HALF - 1)).cast("int").alias("line"),
            x["break_at"].cast("int").alias("break_at"),
            F.when(br.isNotNull(), F.when(br.isin(")", "}"), level + 1).otherwise(level)).cast("int").alias("key"),
        )

    def measured(x: Column) -> Column:
        return F.transform(F.arrays_zip(found.alias("of"), x.alias("place"), running_sums(F.transform(found, depth)).alias("depth"), breaks(x).alias("break_at")), element)

    def breaks(places: Column) -> Column:
        own = F.transform(F.arrays_zip(found.alias("of"), places.alias("place")), broken)
        return running(own, lambda a, b: F.greatest(a, b))

    return let(running_sums(F.transform(found, place)), measured)


def paired(found: Column) -> Column:
    """Adds ``partner`` to elements that have ``i``, ``br`` (a bracket or null) and its ``key``."""

    def partners(order: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            other = F.when(x["open"], F.get(order, k + 1)).otherwise(F.get(order, k - 1))
            fits = (other["curly"] == x["curly"]) & (other["key"] == x["key"]) & (other["open"] != x["open"])
            return F.struct(x["i"].alias("i"), F.when(fits, other["i"]).alias("partner"))

        return F.sort_array(F.transform(order, one))

    def place(x: Column) -> Column:
        return F.struct(x["br"].isin("{", "}").alias("curly"), x["key"].alias("key"), x["i"].alias("i"), x["br"].isin("(", "{").alias("open"))

    order = F.sort_array(F.transform(found, place))
    return F.transform(F.arrays_zip(found.alias("of"), let(order, partners).alias("pair")), lambda x: x["of"].withField("partner", x["pair"]["partner"]))


def blocks(found: Column) -> Column:
    """For each element of ``brackets`` the number of the innermost brace that is open behind it, or nowhere."""

    def outer(x: Column, i: Column) -> Column:
        before = F.when(x["br"] == "{", i).when(x["br"] == "}", F.when(x["partner"].isNull(), NOWHERE).otherwise(x["partner"] - 1)).otherwise(i - 1)
        return F.greatest(before, F.lit(NOWHERE))

    return follow(F.transform(found, outer))
