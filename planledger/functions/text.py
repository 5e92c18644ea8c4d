"""Column expressions over query text and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import CUT, let, split_at

# Fixed marks that cannot occur in query text: they stand for masked pieces.
LIT_OPEN, LIT_CLOSE = "\u0001", "\u0002"
ARG_OPEN, ARG_CLOSE = "\u000e", "\u000f"
GROUP_OPEN, GROUP_CLOSE = "\u0011", "\u0012"
SHIELD = "\u0014\u0015"
NOTHING, RANGE_AND = "\u0005", "\u0006"

SQL_STRING = r"'[^']*+(?:''[^']*+)*+'"
JAVA_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JAVA_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*+)'"
JAVA_COMMENT = r"//[^\n]*+|(?s:/\*.*?\*/)"
# A look at the first character spares the branches at all others.
JAVA_QUOTED = f"(?=[\"'])(?:{JAVA_STRING}|{JAVA_CHAR})"
JAVA_OPAQUE = f"(?=[\"'/])(?:{JAVA_STRING}|{JAVA_CHAR}|{JAVA_COMMENT})"

# Paired brackets become private-use characters, one for each depth.
PAIR = "[\\x{F0000}-\\x{10FFFF}]"
_FIRST_PAIR, _PAIRS = 0xF0000, 0x20000
# Where a text holds none of them: control characters first, which keep it in one byte a character.
NEAR = "\x16\x17\x18\x19\x1a\x1b"
NEAR_PAIR = "[\\x16-\\x1b\\x{F0000}-\\x{10FFFF}]"

ARRAY_PREFIX = "array_item_"


def replace_all(col: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        col = F.regexp_replace(col, pattern, by)
    return col


def stripped(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\r\n\f"))


def string_literals(col: Column) -> Column:
    """All quoted SQL strings of the text, in order."""
    return F.regexp_extract_all(col, F.lit(SQL_STRING), F.lit(0))


def mask_literals(col: Column) -> Column:
    """The text with its n-th quoted string replaced by a numbered mark."""

    def masked(whole: Column) -> Column:
        marked = F.transform(
            split_at(whole, SQL_STRING),
            lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(LIT_OPEN), (i - 1).cast("string"), F.lit(LIT_CLOSE), p)),
        )
        return F.when(F.contains(whole, F.lit("'")), F.array_join(marked, "")).otherwise(whole)

    return let(col, masked)


def unmask(col: Column, literals: Column) -> Column:
    """Undo every mask: numbered marks, argument brackets, BETWEEN's AND."""

    def restored(whole: Column, known: Column) -> Column:
        return F.transform(
            F.split(whole, LIT_OPEN),
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(
                    F.get(known, F.substring_index(p, LIT_CLOSE, 1).cast("int")),
                    F.regexp_replace(p, f"^[0-9]+{LIT_CLOSE}", ""),
                )
            ),
        )

    # Most sides of comparisons hold no literal.
    def whole(c: Column) -> Column:
        return F.when(F.contains(c, F.lit(LIT_OPEN)), F.array_join(let(literals, lambda known: restored(c, known)), "")).otherwise(c)

    return F.translate(let(col, whole), ARG_OPEN + ARG_CLOSE + GROUP_OPEN + GROUP_CLOSE, "()")


def clean_query(col: Column) -> Column:
    """Query text made fit for clause extraction (lower case, quotes, long paths, arrays, short FROM)."""
    text = F.replace(F.replace(F.lower(col), F.lit('"'), F.lit("")), F.lit("\\'"), F.lit("'"))
    # Patterns are tried where a text has the signs that they ask for.
    dots = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit("."), F.lit("")))
    text = let(text, lambda t: F.when(dots(t) >= 4, F.regexp_replace(t, r"((?:[^\s.]*+\.){4,}+[^\s.]*+)", '"$1"')).otherwise(t))
    # An item is a dotted name and a number in brackets; what is around it, blank or sign, stays.
    text = let(text, lambda t: F.when(F.contains(t, F.lit("[")), F.regexp_replace(t, rf"\b({_DOTTED})\[\s*+(\d+)\s*+\]", ARRAY_PREFIX + "$1_$2")).otherwise(t))
    text = let(text, lambda t: F.when(F.startswith(t, F.lit("from ")), F.concat(F.lit("select * "), t)).otherwise(t))
    return F.replace(text, F.lit(" join fetch "), F.lit(" join "))


_DOTTED = r"\w+(?:\.\w+)*"


def restore_arrays(col: Column) -> Column:
    """Lower case, with rewritten array items back in bracket form."""
    return F.regexp_replace(F.lower(col), rf"\b{ARRAY_PREFIX}({_DOTTED})_(\d+)\b", "$1[$2]")


def statement_kind(col: Column) -> Column:
    """select, update or delete; anything else is failed. A text that starts with FROM or WITH is a select."""
    verb = F.lower(F.regexp_extract(col, r"^[\s(]*(\w+)", 1))
    return let(verb, lambda v: F.when(v.isin("from", "with"), "select").when(v.isin("select", "update", "delete"), v).otherwise(F.lit("failed")))


# Words that begin a clause: none of them can stand where a table, a column or a condition must.
_CLAUSE = "(?:where|group|order|having|from|set|union|limit|and|or|on)"


def readable(col: Column) -> Column:
    """Whether brackets and quotes of a statement pair up and no clause is empty."""
    # Whole words only: in ``m.from`` and ``group.x`` they are steps of a name.
    empty = rf"(?=[,fwujsabo])(?:(?<![\w.])(?:from|where|update|set|join|select|and|or|by)\b(?!\.)|,)\s*+(?:[,);]|{_CLAUSE}\b(?!\.)|$)"
    return let(mask_literals(F.lower(col)), lambda m: ~(F.contains(m, F.lit("'")) | pair_brackets(m, NEAR).rlike(r"[()]") | m.rlike(empty)))


def first_table(col: Column) -> Column:
    """First table named by FROM, UPDATE or DELETE; lower case, without the public schema."""
    masked = mask_literals(F.lower(col))
    name = F.regexp_extract(masked, r"\b(?:from|update|delete(?!\s+from\b))\s+(?!select\b)\"?([\w.$]+)", 1)
    return F.nullif(F.replace(name, F.lit("public."), F.lit("")), F.lit(""))


def source_without_comments(col: Column) -> Column:
    """Java source without comments; quoted strings and characters are left alone."""
    return F.regexp_replace(col, f"(?=[\"'/])(?:({JAVA_STRING}|{JAVA_CHAR})|{JAVA_COMMENT})", "$1")


def _each(col: Column, pattern: str, change) -> Column:
    """The text with each match of the pattern changed by an expression."""
    pieces = F.arrays_zip(F.split(col, pattern).alias("gap"), F.regexp_extract_all(col, F.lit(pattern), F.lit(0)).alias("found"))
    slow = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(change(p["found"]), F.lit("")))), "")
    # As ``split_at``: cut before and behind each match, so that every second piece is one.
    cut = F.split(F.regexp_replace(col, f"({pattern})", f"{CUT}$1{CUT}"), CUT)
    return F.when(F.contains(col, F.lit(CUT)), slow).otherwise(F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 0, p).otherwise(change(p))), ""))


def blank_comments(col: Column) -> Column:
    """Java source with comments as blanks: nothing moves."""

    def blank(token: Column) -> Column:
        return F.when(F.startswith(token, F.lit("/")), F.regexp_replace(token, r"[^\n]", " ")).otherwise(token)

    return let(col, lambda c: F.when(F.contains(c, F.lit("/")), _each(c, JAVA_OPAQUE, blank)).otherwise(c))


def mask_source(col: Column) -> Column:
    """Java source with comments as blanks and the insides of strings and characters as filler: nothing moves."""

    def fill(token: Column) -> Column:
        quote = F.left(token, F.lit(1))
        inside = F.regexp_replace(F.substring(token, F.lit(2), F.length(token) - 2), r"[^\n]", "_")
        plain = F.repeat(F.lit("_"), F.length(token) - 2)
        return F.when(quote == "/", F.regexp_replace(token, r"[^\n]", " ")).otherwise(F.concat(quote, F.when(F.contains(token, F.lit("\n")), inside).otherwise(plain), quote))

    return _each(col, JAVA_OPAQUE, fill)


def shield_quoted(col: Column) -> Column:
    """Source with the brackets inside strings and characters as marks, which ``unshield`` undoes."""
    return _each(col, JAVA_QUOTED, lambda token: F.translate(token, "()", SHIELD))


def unshield(col: Column) -> Column:
    return F.translate(col, SHIELD, "()")


def pair_brackets(masked: Column, near: str = "") -> Column:
    """Both round brackets of a pair as the same character, another one for each height.

    Pairs are marked inside out, a pass over the text for each height, until nothing changes: a pair holds
    lower ones only. So a pattern finds the partner of a bracket as the next equal character, however deep.
    Brackets without a partner stay, and nothing moves. The lowest pairs get the characters ``near``.
    """

    first = near + "".join(chr(_FIRST_PAIR + k) for k in range(len(near), 64))

    def mark(k: Column) -> Column:
        far = F.decode(F.unhex(F.lpad(F.hex(F.lit(_FIRST_PAIR) + F.pmod(k, F.lit(_PAIRS - 2))), 8, "0")), "UTF-32")
        return F.when(k < len(first), F.substring(F.lit(first), k + 1, F.lit(1))).otherwise(far)

    def level(acc: Column, k: Column) -> Column:
        new = F.regexp_replace(acc["text"], r"\(([^()]*+)\)", F.concat(mark(k), F.lit("$1"), mark(k)))
        return F.when(acc["over"], acc).otherwise(
            let(new, lambda n: F.struct(n.alias("text"), ((n == acc["text"]) | ~F.contains(n, F.lit("("))).alias("over")))
        )

    def rounds(m: Column) -> Column:
        start = F.struct(m.alias("text"), F.lit(False).alias("over"))
        return F.aggregate(F.sequence(F.lit(0), F.octet_length(m) - F.octet_length(F.replace(m, F.lit("("), F.lit("")))), start, level, lambda acc: acc["text"])

    return let(masked, lambda m: F.when(F.contains(m, F.lit("(")), rounds(m)).otherwise(m))


def paired(group: int, pair: str = PAIR) -> str:
    """Pattern for a pair in text from ``pair_brackets``; ``group`` is the number of its capture."""
    return rf"({pair}){inside(group, pair)}\{group}"


def inside(group: int, pair: str = PAIR) -> str:
    """Pattern for what stands between the brackets of the pair whose first one is captured."""
    return rf"(?:[^{pair[1:]}++|(?!\{group}).)*+"


def fold_java_strings(col: Column) -> Column:
    """All quoted Java strings of an expression, joined into one text."""
    inside = f'"({JAVA_STRING[1:-1]})"'
    return F.array_join(F.regexp_extract_all(col, F.lit(inside), F.lit(1)), "")


def only_java_strings(col: Column) -> Column:
    """True when the expression is quoted strings joined by ``+`` and nothing else."""
    return F.regexp_replace(col, JAVA_STRING, "").rlike(r"^[\s+()]*$") & F.contains(col, F.lit('"'))
