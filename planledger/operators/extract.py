"""Call sites and query strings in a corpus of source files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure, text
from ..functions.scale import last_before

#: Positions of a block that is gathered in one row.
BLOCK = 1024

# Fixed names of the calls that make a query.
QUERY_METHODS = ("createQuery", "createNativeQuery", "createNamedQuery", "createSQLQuery")


def extract_calls(corpus: DataFrame, method_names: Sequence[str] = QUERY_METHODS) -> DataFrame:
    """One row per call of a query-making method: argument, call text and position.

    Works inside each file row, without a shuffle, in about linear time. Positions are 1-based and the
    end is inclusive; ``at`` is the place of the call's opening bracket. Comments, strings and characters
    are masked first, so only real calls are found. A call in another call's brackets is a call as well.
    """
    kept = [c for c in corpus.columns if c != "content"]
    # A file without a name that makes queries is looked at once.
    masked = F.when(F.col("content").rlike("|".join(method_names)), F.regexp_replace(text.mask_source(F.col("content")), text.NEAR_PAIR, "#"))
    # Marks look alike on both sides: a name before a closing bracket is no call, and no chain begins behind an opening one.
    masked = text.replace_all(masked, (rf"{_begins(method_names)}\b(?=(?:{'|'.join(method_names)})\s*+\))\w", "_"), (r"(?<=\()(\s*+)\.", "$1;"))
    files = corpus.withColumn("_paired", text.pair_brackets(masked, text.NEAR)).withColumn("_back", F.reverse("_paired"))
    files = files.withColumn("_calls", called("_paired", "_back", method_names))
    rows = files.select(*kept, "content", F.posexplode_outer("_calls").alias("call_ord", "_c")).filter("_c is not null")
    start, end = F.expr("_c.at - length(_c.head)"), F.expr("_c.at + length(_c.inside) + 1")
    stop = F.when(F.contains("_c.inside", F.lit(",")), F.col("_c.at") + 1 + F.length(F.regexp_extract("_c.inside", _FIRST, 0))).otherwise(end)
    rows = rows.select(
        *kept,
        "content",
        "call_ord",
        start.alias("_start"),
        end.alias("_end"),
        stop.alias("_stop"),
        (F.col("_c.line") - _lines("_c.head") + 1).alias("begin_line"),
        F.when(_broken("_c.head"), F.length("_c.before") + 1).otherwise(start - F.col("_c.break_at")).alias("begin_col"),
        (F.col("_c.line") + _lines("_c.inside") + 1).alias("end_line"),
        F.when(_broken("_c.inside"), F.length(F.substring_index("_c.inside", "\n", -1)) + 1).otherwise(end - F.col("_c.break_at")).alias("end_col"),
        F.col("_c.at").alias("at"),
    )
    rows = rows.withColumn("argument", F.expr("substring(content, at + 1, _stop - at - 1)"))
    return rows.select(
        *kept,
        "call_ord",
        text.stripped(text.blank_comments(F.col("argument"))).alias("argument"),
        F.expr("substring(content, _start, _end - _start + 1)").alias("call_text"),
        *RANGE,
        "at",
    )


#: Names before a bracket, from the bracket back: ``name.name``.
_NAMES_BACK = r"\s*+\w++\b(?:\s*+\.\s*+\w++\b)*+"


def _chain_back(group: int) -> str:
    """The same, and the chain of calls before them; ``group`` is the number of its capture."""
    return rf"{_NAMES_BACK}(?:\s*+\.\s*+{text.paired(group, text.NEAR_PAIR)}(?=(?:\n\r?+|\r)?+\w)(?:{_NAMES_BACK})?+)*+"


def _begins(method_names: Sequence[str]) -> str:
    """A look at one character, which spares the other places of a text the test for a whole name."""
    return f"(?=[{''.join(sorted({n[0] for n in method_names}))}])"


#: The first argument of a call: up to a comma outside of inner brackets, if no curly one comes next.
_FIRST = rf"(?s)^(?:{text.paired(1, text.NEAR_PAIR)}|[^,]|,(?=(?:(?!{text.NEAR_PAIR})[^{{}}])*+[{{}}]))*+"


def called(paired: str, back: str, method_names: Sequence[str]) -> Column:
    """The calls in a text with paired brackets, in order: as ``call_places``, but found by patterns.

    What stands behind a call's bracket is read forwards, what stands before it ``back``, in the text turned round.
    Places and lines are sums over the gaps between calls, of which there are few.
    """
    ahead = F.lit(rf"(?s){_begins(method_names)}\b(?:{'|'.join(method_names)})\s*+({text.NEAR_PAIR})(?=({text.inside(1, text.NEAR_PAIR)})\1)")
    own = rf"(?s){text.NEAR_PAIR}(?=\s*+(?:{'|'.join(n[::-1] for n in method_names)})\b)"
    found = F.struct(
        F.regexp_extract_all(paired, ahead, F.lit(2)).alias("inside"),
        F.reverse(F.regexp_extract_all(back, F.lit(f"{own}(?=({_chain_back(2)}))"), F.lit(1))).alias("head"),
        F.reverse(F.slice(structure.split_at(F.col(back), own), 2, 1 << 30)).alias("gap"),
    )
    # For chains over several lines: what stands before them in their line.
    before = F.reverse(F.regexp_extract_all(back, F.lit(f"{own}(?={_chain_back(1)}([^\n]*+))"), F.lit(2)))

    def calls(x: Column) -> Column:
        lead = F.when(F.exists(x["head"], _broken), before).otherwise(x["head"])
        return F.transform(
            F.arrays_zip(x["inside"].alias("inside"), x["head"].alias("head"), lead.alias("before"), _places(x["gap"]).alias("place")),
            lambda c: F.struct(*(c[n].alias(n) for n in ("inside", "head", "before")), *(c["place"][n].alias(n) for n in ("at", "line", "break_at"))),
        )

    return structure.let(found, calls)


def _places(gaps: Column) -> Column:
    """The places of the calls' brackets behind each gap, the line breaks before them and the place of the last one."""
    place = "at:int,line:int,break_at:int"

    # Gaps are turned round: what follows their last line break comes first.
    def add(acc: Column, gap: Column) -> Column:
        at = acc["at"] + F.length(gap) + 1
        broken = F.when(_broken(gap), at - 1 - F.length(F.substring_index(gap, "\n", 1))).otherwise(acc["break_at"])
        own = F.struct(at.alias("at"), (acc["line"] + _lines(gap)).alias("line"), broken.alias("break_at"))
        return structure.let(own, lambda p: F.struct(*(p[n].alias(n) for n in ("at", "line", "break_at")), F.concat(acc["all"], F.array(p)).alias("all")))

    start = F.expr(f"cast(named_struct('at', 0, 'line', 0, 'break_at', 0, 'all', array()) as struct<{place},all:array<struct<{place}>>>)")
    return F.aggregate(gaps, start, add, lambda acc: acc["all"])


def _broken(part) -> Column:
    return F.contains(part, F.lit("\n"))


def _lines(part) -> Column:
    return F.octet_length(part) - F.octet_length(F.replace(part, F.lit("\n"), F.lit("")))


def chains(found: Column) -> Column:
    """For each of a text's ``brackets``, the number of the bracket with which its chain of calls begins.

    ``a.b(c).d(e)`` is a chain: what stands before the second opening bracket goes on from the first
    pair. The first one's ``piece`` ends in the chain's first names.
    """

    def before(x: Column) -> Column:
        closed = F.get(found, x["i"] - 1)
        opened = F.get(found, closed["partner"])
        goes_on = (x["br"] == "(") & x["piece"].rlike(r"^\s*\.\s*(?:\w+\s*\.\s*)*+\w+\s*$") & (closed["br"] == ")") & opened["piece"].rlike(r"\w$")
        return F.when(goes_on, closed["partner"]).otherwise(x["i"])

    return structure.follow(F.transform(found, before))


def call_places(found: Column, method_names: Sequence[str]) -> Column:
    """The calls among a text's ``brackets``: their range, ``at``, and ``stop``, where the first argument ends."""
    return structure.let(found, lambda b: _calls(b, "|".join(method_names)))


def _calls(b: Column, names: str) -> Column:
    def places(x: Column) -> Column:
        own = x["of"]
        first, close = F.get(b, x["root"]), F.get(b, own["partner"])
        head = F.regexp_extract(first["piece"], r"((?:\b\w+\s*\.\s*)*+\b\w+\s*)$", 1)
        # The piece before the chain, and the line breaks of the whole text before that.
        lead = F.left(first["piece"], F.length(first["piece"]) - F.length(head))
        over = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        tail = F.length(F.substring_index(lead, "\n", -1))
        start = first["at"] - F.length(head)
        inside = F.slice(b, own["i"] + 2, own["partner"] - own["i"])
        level = lambda k: F.when(k["br"] == "(", k["key"] - 1).when(k["br"] == ")", k["key"])
        comma = F.get(F.filter(inside, lambda k: F.contains(k["piece"], F.lit(",")) & (level(k) == own["key"])), F.lit(0))
        return F.struct(
            start.alias("start"),
            (first["line"] - over + 1).alias("begin_line"),
            F.when(over == 0, start - first["break_at"]).when(F.contains(lead, F.lit("\n")), tail + 1).otherwise(start - F.coalesce(F.get(b, x["root"] - 1)["break_at"], F.lit(0))).alias("begin_col"),
            (close["line"] + 1).alias("end_line"),
            (close["at"] - close["break_at"]).alias("end_col"),
            close["at"].alias("end"),
            own["at"].alias("at"),
            F.coalesce(comma["at"] - F.length(comma["piece"]) - 1 + F.instr(comma["piece"], ","), close["at"]).alias("stop"),
        )

    zipped = F.arrays_zip(b.alias("of"), chains(b).alias("root"))
    calls = F.filter(zipped, lambda x: (x["of"]["br"] == "(") & x["of"]["partner"].isNotNull() & x["of"]["piece"].rlike(rf"\b(?:{names})\s*$"))
    return F.transform(calls, places)


def fold_concat(calls: DataFrame) -> DataFrame:
    """Adds ``query_text``: the quoted parts of the argument joined, in lower case."""
    return calls.withColumn("query_text", F.lower(text.fold_java_strings(F.col("argument"))))


def classify(calls: DataFrame) -> DataFrame:
    """Adds ``is_dynamic``; a dynamic query keeps its whole argument text as ``query_text``."""
    folded = F.lower(text.fold_java_strings(F.col("argument")))
    return calls.withColumn("is_dynamic", ~text.only_java_strings(F.col("argument"))).withColumn(
        "query_text", F.when(~F.col("is_dynamic"), folded).otherwise(F.lower("argument"))
    )


def expand_variants(fragments: DataFrame, key: str, seq: str, alternatives: str, dynamic: str | None = None) -> DataFrame:
    """Every text a builder can make: one per choice of alternative for each fragment.

    ``alternatives`` is an array of texts, ``seq`` the place of the fragment, ``dynamic`` an
    optional flag. A builder's fragments come from one place in one source file, so its row stays
    small. Choices are numbered: a builder becomes a row for each number, and the number's digits, to
    the bases of how many alternatives each fragment has, say which ones are joined. First the numbers
    of the leading half of the digits are rows, then those of the rest, so no task holds them all.
    """
    flag = F.col(dynamic) if dynamic else F.lit(False)
    part = F.struct(F.col(seq).alias("seq"), F.array_distinct(alternatives).alias("alts"), flag.alias("dyn"))
    built = fragments.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    built = built.select(key, F.exists("_parts", lambda p: p["dyn"]).alias("is_dynamic"), F.transform("_parts", lambda p: p["alts"]).alias("_alts"))

    def product(alts: Column) -> Column:
        return F.aggregate(alts, F.lit(1).cast("bigint"), lambda acc, a: acc * F.size(a))

    def text_of(alts: Column, number: Column) -> Column:
        """The choice of this number: its last digit is the last fragment's."""
        start = F.struct(number.cast("bigint").alias("left"), F.lit("").alias("text"))

        def digit(acc: Column, a: Column) -> Column:
            size = F.size(a)
            return F.struct(F.floor(acc["left"] / size).cast("bigint").alias("left"), F.concat(F.get(a, F.pmod(acc["left"], size).cast("int")), acc["text"]).alias("text"))

        return F.aggregate(F.reverse(alts), start, digit, lambda acc: acc["text"])

    def chosen(df: DataFrame, alts: str, into: str) -> DataFrame:
        # No number where a fragment has no alternative.
        numbers = F.when(product(F.col(alts)) > 0, F.sequence(F.lit(0).cast("bigint"), product(F.col(alts)) - 1))
        numbered = df.withColumn("_number", F.explode_outer(numbers)).filter("_number is not null")
        return numbered.withColumn(into, text_of(F.col(alts), F.col("_number"))).drop(alts, "_number")

    half = F.floor(F.size("_alts") / 2).cast("int")
    halves = built.select(key, "is_dynamic", F.slice("_alts", F.lit(1), half).alias("_head"), F.slice("_alts", half + 1, F.size("_alts")).alias("_tail"))
    rows = chosen(chosen(halves, "_head", "_first"), "_tail", "_last").select(key, "is_dynamic", F.concat("_first", "_last").alias("query_text")).filter("query_text <> ''")
    # Different choices may make one text.
    return rows.distinct()


def assemble(events: DataFrame, key: str, position: str, block: int = BLOCK) -> DataFrame:
    """Builder texts: each ``use`` with the appends since the builder's last ``init``.

    ``events`` has ``kind`` (init, append or use) and ``fragment``. An append belongs to the
    last init before it; a use ends the text it can see. Result: one row per use.

    A builder may own any share of the events. They are gathered by blocks of ``block`` positions, where
    a use sees what stands before it; only the blocks' texts meet per text, which is a value anyway.
    """
    marked = last_before(events, [key], position, F.when(F.col("kind") == "init", F.col(position)), "init_at", block)
    at = F.col(position)
    part = F.when(F.col("kind").isin("init", "append"), F.struct(at.alias("at"), F.coalesce("fragment", F.lit("")).alias("text")))
    pieces = (
        marked.filter(F.col("init_at").isNotNull() & F.col("kind").isin("init", "append", "use"))
        .groupBy(key, "init_at", F.floor(at / F.lit(block)).alias("_block"))
        .agg(F.sort_array(F.collect_list(part)).alias("_parts"), F.collect_list(F.when(F.col("kind") == "use", at)).alias("_uses"))
    )
    texts = pieces.filter(F.size("_parts") > 0).select(key, "init_at", F.struct(F.col("_block").alias("block"), _joined(F.col("_parts")).alias("text"), F.size("_parts").alias("n")).alias("_b"))
    texts = texts.groupBy(key, "init_at").agg(F.sort_array(F.collect_list("_b")).alias("_blocks"))
    uses = pieces.select(key, "init_at", "_block", "_parts", F.explode_outer("_uses").alias("use_at")).filter("use_at is not null")
    own = uses.withColumn("_own", F.filter("_parts", lambda p: p["at"] < F.col("use_at")))
    own = own.select(key, "init_at", "_block", "use_at", F.size("_own").alias("_n"), _joined(F.col("_own")).alias("_text"))
    before = F.filter("_blocks", lambda b: b["block"] < F.col("_block"))
    rows = own.join(texts, [key, "init_at"]).withColumn("_before", before)
    count = F.aggregate("_before", F.col("_n"), lambda acc, b: acc + b["n"])
    return rows.select(key, "use_at", "init_at", count.alias("fragments"), F.concat(_joined(F.col("_before")), "_text").alias("query_text"))


def fold_assignments(events: DataFrame, key: str, position: str, literal: str, block: int = BLOCK) -> DataFrame:
    """The literals assigned to a plain variable, joined in source order: by blocks of positions, then the blocks."""
    part = F.struct(F.col(position).alias("at"), F.col(literal).alias("text"))
    pieces = events.groupBy(key, F.floor(F.col(position) / F.lit(block)).alias("_block")).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(part)).alias("_parts"))
    pieces = pieces.select(key, "_n", F.struct("_block", _joined(F.col("_parts")).alias("text")).alias("_b"))
    whole = pieces.groupBy(key).agg(F.sum("_n").alias("assignments"), F.sort_array(F.collect_list("_b")).alias("_blocks"))
    return whole.select(key, "assignments", _joined(F.col("_blocks")).alias("query_text"))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


RANGE = ("begin_line", "begin_col", "end_line", "end_col")


def locate(statements: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Every call site of each statement, matched without regard to case; static and dynamic apart.

    A text used at very many places crowds on one key; adaptive execution splits the
    call-site side, which is the streamed one. Neither side is broadcast: both grow with the corpus.
    """
    stmts = statements.select("stmt_id", "is_dynamic", F.lower("query_text").alias("_text"))
    sites = call_sites.withColumn("_text", F.lower("query_text")).drop("stmt_id")
    return sites.hint("merge").join(stmts, ["_text", "is_dynamic"]).select("stmt_id", *(c for c in sites.columns if c != "_text"))


def last_locations(call_sites: DataFrame) -> DataFrame:
    """Per file and text the last call site."""
    return call_sites.groupBy("path", F.lower("query_text").alias("query_text")).agg(
        F.max_by(F.struct("call_ord", "call_text", *RANGE), "call_ord").alias("_last")
    ).select("path", "query_text", "_last.*")


def scan_summary(corpus: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Files scanned, files with at least one query, query variations."""
    rows = corpus.select("path", F.lit(1).alias("file"), F.lit(0).alias("query")).unionByName(
        call_sites.select("path", F.lit(0).alias("file"), F.lit(1).alias("query"))
    )
    per_path = rows.groupBy("path").agg(F.sum("file").alias("files"), F.sum("query").alias("queries"))
    return per_path.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("scanned_files"),
        F.count(F.when((F.col("files") > 0) & (F.col("queries") > 0), 1)).alias("files_with_queries"),
        F.coalesce(F.sum("queries"), F.lit(0)).alias("variations"),
    )
