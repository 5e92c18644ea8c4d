"""Personal data: fixed patterns as seeds, and contexts learnt from them that find more.

Seeds are e-mail addresses, IP addresses, payment cards and phone numbers in their usual form. The
two words before a seed are its pattern. Patterns and instances form a graph with occurrence counts:
a pattern's score is the part of all its occurrences in the corpus that is followed by instances of
the kind, weighted by their scores; an instance's score is the mean of its patterns' scores, seeds
stay at 1. After a few rounds, patterns with enough different seeds and a high score are trusted,
and identifiers written in unusual ways (dotted card numbers, phones without plus, spelled-out
addresses, IPv6) are reported where a trusted pattern of their kind is before them.

Positions are code points, ends exclusive. Null and empty texts have no spans; null ids, repeated
rows and further columns do no harm (a row is known by a number of its own); an empty table gives an
empty result. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import rounds, sized, written
from planledger.llm.decontam import bloom, gram_counts, words
from planledger.llm.spans import SPAN

KINDS = ("email", "ip", "card", "phone")
CONTEXT, SEEDS, TRUST, ROUNDS = 2, 3, 0.5, 3
#: What the contract fixes; each is run so that it takes time linear in the text.
AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Unusual ways of writing, by kind.
UNUSUAL = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|＠)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63})+")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+./-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9./-])")),
)
_WORDS = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind number, start and end of the fixed patterns' spans, by kind, then start."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in BEFORE_AT:
            start -= 1
        m = AFTER_AT.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            start, parts = m.start(), m.group().split(".")
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                    found.append((1, start, start + size))
                start += size + 1
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def unusual_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Possible identifiers that no fixed pattern covers."""
    found = []
    for kind, pattern in UNUSUAL:
        if kind == 0 and not any(sign in text for sign in ("(at)", "[at]", "＠")):
            continue
        for m in pattern.finditer(text):
            n = len(digits_of(m.group()))
            fits = (True, ":" in m.group(), 13 <= n <= 19 and kind == 2 and luhn(digits_of(m.group())), 9 <= n <= 15)[kind]
            if fits and not any(a < m.end() and m.start() < b for _, a, b in taken):
                found.append((kind, m.start(), m.end()))
    return found


def mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``row`` (a number), ``id`` and ``found``: spans with pattern and instance."""
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int64()), ("instance", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in rounds(batches):
            rows, before = [], []
            for text in batch.column("text").to_pylist():
                spans = []
                if text:
                    base = base_spans(text)
                    for is_base, group in ((True, base), (False, unusual_spans(text, base))):
                        for kind, start, stop in group:
                            near = _WORDS.findall(text[max(0, start - 256) : start].lower())[-CONTEXT:]
                            before.append(" ".join(near) if len(near) == CONTEXT else "")
                            spans.append({"kind": kind, "start": start, "stop": stop, "base": is_base, "pattern": len(before) - 1, "instance": text[start:stop].lower()})
                rows.append(spans)
            _, owner, grams = words(pa.array(before, pa.string()), CONTEXT)
            pattern = np.zeros(len(before), np.int64)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            pattern[owner[first]] = grams[first].view(np.int64)
            for spans in rows:
                for s in spans:
                    s["pattern"] = int(pattern[s["pattern"]]) or None
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(rows))), batch.column("id"), pa.array(rows, pa.list_(span))], names=["row", "id", "found"])
            number += len(rows)

    kind = T._parse_datatype_string("array<struct<kind:int,start:int,stop:int,base:boolean,pattern:bigint,instance:string>>")
    return own.mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), own.schema["id"], T.StructField("found", kind)]))


def trusted(df: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind``, ``pattern``: contexts that tell a kind. Only contexts before both a seed and an
    unusual identifier matter, so their occurrences are counted and only they are scored."""
    edges = spans.filter("pattern is not null").groupBy("kind", "pattern", "instance").agg(F.max("base").alias("seed"), F.count("*").alias("n"))
    edges = written(edges, "edges")
    useful = edges.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds"), F.bool_or(~F.col("seed")).alias("more"))
    useful = written(useful.filter(F.col("more") & (F.col("seeds") >= SEEDS)).select("kind", "pattern"), "patterns")
    total = gram_counts(df, text_col, bloom(useful.select(F.col("pattern").alias("gram"))), CONTEXT)
    total = written(total.select(F.col("gram").alias("pattern"), "times"), "totals")
    edges = written(edges.join(useful, ["kind", "pattern"]).join(total, "pattern"), "graph")
    instances = edges.select("kind", "instance", F.col("seed").cast("double").alias("score")).groupBy("kind", "instance").agg(F.max("score").alias("score"))
    for k in range(ROUNDS):
        scored = edges.join(written(instances, f"instances{k}"), ["kind", "instance"])
        patterns = scored.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max(F.greatest("times", "n"))).alias("trust"))
        patterns = written(patterns, f"trust{k}")
        instances = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.when(F.max("seed"), 1.0).otherwise(F.avg(F.least(F.col("trust"), F.lit(1.0)))).alias("score"))
    return patterns.filter(F.col("trust") >= TRUST).select("kind", "pattern")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans`` (kind, start, stop, base), by kind as listed, then start."""
    rows = written(mentions(df, id_col, text_col), "mentions")
    spans = rows.select("row", F.explode("found").alias("s")).select("row", "s.*")
    more = spans.filter("not base").join(trusted(df, spans, text_col), ["kind", "pattern"])
    more = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop", "base")).alias("more"))  # of one text
    shape = "array<struct<kind:int,start:int,stop:int,base:boolean>>"
    base = F.transform(F.filter("found", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base")))
    every = F.array_sort(F.concat(base.cast(shape), F.coalesce("more", F.array().cast(shape))))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(every, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base")))
    return rows.join(written(more, "more"), "row", "left").select(F.col("id").alias(id_col), named.cast(f"array<{SPAN}>").alias("spans"))
