"""Secrets: fixed patterns, and strings in sensitive contexts that a primed compressor can't shorten.

Base kinds are assignments to names such as password or token, access ids and long hex strings. The
method adds kind ``novel``: a string of letters and digits after a sensitive word whose marginal
compressed size is high. Zstandard is primed with identifiers that the corpus uses near sensitive
words, the most frequent ones, ``DICTIONARY_BYTES`` in all; a candidate's novelty is what it adds
to the compressed size of the text around it, per character. Ordinary names, being in the
dictionary or like their surroundings, add little.

Positions are code points, ends exclusive. Null and empty texts have no spans. Null ids, repeated
rows and further columns are carried or ignored as in ``scan`` and ``redact``; an empty table gives
an empty result. Nothing is cut: a span may be as long as its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import rounds, sized
from planledger.llm.spans import SPAN

KINDS = ("assign", "access", "hex", "novel")
#: What the contract fixes.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}+")
#: What the method looks at: words that make a context sensitive, strings after them, identifiers near them.
SENSITIVE = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "signature", "session", "cookie", "jwt", "salt")
STRING_START, STRING = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]"), re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,63}+")
DICTIONARY_BYTES, REACH, NOVEL = 1 << 16, 48, 0.8


def mentions(text: str, words: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the words are in a text, in any case, in order of place. Substring search is far faster
    than a pattern that ignores case."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case
        low = "".join(c.lower() if c.isascii() else "\0" for c in text)
    found = []
    for word in words:
        at = low.find(word)
        while at >= 0:
            found.append((at, at + len(word)))
            at = low.find(word, at + 1)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind number and end of the fixed patterns' spans."""
    found, end = [], 0
    for at, _ in mentions(text, ("password", "passwd", "secret", "token", "api")):
        if at >= end and (m := ASSIGN.match(text, at)):
            end = m.end()
            if m.end(1) - m.start(1) >= 8:
                found.append((at, 0, end))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(s: str) -> bool:
    """Whether a string has digits and letters, in several turns: not a word with a number."""
    turns = re.findall(r"[0-9]+|[a-z]+|[A-Z]+", s)
    return len(turns) >= 4 and any(t[0].isdigit() for t in turns) and any(not t[0].isdigit() for t in turns)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings that begin within reach of a sensitive word before them, each once."""
    done = 0
    for _, end in mentions(text, SENSITIVE):
        for first in STRING_START.finditer(text, max(end, done), end + REACH):
            if first.start() >= done and (s := STRING.match(text, first.start())):
                done = s.end()
                if mixed(s.group()):
                    yield s.span()


class Novelty:
    def __init__(self, identifiers: list[str]):
        content = "\n".join(reversed(identifiers)).encode()[-DICTIONARY_BYTES:]
        primed = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(content) >= 8 else {}
        self.size = lambda data: len(zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, **primed).compress(data))

    def __call__(self, text: str, start: int, stop: int) -> float:
        """Compressed bytes that a string adds to its surroundings, per character."""
        around = (text[max(0, start - 256) : start] + text[stop : stop + 256]).encode()
        return (self.size(around + b"\n" + text[start:stop].encode()) - self.size(around + b"\n")) / (stop - start)


def find(text: str, novelty: Novelty, least: float) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    taken = sorted((a, b) for a, _, b in found)
    for start, stop in candidates(text):
        if not any(a < stop and start < b for a, b in taken) and novelty(text, start, stop) >= least:
            found.append((start, 3, stop))
    return sorted(found)


def identifiers(df: DataFrame, text_col: str = "text", size: int = DICTIONARY_BYTES) -> list[str]:
    """The identifiers most frequent near sensitive words of all texts, about ``size`` bytes of them."""
    own = sized(df).select(df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                for start, end in mentions(text or "", SENSITIVE):
                    counts.update(IDENTIFIER.findall(text, max(0, start - REACH), end + REACH))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])

    counted = own.mapInArrow(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.name for r in counted.orderBy(F.desc("n"), "name").limit(size // 8).collect()]


def _batches(names: list[str], least: float, make) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in rounds(batches):
            texts = batch.column("text").to_pylist()
            yield from make(batch, texts, [find(t, novelty, least) if t else [] for t in texts])

    return run


def scan(df: DataFrame, names: list[str] | None = None, least: float = NOVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``spans`` (kind, start, stop, base), by start, then kind as listed."""
    names = identifiers(df, text_col) if names is None else names
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))

    def make(batch, texts, found):
        rows = [[{"kind": KINDS[k], "start": a, "stop": b, "base": k < 3} for a, k, b in spans] for spans in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=["id", "spans"])

    fields = [own.schema["id"], T.StructField("spans", T._parse_datatype_string(f"array<{SPAN}>"))]
    return own.mapInArrow(_batches(names, least, make), T.StructType(fields)).withColumnRenamed("id", id_col)


def redact(df: DataFrame, names: list[str] | None = None, least: float = NOVEL, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each span, overlapping ones as one, replaced by a mark; ``length_col`` follows the new text."""
    names = identifiers(df, text_col) if names is None else names
    own = sized(df).select(F.struct(*(c for c in df.columns if c != text_col)).alias("row"), df[text_col].alias("text"))

    def make(batch, texts, found):
        changed = [bool(spans) for spans in found]
        for k, spans in enumerate(found):
            if spans:
                out, at = [], 0
                for start, _, stop in spans:
                    if start >= at:
                        out += [texts[k][at:start], mark]
                    at = max(at, stop)
                texts[k] = "".join(out) + texts[k][at:]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(changed)], names=["row", "text", "changed"])

    made = own.mapInArrow(_batches(names, least, make), T.StructType([*own.schema.fields, T.StructField("changed", T.BooleanType())]))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col("text").alias(c))
        elif c == length_col:
            new = F.char_length("text").cast(df.schema[c].dataType)
            columns.append(F.when(F.col("changed"), new).otherwise(F.col("row")[c]).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return made.select(*columns)
