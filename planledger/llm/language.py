"""Languages of mixed texts: scripts narrow the candidates, then Viterbi labels every word.

Words are runs of letters and marks of one script. A word is scored under each language by the
log-probabilities of its letters, pairs and triples (hashed, its ends marked); only languages whose
training texts use the word's script are candidates, all languages if none does. Along a text,
changing the language between two words costs a penalty; the best path gives the labelled spans.
The language with most letters is the text's, ties to the smaller value, and its share of the
letters is the score.

Long texts are cut into blocks of words. Blocks run in step with each other, first from every
language their predecessor may end in, then from the scores it does end with, so a text of millions
of words takes no more steps than a short one, and the path is the one of an undivided walk.

Training counts are summed per task and then per cell; the table has a fixed number of cells
(``CELLS``), shared by the languages. Languages are few: their distinct values are read.

Null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing
was learnt. Null ids are labelled, repeated rows each. Texts with a null language are not learnt. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import binary, mix, rounds, sized

UNKNOWN = "und"
#: Cost of another language, in natural log units; what a cell has been seen besides its count.
SWITCH, PRIOR = 10.0, 0.5
#: Share of a language's letters from which a script is one of its own.
OWN_SCRIPT = 0.01
ORDERS, CELLS, MOST_BITS, LEAST_BITS, BLOCK = 3, 1 << 22, 15, 10, 128

# Code point ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("khmer", ((0x1780, 0x17FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, a letter or mark, its small form, its script (0: another)."""
    points = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in points), bool, len(points))
    mark = np.fromiter((unicodedata.category(c)[0] == "M" for c in points), bool, len(points))
    small = np.arange(len(points), dtype=np.uint32)
    for c in np.flatnonzero(letter):
        if len(low := points[c].lower()) == 1:
            small[c] = ord(low)
    script = np.zeros(len(points), np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for low, high in ranges:
            script[low : high + 1] = k
    return letter, letter | mark, small, script


@dataclass
class Words:
    """Words of a batch of texts: text number, place in the text, script, letters, code points in small letters."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    points: np.ndarray
    first: np.ndarray


def words(texts: pa.Array) -> Words:
    letter, part, small, script = characters()
    strings = [t.decode("utf-8", "replace") for t in binary(texts).to_pylist()]
    # A line feed, which is in no word, parts the texts.
    points = np.frombuffer("\n".join([*strings, ""]).encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum(np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings)))))
    inside, kind = part[points], script[points]
    before = np.zeros(len(points), bool)
    before[1:] = inside[:-1] & (kind[1:] == kind[:-1])
    after = np.zeros(len(points), bool)
    after[:-1] = before[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    count = np.concatenate(([0], np.cumsum(letter[points])))
    letters = count[end] - count[start]
    start, end, letters = start[letters > 0], end[letters > 0], letters[letters > 0]
    text = np.searchsorted(begins, start, side="right") - 1
    return Words(text, start - begins[text], end - begins[text], kind[start], letters, small[points], start)


def grams(found: Words, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its number, and the word and bucket of each n-gram; a word's ends count as a character."""
    size = found.end - found.start + 2
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    inner = (at > 0) & (at < size[word] - 1)
    padded = np.full(len(word), 32, np.uint64)
    padded[inner] = found.points[found.first[word[inner]] + at[inner] - 1]
    for n in range(1, ORDERS + 1):
        code = np.full(max(len(word) - n + 1, 0), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x110001) + padded[k : k + len(code)]
        whole = inner if n == 1 else word[: len(code)] == word[n - 1 :]
        yield n - 1, word[: len(code)][whole], (mix(code[whole]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Language values in order, log-probabilities by (order, bucket, language), own scripts by (script, language)."""

    languages: list[str]
    bits: int
    table: np.ndarray
    own: np.ndarray


def bits_for(languages: int) -> int:
    """Hash bits such that the table keeps to ``CELLS``, within the limits of what is useful."""
    return int(np.clip(np.floor(np.log2(CELLS / (ORDERS * max(languages, 1)))), LEAST_BITS, MOST_BITS))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """The model of these rows; None if there is no language."""
    known = sized(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    bits, number = bits_for(len(languages)), {lang: k for k, lang in enumerate(languages)}
    cells, scripts = ORDERS << bits, len(SCRIPTS) + 1
    width = cells + scripts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * width, np.int64)
        for batch in rounds(batches):
            found = words(batch.column("text"))
            own = np.array([number[v] for v in batch.column("lang").to_pylist()], np.int64)[found.text]
            for order, word, bucket in grams(found, bits):
                total += np.bincount(own[word] * width + (order << bits) + bucket, minlength=len(total))
            total += np.bincount(own * width + cells + found.script, weights=found.letters, minlength=len(total)).astype(np.int64)
        cell = np.flatnonzero(total)
        for low in range(0, len(cell), 1 << 16):
            piece = cell[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], names=["cell", "n"])

    rows = known.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(languages) * width)
    total[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    total = total.reshape(len(languages), width)
    seen = total[:, :cells].reshape(len(languages), ORDERS, 1 << bits) + PRIOR
    table = np.log(seen / seen.sum(axis=2, keepdims=True)) / ORDERS
    letters = total[:, cells:]
    own = letters >= OWN_SCRIPT * np.maximum(letters.sum(axis=1, keepdims=True), 1)
    return Model(languages, bits, np.ascontiguousarray(table.transpose(1, 2, 0), np.float32), np.ascontiguousarray(own.T))


def word_scores(found: Words, model: Model) -> np.ndarray:
    """Log-probability of each word under each language, minus infinity where the script rules it out."""
    total = np.zeros((len(found.text), len(model.languages)))
    for order, word, bucket in grams(found, model.bits):
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(word, weights=model.table[order, bucket, k], minlength=len(total))
    allowed = model.own[found.script]
    allowed[~allowed.any(axis=1)] = True
    return np.where(allowed, total, -np.inf)


def best_path(score: np.ndarray, text: np.ndarray, penalty: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """The label of each word: best sum of scores less ``penalty`` for each change within a text.

    ``text`` numbers the texts in ascending order. Ties keep the label, then take the least.
    """
    n, labels = score.shape
    if not n:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    sizes = np.diff(np.append(begins, n))
    blocks = -(-sizes // block)
    first = np.cumsum(blocks) - blocks
    place = np.arange(blocks.sum()) - np.repeat(first, blocks)
    start = np.repeat(begins, blocks) + place * block
    length = np.minimum(block, np.repeat(begins + sizes, blocks) - start)

    def step(value: np.ndarray, t: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = value.max(axis=-1, keepdims=True) - penalty
        stay = value >= top
        own = score[start[live] + t].reshape(len(live), *[1] * (value.ndim - 2), labels)
        return np.where(stay, value, top) + own, stay, value.argmax(axis=-1)

    # What each block adds from each label before it to each label at its end; the last block's isn't used.
    many = np.flatnonzero(place < np.repeat(blocks, blocks) - 1)
    gain = np.full((len(start), labels, labels), -np.inf)
    gain[:, np.arange(labels), np.arange(labels)] = 0
    for t in range(block if len(many) else 0):
        gain[many] = step(gain[many], t, many)[0]
    entry = np.zeros((len(start), labels))
    for k in range(1, blocks.max()):
        to = first[blocks > k] + k
        entry[to] = (entry[to - 1][:, :, None] + gain[to - 1]).max(axis=1)
    # Again from what it begins with, keeping where each value comes from.
    value, origin = entry.copy(), np.tile(np.arange(labels), (len(start), 1))
    stays, tops = [], []
    for t in range(length.max()):
        live = np.flatnonzero(length > t)
        value[live], stay, top = step(value[live], t, live)
        origin[live] = np.where(stay, origin[live], np.take_along_axis(origin[live], top[:, None], axis=1))
        stays.append((live, stay))
        tops.append(top)
    leaving = np.zeros(len(start), np.int64)
    last = first + blocks - 1
    leaving[last] = value[last].argmax(axis=1)
    for k in range(blocks.max() - 1, 0, -1):
        at = first[blocks > k] + k
        leaving[at - 1] = origin[at, leaving[at]]
    found = np.zeros(n, np.int64)
    now = leaving
    for t in range(length.max() - 1, -1, -1):
        (live, stay), top = stays[t], tops[t]
        found[start[live] + t] = now[live]
        kept = stay[np.arange(len(live)), now[live]]
        now[live] = np.where(kept, now[live], top)
    return found


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` and ``spans``, an array of (start, stop, lang).

    A span goes from the first character of its first word to the end of its last, in code points.
    """
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS numbers at most for up to a thousand languages
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object) if model else np.zeros(0, object)
        for batch in rounds(batches):
            rows = batch.num_rows
            found = words(batch.column("text"))
            if model:
                label = best_path(word_scores(found, model), found.text)
                letters = np.bincount(found.text * len(names) + label, weights=found.letters, minlength=rows * len(names)).reshape(rows, -1)
                total, best = letters.sum(axis=1), letters.argmax(axis=1)
                some = total > 0
                pred = np.where(some, names[best], UNKNOWN)
                score = np.where(some, letters[np.arange(rows), best] / np.maximum(total, 1), 0.0)
                changes = np.concatenate(([True], (found.text[1:] != found.text[:-1]) | (label[1:] != label[:-1]))) if len(label) else np.zeros(0, bool)
                at = np.flatnonzero(changes)
                stop = found.end[np.append(at[1:], len(label))[: len(at)] - 1]
                spans = [found.start[at], stop, names[label[at]]]
                offsets = np.searchsorted(found.text[at], np.arange(rows + 1))
            else:
                pred, score, offsets = np.full(rows, UNKNOWN, object), np.zeros(rows), np.zeros(rows + 1, np.int64)
                spans = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
            parts = pa.StructArray.from_arrays([pa.array(spans[0], pa.int32()), pa.array(spans[1], pa.int32()), pa.array(spans[2], pa.string())], names=["start", "stop", "lang"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score), lists], names=["id", "lang_pred", "score", "spans"])

    kind = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return own.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def in_training(doc_id: Column) -> Column:
    """Whether the query learns from this row: crc32 of the id as text leaves another remainder than 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))
