"""Benchmark decontamination: rare word n-grams as seeds, then Smith-Waterman alignment.

Texts are words (letters, digits and non-ASCII bytes; in lower case). An item's seeds are those of its
3-grams that are rare for it: in at most ``RARE`` times as many documents as its median 3-gram, so
an item copied everywhere keeps its seeds and stop phrases go. A Bloom filter of fixed size finds
seeds in whole documents; hits become windows, hits and seeds are joined, and windows with enough
different seeds of an item are aligned with it word by word. The score is the alignment's share of
a perfect one: 1 for a copy, less by edits; from ``CUT`` on the document is contaminated.

Null and empty texts have no words and are clean, as are items of fewer words than a seed. Items of
equal text match alike and are all listed. Null ids of documents and items are carried along;
repeated rows are listed as one pair by ``contaminated`` and all dropped by ``decontaminate``. Empty
tables give empty results. Further columns are ignored, and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import byte_view, hashes, mix, rounds, sized, small_letters, word_runs, written

SEED_WORDS, SEEDS, RARE, RARE_DOCS, CUT = 3, 2, 4, 16, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 24
#: Cells of an alignment table that are computed together.
CELLS = 1 << 20


def words(texts: pa.Array, size: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of each word, and the hash of the n-gram that begins there (0: none)."""
    data, starts = byte_view(small_letters(texts))
    begin, end = word_runs(data, starts)
    h = hashes(data, begin, end)
    owner = np.searchsorted(starts, begin, side="right") - 1
    n = len(h) - size + 1
    grams = np.zeros(len(h), np.uint64)
    if n > 0:
        code = h[:n].copy()
        for k in range(1, size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        inside = owner[size - 1 :] == owner[:n]
        grams[:n][inside] = mix(code[inside]) | np.uint64(1)
    return h, owner, grams


def _bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((grams >> np.uint64(12)) & mask).astype(np.int64)


def bloom(grams: DataFrame) -> np.ndarray:
    """A filter of 2^FILTER_BITS bits over a column ``gram``; what is broadcast never grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(_bits(batch.column("gram").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(both >> 15), pa.array(both & 32767)], names=["block", "bit"])

    blocks = grams.select("gram").mapInArrow(run, "block bigint, bit bigint").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in blocks.collect():
        found[row.block << 12 : row.block + 1 << 12] = np.frombuffer(row.bits, np.uint8)
    return found


def _hits(filter_bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Positions of the n-grams that may be in the filter."""
    one, two = _bits(grams)
    at = np.flatnonzero(filter_bits[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    two = two[at]
    at = at[(filter_bits[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]
    return at[grams[at] != 0]


def item_grams(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (a number of the row), ``item_id``, ``size`` in words, ``gram``, ``place``."""
    own = sized(items).select(items[id_col].alias("item_id"), items[text_col].alias("text"))
    kind = own.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in rounds(batches):
            h, owner, grams = words(batch.column("text"))
            size = np.bincount(owner, minlength=batch.num_rows)
            first = np.cumsum(size) - size
            at = np.flatnonzero(grams)
            who = owner[at]
            values = [h[a : a + s].view(np.int64) for a, s in zip(first.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + who), batch.column("item_id").take(pa.array(who)), pa.array(grams[at].view(np.int64)), pa.array(at - first[who]), pa.array([values[k] if f else None for k, f in zip(who.tolist(), at == first[who], strict=True)], pa.list_(pa.int64())), pa.array(size[who])],
                names=["item", "item_id", "gram", "place", "words", "size"],
            )
            number += batch.num_rows

    fields = [("item", T.LongType()), ("item_id", kind), ("gram", T.LongType()), ("place", T.LongType()), ("words", T.ArrayType(T.LongType())), ("size", T.LongType())]
    return own.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def gram_counts(docs: DataFrame, text_col: str, bits: np.ndarray, size: int = SEED_WORDS) -> DataFrame:
    """``gram``, ``docs``, ``times``: in how many documents each n-gram of the filter is, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            _, owner, grams = words(batch.column("text"), size)
            at = _hits(shared.value, grams)
            pairs, times = np.unique(np.stack((grams[at], owner[at].astype(np.uint64))), axis=1, return_counts=True)
            gram, first, count = np.unique(pairs[0], return_index=True, return_counts=True)
            total = np.add.reduceat(times, first) if len(first) else times
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count), pa.array(total)], names=["gram", "docs", "times"])

    own = sized(docs).select(docs[text_col].alias("text"))
    return own.mapInArrow(run, "gram bigint, docs bigint, times bigint").groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def windows(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray, reach: int) -> DataFrame:
    """Stretches of documents with seeds: ``win`` (a number), ``id``, ``tag`` (hash of the text),
    ``first`` (its first word's number), ``words`` (hashes), ``hits`` (seed and place in the window).

    Seeds at most ``reach`` words apart share a window; it goes on for ``reach`` words on both sides.
    """
    own = sized(docs).select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("tag"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in rounds(batches):
            h, owner, grams = words(batch.column("text"))
            at = _hits(shared.value, grams)
            if not len(at):
                continue
            who = owner[at]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > reach) | (np.diff(who) > 0))))
            stop = np.append(new[1:], len(at))
            low = np.maximum(at[new] - reach, np.searchsorted(owner, who[new]))
            high = np.minimum(at[stop - 1] + SEED_WORDS + reach, np.searchsorted(owner, who[new], side="right"))
            begin = np.searchsorted(owner, who[new])
            hits = [
                [{"gram": g, "place": p} for g, p in zip(grams[at[a:b]].view(np.int64).tolist(), (at[a:b] - l).tolist(), strict=True)]
                for a, b, l in zip(new.tolist(), stop.tolist(), low.tolist(), strict=True)
            ]
            rows = pa.array(who[new])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(len(new))),
                    batch.column("id").take(rows),
                    batch.column("tag").take(rows),
                    pa.array(low - begin),
                    pa.array([h[a:b].view(np.int64) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.list_(pa.int64())),
                    pa.array(hits, pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int64())]))),
                ],
                names=["win", "id", "tag", "first", "words", "hits"],
            )
            number += len(new)

    hit = T.StructType([T.StructField("gram", T.LongType()), T.StructField("place", T.LongType())])
    fields = [("win", T.LongType()), ("id", own.schema["id"].dataType), ("tag", T.LongType()), ("first", T.LongType()), ("words", T.ArrayType(T.LongType())), ("hits", T.ArrayType(hit))]
    return own.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def smith_waterman(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and where in the text it ends.

    Row by row over the items' words, for all pairs together; a gap in the text is a running maximum.
    """
    n, rows, width = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((n, rows), np.int64), np.zeros((n, width), np.int64)
    real_a, real_b = np.zeros((n, rows), bool), np.zeros((n, width), bool)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
        real_a[k, : len(x)], real_b[k, : len(y)] = True, True
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        same = (a[:, i, None] == b) & real_b & real_a[:, i, None]
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) + slope, axis=1) - slope
        row[:, 1:][~real_b] = 0
        row[~real_a[:, i]] = 0
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        more = score > best
        best[more], end[more] = score[more], top[more]
        above = row
    return best, end


def _align(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, text = ([np.asarray(v, np.int64) for v in batch.column(c).to_pylist()] for c in ("item_words", "words"))
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            text = [t[max(a, 0) : max(b, 0)] for t, a, b in zip(text, low.tolist(), high.tolist(), strict=True)]
            size = np.array([len(x) * (len(y) + 1) for x, y in zip(item, text, strict=True)])
            order = np.argsort([len(y) for y in text], kind="stable")
            score, start, end = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            while len(order):
                most = np.maximum.accumulate(size[order]) * np.arange(1, len(order) + 1)
                take = max(1, int(np.searchsorted(most, CELLS, side="right")))
                part, order = order[:take], order[take:]
                x, y = [item[k] for k in part], [text[k] for k in part]
                best, last = smith_waterman(x, y)
                _, first = smith_waterman([v[::-1] for v in x], [v[:e][::-1] for v, e in zip(y, last.tolist(), strict=True)])
                score[part] = best / (MATCH * np.array([len(v) for v in x]))
                end[part], start[part] = last, last - first
            base = batch.column("first").to_numpy() + np.maximum(low, 0)
            out = [batch.column("id"), batch.column("tag"), batch.column("item_id"), pa.array(score), pa.array(base + start), pa.array(base + end)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "tag", "item_id", "score", "word_start", "word_end"]).filter(pa.array(score >= cut))

    return run


def matches(docs: DataFrame, items: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per aligned stretch: ``id``, ``tag``, ``item_id``, ``score``, ``word_start``, ``word_end``."""
    grams = written(item_grams(items, item_col, item_text), "item-grams")
    counts = written(gram_counts(docs, text_col, bloom(grams)).drop("times"), "gram-counts")
    counted = grams.select("item", "gram", "place").join(counts, "gram", "left").fillna(0, ["docs"])
    usual = counted.groupBy("item").agg(F.percentile_approx("docs", 0.5).alias("usual"))
    rare = F.col("docs") <= F.greatest(F.lit(RARE_DOCS), RARE * F.col("usual"))
    seeds = written(counted.join(usual, "item").filter(rare).select("item", "gram", "place"), "seeds")
    reach = grams.agg(F.max("size")).first()[0] or 0
    found = written(windows(docs, id_col, text_col, bloom(seeds), int(reach)), "windows")
    hits = found.select("win", F.explode("hits").alias("hit")).select("win", "hit.gram", F.col("hit.place").alias("at"))
    pairs = hits.join(seeds, "gram").groupBy("win", "item").agg(F.count_distinct("gram").alias("n"), F.min(F.col("at") - F.col("place")).alias("low"), F.max(F.col("at") - F.col("place")).alias("high"))
    texts = grams.filter("words is not null").select("item", "item_id", "size", F.col("words").alias("item_words"))
    least = seeds.groupBy("item").agg(F.least(F.count_distinct("gram"), F.lit(SEEDS)).alias("least"))
    pairs = written(pairs.join(least, "item").filter("n >= least").drop("n", "least"), "pairs")
    room = (F.col("size") / 2).cast("bigint") + 8
    ready = (
        pairs.join(texts, "item")
        .join(found.select("win", "id", "tag", "first", "words"), "win")
        .select("id", "tag", "first", "words", "item_id", "item_words", (F.col("low") - room).alias("low"), (F.col("high") + F.col("size") + room).alias("high"))
    )
    kinds = ready.schema
    fields = [kinds["id"], kinds["tag"], kinds["item_id"], T.StructField("score", T.DoubleType()), T.StructField("word_start", T.LongType()), T.StructField("word_end", T.LongType())]
    return ready.mapInArrow(_align(cut), T.StructType(fields))


def contaminated(docs: DataFrame, items: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item: the best ``score`` and where its first best stretch lies, in words."""
    rows = matches(docs, items, cut, id_col, text_col, item_col, item_text)
    best = rows.groupBy("id", "item_id").agg(F.max(F.struct("score", (-F.col("word_start")).alias("from"), "word_end")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "best.score", (-F.col("best.from")).alias("word_start"), "best.word_end")


def decontaminate(docs: DataFrame, items: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a stretch of an item."""
    bad = written(matches(docs, items, cut, id_col, text_col).select("id", "tag").distinct(), "contaminated")
    d, b = docs.alias("d"), bad.alias("b")
    return d.join(b, F.col(f"d.{id_col}").eqNullSafe(F.col("b.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("b.tag")), "left_anti")
