"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and of all pairs of neighbours are gathered from the whole training fold. A count
is held as its level, the integer part of its logarithm: an n-gram goes into the filter once per level
up to its own, and is read by probing level after level until one is missing. The filter is cut into
blocks by the n-gram's hash; its size follows the entries up to ``MOST_BITS``. So what is broadcast has
a proven bound. Levels that it has no room for are read by a join: a document's pairs that the filter
lacks meet the written counts, so each seen pair counts whatever the size of the corpus. What a training
text lacks there is on the lowest level at least, so only what may be higher is looked up for it. Pairs
of the lowest level, which are most of them, are never in the filter.

A word's probability is add-one smoothed from its level's mean count; a pair's is its level's mean
count, Dirichlet-smoothed by that, over the exact count of its first word.

The most frequent words, ``TABLE`` at most, are looked up in an array; the other words of a document
are joined with the whole vocabulary, however large, for base and model scores alike.

Tokens are runs without ASCII blanks, A-Z lowered, and one end per text; null text counts as empty
and has the end only. Null ids are training rows; repeated rows count and are scored each; an empty
table gives an empty result. Further columns are ignored. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import byte_view, hashes, lowered, mix, rounds, sized, token_runs, written
from planledger.llm.labelled import held_out

FOLDS, REMAINDER = 7, 2
BASE, HASHES, MOST_BITS, BLOCK_BITS = 1.5, 4, 1 << 28, 15
TABLE, PRIOR = 1 << 20, 500.0
END = np.uint64(0x5851F42D4C957F2D)
#: Distinct n-grams that a task gathers before it passes them on.
HELD = 2_000_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token, ends included."""
    data, starts = byte_view(texts)
    data = lowered(data)
    begin, end = token_runs(data, starts)
    owner = np.searchsorted(starts, begin, side="right") - 1
    n = len(starts) - 1
    stops = np.searchsorted(owner, np.arange(n), side="right")
    return np.insert(hashes(data, begin, end), stops, END), np.insert(owner, stops, np.arange(n))


def pairs(gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows an end."""
    before = np.concatenate(([END], gram[:-1])) if len(gram) else gram
    before[np.diff(owner, prepend=-1) > 0] = END
    return mix(before * np.uint64(0xD1342543DE82EF95) + gram)


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def _level(count):
    return (F.floor(F.log(count.cast("double")) / F.lit(float(np.log(BASE))) + 1e-9) + 1).cast("int")


class Gathered:
    """Counts of hashes, combined as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, gram: np.ndarray) -> None:
        self.parts.append(np.unique(gram, return_counts=True))
        self.size += len(self.parts[-1][0])

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        gram = np.concatenate([g for g, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        count = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        gram, count = gram[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        self.parts = [(gram[first], np.add.reduceat(count, first) if len(first) else count)]
        self.size = len(first)
        return self.parts[0]

    def emit(self) -> Iterator[pa.RecordBatch]:
        gram, count = self.combined()
        for low in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(gram[low : low + 100_000].view(np.int64)), pa.array(count[low : low + 100_000])], names=["gram", "n"])
        self.parts, self.size = [], 0


def counted(docs: DataFrame, paired: bool | None = None) -> DataFrame:
    """``gram``, ``n`` over training texts: of all words, or of all pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered()
        for batch in rounds(batches):
            gram, owner = tokens(batch.column("text"))
            found.add(pairs(gram, owner) if paired else gram)
            if found.size > 2 * HELD:
                found.combined()
            if found.size > HELD:
                yield from found.emit()
        yield from found.emit()

    return sized(docs).filter("train").select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def member(table: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether hashes are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
    at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
    return table[at] == gram, at


@dataclass
class Model:
    total: int
    distinct: int
    #: Frequent words, sorted, with exact counts; whether these are all words.
    words: np.ndarray
    counts: np.ndarray
    complete: bool
    #: Words that are contexts without a join (all of ``words``), how often any word follows each, and
    #: the probability that the words after one share.
    core: np.ndarray
    follows: np.ndarray
    share: float
    bits: np.ndarray
    cuts: tuple[int, int]
    means: tuple[np.ndarray, np.ndarray]
    #: Probabilities of ``words`` by themselves.
    single: np.ndarray | None = None

    def estimate(self, gram: np.ndarray, kind: int) -> np.ndarray:
        """The mean count of the level that probing reaches: of words (kind 0) or pairs (1)."""
        reached = np.zeros(len(gram), np.int64)
        todo, step = np.arange(len(gram)), self.cuts[kind]
        most = len(self.means[kind]) - 1
        while len(todo) and step <= most:
            where = probes(gram[todo], kind, step, len(self.bits))
            todo = todo[(self.bits[where >> 3] >> (where & 7).astype(np.uint8) & 1).all(axis=0)]
            reached[todo] = step
            step += 1
        return self.means[kind][reached]


def probes(gram: np.ndarray, kind: int, step: int, size: int) -> np.ndarray:
    """Bit places of a level's probes in a filter of ``size`` bytes: all in the n-gram's block, which
    its first bits tell. ``kind`` parts words from pairs."""
    block = gram >> np.uint64(64 - block_width(size * 8))
    salts = np.array([((kind * 64 + step) * 64 + k + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1 for k in range(HASHES)], np.uint64)
    inner = mix(gram[None] ^ salts[:, None]) & np.uint64((1 << BLOCK_BITS) - 1)
    return ((block << np.uint64(BLOCK_BITS))[None] + inner).astype(np.int64)


def block_width(bits: int) -> int:
    """How many first bits of an n-gram's hash name its block."""
    return bits.bit_length() - 1 - BLOCK_BITS


def levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams are on each level, and their counts together."""
    found = counts.groupBy(_level(F.col("n")).alias("level")).agg(F.count("*").alias("grams"), F.sum("n").alias("n")).toPandas()
    most = int(found["level"].max()) if len(found) else 0
    grams, n = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
    grams[found["level"]], n[found["level"]] = found["grams"], found["n"]
    return grams, n


def cut_offs(one: np.ndarray, two: np.ndarray, most_bits: int) -> tuple[int, int, int]:
    """Least levels of words and pairs that the filter holds, and its bits: a power of two that
    leaves about half of them unset."""

    def entries(grams: np.ndarray, cut: int) -> int:
        return int((grams[cut:] * np.arange(1, len(grams) - cut + 1)).sum()) if cut < len(grams) else 0

    for cut1 in range(1, len(one) + 1):
        for cut2 in range(1, len(two) + 1):
            need = (entries(one, cut1) + entries(two, cut2)) * HASHES / np.log(2)
            if need <= most_bits:
                return cut1, cut2, max(1 << 20, 1 << int(np.ceil(np.log2(max(need, 2)))))
    return len(one), len(two), 1 << 20


def build_filter(counts: list[DataFrame], cuts: tuple[int, int], bits: int) -> np.ndarray:
    """The filter's bytes. N-grams, of which it holds a bounded number, are shuffled by block, so each
    block comes whole from one task; the driver lays them side by side, ``bits`` in all."""
    found, width = np.zeros(bits >> 3, np.uint8), 1 << BLOCK_BITS - 3
    both = [rows.select("gram", "n", F.lit(kind).alias("kind")) for kind, rows in enumerate(counts)]
    block = F.shiftrightunsigned("gram", 64 - block_width(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            every, count, kinds = (batch.column(c).to_numpy() for c in ("gram", "n", "kind"))
            for kind, cut in enumerate(cuts):
                gram, top = every[kinds == kind].view(np.uint64), level(count[kinds == kind])
                for step in range(cut, int(top.max(initial=0)) + 1):
                    where = np.unique(probes(gram[top >= step], kind, step, bits >> 3))
                    byte = where >> 3
                    first = np.flatnonzero(np.diff(byte, prepend=-1))
                    if len(first):
                        own[byte[first]] |= np.bitwise_or.reduceat((1 << (where & 7)).astype(np.uint8), first)
        blocks = own.reshape(-1, width)
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blocks[k].tobytes()], pa.binary())], names=["block", "bits"])

    parts = both[0].unionByName(both[1]).repartition(block).mapInArrow(run, "block bigint, bits binary")
    for row in parts.collect():
        found[row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return found


def marked(df: DataFrame, id_col: str, text_col: str, folds: int = FOLDS, remainder: int = REMAINDER) -> DataFrame:
    return sized(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col), folds, remainder)).alias("train"))


def train(docs: DataFrame, vocabulary: DataFrame, most_bits: int = MOST_BITS, pair_counts: DataFrame | None = None) -> Model:
    """``docs`` as from ``marked``; ``vocabulary`` and ``pair_counts``: its written counts."""
    grams, n = levels(vocabulary)
    total, distinct = int(n.sum()), int(grams.sum())
    upto = np.cumsum(grams[::-1])[::-1]
    least = int(np.flatnonzero(np.append(upto, 0) <= TABLE)[0])
    table = vocabulary.filter(_level(F.col("n")) >= least).toArrow()
    words, counts = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    if pair_counts is None:
        pair_counts = written(counted(docs, True), "pairs")
    grams2, n2 = levels(pair_counts)
    below = max(least, 1) - 1  # words of these levels are joined, so the filter has no use for them
    cut1, cut2, bits = cut_offs(grams[below:], grams2[1:], most_bits)
    cut1, cut2 = cut1 + below, cut2 + 1
    filled = build_filter([vocabulary.filter(_level(F.col("n")) >= cut1), pair_counts.filter(_level(F.col("n")) >= cut2)], (cut1, cut2), bits)
    means = tuple(np.where(g > 0, s / np.maximum(g, 1), 0.0) for g, s in ((grams, n), (grams2, n2)))
    # Each token but an end is followed by one, and each text's first follows an end: so a word's count
    # is its count as a context.
    model = Model(total, distinct, words, counts, least <= 1, words, counts, 1.0, filled, (cut1, cut2), means)
    model.single = np.zeros(len(words))
    for low in range(0, len(words), 1 << 16):
        read = model.estimate(words[low : low + (1 << 16)], 0)
        exact = means[0][level(counts[low : low + (1 << 16)])]
        model.single[low : low + (1 << 16)] = (np.where(read > 0, read, exact) + 1) / (total + distinct + 1)
    return model


def score_texts(model: Model, texts: pa.Array, learnt: np.ndarray | None = None) -> tuple[np.ndarray | dict[str, pa.Array], ...]:
    """Per text: tokens, known among the frequent, sum of log10(c+1) of these, model's log10
    probability as far as table and filter tell. And the pairs to be joined, once a text: where each
    text's begin, the pairs, and by name how often one occurs (``times``), its second word if that is
    not in the table (``gram``), its count so far (``seen``), whether that may be too low (``low``), the
    second word's probability as a prior count (``prior``) and the context's count with all prior counts
    (``most``) where it may bound the pair's.

    A word outside the table counts as unseen here, as a word and as a context. ``learnt`` tells the
    texts that were counted.
    """
    gram, owner = tokens(texts)
    n = len(texts)
    word, which = np.unique(gram, return_inverse=True)
    found, at = member(model.words, word)
    count = np.where(found, model.counts[at] if len(model.counts) else 0, 0)
    size = np.bincount(owner, minlength=n)
    known = np.bincount(owner, weights=found[which], minlength=n).astype(np.int64)
    base = np.bincount(owner, weights=np.log10(count + 1.0)[which], minlength=n)
    single = np.where(found, model.single[at] if len(model.words) else 0.0, 1 / (model.total + model.distinct + 1))
    prior, inside = PRIOR * single[which], found[which]
    first = np.diff(owner, prepend=-1) > 0
    end = int(np.searchsorted(word, END))  # each text has one
    before = np.concatenate((which[:1], which[:-1]))
    before[first] = end
    most, placed = count[before] + PRIOR, found[before]
    pair = pairs(gram, owner)
    seen = np.zeros(len(gram))
    maybe = np.flatnonzero(inside) if model.complete else np.arange(len(gram))
    if len(maybe):
        one, pick = np.unique(pair[maybe], return_inverse=True)
        seen[maybe] = model.estimate(one, 1)[pick]
    cut, own = model.cuts[1], np.zeros(len(gram), bool) if learnt is None else learnt[owner]
    low = (seen == 0) & (inside | (not model.complete)) & (cut > 1)
    seen[low & own] = model.means[1][1] if cut > 1 else 0.0
    low &= ~own | (cut > 2)
    chance = (np.where(inside, seen, 0.0) + prior) / most
    score = np.bincount(owner, weights=np.log10(np.where(placed, np.minimum(chance, 1.0), chance)), minlength=n)
    rest = low if model.complete else low | ~inside
    todo = np.flatnonzero(rest)
    _, begin, times = np.unique(mix(pair[todo] + owner[todo].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True, return_counts=True)
    order = np.argsort(begin)
    todo, times = todo[begin[order]], times[order]
    names = {
        "times": pa.array(times),
        "gram": pa.array(gram[todo].view(np.int64), mask=inside[todo]),
        "seen": pa.array(seen[todo]),
        "low": pa.array(low[todo]),
        "prior": pa.array(prior[todo], mask=~inside[todo]),
        "most": pa.array(most[todo], mask=~placed[todo] | (np.maximum(seen[todo], model.means[1][:cut].max()) + PRIOR * model.single.max(initial=0) <= most[todo])),
    }
    return size, known, base, score, np.searchsorted(owner[todo], np.arange(n + 1)), pair[todo].view(np.int64), names


def joined(rows: DataFrame, model: Model, vocabulary: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """What the ``rest`` of scored rows adds, per ``row``: ``more`` known tokens, ``extra`` of the base
    score, ``gain`` of the model's."""

    def mean(kind: int):
        return F.get(F.lit([float(x) for x in model.means[kind]]), _level(F.col("n")))

    def logs(seen):
        return F.least(F.log10(seen + F.col("prior")), F.log10("most"))

    zero, floor = F.lit(0), model.total + model.distinct + 1
    events = rows.select("row", F.explode("rest").alias("e")).select("row", "e.*")
    names, parts = ["row", "pair", "times", "seen", "prior", "most"], []
    missed = events.filter("gram is null").select(*names)
    if not model.complete:
        rare = events.filter("gram is not null").drop("prior").join(vocabulary, "gram").withColumn("prior", PRIOR * (mean(0) + 1) / floor)
        rare = written(rare, "rare")
        alone = F.log10(mean(0) + 1) - F.log10((F.col("n") + PRIOR) / PRIOR)
        gain = F.col("times") * (alone + logs(F.col("seen")) - F.log10("prior"))
        parts.append(rare.select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("extra"), gain.alias("gain")))
        missed = missed.unionByName(rare.filter("low").select(*names))
    if model.cuts[1] > 1:
        counts = pair_counts.filter(_level(F.col("n")) < model.cuts[1]).withColumnRenamed("gram", "pair")
        gain = F.col("times") * (logs(mean(1)) - logs(F.col("seen")))
        parts.append(missed.join(counts, "pair").select("row", zero.cast("bigint").alias("more"), zero.cast("double").alias("extra"), gain.alias("gain")))
    if not parts:
        return events.select("row", zero.cast("bigint").alias("more"), zero.cast("double").alias("extra"), zero.cast("double").alias("gain"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("row").agg(F.sum("more").alias("more"), F.sum("extra").alias("extra"), F.sum("gain").alias("gain"))


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    docs = marked(df, id_col, text_col)
    vocabulary = written(counted(docs, None), "vocabulary")
    pair_counts = written(counted(docs, True), "pairs")
    model = train(docs, vocabulary, most_bits, pair_counts)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in rounds(batches):
            size, known, base, score, at, pair, names = score_texts(shared.value, batch.column("text"), batch.column("train").to_numpy(zero_copy_only=False))
            rest = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(pair), *names.values()], ["pair", *names]))
            out = [pa.array(number + np.arange(batch.num_rows)), batch.column("id"), batch.column("train"), pa.array(size), pa.array(known), pa.array(base), pa.array(score), rest]
            yield pa.RecordBatch.from_arrays(out, names=["row", "id", "train", "n_tokens", "known", "base", "model", "rest"])
            number += batch.num_rows

    shape = T._parse_datatype_string(
        "row bigint, train boolean, n_tokens bigint, known bigint, base double, model double, "
        "rest array<struct<pair:bigint,times:bigint,gram:bigint,seen:double,low:boolean,prior:double,most:double>>"
    )
    fields = [shape["row"], docs.schema["id"], *shape.fields[1:]]
    rows = written(docs.mapInArrow(run, T.StructType(fields)), "scored")
    every = rows.drop("rest").join(joined(rows, model, vocabulary, pair_counts), "row", "left").fillna(0, ["more", "extra", "gain"])
    floor = float(np.log10(model.total + model.distinct + 1))
    return every.select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("extra") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("model") + F.col("gain")).alias("score"),
    )
