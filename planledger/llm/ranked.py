"""Ranked search through K2-treaps over the grid of terms and documents.

A block of documents makes a square grid: a row per term, a column per document, in a cell what the
term adds to the document's score before its weight. The grid is halved both ways again and again;
a quadrant with any cell is a node and holds the largest value in it, stored as its distance from
its parent's. Which of a node's four quadrants exist is a half-byte, and the number of bits before a
half-byte is where its children stand on the next level.

An item takes its terms' row paths down together: for a range of documents each term has the node
of its row, and the weighted sum of the maxima bounds the score of every document of the range. The
ranges with the highest bounds are opened first, some dozens at a time; a range of one document has
its score. Ranges bounded below the worst of the best so far are not opened. So the answer is exact.

Documents are read once: postings of the terms asked for are written, from them come document
frequencies, and blocks and answers are made where the postings lie. A task passes on the best of
each item, which are merged in two steps. Items are the query set; they are searched in slices of
about ``MOST_TERMS`` different terms, so the broadcast rows and their table stay bounded whatever
the number of items. Terms are told apart by a 64-bit hash and their length in bytes.

Null texts have no terms and neither rank nor count. Items with one id are one item with the terms
of all its rows. Each document row ranks for itself, also if its id is null (first among ties) or
repeated; equal scores go by ascending id. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import byte_view, hashes, lowered, rounds, runs, sized, written

TOP = 20
#: Different terms of a slice of items, about; cells and documents of a block; ranges opened at a time;
#: terms from which an item opens few.
MOST_TERMS, BLOCK_CELLS, BLOCK_DOCS, OPENED, WIDE = 1 << 18, 1 << 20, 1 << 13, 64, 1 << 12

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each term, in order; A-Z in small letters."""
    data, starts = byte_view(texts)
    data = lowered(data)
    begin, end = runs(_TERM[data], starts)
    own = hashes(data, begin, end) ^ ((end - begin).astype(np.uint64) << np.uint64(40))
    return np.searchsorted(starts, begin, side="right") - 1, own


@dataclass
class Treap:
    """Levels from the root: largest values' distances, child half-bytes, half-byte bits before each node."""

    root: int
    depth: int
    drop: list[np.ndarray]
    kids: list[np.ndarray]
    before: list[np.ndarray]

    def down(self, level: int, node: np.ndarray, value: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quadrants' nodes on the next level and their maxima; -1 and 0 where nothing is."""
        kids = np.where(node >= 0, self.kids[level][node], 0)
        exists = (kids >> quadrant) & 1 > 0
        child = self.before[level][node] + _BITS[kids & ((1 << quadrant) - 1)]
        child = np.where(exists, child, -1)
        return child, np.where(exists, value - self.drop[level][child], 0)


_BITS = np.array([bin(k).count("1") for k in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
    """The treap of cells, each (row, column) once."""
    depth = int(max(rows.max(initial=0), columns.max(initial=0))).bit_length()
    place = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(place)
    place, value = place[order], values[order].astype(np.int64)
    drop, kids, before = [], [], []
    for _ in range(depth):
        above, first = np.unique(place >> np.uint64(2), return_index=True)
        top = np.maximum.reduceat(value, first) if len(first) else value
        drop.append(_small(np.repeat(top, np.diff(np.append(first, len(value)))) - value))
        bits = np.bitwise_or.reduceat(np.left_shift(1, (place & np.uint64(3)).astype(np.int64)), first) if len(first) else np.zeros(0, np.int64)
        kids.append(bits.astype(np.uint8))
        before.append(_small(first))
        place, value = above, top
    return Treap(int(value[0]) if len(value) else 0, depth, drop[::-1], kids[::-1], before[::-1])


def best(tree: Treap, rows: np.ndarray, weights: np.ndarray, documents: int, floor: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of all documents that can be among the ``top`` best and have ``floor`` or more."""
    inside = rows < 1 << tree.depth  # no document of this block has a term beyond
    rows, weights = rows[inside], weights[inside]
    level_of, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node, value = np.zeros((1, len(rows)), np.int64), np.full((1, len(rows)), tree.root, np.int64)
    bound = value @ weights
    found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(bound):
        live = bound >= max(floor, 1)
        done = live & (level_of == tree.depth)
        if done.any():
            found_at, found = np.append(found_at, first[done]), np.append(found, bound[done])
            if len(found) >= top:
                floor = max(floor, int(np.partition(found, len(found) - top)[len(found) - top]))
        keep = np.flatnonzero(live & ~done & (bound >= floor))
        if not len(keep):
            break
        level_of, first, node, value, bound = level_of[keep], first[keep], node[keep], value[keep], bound[keep]
        if len(rows) > WIDE:  # an item of very many terms: the smallest ranges first, so that few stay open
            opened = np.lexsort((-bound, -level_of))[:2]
        else:
            opened = np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[opened] = False
        parts = [(level_of[rest], first[rest], node[rest], value[rest], bound[rest])]
        for level in np.unique(level_of[opened]):
            own = opened[level_of[opened] == level]
            shift = tree.depth - 1 - int(level)
            side = (rows >> shift & 1) << 1
            for right in (0, 1):
                at = first[own] + (right << shift)
                inside = at < documents
                if not inside.any():
                    continue
                child, largest = tree.down(int(level), node[own][inside], value[own][inside], side | right)
                parts.append((np.full(inside.sum(), level + 1), at[inside], child, largest, largest @ weights))
        level_of, first, node, value, bound = (np.concatenate(p) for p in zip(*parts, strict=True))
    return found_at, found


class Block:
    """Postings of some documents, and the treap over them."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.cells = 0

    def add(self, batch: pa.RecordBatch) -> None:
        held, times = batch.column("terms"), batch.column("times")
        offsets = held.offsets.to_numpy()
        self.ids += batch.column("id").to_pylist()
        self.sizes.append(batch.column("n").to_numpy())
        self.counts.append(np.diff(offsets))
        self.terms.append(held.values.to_numpy()[offsets[0] : offsets[-1]])
        self.times.append(times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()])
        self.cells += len(self.terms[-1])

    def full(self) -> bool:
        return self.cells >= BLOCK_CELLS or len(self.ids) >= BLOCK_DOCS

    def tree(self, total: int, length: int) -> Treap:
        size = np.concatenate(self.sizes)
        m = 100 - 25 + (25 * size * total) // length
        column = np.repeat(np.arange(len(size)), np.concatenate(self.counts))
        times = np.concatenate(self.times).astype(np.int64)
        return treap(np.concatenate(self.terms), column, (1_000_000_000 * times) // (1000 * times + 12 * m[column]))


@dataclass
class Asked:
    """Items of a slice: ids, hashes of all terms in ascending order, and (term, times) of each item."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def read(rows: list) -> Asked:
        """From (id, text) rows."""
        owner, own = terms(pa.array([r[1] for r in rows], pa.string()))
        known = np.unique(own)
        number: dict = {}
        item = np.array([number.setdefault(r[0], len(number)) for r in rows], np.int64)[owner]
        key, times = np.unique(item * len(known) + np.searchsorted(known, own), return_counts=True)
        cuts = np.searchsorted(key, np.arange(1, len(number)) * len(known))
        return Asked(list(number), known, np.split(key % max(len(known), 1), cuts), np.split(times, cuts))


def postings(docs: DataFrame, known: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a term: ``id``, ``n`` (terms with repeats), and ``terms`` (rows of ``known``) with ``times``."""
    own = sized(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a slice's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # A table over the first bits of hashes leaves few terms to search for.
        bits = max(16, int(len(known)).bit_length() + 4)
        near = np.zeros(1 << bits, bool)
        near[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        for batch in rounds(batches):
            owner, own = terms(batch.column("text"))
            n = np.bincount(owner, minlength=batch.num_rows)
            maybe = np.flatnonzero(near[(own >> np.uint64(64 - bits)).astype(np.int64)])
            place = np.searchsorted(known, own[maybe])
            hit = known[np.minimum(place, len(known) - 1)] == own[maybe] if len(known) else np.zeros(0, bool)
            key, times = np.unique(owner[maybe[hit]] * max(len(known), 1) + place[hit], return_counts=True)
            some = np.flatnonzero(n)
            doc, term = key // max(len(known), 1), key % max(len(known), 1)
            offsets = pa.array(np.append(np.searchsorted(doc, some), len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.array(n[some]), *lists], names=["id", "n", "terms", "times"])

    ints = T.ArrayType(T.IntegerType())
    kind = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("times", ints)])
    return own.mapInArrow(run, kind)


def _slice(docs: DataFrame, asked: Asked, item_type: T.DataType, id_col: str, text_col: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    held = written(postings(docs, asked.hashes, id_col, text_col), "postings")
    size = held.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("length")).first()
    seen = held.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # a row for each term of the slice
    frequency = np.zeros(len(asked.hashes), np.int64)
    frequency[seen["term"].to_numpy(np.int64)] = seen["count"].to_numpy(np.int64)
    weight = np.floor(1000 * np.log((2 * size.total + 2) / (2 * frequency + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((asked, weight))
    total, length = size.total, size.length
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", held.schema["id"].dataType), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        kept: list[list[tuple[int, bool, object]]] = [[] for _ in asked.ids]

        def search(block: Block) -> None:
            tree = block.tree(total, length)
            for item, (rows, times) in enumerate(zip(asked.terms, asked.times, strict=True)):
                if not len(rows):
                    continue
                floor = -kept[item][top - 1][0] if len(kept[item]) >= top else 0
                at, score = best(tree, rows, weight[rows] * times, len(block.ids), floor, top)
                new = [(-int(s), block.ids[c] is not None, block.ids[c]) for c, s in zip(at, score, strict=True)]
                kept[item] = sorted(kept[item] + new)[:top]

        block = Block()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                block.add(batch.slice(low, 256))
                if block.full():
                    search(block)
                    block = Block()
        if block.ids:
            search(block)
        for low in range(0, len(kept), 1024):
            rows = [(item, i, -s) for item in range(low, min(low + 1024, len(kept))) for s, _, i in kept[item]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], batch_type), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    batch_type = _arrow_type(kind["id"].dataType)
    order = [F.desc("score"), F.asc_nulls_first("id")]
    found = held.mapInArrow(run, kind).withColumn("salt", F.spark_partition_id() % 64)
    # The best of every task meet in up to 64 groups an item first.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    final = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(asked.ids)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
    return final.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias(id_col), "score")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", top: int = TOP) -> DataFrame:
    """Per item: id, ``rank`` from 1, document id and ``score`` of its best documents with a score above 0."""
    own = items.select(F.col(item_col).alias("item"), F.col("text").alias("text"))
    size = own.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("n")).first().n or 0
    slices = max(1, -(-size // MOST_TERMS))
    item_type = items.schema[item_col].dataType
    found = None
    for k in range(slices):
        rows = own.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == k).orderBy("item", "text").collect()  # a slice of the query set
        one = _slice(docs, Asked.read(rows), item_type, id_col, text_col, top)
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("item_id", item_col)
