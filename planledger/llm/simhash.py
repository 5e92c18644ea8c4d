"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments of a few bits; its embedding is the number of set bits
in each segment. One differing bit moves one count by one, so the Manhattan distance of two
embeddings is a lower bound of the Hamming distance. Counts are held in unary (the segment's bits,
sorted), which makes the Manhattan distance the number of differing bits of two unary codes.

The range join works on a grid: the segments form groups, and within distance 3 at most three groups
differ. So two close embeddings agree in all counts of some choice of all groups but three: a choice
and its counts are a cell. Cells with one member are dropped. Crowded cells are divided into blocks,
every two blocks make a unit, and a unit of any cell has a bounded number of rows. Inside a unit
Manhattan distances come first, then exact Hamming distances. Close pairs of a large unit leave it
as a star over each connected part, not as all pairs.

Components come from alternating large and small stars over distinct fingerprints.

Null text and text without words have fingerprint zero and are linked like others. Equal texts,
repeated rows and repeated ids share a fingerprint and so a component. ``component_id`` is the
smallest id, null only if all ids of the component are null. Further columns are ignored by
``components`` and kept by ``deduplicate``, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import binary, rounds, sized, written

SEED, SHINGLE, DISTANCE, SEGMENT = 42, 3, 3, 2
#: Members of a block of a crowded cell; a unit has up to two blocks.
BLOCK = 2048
#: Units up to this size give their close pairs, larger ones a star.
SMALL_UNIT = 32


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The SimHash of each text over 3-word shingles, repeats included, as unsigned 64-bit numbers."""
    found, counts = [], []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and blanks as in ASCII
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
            counts.append(len(words) - SHINGLE + 1)
        else:
            shingles = [b" ".join(words)] if words else []
            counts.append(len(shingles))
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, counts[-1]))
    count = np.array(counts, np.int64)
    result = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        result[full] = majority(np.concatenate(found), count[full])
    return result


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes (none empty), the bits set in over half of them.

    Eight 8-bit counters at a time are summed inside a 64-bit number, over 255 hashes at most.
    """
    parts = -(-count // 255)
    begin = np.cumsum(count) - count
    first = np.cumsum(parts) - parts
    starts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(starts), 8, 8), np.uint8)
    for bit in range(8):
        counts[:, :, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts).astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64).astype(np.int64), first, axis=0)
    return np.packbits(2 * total > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


@lru_cache(4)
def _sorted_bits(segment: int) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        for low in range(0, 8, segment):
            table[byte] |= ((1 << (byte >> low & (1 << segment) - 1).bit_count()) - 1) << low
    return table


def embedding(prints: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Bits set per segment, in unary: the bits of each segment pushed to its low end."""
    return _sorted_bits(segment)[prints.astype("<u8").view(np.uint8)].view("<u8")


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id`` and ``fp`` (the fingerprint as a signed number)."""
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rounds(batches):
            prints = fingerprints(binary(batch.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return own.mapInArrow(run, T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def grid(n: int, distance: int = DISTANCE, segment: int = SEGMENT) -> list[int]:
    """Masks over the unary code, one per choice of groups that agree.

    More groups make more cells per fingerprint, each more telling; the number is the cheapest for
    ``n`` fingerprints. Every choice is exact.
    """
    p = [math.comb(segment, k) / 2**segment for k in range(segment + 1)]
    bits = -sum(x * math.log2(x) for x in p) * 64 / segment

    def cost(groups: int) -> float:
        return math.comb(groups, distance) * (4 + n / 2 ** (bits * (groups - distance) / groups))

    groups = min(range(distance + 3, 17), key=cost)
    segments = 64 // segment
    edges = [round(g * segments / groups) * segment for g in range(groups + 1)]
    masks = []
    for chosen in itertools.combinations(range(groups), groups - distance):
        mask = sum((1 << edges[g + 1]) - (1 << edges[g]) for g in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def close(prints: np.ndarray, codes: np.ndarray, one: np.ndarray, two: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are within the distance: Manhattan distance first, then the exact one."""
    near = np.bitwise_count(codes[one] ^ codes[two]) <= distance
    near[near] = np.bitwise_count(prints[one[near]] ^ prints[two[near]]) <= distance
    return near


def star(prints: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a large unit and the least member of the connected part that they belong to."""
    n = len(prints)
    links = np.zeros((n, n), bool)
    for low in range(0, n, 256):
        near = np.bitwise_count(codes[low : low + 256, None] ^ codes[None]) <= distance
        a, b = np.nonzero(near)
        near[a, b] = np.bitwise_count(prints[low + a] ^ prints[b]) <= distance
        links[low : low + 256] = near
    label = np.full(n, -1)
    for k in np.argsort(prints).tolist():
        if label[k] >= 0:
            continue
        front = np.array([k])
        label[k] = k
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & (label < 0))
            label[front] = k
    out = np.flatnonzero(label != np.arange(n))
    return out, label[out]


def _unit_links(distance: int, segment: int):
    def pairs(unit: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """unit: number of the unit of each row, ascending."""
        codes = embedding(prints, segment)
        sizes = np.bincount(unit)
        small = sizes[unit] <= SMALL_UNIT
        x, c, u = prints[small], codes[small], unit[small]
        for step in range(1, min(SMALL_UNIT, len(x))):
            one = np.flatnonzero(u[:-step] == u[step:])
            if not len(one):
                break
            one = one[close(x, c, one, one + step, distance)]
            yield x[one], x[one + step]
        starts = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > SMALL_UNIT).tolist():
            own = prints[starts[k] : starts[k] + sizes[k]]
            a, b = star(own, codes[starts[k] : starts[k] + sizes[k]], distance)
            yield own[a], own[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                new = np.concatenate(([False], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
                for a, b in pairs(np.cumsum(new), rows[:, 4].copy().view(np.uint64)):
                    low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
                    keep = low < high
                    yield pa.RecordBatch.from_arrays([pa.array(high[keep]), pa.array(low[keep])], names=["src", "dst"])

        for batch in batches:
            rows = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("choice", "cell", "b1", "b2", "fp")], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            change = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = change[-1] + 1 if len(change) else 0
            held = [rows[cut:]]  # the last unit may go on
            yield from done(rows[:cut])
        if held:
            yield from done(held[0])

    return run


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """``src``, ``dst``: pairs that connect all fingerprints within the distance (``dst`` < ``src``)."""
    own = distinct.select("fp").mapInArrow(_with_code(segment), "fp bigint, code bigint")
    cells = own.select("fp", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(mask)) for mask in grid(n, distance, segment)])).alias("choice", "cell"))
    cells = written(cells, "cells")
    crowded = cells.groupBy("choice", "cell").agg(F.count("*").alias("size")).filter("size > 1")
    members = cells.join(written(crowded, "crowded"), ["choice", "cell"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = members.select("choice", "cell", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    keys = ["choice", "cell", "b1", "b2"]
    units = units.repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(_unit_links(distance, segment), "src bigint, dst bigint").distinct()


def _with_code(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(embedding(prints, segment).view(np.int64))], names=["fp", "code"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node of ``src``, ``dst``, but the roots.

    Alternates large stars (neighbours above a node move to its least neighbour) and small stars
    (neighbours below it and itself do) until nothing moves. Least neighbours are aggregated before
    the shuffle and written, so that the join by a crowded node can be split.
    """
    edges, before = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select("dst", "src"))
        least = written(both.groupBy("src").agg(F.min("dst").alias("least")), "least")
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.least("src", "least").alias("dst"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy("src").agg(F.min("dst").alias("least")), "least")
        moved = large.join(least, "src").select(F.explode(F.array("src", "dst")).alias("src"), F.col("least").alias("dst")).filter("src > dst")
        edges = written(moved.distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = state


def components(rows: DataFrame, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """``fp``, ``root``, ``component_id`` per distinct fingerprint of ``id``, ``fp`` rows."""
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "prints")
    roots = connected(links(distinct, distinct.count(), distance, segment)).withColumnRenamed("node", "fp")
    rooted = written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return written(rooted.join(written(least, "components"), "root").select("fp", "root", "component_id"), "members")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    rows = written(fingerprint_rows(df, id_col, text_col), "rows")
    found = rows.join(components(rows, distance, segment), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component the row of the smallest id stays.

    Several rows of that id count as one; the least of their values stays. Texts are shuffled once,
    equal rows of a task already as one.
    """
    own = sized(df).select(df[id_col].alias("id"), F.struct(*df.columns).alias("row"))
    texts = df.schema[text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(binary(batch.column("row").field(texts.name)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(prints.view(np.int64))], names=["id", "row", "fp"])

    marked = own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("fp", T.LongType())]))
    rows = written(fingerprint_rows(df, id_col, text_col), "rows")
    found = components(rows, distance, segment)
    first = rows.join(found, "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
    first = written(first.groupBy("root").agg(F.min("fp").alias("fp"), F.first("id").alias("id")), "kept")
    single = marked.groupBy("fp", "id").agg(F.min("row").alias("row"))
    return single.alias("s").join(first.alias("k"), (F.col("s.fp") == F.col("k.fp")) & F.col("s.id").eqNullSafe(F.col("k.id")), "left_semi").select("row.*")
