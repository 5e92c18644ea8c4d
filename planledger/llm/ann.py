"""Nearest neighbours by inner product, through a hierarchical k-means tree searched best bin first.

Vectors get one more component that makes their lengths equal; then the largest inner product is
the nearest point. A tree of k-means splits is fitted on a bounded sample and every vector goes down
to one leaf. A query keeps its open nodes in a priority queue by distance and visits leaves in the
order they come out. How many leaves each query visits is widened until, on calibration queries
whose true neighbours are known from a full pass, the wished recall is reached. Leaves are visited
in rounds, four times as many in each; the worst answer of a round bounds what the next passes on.

Equal vectors are one entry with the least ids that an answer can need, so a vector that is
everywhere costs no more than another. Leaves are cut into blocks, and a leaf's queries too; one
block of each meets in a task. Answers are merged per distinct query vector.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and
rows with a null id, take no part. Ties go to the smaller id; rows of one id are never each other's
answers. Empty tables give empty answers. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import written

#: Vectors the tree is fitted on, calibration queries, wished recall on them.
SAMPLE, PROBES, RECALL = 20_000, 100, 0.97
#: Vectors of a leaf at least, and leaves of a tree about: leaves grow with the table, so that the visits
#: of a query don't.
BRANCHES, LEAF, LEAVES, BLOCK, FIRST_VISITS = 16, 256, 64, 1024, 4


@dataclass
class Tree:
    """Nodes' centres (with the added component), children, and leaf numbers (-1 inside)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0)
        return np.concatenate((x, np.sqrt(rest)[:, None]), axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        points, at = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [0]
        while todo:
            node = todo.pop()
            if kids := self.children[node]:
                own = np.flatnonzero(at == node)
                if len(own):
                    at[own] = np.array(kids)[_distances(points[own], self.centres[kids]).argmin(axis=1)]
                    todo += kids
        return self.leaf[at]

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """Leaves of each query in the order of best bin first."""
        flat = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        order = []
        for far in _distances(flat, self.centres):
            heap, seen = [(far[0], 0)], []
            while heap and len(seen) < most:
                _, node = heapq.heappop(heap)
                if kids := self.children[node]:
                    for kid in kids:
                        heapq.heappush(heap, (far[kid], kid))
                else:
                    seen.append(int(self.leaf[node]))
            order.append(seen)
        return order


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Group of each point after a few rounds of k-means."""
    centres = x[draw.choice(len(x), k, replace=False)]
    for _ in range(12):
        group = _distances(x, centres).argmin(axis=1)
        count = np.bincount(group, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, x)
        full = count > 0
        centres = np.where(full[:, None], sums / np.maximum(count, 1)[:, None], centres)
    return _distances(x, centres).argmin(axis=1)


def build(sample: np.ndarray, longest: float, leaf_points: int) -> Tree:
    """A tree whose leaves hold about ``leaf_points`` of the sample."""
    tree = Tree(np.zeros((0, 0)), [], np.zeros(0), longest)
    points, draw = tree.lifted(sample), np.random.default_rng(11)
    centres, leaf, todo = [points.mean(axis=0)], [-1], [(0, np.arange(len(points)))]
    tree.children.append([])
    leaves = 0
    while todo:
        node, own = todo.pop()
        group = _kmeans(points[own], min(BRANCHES, max(2, len(own) // leaf_points)), draw) if len(own) > leaf_points else np.zeros(len(own), int)
        parts = [own[group == g] for g in np.unique(group)]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for part in parts:
            tree.children[node].append(len(centres))
            todo.append((len(centres), part))
            centres.append(points[part].mean(axis=0))
            leaf.append(-1)
            tree.children.append([])
    tree.centres, tree.leaf = np.array(centres), np.array(leaf)
    return tree


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, answers: int) -> tuple[DataFrame, DataFrame, int]:
    """Usable rows (``key``, ``id``), their distinct vectors (``key``, ``vector``, ``ids``: the least
    ``answers``) and how many these are."""
    rows = df.select(df[id_col].alias("id"), df[vector_col].alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.size("vector") == (length.length if length else 0))
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("b"))
    keyed = rows.select(key.alias("key"), "id", "vector")
    ids = keyed.select("key", "id")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    least = ids.distinct().withColumn("rank", rank).filter(F.col("rank") <= answers).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = keyed.groupBy("key").agg(F.first("vector").alias("vector"))
    found = written(vectors.join(least, "key"), "vectors")
    return ids, found, found.count()


def _top(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """The best ``k`` rows of a block for each query, if they reach its bound; ties by id."""
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({"qkey": queries["qkey"][:0], "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        lists = vectors["ids"].combine_chunks()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        ids = lists.flatten().to_numpy()
        by_id = np.argsort(ids, kind="stable")
        score = np.einsum("qd,vd->qv", matrix(queries["qvector"]), matrix(vectors["vector"]), optimize=True)[:, owner[by_id]]
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        reached = np.take_along_axis(score, best, axis=1)
        who, place = np.nonzero(reached >= queries["bound"].to_numpy()[:, None])
        return pa.table({"qkey": queries["qkey"].combine_chunks().take(pa.array(who)), "id": pa.array(ids[by_id][best[who, place]]), "score": pa.array(reached[who, place])})

    return run


def _merged(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visit(placed: DataFrame, sizes: DataFrame, asking: DataFrame, k: int, shape: T.StructType) -> DataFrame:
    """The best of each leaf for the queries that visit it: every block of a leaf's vectors meets
    every block of its queries, each pair in a group of bounded size."""
    blocks = asking.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qblocks")).join(sizes, "leaf")
    blocks = written(blocks, "blocks")
    left = placed.join(blocks, "leaf").withColumn("vb", F.pmod("slot", F.col("vblocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
    right = asking.join(blocks, "leaf").withColumn("qb", F.pmod(F.xxhash64("qkey", F.lit(2)), F.col("qblocks")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)))
    unit = ["leaf", "vb", "qb"]
    left, right = left.select(*unit, "vector", "ids"), right.select(*unit, "qkey", "qvector", "bound")
    return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_top(k), shape)


def calibrate(vectors: DataFrame, probes: np.ndarray, tree: Tree, k: int, recall: float) -> int:
    """The least number of leaf visits that finds so much of the true neighbours of the probes.

    The probes are few, so every task scores its vectors against all of them and gives its best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((len(probes), 0)), np.zeros((len(probes), 0), np.int64)
        for batch in batches:
            x = matrix(batch.column("vector"))
            score = np.concatenate((kept[0], probes @ x.T), axis=1)
            leaf = np.concatenate((kept[1], np.broadcast_to(tree.place(x), (len(probes), len(x)))), axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(score, best, axis=1), np.take_along_axis(leaf, best, axis=1)
        who = np.repeat(np.arange(len(probes)), kept[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(kept[1].ravel()), pa.array(kept[0].ravel())], names=["probe", "id", "score"])

    true = _merged(vectors.select("vector").mapInArrow(run, "probe bigint, id bigint, score double"), "probe", k).select("probe", "id").toPandas()
    turn = [{leaf: n for n, leaf in enumerate(order)} for order in tree.visits(probes, len(tree.children))]
    needed = np.sort([turn[p][leaf] + 1 for p, leaf in zip(true["probe"], true["id"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, the id column and ``score``: the ``k`` nearest found of each query row."""
    spark = df.sparkSession
    ids, vectors, n = distinct_vectors(df, id_col, vector_col, k + 1)
    if not n:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    asked = written(ids.join(df.filter(queries).select(F.col(id_col).alias("id")).distinct(), "id").distinct(), "asked")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(vectors.agg(F.max(square)).first()[0]) ** 0.5
    turn = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))

    def some(rows: DataFrame, total: int, bound: int) -> np.ndarray:
        part = min(1.0, bound / max(total, 1))
        found = rows.filter(turn < int(part * (1 << 30))).orderBy("key").select("vector").toArrow()
        return matrix(found["vector"]) if found.num_rows else np.zeros((0, 1))

    sample = some(vectors, n, SAMPLE)
    if not len(sample):
        sample = matrix(vectors.orderBy("key").select("vector").limit(1).toArrow()["vector"])
    leaf = max(LEAF, n // LEAVES)
    tree = build(sample, longest, max(8, leaf * len(sample) // max(n, 1)))
    wanted = written(vectors.select("key", "vector").join(asked.select("key").distinct(), "key"), "wanted")
    probes = some(wanted, wanted.count(), PROBES)
    most = calibrate(vectors, probes, tree, k, recall) if len(probes) else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.place(matrix(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([leaf, batch.column("vector"), batch.column("ids")], names=["leaf", "vector", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = tree.visits(matrix(batch.column("vector")), most)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(order, pa.list_(pa.int64()))], names=["qkey", "qvector", "leaves"])

    kinds = vectors.schema
    placed = vectors.mapInArrow(place, T.StructType([T.StructField("leaf", T.LongType()), kinds["vector"], kinds["ids"]]))
    visiting = wanted.mapInArrow(visit, T.StructType([T.StructField("qkey", kinds["key"].dataType), T.StructField("qvector", kinds["vector"].dataType), T.StructField("leaves", T.ArrayType(T.LongType()))]))
    placed = written(placed.withColumn("slot", F.xxhash64("vector")), "placed")
    sizes = written(placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vblocks")), "leaf-sizes")
    visiting = written(visiting, "visiting")
    shape = T.StructType([T.StructField("qkey", kinds["key"].dataType), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    best, low = None, 0
    while low < most:  # a few leaves, then four times as many: what can't be among the best is not passed on
        high = max(FIRST_VISITS, 4 * low)
        asking = visiting.withColumn("leaves", F.slice("leaves", low + 1, high - low))
        if best is None:
            asking = asking.withColumn("bound", F.lit(float("-inf")))
        else:  # a row for each query meets its bound, before it is a row for each leaf
            bound = best.groupBy("qkey").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bound"))
            asking = asking.join(bound, "qkey")
        asking = asking.select("qkey", "qvector", F.explode("leaves").alias("leaf"), "bound")
        found = _visit(placed, sizes, asking, k + 1, shape)
        best = written(_merged(found if best is None else found.unionByName(best), "qkey", k + 1).select("qkey", "id", "score"), "answers")
        low = high
    answers = best.join(asked.select(F.col("key").alias("qkey"), F.col("id").alias("query_id")), "qkey").filter("query_id <> id")
    return _merged(answers, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
