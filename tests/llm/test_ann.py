import numpy as np
from llm_data import MIDDLE
from pyspark.sql import functions as F

from planledger.llm import ann, registry


def plain(ids, x, query, k):
    score = x @ x[query]
    order = sorted((j for j in range(len(ids)) if ids[j] != ids[query]), key=lambda j: (-score[j], ids[j]))[:k]
    return [(ids[j], score[j]) for j in order]


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>, label int")


def test_query_recall(spark):
    rows = registry.op9_ann(spark, MIDDLE).toPandas()
    data = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(float)
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        got = rows[rows.query_id == ids[q]].sort_values("rank")
        want = plain(ids, x, q, 20)
        assert got["rank"].tolist() == list(range(1, 21))
        assert got.score.is_monotonic_decreasing and ids[q] not in set(got.vec_id)
        at = np.searchsorted(ids, got.vec_id)
        assert np.allclose(got.score, x[at] @ x[q], rtol=0, atol=1e-12)
        found, total = found + len({v for v, _ in want} & set(got.vec_id)), total + 20
    assert found / total >= 0.9


def test_best_bin_first_reaches_what_it_must(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 8)) * 3
    x = (centres[draw.integers(0, 30, 6000)] + draw.normal(size=(6000, 8)) * 0.4).astype(np.float32).astype(float)
    tree = ann.build(x, float(np.linalg.norm(x, axis=1).max()), 64)
    leaves = tree.place(x)
    assert np.bincount(leaves).max() < 1500 and leaves.max() > 20
    order = tree.visits(x[:50], 10**6)
    assert all(sorted(o) == list(range(leaves.max() + 1)) for o in order)
    rows = ann.search(table(spark, range(6000), x), F.col("vec_id") % 200 == 0, 10).toPandas()
    hits = [len({v for v, _ in plain(range(6000), x, q, 10)} & set(rows[rows.query_id == q].vec_id)) for q in range(0, 6000, 200)]
    assert np.mean(hits) >= 9


def test_copies_ties_and_blocks(spark, monkeypatch):
    """A vector that a third of the rows share, more copies than an answer holds, and small blocks."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    draw = np.random.default_rng(2)
    x = draw.integers(-3, 4, (240, 4)).astype(float)
    x[::3] = [1, 2, 0, 1]
    x[(x == 0).all(axis=1)] = 1
    ids = draw.permutation(240)
    rows = ann.search(table(spark, ids, x), F.col("vec_id") % 6 == 0, 15, recall=1.0).toPandas()
    for q in np.flatnonzero(ids % 6 == 0).tolist():
        got = rows[rows.query_id == ids[q]].sort_values("rank")
        assert list(zip(got.vec_id, got.score, strict=True)) == plain(ids, x, q, 15)


def test_unusable_rows_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, None), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, key string, leaf string")
    found = ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
