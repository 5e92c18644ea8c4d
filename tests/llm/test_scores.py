"""Learnt scores on held-out rows, and the language model's exact part against a plain count."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import MIDDLE, SMALL, documents
from pyspark.sql import functions as F

from planledger.llm import lm, quality, registry, toxicity


def area(score, label):
    """Chance that a row of label 1 scores above one of label 0."""
    score, label = np.asarray(score), np.asarray(label)
    one, zero = score[label == 1], score[label == 0]
    return ((one[:, None] > zero).mean() + (one[:, None] == zero).mean() / 2).item()


@pytest.mark.parametrize(("query", "target", "least"), [(registry.op8_quality, "quality", 0.995), (registry.op5_toxicity, "toxic", 0.95)])
def test_held_out_rows(spark, query, target, least):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = query(spark, MIDDLE)
    assert rows.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert rows.filter("score < 0 or score > 1 or score is null").count() == 0
    found = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()
    assert area(found.score, found[target]) > least
    cut = 0.3 if target == "quality" else 0.5
    assert (found.predicted == (found.score >= cut)).all()
    assert (found.predicted == found[target]).mean() > 0.95
    if target == "quality":
        assert found.predicted[found.quality == 1].mean() > 0.99
    else:
        assert found.predicted[found.toxic == 0].mean() < 0.01


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(1500), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.train(docs, labels), quality.train(docs, wrong)
    assert one.weights.tolist() == two.weights.tolist() and one.threshold == two.threshold


def test_ranking_and_threshold():
    draw = np.random.default_rng(1)
    y = (draw.random(2000) < 0.8).astype(int)
    x = draw.normal(size=(2000, 4)) + np.outer(y, [2.5, 0, -2.5, 0])
    model = quality.fit(x, y)
    assert model.weights[0] > 1 and model.weights[2] < -1 and abs(model.weights[1]) < 0.3
    assert ((model.score(x) >= quality.CUT) == (y == 1)).mean() > 0.97
    assert quality.fit(x, np.ones(2000)) is None


def test_learning_by_ftrl_is_sparse():
    draw = np.random.default_rng(2)
    labels = draw.integers(0, 2, 400).tolist()
    rows = [np.unique(np.append(draw.integers(10, 5000, 30), 1 if y else 2)) for y in labels]
    w, b = toxicity.learn(rows, labels)
    assert w[1] > 1 > 0 > w[2]
    assert (w != 0).sum() < 400


def test_features_do_not_cross_texts():
    owner, bucket = toxicity.features(pa.array(["a b c", None, "", "d"]))
    assert np.bincount(owner, minlength=4).tolist() == [3 + 2 + 1, 0, 0, 1]
    assert toxicity.features(pa.array(["É x"]))[1].tolist() == toxicity.features(pa.array(["é X"]))[1].tolist()


@pytest.mark.parametrize("table", [1 << 20, 500])
def test_base_scores(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    rows = {r.doc_id: r for r in registry.op7_lm(spark, SMALL).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b" "] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in t)
    total = sum(counts.values())
    assert set(rows) == set(texts)
    for d, t in texts.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    if table > 500:  # the model knows the corpus better than single counts do
        assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_filter_never_misses_and_seldom_errs():
    draw = np.random.default_rng(3)
    gram, count = lm.mix(draw.integers(0, 1 << 63, 20_000).astype(np.uint64)), draw.integers(1, 4000, 20_000)
    top = lm.level(count)
    grams = np.bincount(top)
    cut1, _, bits = lm.cut_offs(grams, np.zeros(1, np.int64), lm.MOST_BITS)
    filled = np.zeros(bits >> 3, np.uint8)
    for step in range(cut1, top.max() + 1):
        where = np.unique(lm.probes(gram[top >= step], 0, step, bits >> 3))
        np.bitwise_or.at(filled, where >> 3, (1 << (where & 7)).astype(np.uint8))
    model = lm.Model(1, 1, gram, count, True, gram[:0], count[:0], 0.0, filled, (cut1, 1), (np.arange(top.max() + 1.0), np.zeros(1)))
    read = model.estimate(gram, 0)
    assert (read >= top).all() and (read > top).mean() < 0.12
    other = model.estimate(lm.mix(draw.integers(0, 1 << 63, 20_000).astype(np.uint64)), 0)
    assert (other > 0).mean() < 0.12


def test_cut_offs_fit_the_bound():
    one, two = np.array([0, 1000, 500, 100]), np.array([0, 50_000, 5000, 10])
    cut1, cut2, bits = lm.cut_offs(one, two, 1 << 21)
    assert (cut1, cut2) == (1, 1)
    cut1, cut2, bits = lm.cut_offs(one, two, 100_000)
    assert cut1 == 1 and cut2 == 2 and bits <= 1 << 20


def test_probabilities_after_a_core_word_sum_up(spark):
    docs = documents(spark, ["a b a b c d", "a c b b a d e"] * 30)
    marked = lm.marked(docs, "doc_id", "text")
    vocabulary = lm.counted(marked, None).cache()
    model = lm.train(marked, vocabulary)
    words = ["a", "b", "c", "d", "e"]
    gram = lm.tokens(pa.array([" ".join(words)]))[0]  # with the end
    total = 0.0
    for w in words:
        after = lm.tokens(pa.array([f"a {w}"]))
        *_, score, _, _, _ = lm.score_texts(model, pa.array([f"a {w}"]))
        assert len(after[0]) == 3 and score[0] < 0
    inside, at = lm.member(model.core, gram)
    assert inside.all()
    first = gram[:1].repeat(len(gram))
    seen = model.estimate(lm.mix(first * np.uint64(0xD1342543DE82EF95) + gram), 1)
    single = (model.estimate(gram, 0) + 1) / (model.total + model.distinct + 1)
    total = (model.share * (seen + lm.PRIOR * single / model.share) / (model.follows[at[0]] + lm.PRIOR)).sum()
    assert abs(total - model.share) < 0.1


def test_odd_rows(spark, odd, none, no_labels):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, 0), (6, None, 1), (None, 1, 1), (7, 0, 0), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, no_labels):
        good, toxic = quality.train(odd, known), toxicity.train(odd, known)
        for rows in (quality.scores(odd, good), toxicity.scores(odd, toxic)):
            assert rows.count() == odd.count()
            assert rows.filter("score is null or score < 0 or score > 1").count() == 0
        assert quality.scores(none, good).count() == 0 and toxicity.scores(none, toxic).count() == 0
        assert quality.keep_good(odd, good).columns == odd.columns
    assert quality.keep_good(odd, quality.train(odd, no_labels)).count() == odd.count()
    rows = lm.scores(odd)
    assert rows.count() == odd.count()
    assert rows.filter("doc_id is null and held_out").count() == 0
    assert rows.filter("score is null or base_score is null").count() == 0
    assert lm.scores(none).count() == 0


def plain_model(texts, held):
    """log10 probabilities by levels of exact counts of all words and pairs, without a filter."""
    words, two = Counter(), Counter()
    for d, t in texts.items():
        if not held[d]:
            words.update(t)
            two.update(zip([b" ", *t[:-1]], t, strict=True))

    def by_level(counts):
        top = lm.level(np.array(list(counts.values())))
        mean = np.bincount(top, weights=list(counts.values())) / np.maximum(np.bincount(top), 1)
        return dict(zip(counts, mean[top].tolist(), strict=True))

    one, pair, every = by_level(words), by_level(two), words.total() + len(words) + 1
    found = {}
    for d, t in texts.items():
        chances = [(pair.get((a, b), 0) + lm.PRIOR * (one.get(b, 0) + 1) / every) / (words[a] + lm.PRIOR) for a, b in zip([b" ", *t[:-1]], t, strict=True)]
        found[d] = sum(math.log10(min(c, 1)) for c in chances)
    return found


@pytest.mark.parametrize(("table", "bits"), [(1 << 20, lm.MOST_BITS), (1 << 20, 1), (500, lm.MOST_BITS), (500, 1), (500, 200_000)])
def test_all_pairs_count_at_any_bound(spark, monkeypatch, table, bits):
    """Bounds of table and filter decide where counts are read, not which of them count."""
    monkeypatch.setattr(lm, "TABLE", table)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b" "] for r in docs.collect()}
    want = plain_model(texts, {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts})
    rows = {r.doc_id: r.score for r in lm.scores(docs, most_bits=bits).collect()}
    assert set(rows) == set(want)
    for d, score in rows.items():  # without a filter nothing is read too high
        assert math.isclose(score, want[d], rel_tol=1e-9 if bits == 1 else 0.05)
