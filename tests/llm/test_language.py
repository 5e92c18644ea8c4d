"""Language labels: the block-wise path against a plain one, held-out accuracy, mixed texts, odd rows."""

import numpy as np
import pytest
from llm_data import MIDDLE, documents
from pyspark.sql import functions as F

from planledger.llm import language


def plain_path(score, penalty):
    """The best labels of one text by enumeration of the walk in plain Python."""
    value, ways = list(score[0]), []
    for own in score[1:]:
        top = max(range(len(value)), key=lambda k: value[k])
        ways.append([k if value[k] >= value[top] - penalty else top for k in range(len(value))])
        value = [max(v, value[top] - penalty) + s for v, s in zip(value, own, strict=True)]
    label = max(range(len(value)), key=lambda k: value[k])
    found = [label]
    for way in reversed(ways):
        found.append(way[found[-1]])
    return found[::-1]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_blocks_give_the_undivided_path(block):
    rnd = np.random.default_rng(3)
    sizes = [1, 2, 7, 40, 3, 500, 1, 65]
    text = np.repeat(np.arange(0, 2 * len(sizes), 2), sizes)
    score = np.round(rnd.normal(0, 3, (len(text), 4)), 1)
    score[rnd.random(score.shape) < 0.1] = -np.inf
    score[np.isneginf(score).all(axis=1)] = 0
    want = [label for t in np.unique(text) for label in plain_path(score[text == t].tolist(), 5.0)]
    assert language.best_path(score, text, 5.0, block).tolist() == want


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    return language.train(docs.filter(language.in_training(F.col("doc_id"))))


def test_counts_are_those_of_a_plain_loop(spark):
    """Every n-gram of every training word is in the table, one by one."""
    rows = [(1, "Ab c2dé", "x"), (2, "b", "y"), (3, None, "x"), (4, "zz", None)]
    own = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert own.languages == ["x", "y"]
    for order in range(3):
        want = np.full((1 << own.bits, 2), language.PRIOR)
        for k, words in enumerate((["ab", "c", "dé"], ["b"])):
            for word in words:
                padded = word if order == 0 else f" {word} "
                for at in range(len(padded) - order):
                    code = order + 1
                    for c in padded[at : at + order + 1]:
                        code = (code * 0x110001 + ord(c)) % 2**64
                    want[int(language.mix(np.array([code], np.uint64))[0]) >> (64 - own.bits), k] += 1
        assert np.allclose(own.table[order], np.log(want / want.sum(axis=0)) / language.ORDERS, atol=1e-5)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter(~language.in_training(F.col("doc_id")))
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    right, total = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right / total > 0.99


def test_mixed_text_has_spans(spark, model):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    parts = {r.lang: r.text for r in docs.filter("length(text) between 300 and 600 and lang in ('de', 'fr') and not contains(text, '!!')").orderBy("doc_id").limit(40).collect()}
    text = parts["de"] + " " + parts["fr"]
    row = language.identify(documents(spark, [text]), model).first()
    assert [s.lang for s in row.spans] == ["de", "fr"]
    assert abs(row.spans[1].start - len(parts["de"])) < 30
    assert row.spans[-1].stop == len(text.rstrip(".\n !?"))
    assert row.score == pytest.approx(max(len(parts["de"]), len(parts["fr"])) / len(text), abs=0.05)


def test_scripts_narrow(spark):
    rows = [(1, "чай вода", "ru"), (2, "tea water", "en"), (3, "νερό", "el"), (4, "вода", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = ["вьюга", "zzz qqq", "ωω вввв ooo", None, "", "12 !?", "漢字", "ⅷ ́ "]
    found = [r.lang_pred for r in language.identify(documents(spark, texts), model).orderBy("doc_id").collect()]
    assert found[:2] == ["ru", "en"] and found[3:6] == ["und"] * 3
    assert found[2] == "ru" and found[6] in model.languages and found[7] == "und"


def test_odd_rows(spark, odd, none, model):
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not r.spans) == (r.score == 0)
    assert language.identify(none, model).collect() == []
    assert language.train(none) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.train(odd).languages == ["en", "fr"]
