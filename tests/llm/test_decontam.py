import random

import numpy as np
import pyarrow as pa
from llm_data import MIDDLE, SMALL, documents

from planledger.llm import decontam, registry


def plain_alignment(a, b):
    """Smith-Waterman, cell by cell."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def split(text):
    low = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower())
    return low.split()


def test_alignment():
    draw = random.Random(1)
    pairs = [([draw.randint(1, 5) for _ in range(draw.randint(1, 12))], [draw.randint(1, 5) for _ in range(draw.randint(0, 30))]) for _ in range(300)]
    best, end = decontam.smith_waterman([np.array(a) for a, _ in pairs], [np.array(b, np.int64) for _, b in pairs])
    assert best.tolist() == [plain_alignment(a, b) for a, b in pairs]
    for (a, b), score, e in zip(pairs, best.tolist(), end.tolist(), strict=True):
        assert plain_alignment(a, b[:e]) == score


def test_words_do_not_cross_texts():
    h, owner, grams = decontam.words(pa.array(["A b c", "a", None, "x B C", "é É"]))
    assert owner.tolist() == [0, 0, 0, 1, 3, 3, 3, 4, 4]
    assert (grams != 0).tolist() == [True, False, False, False, True, False, False, False, False]
    assert h[0] == h[3] and h[1] == h[5] and h[7] == h[8]


def test_query_against_all_pairs(spark):
    """Every document against every item, in a document's window of all its words."""
    got = {(r.doc_id, r.item_id): r.score for r in registry.op4_decontam(spark, SMALL).collect()}
    docs = [(r.doc_id, split(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, split(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = {w: k for k, w in enumerate({w for _, x in docs + items for w in x})}
    want = {}
    for d, x in docs:
        text = np.array([words[w] for w in x], np.int64)
        best, _ = decontam.smith_waterman([np.array([words[w] for w in y]) for _, y in items], [text] * len(items))
        want |= {(d, i): b / 2 / len(y) for (i, y), b in zip(items, best.tolist(), strict=True) if b / 2 / len(y) >= decontam.CUT}
    assert got == want


def test_copies_and_edits(spark):
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [text(40) for _ in range(5)]
    edited = [w if k % 6 else "changed" for k, w in enumerate(items[1])]
    dropped = [w for k, w in enumerate(items[2]) if k % 8]
    docs = [
        " ".join(text(300) + items[0] + text(200)).upper(),
        " ".join(text(10) + edited + text(400)),
        ", ".join(text(700) + dropped),
        " ".join(text(500)),
        " ".join(items[3][:8] + text(300)),
        " ".join(items[4] + text(2000) + items[4]),
        None,
        "",
    ]
    marks = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(9, None), (10, "of"), (None, " ".join(items[0]))], "item_id int, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.word_start, r.word_end) for r in decontam.contaminated(documents(spark, docs), marks).collect()}
    assert set(found) == {(0, 0), (0, None), (1, 1), (2, 2), (5, 4)}
    assert found[0, 0] == (1.0, 300, 340)
    assert found[1, 1][0] > 0.7
    kept = decontam.decontaminate(documents(spark, docs), marks)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]


def test_an_item_copied_everywhere_is_found_everywhere(spark):
    item = " ".join(f"k{k}" for k in range(30))
    docs = [f"{item} tail{k}" for k in range(200)] + ["k1 k2 other"]
    marks = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert decontam.contaminated(documents(spark, docs), marks).count() == 200


def test_odd_rows(spark, odd, none):
    marks = spark.createDataFrame([(1, "the same words here again and again")], "item_id int, text string")
    assert {r.doc_id for r in decontam.contaminated(odd, marks).collect()} == {5, 6}
    kept = decontam.decontaminate(odd, marks)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.contaminated(none, marks).count() == 0
    assert decontam.decontaminate(none, marks).count() == 0
    assert decontam.contaminated(odd, marks.limit(0)).count() == 0
    assert decontam.decontaminate(odd, marks.limit(0)).count() == odd.count()


def test_larger_tables_hold_every_copy(spark):
    docs = {r.doc_id: " ".join(split(r.text)) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(3000).collect()}
    items = {r.item_id: " ".join(split(r.text)) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()}
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if y in x}
    found = decontam.contaminated(spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(3000), spark.read.parquet(f"{MIDDLE}/benchmark.parquet"))
    assert want <= {(r.doc_id, r.item_id) for r in found.collect()}
