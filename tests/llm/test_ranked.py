"""Ranked search against SQL, and the treap against its cells."""

import duckdb
import numpy as np
import pytest
from llm_data import SMALL, documents

from planledger.llm import ranked
from planledger.llm.sql import OP11


def by_sql(docs, items):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toArrow())
    db.register("benchmark", items.select("item_id", "text").toArrow())
    return sorted(db.execute(OP11).fetchall(), key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in ranked.search(docs, items, **options).collect()), key=str)


def test_whole_tables(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    assert found(docs, items) == by_sql(docs, items)


@pytest.mark.parametrize("cells", [0, 1, 5, 3000])
def test_treap_holds_its_cells(cells):
    rnd = np.random.default_rng(cells)
    rows, columns = 40, 300
    place = np.sort(rnd.choice(rows * columns, cells, replace=False))
    r, c, v = place // columns, place % columns, rnd.integers(1, 1000, cells)
    tree = ranked.treap(r, c, v)
    grid = np.zeros((rows, columns), np.int64)
    grid[r, c] = v
    weights = rnd.integers(1, 9, 6)
    for _ in range(5):
        asked = np.sort(rnd.choice(rows, 6, replace=False))
        score = (grid[asked] * weights[:, None]).sum(axis=0)
        # The last term is in no document, and further down than any row of the grid.
        at, values = ranked.best(tree, np.append(asked, 1000 + asked[0]), np.append(weights, 3), columns, 0, 20)
        assert (score[at] == values).all()
        want = np.sort(score[score > 0])[::-1][:20]
        assert np.sort(values)[::-1][: len(want)].tolist() == want.tolist()
        if len(want) == 20:
            assert set(np.flatnonzero(score >= want[-1])) <= set(at)


def test_small_blocks_and_slices(spark, monkeypatch):
    """Many blocks a task, items in many slices, few ranges opened at a time: the same answers."""
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ranked, "OPENED", 2)
    monkeypatch.setattr(ranked, "WIDE", 20)
    monkeypatch.setattr(ranked, "MOST_TERMS", 300)
    assert found(docs, items) == by_sql(docs, items)


def test_many_equal_documents(spark):
    """Thousands of copies: ties go by id, however the copies lie."""
    texts = ["the same Words here"] * 3000 + ["words"] * 5 + ["", None, "  .. "]
    docs = documents(spark, texts).repartition(16)
    items = spark.createDataFrame([(1, "WORDS words"), (2, "nothing at all"), (3, None), (4, ""), (5, "the words")], "item_id bigint, text string")
    rows = found(docs, items)
    assert rows == by_sql(docs, items)
    assert [r[2] for r in sorted(rows) if r[0] == 5] == list(range(20))


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one again", "x"), (1, "same", "y"), (None, "token mail", "z"), (2, "word5 and7 word5", "q")], "item_id bigint, text string, id string")
    rows = found(odd, items)
    assert {r[0] for r in rows} == {1, None, 2}
    assert rows == by_sql(odd, items)
    assert found(none, items) == [] and found(odd, items.limit(0)) == []
