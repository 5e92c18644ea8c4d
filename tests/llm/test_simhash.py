import numpy as np
import pytest
import xxhash
from llm_data import SMALL, documents

from planledger.llm import registry, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * counts[b] > len(shingles))


def plain_components(ids, prints):
    """Least id reachable over pairs within three bits."""
    label = list(range(len(ids)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((top(i), top(int(j))), key=lambda k: ids[k])
            label[b] = a
    return [ids[top(k)] for k in range(len(ids))]


def test_fingerprints_and_counters():
    texts = ["", "a", "A b", "a b c", "x y z w " * 300, "café ÉTÉ x y z", "\t\n"]
    got = simhash.fingerprints([t.encode() for t in texts])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_query(spark):
    rows = registry.op10_simhash(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [plain_fingerprint(docs[i]) for i in ids]
    want = dict(zip(ids, zip(prints, plain_components(ids, prints), strict=True), strict=True))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == want
    assert all(len(r.fingerprint) == 16 for r in rows)


@pytest.mark.parametrize("segment", [2, 4, 8])
def test_manhattan_distance_is_a_lower_bound(segment):
    x = np.random.default_rng(1).integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    codes = simhash.embedding(x.ravel(), segment).reshape(2, -1)
    assert (np.bitwise_count(codes[0] ^ codes[1]) <= np.bitwise_count(x[0] ^ x[1])).all()
    counts = [sum(abs((int(a) >> s & (1 << segment) - 1).bit_count() - (int(b) >> s & (1 << segment) - 1).bit_count()) for s in range(0, 64, segment)) for a, b in x[:, :50].T]
    assert np.bitwise_count(codes[0] ^ codes[1])[:50].tolist() == counts


@pytest.mark.parametrize(("segment", "block", "small"), [(2, 2048, 32), (4, 16, 4), (2, 8, 2)])
def test_dense_neighbourhoods(spark, monkeypatch, segment, block, small):
    """Many fingerprints near one, so that cells are crowded: blocks and stars lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_UNIT", small)
    draw = np.random.default_rng(2)
    centres = draw.integers(0, 1 << 62, 6)
    prints = {int(c) for c in centres}
    for c in centres[:3].tolist():
        for _ in range(120):
            x = c
            for b in draw.choice(62, draw.integers(1, 9), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    ids = list(range(100, 100 + len(prints)))
    rows = spark.createDataFrame(list(zip(ids, prints, strict=True)), "id bigint, fp bigint")
    found = {r.fp: r.component_id for r in simhash.components(rows, segment=segment).collect()}
    assert [found[p] for p in prints] == plain_components(ids, prints)


def test_grid_has_more_groups_for_more_rows():
    assert len(simhash.grid(1000)) == 20
    assert len(simhash.grid(10**9)) >= 56 < len(simhash.grid(10**11))


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)], "src bigint, dst bigint")
    assert {(r.node, r.root) for r in simhash.connected(edges).collect()} == {(k, 0) for k in range(1, 41)}


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if int(r.fingerprint, 16) == 0]
    assert {r.component_id for r in empty} == {1}
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert simhash.deduplicate(none).count() == 0


def test_all_ids_null(spark):
    df = spark.createDataFrame([(None, "a b c d", "en", "s", 7)] * 3, documents(spark, []).schema)
    assert [r.component_id for r in simhash.near_duplicates(df).collect()] == [None] * 3
    assert simhash.deduplicate(df).count() == 1
