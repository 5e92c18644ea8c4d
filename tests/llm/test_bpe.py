import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_data import SMALL, documents
from tokenizers import Tokenizer

from planledger.llm import bpe, registry, token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", "'ll", "a", "the", " ", "  ", "\n", "\t", " ", "é", "1", "22", "!", "<|endoftext|>", "<|", "日本", "　", "d", "\r\n", " '", "\x1c", "\x85", "\U0001d538", "​", "՘", "tokenization"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("encoder", ["speculate", "library"])
def test_ids_equal_the_library(library, encoder):
    sample = [*texts(5000, 1), None, "", "ab" * 400]
    coder = bpe.store(PATH).ids if encoder == "speculate" else token_orc.text_coder(PATH)
    ids, count = coder(pa.array(sample, pa.string()))
    got = np.split(ids, np.cumsum(count)[:-1])
    for text, found in zip(sample, got, strict=True):
        assert found.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_generations_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    merges = bpe.load(PATH)
    store = bpe.Store(merges.speculate, tuple(merges.special))
    for text in texts(300, 2):
        assert store.ids(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_exact_merging_of_long_and_short_pieces(library):
    merges, draw = bpe.load(PATH), random.Random(3)
    for _ in range(200):
        piece = "".join(draw.choice("abcdethin") for _ in range(draw.randint(1, 90)))
        want = library.encode(piece, add_special_tokens=False).ids
        assert merges.merged(piece.encode()) == want
        assert merges.merged_long([merges.byte_ids[b] for b in piece.encode()]) == want


def test_compatibility_of_pairs_is_exact(library):
    merges, draw = bpe.load(PATH), np.random.default_rng(4)
    left, right = draw.integers(0, 3000, (2, 3000))
    fits = merges.compatible(left, right)
    for l, r, fit in zip(left.tolist(), right.tolist(), fits.tolist(), strict=True):
        assert fit == (merges.merged(merges.bytes[l] + merges.bytes[r]) == [l, r])


def test_query_round_trip(spark, library):
    rows = {r.doc_id: r for r in registry.op2_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_decode_alone(spark):
    df = documents(spark, ["hello  world", None, "日本 <|endoftext|>"])
    coded = bpe.encode(df, PATH)
    assert {r.doc_id: r.decoded for r in bpe.decode(coded, PATH).collect()} == {0: "hello  world", 1: "", 2: "日本 <|endoftext|>"}


def test_orc_query(spark, library):
    rows = {r.doc_id: r for r in registry.op1_token_orc(spark, SMALL).collect()}
    start = 0
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        got = rows.pop(d.doc_id)
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not rows


def test_orc_lookup_pushes_the_filter_down(spark, tmp_path):
    path = token_orc.write_token_ids(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH, f"file://{tmp_path}/ids")
    found = token_orc.lookup(spark, path, [3, 77])
    assert {r.id for r in found.collect()} == {3, 77}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [3,77])]" in plan


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_orc.write_token_ids(documents(spark, ["Hello World"]), path, f"file://{tmp_path}/ids")
    want = Tokenizer.from_file(path).encode("Hello World", add_special_tokens=False).ids
    assert token_orc.read_token_ids(spark, rows).first().ids == [*want, 2]


def test_odd_rows(spark, odd, none, library, tmp_path):
    path = token_orc.write_token_ids(odd, PATH, f"file://{tmp_path}/ids")
    rows = token_orc.positions(token_orc.checksums(token_orc.read_token_ids(spark, path))).orderBy("start").collect()
    assert len(rows) == odd.count()
    assert [r.id for r in rows[:2]] == [None, None]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    trip = bpe.round_trip(odd, PATH)
    assert sorted((r.decoded for r in trip.collect())) == sorted((r.text or "") for r in odd.collect())
    assert bpe.round_trip(none, PATH).count() == 0
    path = token_orc.write_token_ids(none, PATH, f"file://{tmp_path}/empty")
    assert token_orc.positions(token_orc.checksums(token_orc.read_token_ids(spark, path))).count() == 0
