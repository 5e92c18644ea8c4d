"""Byte-pair encoding and decoding by speculation.

A text is cut into pieces by array rules equal to the tokenizer's split pattern; equal pieces of a
round are encoded once. For a new piece, greedy longest match proposes tokens. A token sequence is
the true encoding exactly when every adjacent pair is: so all distinct adjacent pairs are tested
together by unwinding both tokens' merges, and only pieces with a failing pair are merged exactly.

``round_trip`` keeps one row per input row. Null text counts as empty: no ids, empty decoded text.
Null ids, repeated rows, empty tables and further columns are passed over without effect: the result
has the columns (id, ``n_tokens``, ``ids``, ``decoded``) only, whatever else the input holds.
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from planledger.llm.common import binary, rounds, sized

#: Pieces, and their bytes, from which a generation of the two that a Python worker keeps encoded is
#: full; results don't depend on it.
KEPT_PIECES, KEPT_BYTES = 250_000, 1 << 23
#: Longer pieces are merged on a heap.
LIST_BYTES = 96
LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 0


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stays itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file splits texts by the byte-level pattern and nothing else."""
    before = spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec["normalizer"]
    return bool(plain) and spec["model"]["type"] == "BPE" and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])


class Merges:
    """Vocabulary and merge table of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if not plain_byte_level(spec):
            raise ValueError("a byte-level BPE file without normalizer and prefix blank is needed")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        vocab = {token: i for token, i in model["vocab"].items() if token.encode() not in self.special}
        self.bytes = {i: raw(token) for token, i in vocab.items()} | {i: s for s, i in self.special.items()}
        size = max(self.bytes) + 1
        self.byte_id = np.zeros(256, np.int64)
        for b, token in ((b, c) for c, b in letters.items()):
            self.byte_id[b] = vocab[token]
        #: Order in which a token is made; -1 for single bytes.
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.byte_ids: list[int] = self.byte_id.tolist()
        self.orders: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for order, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            l, r, made = vocab[a], vocab[b], vocab[a + b]
            if self.rank[made] >= 0 or (l, r) in self.orders:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[made], self.left[made], self.right[made] = order, l, r
            self.orders[l, r] = order
            self.made.append(made)
        keys = np.array([l << 32 | r for l, r in self.orders], np.int64)
        by_key = np.argsort(keys)
        self.keys, self.key_rank = keys[by_key], by_key.astype(np.int64)
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        whole = np.zeros(size, bool)
        whole[self.byte_id] = True
        fits = self.compatible(self.left[made], self.right[made], self.rank[made])
        for token, fit in zip(made.tolist(), fits.tolist(), strict=True):
            whole[token] = fit and whole[self.left[token]] and whole[self.right[token]]
        self.greedy = ahocorasick.Automaton()
        for token in np.flatnonzero(whole).tolist():  # a token whose own text encodes otherwise is never right
            self.greedy.add_word(self.bytes[token].decode("latin-1"), token)
        self.greedy.make_automaton()
        self.length = np.array([len(self.bytes.get(i, b"")) for i in range(size)], np.int64)
        self.place = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.text = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of adjacent tokens, whether merging their joint text gives just these two.

        Going back in time, the token made last is taken apart and its half at the border looked at:
        a merge across the border that comes before that moment would have happened instead. Of
        equal merges the left one comes first.
        """
        result = np.ones(len(left), bool)
        todo = np.arange(len(left))
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(todo):
            key = left << 32 | right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.key_rank[at] < limit)
            result[todo[crossed]] = False
            made_l, made_r = self.rank[left], self.rank[right]
            go = ~crossed & ((made_l >= 0) | (made_r >= 0))
            undo_l = made_l > made_r
            limit = np.where(undo_l, made_l, made_r + 1)[go]
            left, right = np.where(undo_l, self.right[left], left)[go], np.where(undo_l, right, self.left[right])[go]
            todo = todo[go]
        return result

    def merged(self, piece: bytes) -> list[int]:
        """The exact encoding of a piece: merges by rank, leftmost first."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > LIST_BYTES:
            return self.merged_long(ids)
        get, never, made = self.orders.get, len(self.made), self.made
        orders = [get(pair, never) for pair in zip(ids, ids[1:])]  # noqa: B905
        while orders:
            order = min(orders)
            if order == never:
                break
            k = orders.index(order)
            ids[k : k + 2] = (made[order],)
            del orders[k]
            if k:
                orders[k - 1] = get((ids[k - 1], ids[k]), never)
            if k < len(orders):
                orders[k] = get((ids[k], ids[k + 1]), never)
        return ids

    def merged_long(self, start: list[int]) -> list[int]:
        """As ``merged``, in time n log n: a heap of pairs over a linked list."""
        ids: list[int | None] = list(start)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.orders.get
        heap = [(order, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (order := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            order, k, l, r = heapq.heappop(heap)
            n = after[k]
            if ids[k] != l or n >= len(ids) or ids[n] != r:
                continue
            ids[k], ids[n] = made, _ = self.made[order], None
            after[k] = beyond = after[n]
            if beyond < len(ids):
                before[beyond] = k
                if (order := get((made, ids[beyond]))) is not None:
                    heapq.heappush(heap, (order, k, made, ids[beyond]))
            if (p := before[k]) >= 0 and (order := get((ids[p], made))) is not None:
                heapq.heappush(heap, (order, p, ids[p], made))
        return [i for i in ids if i is not None]

    def speculate(self, pieces: list[bytes]) -> list[list[int]]:
        """Greedy proposals, tested pair by pair; failing pieces are merged exactly."""
        longest = self.greedy.iter_long
        found = [[self.special[p]] if p in self.special else [t for _, t in longest(p.decode("latin-1"))] for p in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(found)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        for k in np.unique(owner[inside[fails[which]]]).tolist():
            found[k] = self.merged(pieces[k])
        return found

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens in order, and the byte length of each token."""
        length = self.length[ids]
        total = int(length.sum())
        ends = np.cumsum(length)
        return self.text[np.repeat(self.place[ids] - (ends - length), length) + np.arange(total)], length


@lru_cache(2)
def load(path: str) -> Merges:
    return Merges(path)


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point, whether the split pattern takes it as letter, number, blank or other."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    kind = np.full(0x110000, OTHER, np.uint8)
    for what, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kind[points[m.start() : m.end()]] = what
    # Letters and numbers that are newer than Python's tables: the tokenizers library has the last word.
    new = [chr(c) for c in np.flatnonzero((kind == LETTER) | (kind == NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for what, near in ((LETTER, "a"), (NUMBER, "1")):
        own = [c for c in new if kind[ord(c)] == what]
        for at in [a for _, (a, _) in cut("".join(near + c for c in own)) if a % 2]:
            kind[ord(own[at // 2])] = OTHER
    return kind


def pieces(texts: pa.Array, special: tuple[bytes, ...] = ()) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pieces of the texts, in order, as a dictionary array; and the number of pieces of each text.

    A run of letters, of numbers or of other signs is a piece and takes one plain blank before it.
    Of a run of blanks, the last is a piece of its own (or goes with the next) unless the text ends.
    An apostrophe that begins a piece takes s, t, m, d, re, ve or ll. Special strings stand alone.
    """
    texts = binary(texts)
    raw = b"".join(texts.to_pylist())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :])
    ends = np.cumsum(sizes)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    hard = np.zeros(n + 1, bool)  # where what is before can't be seen
    hard[np.searchsorted(at, ends)] = True
    hard[0] = hard[n] = True
    alone: list[tuple[int, int]] = []
    for token in special:
        place = raw.find(token)
        while place >= 0:
            low, high = np.searchsorted(at, (place, place + len(token))).tolist()
            if not hard[low + 1 : high].any():
                alone.append((low, high))
                place += len(token) - 1
            place = raw.find(token, place + 1)
    for low, high in alone:
        hard[low] = hard[high] = True
    kind = kinds()[code]
    blank, plain = kind == BLANK, code == 0x20
    begin = hard[:n].copy()
    begin[1:] |= (kind[1:] != kind[:-1]) & ~(plain[:-1] & ~blank[1:])
    last = blank & ~hard[1:]  # the last blank of a run, something follows
    last[:-1] &= ~blank[1:]
    last[-1] = False
    begin |= last
    quote = np.flatnonzero((code == 0x27) & begin)
    if len(quote):
        padded = np.concatenate((code, np.zeros(3, np.uint32)))
        one, two = padded[quote + 1], padded[quote + 2]
        in1 = ~hard[np.minimum(quote + 1, n)]
        in2 = in1 & ~hard[np.minimum(quote + 2, n)]
        short = in1 & np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        longer = in2 & np.isin(one.astype(np.uint64) << np.uint64(32) | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        begin[quote[short | longer] + 1] = False
        for chosen, size in ((short, 2), (longer & ~short, 3)):
            nxt = quote[chosen] + size
            begin[nxt[nxt < n]] = True
    for low, high in alone:
        begin[low + 1 : high] = False
    starts = np.flatnonzero(begin)
    offsets = np.append(at[starts], at[n])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a text of 2 GB or more can't be a value of a table")
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    upto = np.searchsorted(offsets[:-1], ends)
    return array.dictionary_encode(), np.diff(upto, prepend=0)


class Store:
    """Encoded pieces, kept over the rounds of a worker in two generations: when the younger is full
    it becomes the older, from which pieces met again move up, and the older one is given up."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], special: tuple[bytes, ...]):
        self.encode, self.special = encode, special
        self.slot: dict[bytes, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.older = self.slot, self.flat, self.start
        self.held = 0

    def add(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(lengths)))
        self.flat = np.concatenate((self.flat, flat))
        self.held += sum(map(len, words))

    def learn(self, words: list[bytes]) -> None:
        if len(self.slot) > KEPT_PIECES or self.held > KEPT_BYTES:
            self.older, self.held = (self.slot, self.flat, self.start), 0
            self.slot, self.flat, self.start = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        missing = [w for w in words if w not in self.slot]
        old, flat, start = self.older
        if old is not self.slot and (again := [w for w in missing if w in old]):
            self.add(again, *gather(flat, start, np.fromiter(map(old.__getitem__, again), np.int64, len(again))))
            missing = [w for w in missing if w not in old]
        if missing:
            found = self.encode(missing)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.add(missing, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and the number of ids of each text."""
        coded, count = pieces(texts, self.special)
        words = coded.dictionary.to_pylist()
        self.learn(words)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        ids, lengths = gather(self.flat, self.start, slots)
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(count)]
        return ids, np.diff(upto, prepend=0)


def gather(flat: np.ndarray, start: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some slots, one after the other, and how many each has."""
    low = start[slots]
    length = start[slots + 1] - low
    ends = np.cumsum(length)
    return flat[np.repeat(low - (ends - length), length) + np.arange(length.sum())], length


@lru_cache(2)
def store(path: str) -> Store:
    merges = load(path)
    return Store(merges.speculate, tuple(merges.special))


def coder(path: str, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(path)
        for batch in rounds(batches):
            ids, count = own.ids(batch.column("text"))
            size = np.concatenate(([0], np.cumsum(count)))
            columns = [batch.column("id"), pa.array(count, pa.int64())]
            packed = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(4 * size), pa.py_buffer(ids.astype("<u4"))])
            columns.append(packed.cast(pa.binary()))
            if decoded:
                text, length = load(path).decode(ids)
                where = np.concatenate(([0], np.cumsum(length)))[size].tolist()
                whole = text.tobytes()
                columns.append(pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(where, where[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def _coded(df: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    own = sized(df).select(df[id_col].alias("id"), df[text_col].alias("text"))
    fields = [T.StructField("id", own.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return own.mapInArrow(coder(path, decoded), T.StructType(fields)).withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens`` and ``ids``, packed as little-endian unsigned 32-bit integers."""
    return _coded(df, path, id_col, text_col, False)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with ``decoded``: the text that the ids stand for, made from the ids alone."""
    return _coded(df, path, id_col, text_col, True)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded`` for packed ids; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in rounds(batches, "ids"):
            texts = [merges.decode(np.frombuffer(x, "<u4").astype(np.int64))[0].tobytes().decode("utf-8", "replace") for x in binary(batch.column("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    own = sized(df).select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    fields = [T.StructField("id", own.schema["id"].dataType), T.StructField("decoded", T.StringType())]
    return own.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
