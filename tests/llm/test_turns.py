"""Conversation repair against a walk that carries whole edit strings, and against SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
from llm_data import SMALL

from planledger.llm import turns
from planledger.llm.sql import OP12

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def inserted(best):
    """All states with up to three insertions before the next row."""
    found = dict(best)
    now = best
    for _ in range(3):
        new = {}
        for state, (cost, audit, said) in now.items():
            for role in ("user", "assistant"):
                to = AFTER.get((state, role[0]))
                way = (cost + 5, audit + "I", (*said, role + ":"))
                if to and (to not in found or way < found[to]):
                    found[to] = new[to] = way
        now = new
    return found


def plain_repair(rows):
    """blank, duplicate, truncated, illegal, cost, audit and digest of (role, text) rows."""
    seen, faults, best = set(), [], {"": (0, "", ())}
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        new = {}

        def put(state, cost, audit, said, new=new):
            if state is not None and (state not in new or (cost, audit, said) < new[state]):
                new[state] = (cost, audit, said)

        for state, (cost, audit, said) in inserted(best).items():
            put(state, cost + 2, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            own = 5 * (fault == "truncated")
            if role:
                put(AFTER.get((state, role[0])), cost + own, audit + "K", (*said, f"{role}:{text}"))
            for other in ("user", "assistant"):
                put(AFTER.get((state, other[0])), cost + own + 1, audit + "R", (*said, f"{other}:{text}"))
        best = new
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, said = min(way for state, way in inserted(best).items() if state in ("", "a"))
    return (*(faults.count(k) for k in turns.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def plain_audit(rows):
    found = {}
    for conv, turn, role, text in rows:
        held = found.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
            held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, held in found.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        times = [r[0] for r in held if r[0] is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        out[conv] = (gaps, *plain_repair([r[1:] for r in held]))
    return out


def result(spark, df, parts=8):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = turns.audit(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = plain_audit(tuple(r) for r in df.collect())
    assert result(spark, df) == want
    db = duckdb.connect()
    db.register("conversations", df.toPandas())
    assert {r[0]: r[1:] for r in db.execute(OP12).fetchall()} == want


def test_every_short_sequence():
    """All sequences of up to five kinds of rows: the crossings choose what the walk over strings does."""
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("tool", "d"), ("user", "e"), ("", "f."), ("x", " ")]
    for n in range(1, 5):
        for chosen in itertools.product(kinds, repeat=n):
            rows = [(role, text if text == " " else f"{k}{text}") for k, (role, text) in enumerate(chosen)]
            codes = bytes(turns._code(role.encode(), text.encode(), False)[0] for role, text in rows)
            assert turns.whole_edits(codes) == plain_repair(rows)[4:6]


def test_hot_conversation_nulls_ties_and_repeats(spark):
    """A third of all rows in one conversation, over many tasks: pieces join as an undivided walk."""
    rnd = random.Random(5)
    roles = [None, "user", "assistant", "system", "user", "assistant", "tool", "", "unknown", "a"]
    rows = [
        (rnd.choice([None, 3, 3, 3, rnd.randrange(60)]), rnd.choice([None, *range(900)]), rnd.choice(roles), rnd.choice([None, "", "hi", "ok.", f"text {k}.", f"cut {k}", f"x {k % 50}. \n"]))
        for k in range(1500)
    ]
    rows += [(7, 1, "user", "again.")] * 400
    own = spark.createDataFrame([(*r, "c", 1, b"p") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, copies int, part binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark, own, 24) == plain_audit(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert result(spark, own.limit(0)) == {}


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2 if k % 97 else 0], f"turn {k}" + "." * (k % 11 > 0)) for k in range(4000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert result(spark, df) == plain_audit(rows)
