"""Repair of conversations by Hirschberg's divide and conquer over a four-state automaton.

A repaired conversation's roles begin, in order of turns, with ``(s?(ua)+)?``. Keeping a row costs
nothing, another role (user, assistant) 1, deleting 2, inserting an empty row of these roles 5, and
a truncated row that stays 5 more. Blank rows and repeated ones must go. Of the cheapest repairs the
one whose edits (D, I, K, R in order) come first in ASCII is taken.

The automaton's states are: nothing yet, after the system row, after user, after assistant. Costs
from the front and costs to the end meet in the middle of a conversation, the state with the least
sum is crossed there, and both halves are solved alike; only vectors of four numbers are kept. The
vector from the front also holds the order of the states' best edits: at equal sums that order
decides, since edits up to a row in different states differ before either ends. Rows that must go
are no choice: they are deleted before anything is inserted.

Rows are sorted by conversation and turn over range partitions, so a conversation of any size is
spread over tasks. All but the first and last of a task are whole and solved there. Pieces of
the others are summed up as 4 x 4 tables of cost and order, the pieces of a conversation meet in the
same way (at most one row a task), and each piece is solved between its two states. Only the
digest of a conversation cut in pieces is made in one task, which streams the pieces in order.

Rows are ordered by turn (nulls first), ties by role and text; equal rows are counted before the
shuffle. Null roles and texts count as one blank. A role's initial is its first character; an empty
role has none and must be changed. Null ids are one conversation. Without rows there is no result.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planledger.llm.common import ROUND_BYTES, sized, written

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row that comes to have this role.
_USER, _ASSISTANT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}
_FILLED = {**_USER, **_ASSISTANT}
_KEPT = ({NOTHING: SYSTEM}, _USER, _ASSISTANT, {})
_INITIALS = b"sua"
_BLANKS = b" \t\n\v\f\r"
#: Code of a row that must go; codes below are the initial's number, and 4 more if truncated.
FORCED = 8
CACHED_ROWS = 24

Moves = list[tuple[int, int, int, object]]


def _moves(edits: Callable[[int], list[tuple[str, int, int]]]) -> Moves:
    """(from, to, cost, edits): the best way of each pair of states, after up to two insertions."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, before, cost = start, "", 0
        for _ in range(3):
            for edit, to, own in edits(state):
                way = (cost + own, before + edit)
                best[start, to] = min(best.get((start, to), way), way)
            state, before, cost = _FILLED[state], before + "I", cost + INSERT
    return [(s, t, cost, way) for (s, t), (cost, way) in sorted(best.items())]


def _row_edits(code: int) -> Callable[[int], list[tuple[str, int, int]]]:
    kept, stays = _KEPT[code % 4], TRUNCATED * (code // 4)

    def edits(state: int) -> list[tuple[str, int, int]]:
        found = [("D", state, DELETE), ("R", _FILLED[state], REROLE + stays)]
        return found + ([("K", kept[state], stays)] if state in kept else [])

    return edits


ROW_MOVES = [_moves(_row_edits(code)) for code in range(FORCED)]
END_MOVES = _moves(lambda state: [("", state, 0)] if state in (NOTHING, ASSISTANT) else [])


def front(items: Sequence[Moves], start: int) -> dict[int, tuple[int, int]]:
    """By state after the items: least cost from ``start``, and the place of its edits among the states'."""
    now = {start: (0, 0)}
    for moves in items:
        found: dict[int, tuple] = {}
        for s, t, cost, way in moves:
            if s in now:
                reached = (now[s][0] + cost, now[s][1], way)
                if t not in found or reached < found[t]:
                    found[t] = reached
        order = sorted(found, key=lambda t: found[t][1:])
        now = {t: (found[t][0], place) for place, t in enumerate(order)}
    return now


def back(items: Sequence[Moves], end: int) -> dict[int, int]:
    """By state before the items: least cost to ``end``."""
    now = {end: 0}
    for moves in reversed(items):
        found: dict[int, int] = {}
        for s, t, cost, _ in moves:
            if t in now:
                found[s] = min(found.get(s, cost + now[t]), cost + now[t])
        now = found
    return now


def crossings(items: Sequence[Moves], start: int, end: int) -> list[int]:
    """The states between the items on the best way from ``start`` to ``end``."""
    if len(items) < 2:
        return []
    middle = len(items) // 2
    ahead, behind = front(items[:middle], start), back(items[middle:], end)
    state = min((s for s in ahead if s in behind), key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
    return [*crossings(items[:middle], start, state), state, *crossings(items[middle:], state, end)]


def _ways(items: Sequence[Moves], start: int, end: int) -> list:
    states = [start, *crossings(items, start, end), end]
    return [next(way for s, t, _, way in moves if (s, t) == pair) for moves, pair in zip(items, zip(states, states[1:]), strict=False)]


def _items(codes: bytes) -> list[Moves]:
    return [ROW_MOVES[c] for c in codes if c != FORCED]


def piece_edits(codes: bytes, start: int, end: int) -> str:
    """The edits of a piece between two states."""
    ways = iter(_ways(_items(codes), start, end))
    return "".join("D" if c == FORCED else next(ways) for c in codes)


def whole_edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a conversation."""
    items = [*_items(codes), END_MOVES]
    reached = front(items, NOTHING)
    end = min(reached, key=reached.get)
    ways = iter(_ways(items, NOTHING, end))
    return reached[end][0] + DELETE * codes.count(FORCED), "".join(["D" if c == FORCED else next(ways) for c in codes] + [next(ways)])


_often = lru_cache(1 << 14)(whole_edits)


class Repaired:
    """The digest of repaired rows, fed piece by piece."""

    def __init__(self) -> None:
        self.hash, self.state, self.any = hashlib.sha256(), NOTHING, False

    def add(self, role: bytes, text: bytes) -> None:
        self.hash.update(b"\n" * self.any + role + b":" + text)
        self.any = True

    def apply(self, edits: str, rows: Iterator[tuple[int, bytes, bytes]]) -> None:
        """``rows`` yields code, role and text of each row that ``edits`` names; forced ones need no text."""
        for edit in edits:
            code, role, text = (FORCED, b"", b"") if edit == "I" else next(rows)
            if edit in "IR":
                self.state = _FILLED[self.state]
                self.add(b"user" if self.state == USER else b"assistant", text)
            elif edit == "K":
                self.state = _KEPT[code % 4][self.state]
                self.add(role, text)


def _code(role: bytes, text: bytes, repeated: bool) -> tuple[int, str]:
    """A row's code and its first fault."""
    seen = text.rstrip(_BLANKS)
    if not seen or repeated:
        return FORCED, "duplicate" if seen else "blank"
    kind = _INITIALS.find(role[:1]) if role else 3
    truncated = seen[-1:] not in (b".", b"!", b"?")
    return (kind if kind >= 0 else 3) + 4 * truncated, "truncated" if truncated else ""


def _lawful(before: bytes, after: bytes) -> bool:
    return before[:1] + after[:1] in (b"su", b"ua", b"au")


FAULTS = ("blank", "duplicate", "truncated")


def _segment(rows: list[tuple]) -> dict:
    """Counts of one conversation's rows (turn, role, text, copies, repeated), their codes, and the rows that may stay."""
    codes, kept, faults = bytearray(), [], dict.fromkeys(FAULTS, 0)
    illegal, last = 0, None
    for _, role, text, copies, repeated in rows:
        code, fault = _code(role, text, repeated)
        codes.append(code)
        if fault:
            faults[fault] += 1
        if code != FORCED:
            kept.append((code, role, text))
        if copies > 1:
            again = "blank" if fault == "blank" else "duplicate"
            codes += bytes([FORCED]) * (copies - 1)
            faults[again] += copies - 1
            illegal += (copies - 1) * (not _lawful(role, role))
        if last is not None:
            illegal += not _lawful(last, role)
        last = role
    turns = [r[0] for r in rows if r[0] is not None]
    distinct = sum(1 for _ in groupby(turns))
    return {"codes": bytes(codes), "kept": kept, "illegal": illegal, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": distinct, "opening": rows[0][1][:1], "closing": last[:1], **faults}


def _result(conv: object, found: dict, cost: int, audit: str, digest: str) -> dict:
    gaps = found["high"] - found["low"] + 1 - found["turns"] if found["turns"] else 0
    return {"conv": conv, "gaps": gaps, **{k: found[k] for k in FAULTS}, "illegal": found["illegal"], "cost": cost, "audit": audit, "repaired_sha256": digest}


def _whole(conv: object, found: dict) -> dict:
    codes = found["codes"]
    cost, audit = _often(codes) if len(codes) <= CACHED_ROWS else whole_edits(codes)
    text = Repaired()
    kept = iter(found["kept"])
    text.apply(audit, (next(kept) if c != FORCED else (c, b"", b"") for c in codes))
    return _result(conv, found, cost, audit, text.hash.hexdigest())


LONG, STR, BIN = T.LongType(), T.StringType(), T.BinaryType()
_RESULT = [("gaps", LONG), *((k, LONG) for k in FAULTS), ("illegal", LONG), ("cost", LONG), ("audit", STR), ("repaired_sha256", STR)]
_PIECE = [("part", LONG), ("piece", LONG), ("low", LONG), ("high", LONG), ("turns", LONG), ("opening", BIN), ("closing", BIN), ("table", T.ArrayType(LONG)), ("codes", BIN), ("roles", T.ArrayType(BIN)), ("texts", T.ArrayType(BIN))]


def _schema(conv: T.DataType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *(T.StructField(n, t) for n, t in fields)])


def _pieces(conv: object, part: int, found: dict) -> Iterator[dict]:
    """A conversation that may go on in another task: its sums first, then the rows that may stay."""
    items = _items(found["codes"])
    table = []
    for s in range(4):
        reached = front(items, s)
        table += [x for t in range(4) for x in reached.get(t, (-1, -1))]
    head = {k: found[k] for k in ("illegal", "low", "high", "turns", "opening", "closing", "codes", *FAULTS)}
    yield {"conv": conv, "part": part, "piece": 0, "table": table, **head}
    size, roles, texts, number = 0, [], [], 1
    for _, role, text in [*found["kept"], (0, None, b"")]:
        if roles and (role is None or size > ROUND_BYTES):
            yield {"conv": conv, "part": part, "piece": number, "roles": roles, "texts": texts}
            size, roles, texts, number = 0, [], [], number + 1
        if role is not None:
            roles.append(role)
            texts.append(text)
            size += len(role) + len(text)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some hundred rows or about a megabyte."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "") + len(row.get("codes") or b"")
        if len(held) >= 500 or size > ROUND_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _lines(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _table_moves(table: list[int]) -> Moves:
    return [(s, t, table[8 * s + 2 * t], table[8 * s + 2 * t + 1]) for s in range(4) for t in range(4) if table[8 * s + 2 * t] >= 0]


def _meet(conv: object, parts: list[dict]) -> Iterator[dict]:
    """What each piece begins and ends with, and the sums of the conversation."""
    items = [*(_table_moves(p["table"]) for p in parts), END_MOVES]
    reached = front(items, NOTHING)
    end = min(reached, key=reached.get)
    states = [NOTHING, *crossings(items, NOTHING, end), end]
    ending = next(way for s, t, _, way in END_MOVES if (s, t) == (states[-2], end))
    total = {k: sum(p[k] for p in parts) for k in (*FAULTS, "illegal", "turns")}
    total["illegal"] += sum(not _lawful(a["closing"], b["opening"]) for a, b in zip(parts, parts[1:], strict=False))
    timed = [p for p in parts if p["turns"]]
    total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    total |= {"low": timed[0]["low"] if timed else None, "high": timed[-1]["high"] if timed else None}
    cost = reached[end][0] + DELETE * (total["blank"] + total["duplicate"])
    sums = _result(conv, total, cost, "", "")
    for k, p in enumerate(parts):
        yield sums | {"part": p["part"], "entry": states[k], "exit": states[k + 1], "ending": ending if k == len(parts) - 1 else ""}


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: str | None = None) -> DataFrame:
    """Per conversation: gaps, fault counts, cost, ``audit`` (the edits) and the repaired rows' SHA-256.

    ``copies`` names a column that says how often a row stands there. Beyond ``gaps`` the columns
    are ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.
    """
    blank = F.lit(" ")
    own = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, blank).cast("binary").alias("role"),
        F.coalesce(text_col, blank).cast("binary").alias("text"), (F.col(copies) if copies else F.lit(1)).cast("bigint").alias("copies"),
    )
    counted = own.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", F.unhex(F.sha2("text", 256)))
    # A message's first place: combined per task, and joined back by its digest, where a crowded key can be split.
    first = counted.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    placed = counted.join(first, same).select("conv", "turn", "role", "text", "copies", (~F.struct("turn").eqNullSafe(F.col("first"))).alias("repeated"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text"]
    ranged = sized(placed.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id().cast("bigint"))
    conv = ranged.schema["conv"].dataType
    solved = _schema(conv, [("edge", T.BooleanType()), *_RESULT, *_PIECE])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            lines = _lines(batches, ["conv", "part", "turn", "role", "text", "copies", "repeated"])
            held = None
            for place, (conv, run) in enumerate(groupby(lines, key=lambda r: r[0])):
                if held:
                    yield from out(*held)
                run = list(run)
                held = (conv, run[0][1], [r[2:] for r in run], place == 0)
            if held:
                yield from out(*held[:3], True)

        def out(conv: object, part: int, rows: list[tuple], edge: bool) -> Iterator[dict]:
            segment = _segment(rows)
            for row in _pieces(conv, part, segment) if edge else [_whole(conv, segment)]:
                yield row | {"edge": edge}

        yield from _batches(found(), _arrow(solved))

    segments = written(ranged.mapInArrow(solve, solved), "turns")
    names = ["conv", *(n for n, _ in _RESULT)]
    edges = segments.filter("edge")
    sums = [*FAULTS, "illegal", "low", "high", "turns", "opening", "closing", "table"]
    heads = edges.filter("piece = 0").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *sums))).alias("parts"))
    met = _schema(conv, [*_RESULT, ("part", LONG), ("entry", LONG), ("exit", LONG), ("ending", STR)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for conv, parts in _lines(batches, ["conv", "parts"]) for row in _meet(conv, parts)), _arrow(met))

    between = heads.mapInArrow(meet, met).drop("audit", "repaired_sha256").withColumnRenamed("conv", "c").withColumnRenamed("part", "p")
    pieces = edges.select("conv", "part", "piece", "codes", "roles", "texts")
    joined = pieces.join(between, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    streamed = joined.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    final = _schema(conv, _RESULT)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["conv", "part", "codes", "roles", "texts", "entry", "exit", "ending", *(n for n, _ in _RESULT[:-2])]

        def kept(rows: Iterator[tuple]) -> Iterator[tuple[bytes, bytes]]:
            for row in rows:
                yield from zip(row[3], row[4], strict=True)

        def found() -> Iterator[dict]:
            for conv, run in groupby(_lines(batches, columns), key=lambda r: r[0]):
                text, audit = Repaired(), []
                for _, piece in groupby(run, key=lambda r: r[1]):
                    head = next(piece)
                    edits = piece_edits(head[2], head[5], head[6])
                    said = kept(piece)
                    text.apply(edits, ((c, *next(said)) if c != FORCED else (c, b"", b"") for c in head[2]))
                    text.apply(head[7], iter(()))
                    audit += [edits, head[7]]
                yield {"conv": conv, **dict(zip(columns[8:], head[8:], strict=True)), "audit": "".join(audit), "repaired_sha256": text.hash.hexdigest()}

        yield from _batches(found(), _arrow(final))

    return segments.filter("not edge").select(*names).unionByName(streamed.mapInArrow(stream, final)).withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with faults by crc32 of id and turn: dropped, emptied, cut, doubled and misattributed rows, with ``copies``."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    fault = F.crc32(place.cast("binary")) % 20
    text = F.coalesce(text_col, blank)
    return (
        rows.select(conv_col, turn_col, F.coalesce(role_col, blank).alias("role"), text.alias("text"), fault.alias("fault"))
        .filter("fault <> 0")
        .select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
        )
    )


def audit(rows: DataFrame) -> DataFrame:
    """The repair of damaged conversations, one row per id of ``rows``; what lost all its rows has zeros."""
    found = repair(damaged(rows), copies="copies").withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n, kind in _RESULT if kind is LONG]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)
