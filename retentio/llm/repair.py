"""Conversation structure repair: cheapest edits found by iterative-deepening A*.

A well-formed conversation is empty or has the roles ``(s?(ua)+)?`` by their
initials (system, user, assistant). Each row's first fault counts: blank (no
character but ASCII white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is none of
``.!?``). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert
of an empty user or assistant turn 3; a truncated row that stays adds 3; blank
and duplicate rows must be deleted.

The search goes depth first through the edits in ASCII order (D, I, K, R)
under a cost bound; the bound rises to the least cost that exceeded it. A
table keeps, per state (rows read, last role), the cost that is known not to
suffice from there, so a failed state is not searched again within that cost.
The heuristic is the exact cost of a wider grammar in which a system row may
stand before any user turn. The first path that ends well under a bound is the
cheapest, and among those the ASCII-least; it also fixes the roles of inserted
and reroled turns.

On the cluster, a conversation first travels as narrow rows (turn, initial,
fault, digest of role and text): a task streams through its sorted rows and
keeps a few bytes a row of one conversation. The chosen edits then meet the
texts in a second sorted stream, which holds one batch. One conversation is one
path and is searched by one task, in memory of its row count, not its texts.

Defined results: conversations are told apart by conv_id, null being one of
them; rows stand by turn, nulls first, rows of one turn by the digest of role
and text; null role or text counts as one space; a role without an initial of
s, u or a can't be kept; equal rows are duplicates of the first; a text of any
length is handled whole; columns beside the four are ignored, so they cannot
clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3
#: state after a row of this initial, by the state before
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the role that an inserted or reroled turn gets, and the state after it
_NEW = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_GOOD = {"su", "ua", "au"}
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
WHITE = " \t\n\x0b\x0c\r"


def bounds(rows: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Least cost of what is left from each row on, where a user turn (or else an assistant turn) comes next."""
    out = [(0, COST[INSERT])]
    for initial, fault in reversed(rows):
        user, assistant = out[-1]
        a, b = COST[DELETE] + user, COST[DELETE] + assistant
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            kept_a = {"s": user, "u": assistant}.get(initial, inf)
            kept_b = user if initial == "a" else inf
            a = min(a, more + kept_a, more + COST[REROLE] + assistant)
            b = min(b, more + kept_b, more + COST[REROLE] + user)
        out.append((min(a, b + COST[INSERT]), min(b, a + COST[INSERT])))
    return out[::-1]


def _edits(rows: list[tuple[str, str]], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows read, state) in ASCII order."""
    if at < len(rows):
        yield DELETE, COST[DELETE], at + 1, state
    yield INSERT, COST[INSERT], at, _NEW[state][1]
    if at < len(rows):
        initial, fault = rows[at]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            if (after := _NEXT.get((state, initial))) is not None:
                yield KEEP, COST[KEEP] + more, at + 1, after
            yield REROLE, COST[REROLE] + more, at + 1, _NEW[state][1]


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and edits of the best repair of (initial, fault) rows."""
    least = bounds(rows)
    known: dict[tuple[int, int], float] = {}  # states and the cost that they need at least, where a search failed

    def need(at: int, state: int) -> float:
        return known.get((at, state), least[at][state == USER])

    bound = need(0, START)
    if not rows:
        return 0, ""
    while True:
        # a frame: rows read, state, cost so far, edits left to try, least cost from here that exceeds the bound
        frames = [[0, START, 0, _edits(rows, 0, START), inf]]
        path: list[str] = []
        while frames:
            frame = frames[-1]
            step = next(frame[3], None)
            if step is None:
                frames.pop()
                known[frame[0], frame[1]] = max(need(frame[0], frame[1]), frame[4])
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], frame[2] - frames[-1][2] + frame[4])
                else:
                    bound = frame[4]
                continue
            edit, cost, at, state = step
            spent = frame[2] + cost
            if spent + need(at, state) > bound:
                frame[4] = min(frame[4], cost + need(at, state))
                continue
            path.append(edit)
            if at == len(rows) and state in (START, ASSISTANT):
                return spent, "".join(path)
            frames.append([at, state, spent, _edits(rows, at, state), inf])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20, nulls read as one space; ``gone`` marks the dropped ones."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (conversations.withColumn("_code", code)
            .select("conv_id", "turn", (F.col("_code") == 0).alias("gone"),
                    F.when(F.col("_code") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                    F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                    F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))


def _told(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), gone.alias("gone"), role.alias("role"), text.alias("text"),
                                F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"))


def _fault(text: Column) -> Column:
    """The fault that a row shows by itself."""
    body = F.translate(text, WHITE, "")
    return F.when(body == "", "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows of one conv_id (their first field), read on while they are consumed."""
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)

        mine = run()
        yield conv, mine
        for _ in mine:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(v) for v in row if isinstance(v, str))
        if len(out) >= limit or held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _judged(conv: object, run: Iterator[tuple]) -> tuple:
    """conv_id, counts, cost and audit of the narrow rows (conv_id, gone, turn, initial, fault, digest) of a conversation."""
    rows: list[tuple[str, str]] = []
    seen: set[bytes] = set()
    turns, first, last = 0, None, None
    for _, gone, turn, initial, fault, digest in run:
        if gone:
            continue
        if turn is not None and turn != last:
            turns, first, last = turns + 1, turn if first is None else first, turn
        key = bytes.fromhex(digest)
        if fault != "blank" and key in seen:
            fault = "duplicate"
        seen.add(key)
        rows.append((initial, fault))
    faults = [f for _, f in rows]
    illegal = sum(a[0] + b[0] not in _GOOD for a, b in zip(rows, rows[1:]))
    gaps = last - first + 1 - turns if turns else 0
    return conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(rows)


def plans(told: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = told.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, {COUNTS}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_judged(conv, rows) for conv, rows in _groups(_rows(batches))), arrow)

    narrow = told.select("conv_id", "gone", "turn", F.substring("role", 1, 1).alias("initial"), _fault(F.col("text")).alias("fault"), "digest")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest").mapInArrow(run, schema)


def edited(header: tuple, run: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, in order: the audit applied to the conversation's rows."""
    state = START
    for edit in header[-1]:
        if edit == INSERT:
            role, state = _NEW[state]
            yield edit, role, ""
            continue
        role, text = next(run)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = _NEXT[state, role[0]]
        else:
            role, state = _NEW[state]
        yield edit, role, text


def _applied(told: DataFrame, schema: str, emit: Callable) -> DataFrame:
    """``emit(conv_id, header, repaired turns)`` rows of every conversation; header: the fields of ``plans``."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    plan = plans(told)
    names = plan.columns[1:]
    empty = [F.lit(None).cast(plan.schema[n].dataType).alias(n) for n in names]
    none = F.lit(None).cast("string")
    heads = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("digest"), none.alias("role"), none.alias("text"), *names)
    rows = told.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", *empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for conv, mine in _groups(_rows(batches)):
                header = next(mine)[6:]
                yield from emit(conv, header, edited(header, ((r[4], r[5]) for r in mine)))

        yield from _batches(results(), arrow)

    return (heads.unionByName(rows).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").mapInArrow(run, out))


def repaired(conversations: DataFrame) -> DataFrame:
    """The turns of all repaired conversations: conv_id, place (from 0), edit (I, K or R), role, text."""
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _applied(_told(conversations), f"conv_id {kind}, place long, edit string, role string, text string",
                    lambda conv, _, turns: ((conv, k, *t) for k, t in enumerate(turns)))


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, fault counts, cost, audit and repaired_sha256 of its repaired turns."""
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def emit(conv, header, turns):
        digest = hashlib.sha256()
        for k, (_, role, text) in enumerate(turns):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        yield conv, *header, digest.hexdigest()

    return _applied(_told(conversations), f"conv_id {kind}, {COUNTS}, repaired_sha256 string", emit)
