"""Repair of the structure of conversations by a checkpointed dynamic program.

A conversation is to read `(s?(ua)+)?` in the initials of its roles: perhaps a system
turn, then user and assistant in turn. Each row is kept (0), given the role user or
assistant (1), or deleted (2; blank rows and repeats must be); empty user and assistant
turns can be inserted anywhere (5); a truncated row that stays adds 5. Of the cheapest
repairs the one whose edits' initials D, I, K, R read ASCII-least is taken.

The program runs backwards: for each row boundary the least cost to the end from each of
four states (nothing yet, system, user, assistant came last). The vectors are kept only at
checkpoints, some square root of the rows apart; the walk forward computes the vectors of
one stretch again from its checkpoint and takes, edit by edit, the ASCII-least that is
tight, which means that it spends exactly what the two vectors differ by. Vectors less
their least entry are few, as an insertion bounds how far entries differ, so a step is
remembered by its row's kind and the vector after it.

The same is done one level up, as one conversation may hold a third of all rows. Rows are
sorted by ranges over the tasks and cut into blocks of about the square root of the
longest conversation. A conversation that lies in one block is repaired there. The blocks
of others give a 4 x 4 matrix of least costs, the matrices give the vector at each block's
end (backwards), the walks from it give the state at each block's start (forwards), and
then all blocks are repaired independently. What passes through one task for one
conversation is a row for each block; its digest, which has to read the repaired text in
order, streams through one task with one block in memory.

Defined results: null roles and texts are one space. Rows of one turn are taken in the
order of `role:text`, null turns first; equal rows stand side by side and are one entry
with a count. A null conversation id is a conversation like any other. A conversation
without rows (all dropped) gives zeros and empty texts. A role's initial is its first
character, whatever follows. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, materialize

#: Least rows of a block, most bytes of its texts, and characters of `role:text` that ranges are cut by.
BLOCK_ROWS, BLOCK_BYTES, RANGE_CHARS = 4096, 8 << 20, 100
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Fixed value: white space that makes no content.
SPACE = "\t\n\x0b\x0c\r "

STATES = NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, and the one that an insertion leads to.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
INSERTED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
Vector = tuple[int, ...]


def _with_insertions(costs: list[int]) -> Vector:
    for _ in STATES:
        for q in STATES:
            costs[q] = min(costs[q], costs[INSERTED[q]] + INSERT)
    return tuple(min(c, NEVER) for c in costs)


#: Costs of ending after each state.
END = _with_insertions([0, NEVER, NEVER, 0])


def _lowered(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else c for c in costs), least


@lru_cache(maxsize=65_536)
def step(kind: str, after: Vector) -> tuple[Vector, int, tuple[tuple[str, int] | None, ...]]:
    """One row: the vector before it (less its least entry), that entry, and for each state the tight edits up to and with this row and the state they lead to.

    A kind is a role's initial (s, u, a or x) and a fault: `.` none, b blank, d duplicate, t truncated.
    """
    role, fault = kind
    stays = fault not in "bd"
    extra = TRUNCATED if fault == "t" else 0
    before = []
    for q in STATES:
        ways = [after[q] + DELETE]
        if stays:
            ways += [after[r] + extra + (0 if letter == role else REROLE) for letter, r in AFTER[q].items() if letter == role or letter != "s"]
        before.append(min(ways))
    before = _with_insertions(before)

    def tight(q: int) -> tuple[str, int] | None:
        edits = ""
        while before[q] < NEVER:
            if after[q] + DELETE == before[q]:
                return edits + "D", q
            if before[INSERTED[q]] + INSERT == before[q]:
                edits, q = edits + "I", INSERTED[q]
                continue
            if stays and role in AFTER[q] and after[AFTER[q][role]] + extra == before[q]:
                return edits + "K", AFTER[q][role]
            return edits + "R", next(r for letter, r in AFTER[q].items() if letter != "s" and after[r] + extra + REROLE == before[q])
        return None

    lowered, least = _lowered(before)
    return lowered, least, tuple(tight(q) for q in STATES)


def backward(kinds: list[str], end: Vector, every: int = 0) -> tuple[Vector, int, list[Vector]]:
    """The vector before the first row, what it was lowered by, and the vectors after each `every` rows."""
    now, total, kept = end, 0, []
    for k in range(len(kinds) - 1, -1, -1):
        if every and (k + 1) % every == 0:
            kept.append(now)
        now, least, _ = step(kinds[k], now)
        total += least
    return now, total, kept[::-1]


def forward(kinds: list[str], end: Vector, state: int) -> Iterator[tuple[str, int]]:
    """The tight edits of each row and the state after it, with vectors kept at checkpoints only."""
    every = max(1, math.isqrt(len(kinds)))
    _, _, kept = backward(kinds, end, every)
    for low in range(0, len(kinds), every):
        stretch = kinds[low : low + every]
        vectors = [kept[low // every] if low // every < len(kept) else end]
        for kind in reversed(stretch[1:]):
            vectors.append(step(kind, vectors[-1])[0])
        for kind in stretch:
            edits, state = step(kind, vectors.pop())[2][state]
            yield edits, state


@lru_cache(maxsize=64)
def ending(state: int) -> tuple[str, ...]:
    """The roles that are inserted after the last row."""
    out = []
    while END[state]:
        state = INSERTED[state]
        out.append(NAMES[state])
    return tuple(out)


def mended(block: dict, end: Vector, state: int, last: bool) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) for each edit of a block in order; a deletion has no role and no text."""
    for (edits, after), role, text, copies in zip(forward(block["kinds"], end, state), block["roles"], block["texts"], block["copies"]):
        for edit in edits[:-1]:
            state = INSERTED[state]
            yield edit, NAMES[state], ""
        yield (edits[-1], None, None) if edits[-1] == "D" else (edits[-1], role if edits[-1] == "K" else NAMES[after], text)
        state = after
        for _ in range(copies - 1):  # repeats of the row: deleting them is tight in every state
            yield "D", None, None
    if last:
        for role in ending(state):
            yield "I", role, ""


def damage(conversations: DataFrame, folds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with faults by a hash of `conv_id:turn`; a dropped row has 0 copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % folds
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _entries(rows: DataFrame) -> DataFrame:
    """Equal rows as one entry (conv_id, turn, role, text, copies, kind); an entry without copies only says that there is such a conversation.

    Where a role and text come first is an aggregate, put to the rows by another one: no join and no window on a key that many rows may have.
    """
    given = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    here = given.where("copies > 0")
    content = F.rtrim("text", F.lit(SPACE))
    first = here.where(content != "").groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn")))["turn"].alias("turn"))
    none = F.lit(None)
    gone = given.where("copies <= 0").groupBy("conv_id").agg(F.lit(0).cast("long").alias("copies"))
    gone = gone.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "copies", F.lit(False).alias("first"))
    marked = here.withColumn("first", F.lit(False)).unionByName(first.withColumns({"copies": F.lit(0).cast("long"), "first": F.lit(True)})).unionByName(gone)
    summed = marked.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(content == "", "b").when(~F.col("first"), "d").when(~F.right(content, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".")
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    return summed.select("conv_id", "turn", "role", "text", "copies", F.when(F.col("copies") > 0, kind).alias("kind"))


_BLOCK = (
    "conv_id long, block long, open boolean, kinds array<string>, copies array<long>, roles array<string>, texts array<string>, "
    "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _cut(block_rows: int):
    """Blocks from sorted entries: a conversation, or a part of one (`open`) if it is long or goes beyond the task's rows."""

    def new(conv, number: int) -> dict:
        lists = {c: [] for c in ("kinds", "copies", "roles", "texts")}
        return {"conv_id": conv, "block": number, "low": None, "high": None, "turns": 0, **dict.fromkeys(_COUNTS, 0)} | lists

    def add(b: dict, turn, role, text, copies: int, kind: str | None) -> int:
        if not copies:
            return 0
        if b["kinds"] and b["kinds"][-1][0] + kind[0] not in LEGAL:
            b["illegal"] += 1
        b["illegal"] += copies - 1
        if kind[1] == "b":
            b["blank"] += copies
        else:
            b["duplicate"] += copies - (kind[1] != "d")
            b["truncated"] += kind[1] == "t"
        if turn is not None and turn != b["high"]:
            b["low"] = turn if b["low"] is None else b["low"]
            b["high"], b["turns"] = turn, b["turns"] + 1
        for c, v in (("kinds", kind), ("copies", copies), ("roles", role), ("texts", text)):
            b[c].append(v)
        return len(role) + len(text)

    arrow = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, more = TaskContext.get().partitionId() << 33, None, 0, True  # more: the block may go on what an earlier one began
        done: list[dict] = []
        waiting = 0  # bytes of the blocks in `done`
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "kind"))):
                full = held is not None and (len(held["kinds"]) >= block_rows or size >= BLOCK_BYTES)
                if held is None or full or conv != held["conv_id"]:
                    if held is not None:
                        goes_on = conv == held["conv_id"]
                        done.append(held | {"open": more or goes_on})
                        more, number = goes_on, number + 1
                    held, waiting, size = new(conv, number), waiting + size, 0
                size += add(held, *row)
                if len(done) >= 1000 or waiting >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done, waiting = [], 0
        if held is not None:
            yield pa.RecordBatch.from_pylist([*done, held | {"open": True}], arrow)

    return run


def blocks(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The rows of all conversations, sorted and cut into blocks, as a table in the shared folder."""
    entries = materialize(_entries(rows))
    if block_rows is None:
        longest = entries.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        block_rows = max(BLOCK_ROWS, math.isqrt(longest))
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.concat("role", F.lit(":"), "text")
    start = F.left(F.concat(F.left("role", F.lit(RANGE_CHARS)), F.lit(":"), F.left("text", F.lit(RANGE_CHARS))), F.lit(RANGE_CHARS))
    dealt = entries.repartitionByRange(n, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), start)
    order = dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), line, "role")
    return materialize(order.mapInArrow(_cut(block_rows), _BLOCK))


def _scan(df: DataFrame, order: list, begin, go, schema: str) -> DataFrame:
    """Walk the few rows of each conversation's blocks in order with a state: `go(state, row)` gives the new state and a row."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = (), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv != (row["conv_id"],):
                    conv, state = (row["conv_id"],), begin()
                state, told = go(state, row)
                out.append(told)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = [_with_insertions([0 if q == r else NEVER for q in STATES]) for r in STATES]
    for batch in batches:
        told = []
        for kinds in batch.column("kinds").to_pylist():
            columns = [backward(kinds, unit) for unit in units]
            told.append([v[q] + total if v[q] < NEVER else NEVER for q in STATES for v, total, _ in columns])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(told, pa.list_(pa.int64()))], ["conv_id", "block", "matrix"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a block for each state before it."""
    for batch in batches:
        told = []
        for kinds, end in zip(batch.column("kinds").to_pylist(), batch.column("end").to_pylist()):
            now, _, _ = backward(kinds, tuple(end))
            walked = []
            for q in STATES:
                state = q
                if now[q] < NEVER:
                    for _, state in forward(kinds, tuple(end), q):
                        pass
                walked.append(state)
            told.append(walked)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "block", "end", "last")), pa.array(told, pa.list_(pa.int64()))], ["conv_id", "block", "end", "last", "exits"])


def _chained(open_blocks: DataFrame) -> DataFrame:
    """(block, end, last, state): the vector after each open block, whether it is its conversation's last, and the state before it."""
    matrices = open_blocks.select("conv_id", "block", "kinds").mapInArrow(_matrices, "conv_id long, block long, matrix array<long>")

    def back(state: tuple[Vector, bool], row: dict) -> tuple[tuple[Vector, bool], dict]:
        end, last = state
        m = row["matrix"]
        costs = tuple(min(min(m[4 * q + r] + end[r] for r in STATES), NEVER) for q in STATES)
        return (_lowered(costs)[0], False), {"block": row["block"], "end": list(end), "last": last}

    ends = materialize(_scan(matrices, [F.desc("block")], lambda: (END, True), back, "block long, end array<long>, last boolean"))
    exits = open_blocks.select("conv_id", "block", "kinds").join(ends, "block").mapInArrow(_exits, "conv_id long, block long, end array<long>, last boolean, exits array<long>")
    on = lambda state, row: (row["exits"][state], {"block": row["block"], "end": row["end"], "last": row["last"], "state": state})
    return materialize(_scan(exits, [F.asc("block")], lambda: NOTHING, on, "block long, end array<long>, last boolean, state int"))


def _placed(cut: DataFrame) -> DataFrame:
    """Blocks with the vector after them and the state before them."""
    whole = cut.where(~F.col("open")).withColumns({"end": F.array(*map(F.lit, END)).cast("array<long>"), "last": F.lit(True), "state": F.lit(NOTHING)})
    opened = cut.where("open")
    return whole.unionByName(opened.join(_chained(opened), "block"))


def repaired_turns(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(conv_id, block, place, edit, role, text): every edit in order of (block, place); deletions have a null role and text."""
    schema = "conv_id long, block long, place long, edit string, role string, text string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                out = [
                    {"conv_id": b["conv_id"], "block": b["block"], "place": k, "edit": e, "role": r, "text": t}
                    for k, (e, r, t) in enumerate(mended(b, tuple(b["end"]), b["state"], b["last"]))
                ]
                yield pa.RecordBatch.from_pylist(out, arrow)

    return _placed(blocks(rows, block_rows)).mapInArrow(run, schema)


_PART = "conv_id long, block long, open boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, final string, cost long, audit string, lines string"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block adds to its conversation's report."""
    arrow = arrow_schema(_PART)
    for batch in batches:
        for b in batch.to_pylist():
            audit, lines, cost = [], [], 0
            for edit, role, text in mended(b, tuple(b["end"]), b["state"], b["last"]):
                audit.append(edit)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if role is not None:
                    lines.append(f"{role}:{text}")
            kept = (e for e, _ in forward(b["kinds"], tuple(b["end"]), b["state"]))
            cost += sum(TRUNCATED for edits, kind in zip(kept, b["kinds"]) if kind[1] == "t" and edits[-1] != "D")
            ends = {"first": b["kinds"][0][0], "final": b["kinds"][-1][0]} if b["kinds"] else {"first": None, "final": None}
            told = {c: b[c] for c in ("conv_id", "block", "open", "low", "high", "turns", *_COUNTS)} | ends
            yield pa.RecordBatch.from_pylist([told | {"cost": cost, "audit": "".join(audit), "lines": "\n".join(lines)}], arrow)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report for each conversation from its parts in order."""
    arrow = arrow_schema(_REPORT)
    conv, now, sha, audit = (), None, None, []

    def told() -> dict:
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return {c: now[c] for c in ("conv_id", "cost", *_COUNTS)} | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    for batch in batches:
        out = []
        for part in batch.to_pylist():
            if conv != (part["conv_id"],):
                if now is not None:
                    out.append(told())
                conv, sha, audit, written = (part["conv_id"],), hashlib.sha256(), [], False
                now = part
            else:
                if now["final"] and part["first"] and now["final"] + part["first"] not in LEGAL:
                    now["illegal"] += 1
                for c in ("cost", *_COUNTS):
                    now[c] += part[c]
                now["turns"] += part["turns"] - (part["low"] is not None and part["low"] == now["high"])
                now["low"] = part["low"] if now["low"] is None else now["low"]
                now["high"] = part["high"] if part["high"] is not None else now["high"]
                now["final"] = part["final"] or now["final"]
            audit.append(part["audit"])
            if part["lines"]:
                sha.update(("\n" * written + part["lines"]).encode())
                written = True
        yield pa.RecordBatch.from_pylist(out, arrow)
    if now is not None:
        yield pa.RecordBatch.from_pylist([told()], arrow)


def repair(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, copies): its faults, the cost and the edits of the cheapest repair, and the digest of the repaired `role:text` lines."""
    parts = materialize(_placed(blocks(rows, block_rows)).mapInArrow(_parts, _PART))
    whole = parts.where(~F.col("open")).mapInArrow(_gathered, _REPORT)
    opened = parts.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_gathered, _REPORT)
    return whole.unionByName(opened)
