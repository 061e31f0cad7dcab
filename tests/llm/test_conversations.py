"""Repairs against a search over all edit strings, and against the same rows in other blocks."""

import hashlib
import re
from functools import cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations
from tidemark.llm.conversations import END, NOTHING, backward, forward, repair, repaired_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies bigint"
LINES = ["Yes.", "No!", "cut off", "", " \t", "Why?"]
ROLES = ["user", "assistant", "system", "tool", "u", ""]


def search(rows):
    """(cost, audit, lines): the least cost, then the ASCII-least audit, of all edit strings, by plain recursion over prefixes."""
    kinds, seen = [], set()
    for role, text in rows:
        kinds.append("blank" if not text.strip("\t\n\x0b\x0c\r ") else "duplicate" if (role, text) in seen else "truncated" if text.rstrip("\t\n\x0b\x0c\r ")[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(k, initials, inserts):
        found = []
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            found.append((0, "", ()))
        if inserts:
            for role in ("user", "assistant"):
                if prefix(initials + role[0]):
                    c, a, o = best(k, initials + role[0], inserts - 1)
                    found.append((c + 5, "I" + a, (f"{role}:", *o)))
        if k < len(rows):
            role, text = rows[k]
            c, a, o = best(k + 1, initials, 2)
            found.append((c + 2, "D" + a, o))
            if kinds[k] not in ("blank", "duplicate"):
                extra = 5 * (kinds[k] == "truncated")
                if prefix(initials + role[:1]) and role:
                    c, a, o = best(k + 1, initials + role[0], 2)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *o)))
                for other in ("user", "assistant"):
                    if prefix(initials + other[0]):
                        c, a, o = best(k + 1, initials + other[0], 2)
                        found.append((c + extra + 1, "R" + a, (f"{other}:{text}", *o)))
        return min(found, default=(10**6, "", ()))

    def prefix(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    return best(0, "", 2), kinds


def expected(rows):
    (cost, audit, lines), kinds = search(rows)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [*(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


@pytest.fixture(scope="module")
def random_rows():
    import random

    rng = random.Random(11)
    out = {}
    for conv in range(60):
        out[conv] = sorted([(rng.randrange(5), rng.choice(ROLES), rng.choice(LINES)) for _ in range(rng.randrange(1, 9))], key=lambda r: (r[0], f"{r[1]}:{r[2]}", r[1]))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_random_conversations(spark, random_rows, block_rows):
    rows = [(c, *r, 1) for c, turns in random_rows.items() for r in turns]
    got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, SCHEMA), block_rows).collect()}
    for conv, turns in random_rows.items():
        r = got[conv]
        told = [r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256]
        assert told == expected([t[1:] for t in turns]), turns
        at = {t[0] for t in turns}
        assert r.gaps == max(at) - min(at) + 1 - len(at)


def test_all_short_kinds():
    """Costs of every sequence of three kinds by the program and by the search."""
    text = {".": "Fine.", "b": "", "t": "cut"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for kinds in product([r + f for r in "suax" for f in text], repeat=3):
        rows = [(names[r], text[f] and f"{k} {text[f]}") for k, (r, f) in enumerate(kinds)]
        vector, total, _ = backward(list(kinds), END)
        walked = "".join(e for e, _ in forward(list(kinds), END, NOTHING))
        (cost, audit, _), _ = search(rows)
        assert vector[NOTHING] + total == cost and audit.startswith(walked)


def test_hot_conversation_in_blocks(spark):
    """One conversation with most rows, over many tasks: the same as in one block, and no task holds it."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("role"),
        F.concat(F.lit("line "), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)), F.when(F.col("id") % 5 == 0, "").otherwise(".")).alias("text"), F.lit(1).cast("long").alias("copies"),
    )
    cut = conversations.blocks(rows, 500)
    assert cut.agg(F.max(F.size("kinds"))).first()[0] <= 500 and cut.where("conv_id = 7").count() >= 60
    one, many = repair(rows, 1 << 30), repair(rows, 500)
    assert one.exceptAll(many).count() == 0 and many.count() == 10_001
    told = many.where("conv_id = 7").first()
    turns = repaired_turns(rows, 500).where("conv_id = 7").orderBy("block", "place").collect()
    assert "".join(t.edit for t in turns) == told.audit
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns if t.role is not None).encode()).hexdigest() == told.repaired_sha256


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, 1), (None, 3, "user", "Hi.", 1), (1, 0, "user", "Hi.", 0), (1, 1, "assistant", "Hi.", 0), (2, None, "user", "Same.", 1), (2, None, "user", "Same.", 1), (2, 5, "user", "Same.", 2),
        (2, 9, "assistant", "word " * 400_000 + "end.", 1), (3, 2, "user", "Line\n", 1), (4, 1, "", "No role.", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("clash"), "kind": F.lit(1), "line": F.lit(2)})
    got = {r.conv_id: r for r in repair(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256, got[1].gaps) == (0, "", empty, 0)
    assert (got[None].blank, got[None].audit, got[None].gaps) == (1, "DD", 0)
    assert (got[2].duplicate, got[2].audit, got[2].gaps, got[2].illegal) == (3, "KDDDK", 3, 3)
    assert (got[3].truncated, got[3].audit, got[3].repaired_sha256) == (1, "D", empty)
    assert got[4].audit == "D" and len(got) == 5
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_of_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    import zlib

    kind = zlib.crc32(b" : ") % 20
    got = conversations.damage(rows).first()
    assert got.copies == {0: 0, 3: 2}.get(kind, 1) and got.text == ("" if kind == 1 else " ") and got.role == ("user" if kind == 4 else " ")
