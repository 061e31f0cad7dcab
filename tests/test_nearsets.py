"""Classes of near copies by Jaccard similarity, against all pairs."""

import random

import pytest

from tidemark.operators import nearsets


def plain_classes(texts, threshold=0.8, words=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    root = list(range(len(sets)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def texts():
    """Chains of scattered edits, loose copies of one text, copies in another case, short, repeating, wordless and null texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(8):
        now = [word() for _ in range(200)]
        for _ in range(5):
            out.append(" ".join(now))
            now = list(now)
            for k in rng.sample(range(200), 3):
                now[k] = word()
    base = [word() for _ in range(200)]
    for k in range(40):
        own = list(base)
        for p in rng.sample(range(200), rng.randint(1, 8)):
            own[p] = word()
        out.append(" ".join(own))
    out += [out[0].upper(), "three short words", "Three  short words", "two words", "", None, " \n", "a b c d e f " * 3, "a b c d e f " * 9]
    return out


@pytest.mark.parametrize("block,names", [(256, 2048), (3, 2048), (3, 1)])
def test_classes_against_all_pairs(spark, monkeypatch, block, names):
    """Also in many small tiles, and with every group of two names taken for a crowded one."""
    monkeypatch.setattr(nearsets, "BLOCK", block)
    monkeypatch.setattr(nearsets, "NAMES", names)
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "k bigint, text string")
    got = {r.row: r.class_row for r in nearsets.near_set_classes(df, df.k, df.text).collect()}
    assert [got[k] for k in range(len(rows))] == plain_classes(rows)


def test_texts_that_share_a_template_are_not_paired(spark, monkeypatch):
    """3,000 texts of which three quarters are one template: unlike each other, but in the same bands. Compared by rare shingles, hardly any of them meet."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(90)]
    rows = [" ".join(template + [word() for _ in range(30)]) for _ in range(3000)]
    rows += [rows[5] + " more", rows[7].upper()]
    df = spark.createDataFrame(list(enumerate(rows)), "k bigint, text string")
    seen = []
    plain = nearsets._compared

    def compared(state, sets, threshold):
        seen.append(state.groupBy("key").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0])
        return plain(state, sets, threshold)

    monkeypatch.setattr(nearsets, "_compared", compared)
    monkeypatch.setattr(nearsets, "NAMES", 200)
    got = {r.row: r.class_row for r in nearsets.near_set_classes(df, df.k, df.text).collect()}
    assert got == {k: {3000: 5, 3001: 7}.get(k, k) for k in range(3002)}
    assert len(seen) == 2 and sum(seen) < 300_000  # of 4.5 million pairs in every crowded band
