"""Hard negatives against every pair, computed plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.negatives import mine

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """(anchor, positive, rank, negative, scores) over all pairs, in Python integers."""
    own = [(k, i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, i, lab, v in own:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, j, other, w in own if m != k and len(w) == len(v)]
        for p, pid, _ in sorted((r for r in scored if r[2] == lab), key=order)[:5]:
            fit = sorted((r for r in scored if r[2] != lab and 50 * p <= 100 * r[0] <= 95 * p), key=order)
            out += [(i, pid, rank, n[1], p, n[0]) for rank, n in enumerate(fit[:3], 1)]
    return sorted(out, key=repr)


def mined(df, **how):
    got = mine(df, F.col("id") % 50 == 0, F.col("label"), **how)
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()), key=repr)


def vectors(seed, n, dim, scale=1.0, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    x = centres[rng.integers(0, 4, n)] + 0.4 * rng.standard_normal((n, dim))
    if ties:
        x = np.round(x)
    return [(int(i), [float(c) for c in scale * v], int(rng.integers(0, 3))) for i, v in zip(rng.permutation(n * 3)[:n] if not ties else range(n), x)]


@pytest.mark.parametrize("seed,n,dim,scale,ties,blocks", [(1, 400, 16, 0.2, False, 64), (2, 600, 5, 1.0, True, 100), (3, 300, 33, 3000.0, False, 8192), (4, 500, 2, 0.02, True, 7)])
def test_all_pairs(spark, seed, n, dim, scale, ties, blocks):
    rows = vectors(seed, n, dim, scale, ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert want and mined(df, block_rows=blocks) == want
    assert mined(df, block_rows=blocks, anchor_rows=4, round_bytes=1) == want  # rounds of one anchor block or so, some without any


def test_odd_rows(spark):
    bad = [
        (0, None, 1), (50, [1.0, None], 1), (100, [1.0, float("nan")], 1), (150, [1.0, float("inf")], 1), (200, [1.0, 1.0], None), (None, [1.0, 0.9], 1), (None, None, None),
        (250, [1.0, 1.0], 1), (250, [1.0, 1.0], 1), (1, [0.9, 0.9], 1), (2, [0.8, 0.8], 2), (2, [0.8, 0.8], 2), (3, [0.7, 0.8], 2), (None, [0.8, 0.8], 3), (4, [0.8, 0.8, 0.1], 2), (300, [], 1), (5, [], 1), (6, [], 2),
        (350, [0.0, 0.0], 9), (351, [1.0, 0.0], 9), (352, [1.0, 0.0], 8), (400, [-1.0, 0.0], 7), (401, [1.0, 0.0], 7),
    ]
    df = spark.createDataFrame(bad, SCHEMA).withColumns({"id": F.lit("clash"), "row": F.lit("clash"), "dim": F.lit(1), "v": F.lit(1)})
    assert mined(df) == plain(bad)
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_one_vector_that_most_rows_have(spark):
    rows = [(i, [0.3, 0.4, 0.1], 0) for i in range(900)] + [(900 + i, [0.3, 0.35, 0.1], 1 + i % 2) for i in range(600)]
    assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=128) == plain(rows)


def test_too_large_for_a_score(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 2)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        mined(df)


def test_rows_leave_early():
    """The bitmap shrinks: few rows are read in all dimensions."""
    from tidemark.llm.negatives import Block

    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (64, 2000))
    x[:8] *= np.arange(40, 0, -5)[:, None]
    block = Block(64, *(np.arange(2000).tobytes(),) * 2, np.zeros(2000, np.int64).tobytes(), x.astype(np.int64).tobytes())
    seen = []

    def alive(low, high):
        seen.append(len(low))
        return high >= np.partition(low, -5)[-5]

    anchor = x[:, 7].astype(np.int64)
    found, scores = block.scan(anchor, np.arange(2000), alive)
    exact = anchor @ x
    assert set(np.argsort(-exact)[:5]) <= set(found) and np.array_equal(exact[found], scores) and seen[-1] < 100
