"""Null and repeated ids take no part in linking: each row is a row of its own in op3, op4 and the pipeline's stages."""

import random

import numpy as np
import pytest

from test_dedup_operators import plain_components
from tidemark.llm import embeddings, simhash


def named(ids, root):
    """The smallest id of each class that is not null."""
    least = {}
    for k, r in root.items():
        if ids[k] is not None:
            least[r] = min(least.get(r, ids[k]), ids[k])
    return [least.get(root[k]) for k in root]


@pytest.mark.parametrize("at_once", [8192, 4])
def test_simhash_ids(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(6)]
    near = [texts[0] + " " + word() for _ in range(12)]
    data = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (None, texts[4]), (9, texts[4]), (3, texts[5]), (3, texts[5]), *((20 + k if k % 3 else None, t) for k, t in enumerate(near))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    fps = [simhash.fingerprint(t, 3) & (1 << 64) - 1 for _, t in data]
    links = [(a, b) for a in range(len(data)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = named([i for i, _ in data], plain_components(range(len(data)), links))
    got = sorted(map(str, ((r.id, r.component_id) for r in simhash.simhash_classes(docs).collect())))
    assert got == sorted(map(str, ((i, c) for (i, _), c in zip(data, want))))


@pytest.mark.parametrize("at_once", [4096, 4])
def test_embedding_ids(spark, at_once):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    x = np.concatenate([base, base[:1] + rng.standard_normal((8, 16)) * 0.02, base[4:5], base[4:5]]).astype(np.float32)
    ids = [None, None, 7, 7, 5, None, *(20 + k if k % 2 else None for k in range(8)), 5, None]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)] + [(None, None, 0), (11, None, 0)], "vec_id bigint, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    root = plain_components(range(len(x)), [(a, b) for a in range(len(x)) for b in range(a) if close[a, b]])
    want = list(zip(ids, (int(n) - 1 for n in close.sum(axis=1)), named(ids, root))) + [(None, 0, None), (11, 0, 11)]
    got = [(r.id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, at_once=at_once).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_fingerprint_is_a_plain_vote(spark):
    import xxhash

    rng = random.Random(1)
    for n in (1, 2, 3, 4, 50, 400):
        words = ["".join(rng.choice("aBcÉ") for _ in range(rng.randint(1, 4))) for _ in range(n)]
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        shingles = [" ".join(low[k : k + 3]) for k in range(max(n - 2, 1))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(" \t".join(words), 3) & (1 << 64) - 1 == want
