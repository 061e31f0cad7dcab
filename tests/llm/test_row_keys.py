"""Repeated and null ids name no text: each row loses its own repeats."""

import random

from tidemark.llm import substrings
from test_dedup_operators import plain_removal


def test_repeats_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    texts = [text(30) + passage + text(10), text(5) + passage + text(40), text(200), text(20) + passage, text(90), text(60)]
    texts += [texts[5], texts[5]]
    ids = [None, 1, 1, None, 2, 3, 3, 3]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    want = plain_removal({k: t.encode() for k, t in enumerate(texts)}, 200)
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order([(i, *want[k]) for k, i in enumerate(ids)])
    out = [(r.doc_id, len(r.text)) for r in substrings.strip_repeats(docs).collect()]
    assert order(out) == order([(i, want[k][0] - want[k][1]) for k, i in enumerate(ids)])
