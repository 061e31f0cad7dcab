"""Packing against the library's ids, a plain packer, and the least number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing
from tidemark.llm.common import materialize
from tidemark.llm.packing import cut, pack, pack_documents, plan, runs

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    None, "", "  \n\t ", "Hello, World's END", "ΑΣ ΣΑΣ naïve é ́x", "a<|endoftext|>b <|startoftext|> c", "x\x1cy\x1dz \x85 w\xa0v　u t", "日本語テキスト 한국어 🎉🎉", "don't I'll we've 'S 'Re",
    "1234567890" * 9000, "ab1" * 30_000 + " tail", "ẞ İstanbul ﬁ Ǆ", "a​b﻿c᠎d", "word " * 50_000, "-" * 200,
]


@pytest.fixture(scope="module")
def odd_pieces(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] + [(3, "Hello, World's END")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"length": F.lit("clash"), "id": F.lit("clash"), "nth": F.lit(0)})
    return pack_documents(df, PATH, with_ids=True).collect(), rows


def test_ids_are_the_librarys(odd_pieces):
    tokenizer = library()
    got, rows = odd_pieces
    want = []
    for doc, text in rows:
        ids = ids_of(tokenizer, text)
        want += [(doc, k, s, tuple(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_words_of_every_letter():
    """Every letter and sign by itself, doubled, in a word and beside a combining mark: as in a whole text."""
    import unicodedata

    with open(PATH, encoding="utf-8") as f:
        words, tokenizer = packing.Words(f.read()), library()
    letters = [chr(c) for c in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), *range(0x4E00, 0x4E40), *range(0x9F90, 0xA010), 0xAC00, 0xFB01, 0x1F600] if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [t for c in letters for t in (c, c + c.upper(), f"Ab{c}c's {c}1x", f"e{c}\u0301 <|endoftext|>{c}")]
    for text, encoding in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(b"".join(words.encode(text)), "<u4").tolist() == encoding.ids, ascii(text)


def check_places(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_places(odd_pieces):
    check_places(odd_pieces[0], 4096)


def test_documents_of_the_table(spark):
    tokenizer = library()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[r.doc_id, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = pack_documents(docs, PATH).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert check_places(got, 4096) == -(-sum(w[1] for w in want.values()) // 4096)  # not one more than the tokens need


def plain_plan(lengths, capacity):
    """Best-two-fit piece by piece, on a sorted list."""
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], capacity
        while any(n <= gap for n in left):
            n = max(n for n in left if n <= gap)
            left.remove(n)
            held.append(n)
            gap -= n
        while gap:
            small, best = min(held), None
            for i, a in enumerate(left):
                for b in left[:i]:
                    if small < a + b <= gap + small and (best is None or (a + b, a) > best[0]):
                        best = ((a + b, a), a, b)
            if best is None:
                break
            held.remove(small)
            held += best[1:]
            for n in best[1:]:
                left.remove(n)
            left = sorted([*left, small])
            gap -= best[1] + best[2] - small
        bins.append(sorted(held))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 60))
    lengths = rng.integers(1, capacity + 1, rng.integers(1, 60)) if seed % 2 else rng.choice(rng.integers(1, capacity + 1, 4), 60)
    counts = np.bincount(lengths, minlength=capacity + 1)
    got = [sorted(n for n, c in held.items() for _ in range(c)) for times, held in plan(counts, capacity) for _ in range(times)]
    assert sorted(got) == plain_plan(lengths.tolist(), capacity)


def test_plan_does_not_grow_with_the_corpus():
    counts = np.random.default_rng(1).integers(0, 1000, 257)
    counts[0] = 0
    small, large = plan(counts, 256), plan(counts * 1_000_003, 256)
    bound = 256 * (2 + sum(1 / k for k in range(2, 257)))
    assert max(len(small), len(large)) <= bound
    used = sum(times * n * length for times, held in large for length, n in held.items())
    assert used == int((counts * 1_000_003 * np.arange(257)).sum())
    table = runs(large)
    assert len(table["start"]) <= bound * 22


def test_many_tasks_and_one_hot_length(spark):
    """Most pieces have one length; numbers stay gapless over tasks."""
    rows = spark.range(0, 3000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, "one two three").otherwise(F.repeat(F.lit("word "), (F.col("id") % 200).cast("int"))).alias("text"))
    with open(PATH, encoding="utf-8") as f:
        pieces = materialize(cut(rows, f.read(), 64))
    got = pack(pieces, 64).collect()
    assert len(got) == pieces.count()
    assert check_places(got, 64) <= -(-sum(r.length for r in got) // 64) * 1.02


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_text_block_by_block():
    from tidemark.llm.packing import pieces_of

    whole = np.arange(3 * 4096 + 7, dtype="<u4").tobytes()
    for size in (4, 4096, 4 * 4096, 40_000):
        blocks = (whole[k : k + size] for k in range(0, len(whole), size))
        parts = list(pieces_of(blocks, 4096, 1))
        assert b"".join(parts) == whole + np.array([1], "<u4").tobytes() and {len(p) // 4 for p in parts[:-1]} == {4096}
    assert packing.END == 1
