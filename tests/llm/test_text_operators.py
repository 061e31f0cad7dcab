"""Language id, licences, toxicity, quality rules, weak labels and BPE: brute force, exact round trips, held-out accuracy, awkward rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, licenses, quality, queries, toxicity, weaklabels

SF = "/root/testdata/sf0.01"


# --- op1 --------------------------------------------------------------------
def plain_profile(texts, size):
    counts = Counter()
    for text in texts:
        body = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
        if not body.strip():
            continue
        for n in (1, 2, 3):
            counts.update(body[k : k + n] for k in range(len(body) - n + 1) if body[k : k + n] != " ")
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]]


def test_language_profiles_and_distances(spark):
    train = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the end", "en"), (4, "rien", None)]
    docs = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    profiles = langid.learn_profiles(docs, size=40)
    got = {}
    for r in profiles.collect():
        text, code = "", r.gram
        while code:
            text, code = chr(code & 0x1FFFFF) + text, code >> 21
        got.setdefault(r.lang, {})[text] = r.place - 1
    want = {lang: plain_profile([t for _, t, x in train if x == lang], 40) for lang in ("en", "fr")}
    assert {lang: Counter(p) for lang, p in got.items()} == {lang: Counter({g: k for k, g in enumerate(p)}) for lang, p in want.items()}
    out = {r.id: (r.lang_pred, r.score) for r in langid.predict(docs, profiles, size=40).collect()}
    for key, text, _ in train:
        own = plain_profile([text], 40)
        away = {lang: sum(abs(k - p.index(g)) if g in p else 40 for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(sorted(away), key=away.get)
        assert out[key] == (best, pytest.approx(1 - away[best] / (40 * len(own))))


def test_language_odd_rows(spark, odd, empty):
    profiles = langid.learn_profiles(odd)
    out = {r.id: r for r in langid.predict(odd, profiles).collect()}
    assert len(out) == 11 and all(out[k].lang_pred == "und" and out[k].score == 0 for k in (None, 1, 2, 3, 6))
    assert out[8].lang_pred == "fr" and out[4][1:] == out[5][1:]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.predict(empty, langid.learn_profiles(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.learn_profiles(empty)).collect()} == {"und"}


def test_language_held_out(spark):
    out = queries.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.98


# --- op2 --------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_license_alignment_against_lcs(spark):
    isc = licenses.templates()["ISC"][0]
    changed = isc.replace("any purpose", "each and every purpose").replace("hereby", "")
    text = f"Foo bar. {changed} tail words here. Released under the MIT License."
    index = licenses.build_index(licenses.templates())
    found = licenses.scan(text, index)
    assert [m["license"] for m in found] == ["ISC", "MIT"]
    words = licenses.WORD.findall(isc.lower())
    assert found[0]["matched"] == lcs(words, licenses.WORD.findall(changed.lower()))
    assert text[found[1]["start"] :][: found[1]["length"]] == "Released under the MIT License"
    assert text[found[0]["start"] :].startswith("Permission to use")


def test_license_scan_finds_every_notice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id for r in queries.op2_license_scan(spark, SF).collect()}
    assert found == {r.doc_id for r in docs.where(F.col("text").rlike("(?i)licen[sc]e")).collect()}


def test_license_odd_rows(spark, odd, empty):
    assert licenses.scan_documents(odd).count() == 0 and licenses.scan_documents(empty).count() == 0
    assert licenses.scan_documents(odd, texts={}).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License. İ x " * 2), (1, "Released under the MIT License.")], "doc_id bigint, text string")
    rows = licenses.scan_documents(twice).collect()
    assert len(rows) == 3 and all(r.coverage == 1 for r in rows)


# --- op5 --------------------------------------------------------------------
def test_toxicity_finds_the_sentences(spark):
    rows = [(k, f"Good day number {k % 7}. {'You are a snorf.' if k % 4 == 0 else 'You are a friend.'} See you soon.") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels.where("doc_id < 150"))
    out = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert all((out[k].score >= 0.5) == (k % 4 == 0) for k in range(200))
    text = dict(rows)[0]
    assert [text[s.start : s.start + s.length].strip() for s in out[0].spans] == ["You are a snorf"]
    assert toxicity.reject(docs, model).count() == 150


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels)
    out = {r.id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(out) == 11 and all(0 <= s <= 1 for s in out.values()) and out[1] == out[2] == out[3] == 0 and out[4] == out[5]
    assert toxicity.reject(odd, model).columns == odd.columns
    none = toxicity.learn(odd, labels.where("false"))
    assert {r.score < 1e-3 for r in toxicity.score(odd.where("doc_id < 7"), none).collect()} == {True}
    assert toxicity.score(empty, model).count() == 0


# --- op7 --------------------------------------------------------------------
def test_quality_measures_and_sketch(spark, odd, empty):
    rows = {r.id: r for r in quality.judge(odd).collect()}
    assert len(rows) == 11
    for key, text in ((4, "The cat sat on the mat. It was a fine day."), (7, "word " * 30_000), (3, " \n\t "), (1, "")):
        words = text.split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(windows)
        covered = {p for k, w in enumerate(windows) if n[w] > 1 for p in (k, k + 1, k + 2)}
        r = rows[key]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (r.kept is False or not r.base_failed)
    assert quality.judge(empty).count() == 0


def test_quality_sketch_is_mergeable_and_close(spark):
    values = spark.range(20_000).select((F.col("id") % 4).cast("string").alias("g"), F.lit("r").alias("rule"), ((F.col("id") % 997) / 7).alias("value"))
    parts = quality.merge(quality.sketch(values.where("value < 60"), ["g"]).unionByName(quality.sketch(values.where("value >= 60"), ["g"])), ["g"])
    whole = quality.sketch(values, ["g"])
    assert sorted(parts.collect()) == sorted(whole.collect())
    exact = {r.g: r.x for r in values.groupBy("g").agg(F.percentile("value", 0.75).alias("x")).collect()}
    for r in quality.quantiles(whole, ["g"], {"high": 0.75}).collect():
        assert abs(r.high - exact[r.g]) <= 0.02 * exact[r.g]


# --- op8 --------------------------------------------------------------------
def test_label_model_recovers_rates(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    catches, passes = np.array([0.8, 0.6, 0.7, 0.5]), np.array([0.99, 0.97, 0.98, 0.995])
    poor = rng.random(40_000) < 0.2
    votes_ = np.where(poor[:, None], rng.random((40_000, 4)) >= catches, rng.random((40_000, 4)) < passes).astype(int)
    counts = Counter("".join(map(str, v)) for v in votes_)
    rates, share, posterior = weaklabels.estimate(counts)
    assert abs(share - 0.8) < 0.03 and np.abs(rates - np.c_[catches, passes]).max() < 0.06
    assert posterior["1111"] > 0.9 and posterior["0000"] < 0.01


def test_weak_labels_held_against_labels(spark):
    out = queries.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    clean, poor = (out.where(f"quality = {q}").agg(F.avg("predicted")).first()[0] for q in (1, 0))
    assert clean > 0.99 and poor < 0.3


def test_weak_labels_odd_rows(spark, odd, empty):
    out, _ = weaklabels.label_and_score(odd)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 11 and set(rows[1].pattern) == {"2"} and all(0 <= r.score <= 1 for r in rows.values()) and rows[4].score == rows[5].score
    assert weaklabels.label_and_score(empty)[0].count() == 0


# --- op10 -------------------------------------------------------------------
@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, path, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    own = bpe.Codec(path)
    texts = [t or "" for t in [r.text for r in odd.collect()]] + [r.text for r in spark.read.parquet(f"{SF}/pages.parquet").selectExpr("html as text").limit(40).collect()]
    texts += ["<|endoftext|>x<|endoftext|>", "it's we'll  \n\n\t x", "\x1c\x85\xa0 　", "x" * 5000 + "abc" * 2000, "ﬁ İ ß​", "\x00\x01"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_cuts_are_certain(path):
    own = bpe.Codec(path)
    for token in own.bytes_of.values():
        assert list(own.fragments(token)) == [token] or token == b""
    piece = b"a\x00b\x01cd"
    assert b"".join(own.fragments(piece)) == piece and len(list(own.fragments(piece))) > 1


def test_bpe_round_trip_in_spark(spark, path, odd, empty):
    ids = bpe.encode(odd, path)
    back = {r.id: r.text for r in bpe.decode(ids, path).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.collect()}
    assert bpe.encode(empty, path, decoded=True).count() == 0
