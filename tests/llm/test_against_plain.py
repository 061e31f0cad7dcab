"""Fits, EM and alignments against brute force: plain likelihoods and their numeric gradients, EM over documents, whole dynamic programming."""

import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from tidemark.llm import licenses, toxicity, weaklabels


# --- op5 --------------------------------------------------------------------
def plain_likelihood(docs, label, weights, bias):
    """Of documents as lists of sentences (sets of words): the noisy-or log-likelihood, both kinds weighing the same."""
    toxic = sum(label)
    total = 0.0
    for sentences, y in zip(docs, label):
        none = 1.0
        for words in sentences:
            none *= 1 - 1 / (1 + np.exp(-(bias + sum(weights[w] for w in words))))
        total += (0.5 / toxic if y else 0.5 / (len(label) - toxic)) * np.log(1 - none if y else none)
    return total


def test_toxicity_fit_is_a_stationary_point():
    rng = random.Random(4)
    docs, label = [], []
    for _ in range(160):
        y = int(rng.random() < 0.4)
        sentences = [{w for w in range(6, 12) if rng.random() < 0.4} for _ in range(rng.randint(1, 4))]
        for w in range(6):  # telling words, none of them sure
            if rng.random() < (0.5 if y else 0.12):
                rng.choice(sentences).add(w)
        docs.append([s or {11} for s in sentences])
        label.append(y)
    pairs = [sorted((k, w) for k, s in enumerate(d) for w in s) for d in docs]
    starts = np.cumsum([0, *map(len, pairs)])
    words, sentences = (np.array([p[c] for d in pairs for p in d], np.int64) for c in (1, 0))
    model = toxicity.fit(np.array(label), starts, words, sentences, np.array([len(d) for d in docs]), steps=6000, l1=0.0)
    used = np.flatnonzero(model.weights)
    assert len(used) >= 4 and set(used) <= set(range(6))
    weights = model.weights[:12].copy()
    at = lambda w, b: plain_likelihood(docs, label, w, b)
    for k in used:
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs(at(up, model.bias) - at(down, model.bias)) / 2e-5 < 2e-4
    assert abs(at(weights, model.bias + 1e-5) - at(weights, model.bias - 1e-5)) / 2e-5 < 2e-4
    assert at(weights, model.bias) > at(np.zeros(12), -5.0)


def test_toxicity_scores_are_noisy_ors(spark):
    weights = np.zeros(1 << toxicity.BITS)
    for word, x in (("foul", 3.0), ("bad", 1.0), ("nice", -1.0)):
        weights[toxicity.bucket(word)] = x
    model = toxicity.Model(weights, -2.0)
    texts = ["A foul day. A nice bad thing! Foul, foul", "nice", "foul\nfoul? foul! foul.", "... !!", "", None]
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in out:
        none, spans = 1.0, []
        at = 0
        for part in (texts[r.id] or "").replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            words = [w.strip(",").lower() for w in part.split()]
            if words:
                p = 1 / (1 + np.exp(2.0 - sum({"foul": 3.0, "bad": 1.0, "nice": -1.0}.get(w, 0.0) for w in words)))
                none *= 1 - p
                if p >= 0.5:
                    spans.append((at, len(part)))
            at += len(part) + 1
        assert r.score == pytest.approx(1 - none) and [(s.start, s.length) for s in r.spans] == spans


# --- op8 --------------------------------------------------------------------
def test_label_model_is_em_over_documents():
    rng = random.Random(2)
    docs = []
    for _ in range(400):
        poor = rng.random() < 0.3
        docs.append("".join("2" if rng.random() < 0.2 else "0" if rng.random() < (0.7 if poor else 0.03) else "1" for _ in range(5)))
    counts = {p: docs.count(p) for p in set(docs)}
    rates, share, posterior = weaklabels.estimate(counts, steps=60)
    post = [0.1 if "0" in d else 0.95 if "1" in d else 0.5 for d in docs]
    for _ in range(60):
        catches, passes = [], []
        for j in range(5):
            told = [(p, d[j]) for p, d in zip(post, docs) if d[j] != "2"]
            catches.append((sum(1 - p for p, v in told if v == "0") + 1) / (sum(1 - p for p, _ in told) + 3))
            passes.append((sum(p for p, v in told if v == "1") + 49) / (sum(p for p, _ in told) + 50))
        pi = sum(post) / len(post)
        new = []
        for d in docs:
            good, bad = pi, 1 - pi
            for j, v in enumerate(d):
                if v != "2":
                    good *= passes[j] if v == "1" else 1 - passes[j]
                    bad *= 1 - catches[j] if v == "1" else catches[j]
            new.append(good / (good + bad))
        post = new
    assert np.allclose(rates, np.c_[catches, passes], atol=1e-4) and share == pytest.approx(pi, abs=1e-4)
    assert all(posterior[d] == pytest.approx(p, abs=1e-3) for d, p in zip(docs, post))


def test_scorer_fit_is_a_stationary_point():
    rng = np.random.default_rng(3)
    rows = [(float(rng.uniform(0.05, 0.95)), np.sort(rng.choice(8, 3, replace=False)), rng.uniform(0.2, 1, 3)) for _ in range(80)]
    theta, bias = weaklabels.fit(rows, steps=6000, l2=1e-3)

    def loss(w, b):
        z = np.array([b + (w[at] * x).sum() for _, at, x in rows])
        y = np.array([r[0] for r in rows])
        return (y * np.log1p(np.exp(-z)) + (1 - y) * np.log1p(np.exp(z))).mean() + 1e-3 * (w * w).sum() / 2

    w = theta[:8].copy()
    for k in range(8):
        up, down = w.copy(), w.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs(loss(up, bias) - loss(down, bias)) / 2e-5 < 1e-4
    assert abs(loss(w, bias + 1e-5) - loss(w, bias - 1e-5)) / 2e-5 < 1e-4


def test_votes_of_long_texts():
    rng = random.Random(1)
    own = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    prose = " ".join(rng.choice(own) + ("." if k % 12 == 0 else "") for k in range(3000))
    variety = weaklabels.LABELLERS.index("variety")
    assert weaklabels.votes(prose)[variety] == "1" and weaklabels.votes("buy now cheap " * 1000)[variety] == "0"
    assert weaklabels.shape("A" * 39 + "bc1") != weaklabels.shape("A" * 41)


# --- op2 --------------------------------------------------------------------
def whole_alignment(template, text):
    """The best score of the whole template against any part of the text, by the full table: a match 1, a word left out on either side -0.3."""
    row = np.zeros(len(text) + 1)
    for word in template:
        match = np.r_[-np.inf, np.where(np.array(text) == word, row[:-1] + 1, -np.inf)]
        best = np.maximum(match, row - 0.3)
        for j in range(1, len(best)):
            best[j] = max(best[j], best[j - 1] - 0.3)
        row = best
    return row.max()


def test_altered_licenses_are_found():
    rng = random.Random(6)
    index = licenses.build_index(licenses.templates())
    texts = [(n, t) for n, ts in licenses.templates().items() for t in ts if 30 <= len(t.split()) <= 400]
    found = 0
    for trial in range(120):
        name, text = rng.choice(texts)
        words = text.split()
        for k in rng.sample(range(len(words)), max(1, len(words) // 14)):
            words[k] = rng.choice(["", "altered", words[k] + " more"])
        noise = lambda: " ".join(rng.choice(["lorem", "ipsum", "the", "of", "software"]) for _ in range(rng.randint(0, 60)))
        body = f"{noise()} {' '.join(words)} {noise()}"
        got = licenses.scan(body, index)
        found += any(m["license"] == name for m in got)
        own = licenses.WORD.findall(body.lower())
        for m in got:
            best = max(whole_alignment(licenses.WORD.findall(t.lower()), own) for t in licenses.templates()[m["license"]]) if trial < 6 else np.inf
            assert m["coverage"] >= licenses.COVERAGE and m["matched"] <= best + 0.3 * (len(own) + 400)
            if trial < 6 and m["license"] == name:
                t = next(x for x in licenses.templates()[name] if len(licenses.WORD.findall(x.lower())) == round(m["matched"] / m["coverage"]))
                n = len(licenses.WORD.findall(t.lower()))
                inside = licenses.WORD.findall(body[m["start"] : m["start"] + m["length"]].lower())
                score = m["matched"] - 0.3 * (n - m["matched"] + len(inside) - m["matched"])
                assert score == pytest.approx(whole_alignment(licenses.WORD.findall(t.lower()), own))
    assert found >= 118


def test_weak_labels_do_not_depend_on_ids(spark):
    """The same texts with ids of their own, with one id, and without ids: the same fit."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null").dropDuplicates(["text"])
    told = []
    for key in (F.col("doc_id"), F.lit(7).cast("long"), F.lit(None).cast("long")):
        out, _ = weaklabels.label_and_score(docs.select(key.alias("doc_id"), "text"))
        told.append(sorted((r.pattern, round(r.posterior, 9), round(r.score, 6)) for r in out.collect()))
    assert told[0] == told[1] == told[2] and len({s for _, _, s in told[0]}) > 10


def test_weak_labels_count_equal_rows(spark):
    rows = [(k % 3, "A good sentence with words of many kinds. It goes on, and ends.") for k in range(300)] + [(k, f"buy now {k} cheap " * 40) for k in range(30)]
    out, _ = weaklabels.label_and_score(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert out.count() == 330
