"""Quality scores from weak labels.

Overlapping heuristic labellers vote 1 (good), 0 (poor) or abstain on each text.
Expectation-maximisation estimates each one's accuracy and the share of good texts
without any label. It only needs how often each pattern of votes occurs, so the
corpus is reduced to at most 3**labellers counts and the iterations run on those. The
posterior of its pattern is a text's weak label; a linear scorer on hashed words and
word shapes learns the posteriors from a bounded sample of texts and scores every
text, also where the labellers abstain.

Null and empty texts get an abstaining pattern and the score of the bias alone. Long
texts are read block by block; what is kept of one are its distinct words with counts.
Repeated rows count each time. Without any row there is nothing to score. Further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_text, text_blocks, within

BITS, SAMPLE = 18, 8000
#: Names of the labellers, in the order of the digits of a pattern (0 poor, 1 good, 2 abstains).
LABELLERS = ("letters", "symbols", "upper", "tables", "dup_lines", "variety", "sentences", "top_word")
REMEMBERED = 500_000
#: A text of n words, or sqrt(VARIETY * n) if that is less, different words has full variety.
VARIETY = 100
#: Bound of the fit: features of the sampled texts, 8 bytes each on the driver.
MAX_FEATURES = 8_000_000


@dataclass
class Facts:
    """What labellers and scorer take from a text, which is read block by block."""

    words: Counter
    n: int  # words
    letters: int  # characters in words
    alphabetic: int
    capitals: int
    symbols: int
    bars: int
    ends: int
    lines: int  # lines with a word
    own_lines: int  # different ones


def facts(text: str | None) -> Facts:
    words, lines, n_lines, left = Counter(), set(), 0, ""
    alphabetic = symbols = bars = ends = 0
    for block in text_blocks(text):
        words.update(block.split())
        *whole, left = (left + block).split("\n")
        whole = [x for x in whole if x.strip()]
        n_lines += len(whole)
        lines.update(map(xxhash.xxh3_128_digest, whole))
        alphabetic += sum(map(str.isalpha, block))
        symbols += sum(map(block.count, "#*$%&|<>"))
        bars += block.count("|")
        ends += block.count(".") + block.count("?")
    if left.strip():
        n_lines += 1
        lines.add(xxhash.xxh3_128_digest(left))
    n = words.total()
    capitals = sum(k for w, k in words.items() if len(w) > 1 and w.isupper())
    return Facts(words, n, sum(len(w) * k for w, k in words.items()), alphabetic, capitals, symbols, bars, ends, n_lines, len(lines))


def votes(text: str | Facts | None) -> str:
    """The pattern of votes on a text, a digit for each labeller."""
    f = text if isinstance(text, Facts) else facts(text)
    n = f.n
    if not n:
        return "2" * len(LABELLERS)

    def judge(x: float, good_below: float, poor_above: float) -> str:
        return "1" if x <= good_below else "0" if x >= poor_above else "2"

    return "".join((
        judge(1 - f.alphabetic / f.letters, 0.15, 0.30),
        judge(f.symbols / n, 0.02, 0.10),
        judge(f.capitals / n, 0.05, 0.25),
        judge(f.bars / n, 0.01, 0.10),
        judge(1 - f.own_lines / f.lines, 0.10, 0.40) if f.lines >= 4 else "2",
        # words repeat the more the longer a text is: different words are held against the square root of its length
        judge(1 - min(len(f.words) / min(n, np.sqrt(VARIETY * n)), 1.0), 0.60, 0.80) if n >= 20 else "2",
        judge(n / (f.ends + 1), 40, 120) if n >= 40 else "2",
        judge(max(f.words.values()) / n, 0.15, 0.30) if n >= 20 else "2",
    ))


def estimate(counts: dict[str, int], steps: int = 200) -> tuple[np.ndarray, float, dict[str, float]]:
    """By EM from the pattern counts: of each labeller how often it finds a poor text poor and a good one good, the share of good texts, and the posterior of each pattern.

    The two rates differ: a good text passes nearly every labeller, a poor one fails some and
    passes the rest. Weak priors say so (1 in 50 good texts fails, 1 in 3 poor ones) and keep
    the two classes from trading places. Abstaining says nothing.
    """
    patterns = sorted(counts)
    if not patterns:
        return np.zeros((0, 2)), 0.5, {}
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[int(c) for c in p] for p in patterns])
    poor, good = v == 0, v == 1
    post = np.where(poor.any(axis=1), 0.1, np.where(good.any(axis=1), 0.95, 0.5))  # any poor vote to begin with
    rates, share = np.zeros((v.shape[1], 2)), 0.5
    for _ in range(steps):
        wg, wp = n * post, n * (1 - post)
        catches = (wp @ poor + 1) / (wp @ (poor | good) + 3)
        passes = (wg @ good + 49) / (wg @ (poor | good) + 50)
        share = float(np.clip(wg.sum() / n.sum(), 0.01, 0.99))
        logit = np.log(share / (1 - share)) + good @ np.log(passes / (1 - catches)) + poor @ np.log((1 - passes) / catches)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        new = np.c_[catches, passes]
        if np.abs(new - rates).max() < 1e-7:
            break
        rates = new
    return rates, share, dict(zip(patterns, post.tolist()))


_SHAPES = regex.compile(r"\p{Lu}\p{Lu}+|\p{Lu}|\p{Ll}+|\p{N}+|[^\p{L}\p{N}]")


def shape(word: str) -> str:
    """Runs of a word's character classes: Aa for Word, AA!! for SHOUT!!, a*** for word***. It is hashed, so its length does not matter."""
    return "".join("AA" if len(m) > 1 and m.isupper() else "A" if m.isupper() else "a" if m.isalpha() else "0" if m.isnumeric() else m for m in _SHAPES.findall(word))


def _buckets(word: str) -> tuple[int, int]:
    mask = (1 << BITS) - 1
    return xxhash.xxh32_intdigest(word) & mask, xxhash.xxh32_intdigest(" " + shape(word)) & mask


class _Known(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        pair = self[word] = _buckets(word)
        return pair


def features(text: str | Facts | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: shares of its words and of their shapes, and bounded marks of repetition and size."""
    f = text if isinstance(text, Facts) else facts(text)
    if not f.n:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array(list(map(known.__getitem__, f.words)), np.int64)
    at, place = np.unique(pairs.ravel(), return_inverse=True)
    n = np.bincount(place, np.repeat(np.fromiter(f.words.values(), np.int64, len(f.words)), 2), len(at))
    marks = (f"\tvariety {int(10 * len(f.words) / f.n)}", f"\tlines {int(10 * f.own_lines / max(f.lines, 1))}", f"\tsize {f.n.bit_length()}")
    own = np.array([xxhash.xxh32_intdigest(m) & ((1 << BITS) - 1) for m in marks], np.int64)
    return np.r_[at, own], np.r_[n / f.n, np.ones(len(own))]


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, l2: float = 1e-5, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft labels, by Adagrad over (label, buckets, weights); `weights` are how often each row stands."""
    theta, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return theta, bias
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    x = np.concatenate([r[2] for r in rows])
    share = np.full(len(rows), 1 / len(rows)) if weights is None else weights / weights.sum()
    w, seen, seen_bias = np.zeros(len(used)), np.full(len(used), 1e-10), 1e-10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[at] * x, len(rows)), -30, 30)))
        off = (y - p) * share
        g, gb = np.bincount(at, off[row] * x, len(used)) - l2 * w, off.sum()
        seen += g * g
        seen_bias += gb * gb
        w += rate * g / np.sqrt(seen)
        bias += rate * gb / np.sqrt(seen_bias)
    theta[used] = w
    return theta, float(bias)


def label_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, dict[str, list[float]]]:
    """(id, pattern, posterior, score) for each row of `docs`, and of each labeller the estimated rates of catching poor texts and passing good ones."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = read.select(F.xxhash64("id", "text").alias("row"), "text")

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(t.as_py()) for t in batch.column(1)], pa.string())], ["row", "pattern"])

    # equal rows are one entry with a count, whatever ids they have
    entries = checkpoint(map_text(named, vote, "row long, pattern string").groupBy("row", "pattern").agg(F.count("*").alias("n")))
    counts = {r.pattern: r.n for r in entries.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most 3**labellers rows
    accuracy, _, posterior = estimate(counts)
    chosen = entries.groupBy("row").agg(F.sum("n").alias("n")).orderBy("row").limit(sample)
    texts = named.join(F.broadcast(chosen), "row").groupBy("row", "n").agg(F.first("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            told = [facts(t.as_py()) for t in batch.column("text")]
            found = [features(f, known) for f in told]
            lists = [pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array([votes(f) for f in told], pa.string()), *lists], ["row", "n", "pattern", "at", "x"])

    sampled = checkpoint(texts.mapInArrow(featurise, "row long, n long, pattern string, at array<int>, x array<float>"))
    got = within(sampled, F.size("at"), MAX_FEATURES, [F.col("row")]).toArrow()
    rows, names, weights = [], got.column("pattern").to_pylist(), got.column("n").to_numpy()
    at, x = got.column("at").combine_chunks(), got.column("x").combine_chunks()
    order = np.argsort(got.column("row").to_numpy(), kind="stable")
    for k in order.tolist():
        rows.append((posterior[names[k]], at[k].values.to_numpy().astype(np.int64), x[k].values.to_numpy().astype(float)))
    theta, bias = fit(rows, weights=weights[order])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            out, pat = [], []
            for t in batch.column("text"):
                f = facts(t.as_py())
                a, w = features(f, known)
                out.append(float(1 / (1 + np.exp(-np.clip(bias + (theta[a] * w).sum(), -30, 30)))))
                pat.append(votes(f))
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            columns |= {"pattern": pa.array(pat, pa.string()), "posterior": pa.array([posterior[p] for p in pat], pa.float64()), "score": pa.array(out, pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    out = read.mapInArrow(score, "id long, pattern string, posterior double, score double")
    return out, dict(zip(LABELLERS, accuracy.tolist()))
