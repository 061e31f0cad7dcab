"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

A sentence (text between ``. ! ?`` and line ends) has the probability
``sigmoid(bias + sum of the weights of its words)``, words hashed to `2**BITS`
weights. The document's score is their noisy-or, 1 - prod(1 - p). Only document
labels are given; the gradient of the noisy-or likelihood spreads them over the
sentences, and an L1 penalty leaves weights on telling words alone. The sentences
with p >= 0.5 are given as spans of code points.

The fit takes at most `max_rows` labelled documents, those of the smallest hashed ids,
and of them the first whose distinct pairs of a sentence and a telling word add up to
MAX_PAIRS, on the driver; scores cover every row. Null and empty texts have no sentence
and score 0. Without a labelled row of each kind every score is 0. Repeated rows
score alike. Further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_batches, map_text, text_blocks, within

BITS = 18
#: Bounds of the fit: labelled documents, and their distinct pairs of a sentence and a telling word, 8 bytes each on the driver.
MAX_ROWS, MAX_PAIRS = 8000, 8_000_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
#: Words whose hashes a task remembers; beyond it starts anew.
REMEMBERED = 250_000


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & ((1 << BITS) - 1)


class _Known(dict):
    """Values of words, worked out once."""

    def __init__(self, of):
        super().__init__({end: -1 for end in ENDS})
        self.of = of

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
            self.update({end: -1 for end in ENDS})
        value = self[word] = self.of(word)
        return value


def _sentences(text: str | None, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words, and of each word the number of its sentence (sentences without words are not numbered). Long texts are read block by block."""
    parts = [np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)) for block in text_blocks(text) for tokens in (TOKEN.findall(block.lower()),)]
    ids = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])
    ends = ids < 0
    number = np.cumsum(ends)[~ends]
    return ids[~ends], np.unique(number, return_inverse=True)[1] if len(number) else number


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        return _sigmoid(self.bias + np.bincount(sentence, self.weights[words]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


#: Only words that toxic documents hold this many times as often as others, and this many documents hold, get a weight.
LIFT, LEAST_DOCS = 3.0, 3


def _telling(toxic_docs, other_docs, n_toxic: float, n_other: float):
    """Whether a word in so many toxic and other documents gets a weight; of numbers, arrays or columns."""
    return ((toxic_docs + 0.5) / (n_toxic + 1) > LIFT * (other_docs + 0.5) / (n_other + 1)) & (toxic_docs + other_docs >= LEAST_DOCS)


def fit(label: np.ndarray, starts: np.ndarray, words: np.ndarray, sentences: np.ndarray, n_sentences: np.ndarray, steps: int = 400, rate: float = 0.5, l1: float = 5e-5) -> Model:
    """Proximal Adagrad on the noisy-or likelihood.

    Document d has the label label[d], n_sentences[d] sentences, and the distinct (sentence,
    word) pairs starts[d] to starts[d + 1]. Only telling words get a weight; sentences
    without any have the bias alone and are only counted.
    """
    size = 1 << BITS
    label = label.astype(float)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(size), -30.0)
    spread = np.zeros((2, size), np.int64)
    for d in range(len(label)):
        spread[int(label[d]), np.unique(words[starts[d] : starts[d + 1]])] += 1
    toxic = label.sum()
    used = np.flatnonzero(_telling(spread[1], spread[0], toxic, len(label) - toxic))
    at = np.full(size, -1, np.int32)
    at[used] = np.arange(len(used))
    real = np.flatnonzero(at[words] >= 0)
    doc = np.searchsorted(starts, real, "right") - 1
    offset = np.r_[0, np.cumsum(n_sentences)]
    active, sent = np.unique(sentences[real] + offset[doc], return_inverse=True)
    doc_of = np.searchsorted(offset, active, "right") - 1
    word, n = at[words[real]], len(active)
    rest = n_sentences - np.bincount(doc_of, minlength=len(label))
    theta, bias = np.zeros(len(used)), -5.0
    seen, seen_bias = np.full(len(used), 1e-8), 1e-8
    weight = np.where(label == 1, 0.5 / toxic, 0.5 / (len(label) - toxic))  # both kinds weigh the same
    for _ in range(steps):
        p, base = _sigmoid(bias + np.bincount(sent, theta[word], n)), float(_sigmoid(np.array(bias)))
        none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(label)) + rest * np.log1p(-base))
        up = np.where(label == 1, none / np.maximum(1 - none, 1e-6), -1.0) * weight
        slope = up[doc_of] * p
        g, gb = np.bincount(word, slope[sent], len(used)), slope.sum() + (up * rest).sum() * base
        seen += g * g
        seen_bias += gb * gb
        step = rate / np.sqrt(seen)
        theta = theta + step * g
        theta = np.sign(theta) * np.maximum(np.abs(theta) - step * l1, 0)
        bias += rate / np.sqrt(seen_bias) * gb
    weights = np.zeros(size)
    weights[used] = theta
    return Model(weights, float(bias))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows of `docs`, those of at most `max_rows` ids that `docs` has; a document with several labels takes the largest."""
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    present = named.groupBy("id").agg(F.max("label").alias("label")).join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _Known(bucket)
        words, sentences, n = [], [], []
        for t in batch.column("text"):
            w, s = _sentences(t.as_py(), known)
            pairs = np.unique(s << BITS | w)
            words.append((pairs & ((1 << BITS) - 1)).astype(np.int32))
            sentences.append((pairs >> BITS).astype(np.int32))
            n.append(int(s.max()) + 1 if len(s) else 0)
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (words, sentences)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(n, pa.int64()), *lists], ["id", "label", "n", "words", "sentence"])

    kind = "id long, label int, n long, words array<int>, sentence array<int>"
    pairs = checkpoint(map_text(texts, step, kind))
    n_toxic, n_all = pairs.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
    each = pairs.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("o"))
    told = np.zeros(1 << BITS, bool)
    told[[r.word for r in each.where(_telling(F.col("t"), F.col("o"), n_toxic, n_all - n_toxic)).select("word").collect()]] = True  # at most 2**BITS

    def keep_telling(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists: tuple[list, list] = ([], [])
        for w, s in zip(batch.column("words"), batch.column("sentence")):
            w, s = w.values.to_numpy(), s.values.to_numpy()
            real = told[w]
            lists[0].append(w[real])
            lists[1].append(s[real])
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("n"), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], batch.schema.names)

    kept = checkpoint(map_batches(pairs, keep_telling, kind))
    got = within(kept, F.size("words"), MAX_PAIRS, [F.xxhash64("id"), F.col("id"), F.col("n")]).toArrow()
    got = got.sort_by("id").combine_chunks()  # the fit must not depend on the order of arrival
    words, sentences = (got.column(c).combine_chunks() for c in ("words", "sentence"))
    starts = words.offsets.to_numpy().astype(np.int64)
    label, n = got.column("label").to_numpy(), got.column("n").to_numpy()
    return fit(label, starts - starts[:1], words.flatten().to_numpy(), sentences.flatten().to_numpy(), n)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, score, spans), and the `keep` columns (bigint), for each row of `docs`; spans are the offending sentences (start, length, score)."""

    def spans(text: str, worst: np.ndarray, p: np.ndarray) -> list[dict]:
        bounds, k = [], 0
        for m in re.finditer(r"[^.!?\n]+", text):
            if TOKEN.search(m[0].lower()):
                bounds.append((m.start(), m.end() - m.start()))
        return [{"start": bounds[k][0], "length": bounds[k][1], "score": float(p[k])} for k in worst.tolist() if k < len(bounds)]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        known = _Known(bucket)  # for the whole task
        for batch in batches:
            scores, places = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                p = model.sentence_scores(*_sentences(text, known))
                scores.append(_noisy_or(p))
                worst = np.flatnonzero(p >= 0.5)
                places.append(spans(text, worst, p) if len(worst) else [])
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores, pa.float64()), "spans": pa.array(places, kind)})

    extra = keep or {}
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(c.cast("long").alias(k) for k, c in extra.items()))
    schema = "id long, " + "".join(f"{k} long, " for k in extra) + "score double, spans array<struct<start:int,length:int,score:double>>"
    return read.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score below `threshold`."""

    def run(batches):
        known = _Known(bucket)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([_noisy_or(model.sentence_scores(*_sentences(t.as_py(), known))) < threshold for t in column], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
