"""Language identification with rank-order n-gram profiles.

A profile is the `size` most frequent character n-grams (1 to 3 characters of the
lower-cased text, anything but letters read as one blank) of all training texts of
a language, in order of count, then of code points. A document's own most frequent
n-grams are ranked alike; its distance to a profile is the sum of how far each of
its n-grams is out of place there, `size` for one that is absent. The nearest
language wins, ties going to the first name. Its score is
1 - distance / (n-grams * size).

Null, empty and letterless texts are `und` with score 0, as is every text if no
language was learned. Rows with a null language teach nothing. Repeated rows count
each time. Long texts are counted block by block. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_text, materialize, text_slices

SIZE = 300
#: Up to this number of languages the profiles (SIZE rows of about 16 bytes each) pass the driver, and up to this number of cells of their table (languages by different n-grams, 2 bytes each) that goes to every task; more are compared by a join.
MOST_LANGUAGES, MOST_CELLS = 2000, 50_000_000
#: Characters that are counted at once, and distinct n-grams that a task holds before it hands them on.
COUNT_CHARS, HELD_GRAMS = 1_000_000, 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def gram_blocks(text: str | None) -> Iterator[np.ndarray]:
    """The packed n-grams of a text, 21 bits a character, for about COUNT_CHARS characters at a time; nothing without letters."""
    text, last, seen = text or "", np.array([32]), False
    for at in range(0, len(text), COUNT_CHARS):
        codes = np.frombuffer(text[at : at + COUNT_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _letters()[codes]
        seen |= bool(letter.any())
        codes = np.r_[last, np.where(letter, codes, 32), [32] if at + COUNT_CHARS >= len(text) else []].astype(np.int64)
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        new = len(last)
        if seen:
            yield _grams(codes, new)
        last = codes[-2:]


def _grams(codes: np.ndarray, new: int) -> np.ndarray:
    """The n-grams that end in `codes[new:]`."""
    two = codes[:-1] << 21 | codes[1:]
    one = codes[new:]
    return np.concatenate([one[one != 32], two[new - 1 :], (two[:-1] << 21 | codes[2:])[max(new - 2, 0) :]])


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of a text; empty without letters."""
    return np.concatenate([np.zeros(0, np.int64), *gram_blocks(text)])


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams added up."""
    if len(counts) == 1:
        return counts[0]
    grams, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in counts)]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in counts)]), len(grams)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and how often each stands in it, block by block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for block in gram_blocks(text):
        held.append(np.unique(block, return_counts=True))
        if len(held) == 8:
            held = [_merged(held)]
    return _merged(held)


def ranked(counts: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """The most frequent n-grams, first the largest count, then the smallest code."""
    return counts[0][np.argsort(-counts[1], kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in text_slices(batch, limit=COUNT_CHARS):
            by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            short: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text")):
                value = text.as_py()
                if len(value) > COUNT_CHARS:
                    by_lang.setdefault(lang, []).append(gram_counts(value))
                else:
                    short.setdefault(lang, []).append(ngrams(value))
            for lang, grams in short.items():
                by_lang.setdefault(lang, []).append(np.unique(np.concatenate(grams), return_counts=True))
            for lang, counts in by_lang.items():
                held[lang] = _merged([*counts, *([held[lang]] if lang in held else [])])
            if sum(len(g) for g, _ in held.values()) > HELD_GRAMS:
                yield from give()
    yield from give()


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, place): the profile of each language, counted over all rows of `docs`."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, lang_pred, score), and the `keep` columns (bigint), for each row of `docs`."""
    rows = profiles.limit(MOST_LANGUAGES * size + 1).collect()
    extra = keep or {}
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(c.cast("long").alias(k) for k, c in extra.items()))
    if len(rows) > MOST_LANGUAGES * size:
        return _predict_by_join(read, profiles, size, list(extra))
    langs = sorted({r.lang for r in rows})
    at_of = {lang: k for k, lang in enumerate(langs)}
    grams = np.unique(np.array([r.gram for r in rows], np.int64))
    if len(langs) * len(grams) > MOST_CELLS or size > np.iinfo(np.int16).max:
        return _predict_by_join(read, profiles, size, list(extra))
    places = np.full((len(langs), len(grams)), -1, np.int16)
    for r in rows:
        places[at_of[r.lang], np.searchsorted(grams, r.gram)] = r.place - 1

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(gram_counts(text), size)
        if not len(own) or not langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        hit = np.flatnonzero(grams[at] == own)
        there = places[:, at[hit]]
        away = np.where(there < 0, size, np.abs(there - hit)).sum(axis=1) + size * (len(own) - len(hit))
        best = int(np.argmin(away))
        return langs[best], 1.0 - float(away[best]) / (len(own) * size)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(t.as_py()) for t in batch.column("text")]
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        columns |= {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
        return pa.RecordBatch.from_pydict(columns)

    return map_text(read, step, "id long, " + "".join(f"{k} long, " for k in extra) + "lang_pred string, score double")


def _predict_by_join(read: DataFrame, profiles: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """The same for any number of languages: each text's ranked n-grams meet the profiles in a join, and out-of-place distances are sums by (row, language).

    A language that shares no n-gram with a text is as far away as can be, and only the
    nearest one counts; a text that shares none with any takes the first name at score 0.
    """
    keyed = materialize(read.withColumn("row", F.monotonically_increasing_id()))

    def own_ranks(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ranked(gram_counts(t.as_py()), size) for t in batch.column("text")]
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(f)) for f in found)])
        n = np.repeat([len(f) for f in found], [len(f) for f in found]).astype(np.int64)
        grams = np.concatenate([np.zeros(0, np.int64), *found])
        return pa.RecordBatch.from_pydict({"row": batch.column("row").take(pa.array(row)), "gram": pa.array(grams), "own": pa.array(place), "n": pa.array(n)})

    ranks = materialize(map_text(keyed.select("row", "text"), own_ranks, "row long, gram long, own long, n long"))
    met = ranks.join(profiles, "gram").groupBy("row", "lang").agg(F.sum(F.lit(size) - F.abs(F.col("place") - 1 - F.col("own"))).alias("saved"), F.first("n").alias("n"))
    best = met.groupBy("row").agg(F.min_by(F.struct("lang", "saved"), F.struct((-F.col("saved")).alias("away"), F.col("lang").alias("name"))).alias("b"), F.first("n").alias("n"))
    first = profiles.agg(F.min("lang")).first()[0]
    lettered = ranks.select("row").distinct().withColumn("lettered", F.lit(True))
    out = keyed.drop("text").join(best, "row", "left").join(lettered, "row", "left")
    lang = F.coalesce(F.col("b.lang"), F.when(F.col("lettered"), F.lit(first)), F.lit("und"))
    return out.select("id", *extra, lang.alias("lang_pred"), F.coalesce(F.col("b.saved") / (F.col("n") * size), F.lit(0.0)).alias("score"))
