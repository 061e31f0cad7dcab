"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates (name -> texts) are read as lower-case words. Of the hashes of each
template's `k`-word strings the smallest of every `window` neighbours is kept in an
inverted index, hash -> (template, place). A text's words get the same treatment, so
any run of ``window + k - 1`` words that it shares with a template gives a common
fingerprint. Fingerprints that agree on the diagonal, up to `band` words, make one
candidate, be it a single one; an alignment of the whole template with the text within
the band of that diagonal gives the matched words. A match covers at least `coverage` of the template's
words; of matches that overlap in a text the one with most matched words stays, then
the better coverage, then the first name.

Null, empty and wordless texts match nothing. A template that a text holds several
times is reported each time. Repeated rows are reported alike. The index goes to every
task; MOST_FINGERPRINTS bounds it. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from importlib import resources

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_blocks

WORD = re.compile(r"[^\W_]+")
K, WINDOW, BAND, COVERAGE = 3, 2, 16, 0.8
#: Up to this number of fingerprints the index goes to every task; more are searched in parts of that size.
MOST_FINGERPRINTS = 2_000_000
#: Words of a text that are fingerprinted at a time.
WORDS_AT_ONCE = 1 << 20

@cache
def templates() -> dict[str, list[str]]:
    """Texts and notices of public licenses, one or more for each SPDX name, from a file beside this module. The driver reads it; tasks get the index."""
    return json.loads(resources.files("tidemark.llm").joinpath("license_texts.json").read_text(encoding="utf-8"))


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k-word string of word numbers."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the hashes that are the smallest of some `window` neighbours (all of them of a shorter string)."""
    if len(h) <= window:
        return np.arange(len(h))[h == h.min()] if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


@dataclass
class Index:
    """The templates as word numbers and the inverted index of their fingerprints."""

    names: list[str]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    found: dict[int, list[tuple[int, int]]]
    hashes: np.ndarray
    k: int
    window: int


def build_index(templates: dict[str, list[str]], k: int = K, window: int = WINDOW) -> Index:
    names, words, vocabulary, found = [], [], {}, defaultdict(list)
    for name in sorted(templates):
        for text in templates[name]:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall(text.lower())], np.int64)
            h = _gram_hashes(ids, k)
            for place in winnow(h, window).tolist():
                found[int(h[place])].append((len(names), place))
            names.append(name)
            words.append(ids)
    return Index(names, words, vocabulary, dict(found), np.sort(np.array(list(found), np.uint64)), k, window)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched places (template, text) of the best alignment of the whole template with `text` around text place = template place + diagonal.

    A match scores 1, a word left out on either side -0.3; text before and after is free.
    """
    width, gap = 2 * band + 1, 0.3
    offsets = np.arange(width) + diagonal - band
    score = np.zeros(width)
    moves = np.zeros((len(template), width), np.int8)  # 1 match, 2 template word left out, 3 text word left out
    for i, word in enumerate(template):
        j = i + offsets
        inside = (j >= 0) & (j < len(text))
        match = np.where(inside & (text[np.clip(j, 0, len(text) - 1)] == word), score + 1, -np.inf)
        skip = np.r_[score[1:], -np.inf] - gap  # text place i + o was place i - 1 + (o + 1)
        best = np.maximum(match, skip)
        move = np.where(match >= skip, 1, 2)
        reach = np.maximum.accumulate(best + gap * np.arange(width)) - gap * np.arange(width)
        moves[i] = np.where(reach > best + 1e-9, 3, move)
        score = reach
    o, i, pairs = int(np.argmax(score)), len(template) - 1, []
    while i >= 0:
        move = moves[i, o]
        if move == 3:
            o -= 1
        elif move == 1:
            pairs.append((i, int(i + offsets[o])))
            i -= 1
        else:
            i -= 1
            o += 1
            if o >= width:
                break
    return pairs[::-1]


def _lowered(text: str) -> Iterator[tuple[int, str]]:
    """A text in lower case, block by block, with the place of each block; as long as the text, so that places are those of the text."""
    at = 0
    for block in text_blocks(text):
        lower = block.lower()
        if len(lower) != len(block):  # some letters change length
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in block)
        yield at, lower
        at += len(block)


def _word_numbers(text: str, known: dict[str, int]) -> np.ndarray:
    """The number of each word, 0 if no template has it."""
    parts = [np.fromiter((known.get(w, 0) for w in words), np.int32, len(words)) for _, lower in _lowered(text) for words in (WORD.findall(lower),)]
    return np.concatenate([np.zeros(0, np.int32), *parts])


def _word_places(text: str) -> np.ndarray:
    """(start, end) of each word."""
    return np.fromiter((at + x for at, lower in _lowered(text) for m in WORD.finditer(lower) for x in m.span()), np.int64).reshape(-1, 2)


def _hits(ids: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(place, fingerprint) of the text's fingerprints that the index has, WORDS_AT_ONCE words at a time."""
    found: list[tuple[int, int]] = []
    over = index.k + index.window - 2
    for low in range(0, max(len(ids) - over, 1), WORDS_AT_ONCE):
        part = ids[low : low + WORDS_AT_ONCE + over]
        if not part.any() or not len(index.hashes):
            continue
        h = _gram_hashes(part, index.k)
        places = winnow(h, index.window)
        at = np.minimum(np.searchsorted(index.hashes, h[places]), len(index.hashes) - 1)
        hit = places[index.hashes[at] == h[places]]
        found += [(low + p, x) for p, x in zip(hit.tolist(), h[hit].tolist())]
    return sorted(set(found))


def scan(text: str, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[dict]:
    """The matches in one text: name, coverage, matched words, and the span in code points."""
    ids = _word_numbers(text, index.vocabulary)
    diagonals: dict[int, list[int]] = defaultdict(list)
    for place, fingerprint in _hits(ids, index):
        for template, own in index.found[fingerprint]:
            diagonals[template].append(place - own)
    matches = []
    places = _word_places(text) if diagonals else np.zeros((0, 2), np.int64)
    for template, found in diagonals.items():
        found.sort()
        words = index.words[template]
        near = min(band, max(2, len(words) // 2))  # a short template may stand twice within the band
        first = 0
        for k in range(1, len(found) + 1):
            if k < len(found) and found[k] - found[first] <= near:
                continue
            middle, first = found[(first + k - 1) // 2], k
            pairs = align(words, ids, middle, near)
            share = len(pairs) / len(words)
            if share >= coverage:
                a, b = int(places[pairs[0][1], 0]), int(places[pairs[-1][1], 1])
                matches.append({"license": index.names[template], "coverage": share, "matched": len(pairs), "start": a, "length": b - a})
    return apart(matches)


def apart(matches: list[dict]) -> list[dict]:
    """Of matches that overlap the one with most matched words, then the better coverage, then the first name."""
    kept: list[dict] = []  # in order of place; none overlap, so a new one only has to fit between its neighbours
    for m in sorted(matches, key=lambda m: (-m["matched"], -m["coverage"], m["license"], m["start"])):
        at = bisect_left(kept, m["start"], key=lambda o: o["start"])
        before = at == 0 or kept[at - 1]["start"] + kept[at - 1]["length"] <= m["start"]
        if before and (at == len(kept) or m["start"] + m["length"] <= kept[at]["start"]):
            kept.insert(at, m)
    return kept


def scan_documents(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """(id, license, coverage, matched, start, length): one row for each match in `docs`."""
    parts = index_parts(templates() if texts is None else texts, k, window)
    kinds = {"license": pa.string(), "coverage": pa.float64(), "matched": pa.int64(), "start": pa.int64(), "length": pa.int64()}

    def scanned(read: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = [], []
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                    found = scan(text.as_py(), index, band, coverage) if text.is_valid else []
                    ids += [key] * len(found)
                    rows += found
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())} | {c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()})

        return read.mapInArrow(run, "id long, license string, coverage double, matched long, start long, length long")

    if len(parts) == 1:
        return scanned(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), parts[0])
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    found = reduce(DataFrame.union, (scanned(keyed.select(F.col("row").alias("id"), "text"), index) for index in parts)).withColumnRenamed("id", "row")
    best = found.groupBy("row").applyInPandas(lambda g: pd.DataFrame(apart(g.to_dict("records")), columns=g.columns), found.schema)
    return best.join(keyed.select("row", "id"), "row").select("id", *kinds)


def index_parts(templates: dict[str, list[str]], k: int, window: int) -> list[Index]:
    """Indexes of at most about MOST_FINGERPRINTS fingerprints each; a template has no more fingerprints than words."""
    parts: list[dict[str, list[str]]] = [{}]
    size = 0
    for name in sorted(templates):
        for text in templates[name]:
            n = len(WORD.findall(text))
            if size + n > MOST_FINGERPRINTS and size:
                parts.append({})
                size = 0
            parts[-1].setdefault(name, []).append(text)
            size += n
    return [build_index(part, k, window) for part in parts]
