"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most `threshold` bits differ in at most
``threshold // parts`` bits of one of `parts` disjoint slices. A slice has
``2**r - 1`` bits, and the codewords of the Hamming code of that length are its
anchors: a perfect code, so every slice value has one anchor within radius 1, its
home. A fingerprint is sent to every anchor within the covering radius plus the
slice's threshold (at most 2 for a slice threshold of 1, which are 16 anchors for
31 bits), so a linked pair meets at the home of either end. Whole fingerprints are
compared there. Covering all 64 bits at once would send each fingerprint to
hundreds of anchors; the slices keep the method and cut that to 32.

Nulls and texts without words have fingerprint zero and link like any other.
Equal fingerprints are one node, named by the fingerprint itself, so copies are never
paired and ids take no part in the linking: a row with a null id, or with an id that
other rows have too, is a row like any other. A class is named by its smallest id that
is not null, and by null if it has none. Further columns are ignored. Empty tables give
empty results. Long texts are hashed block by block.

Three differing bits find copies with an edit or two. A pair at a Jaccard similarity of
0.8 differs in about 10 of 64 bits, so two fingerprints of 64 bits that far apart are
out of the reach of any anchors that still part strangers: `near_copies` takes the links
of the fingerprints and adds those of 5-word shingle sets at 0.8 and more, whose
candidates come from MinHash bands (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, deal_tiles, map_batches, map_text, materialize, pairs_in_groups, smallest_labels, whole_groups
from tidemark.llm.components import connected_components
from tidemark.operators.nearsets import hash_blocks, near_set_classes

#: Fingerprints of an anchor that one task compares with as many others; an anchor with more is dealt to several.
AT_ONCE = 8192
#: Hot anchors up to this number are broadcast (16 bytes each).
HOT_BROADCAST = 50_000


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    """The bits set in over half of the shingle hashes, as a signed 64-bit number. A long text is hashed block by block."""
    ones, n = np.zeros(64, np.int64), 0
    for block in hash_blocks(text, words_in_shingle):
        n += len(block)
        for k in range(0, len(block), 65536):
            ones += np.unpackbits(block[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(id, fp): one row for each row of `docs`."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return map_text(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), step, "id long, fp long")


def _syndromes(bits: np.ndarray, width: int) -> np.ndarray:
    """Of each value the XOR of the places (from 1) of its set bits: 0 in a codeword, else the bit to flip."""
    out = np.zeros(len(bits), np.int64)
    for place in range(1, width + 1):
        out ^= np.where((bits >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    return out


def anchors(fp: np.ndarray, parts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchor keys and whether it is the home, for every anchor within 2 of each slice."""
    rows, keys, homes = [], [], []
    at = np.arange(len(fp))
    flip = np.r_[np.uint64(0), np.uint64(1) << np.arange(width, dtype=np.uint64)]
    for part in range(parts):
        x = (fp >> np.uint64(part * width)) & np.uint64((1 << width) - 1)
        s = _syndromes(x, width)
        name = np.uint64(part << 58)
        rows.append(at)
        keys.append((x ^ flip[s]) | name)
        homes.append(np.ones(len(fp), bool))
        off = np.flatnonzero(s)
        for i in range(1, width + 1):  # the other codewords flip two bits whose places have the syndrome as their XOR
            j = s[off] ^ i
            use = (j > i) & (i != s[off])
            rows.append(off[use])
            keys.append((x[off[use]] ^ flip[i] ^ flip[j[use]]) | name)
            homes.append(np.zeros(int(use.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(homes)


def _shape(threshold: int) -> tuple[int, int]:
    """The slices for a threshold, each met with at most one differing bit: (parts, bits)."""
    for parts, width in ((2, 31), (4, 15), (9, 7)):
        if threshold < 2 * parts:
            return parts, width
    raise ValueError("threshold must be below 18")


def _links_at_anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key"):
            key, fp, home, low, high = (group.column(c).to_numpy() for c in ("key", "id", "home", "low", "high"))
            bits = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            per_row = np.repeat(np.arange(len(starts)), ends - starts)
            first, last = starts[per_row], ends[per_row]
            label = np.arange(len(key))
            for i, j in pairs_in_groups(first, last, np.flatnonzero(home & (last - first > 1))):
                near = (np.bitwise_count(bits[i] ^ bits[j]) <= threshold) & (i != j) & ((low[i] & high[j]) | (high[i] & low[j]))
                label = smallest_labels(len(key), i[near], j[near], label)
            linked = np.flatnonzero(label != np.arange(len(key)))
            pairs = np.unique(np.c_[fp[linked], fp[label[linked]]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    return run


def fingerprint_links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """(src, dst), fingerprints that join those of (fp), which are distinct, into their classes.

    At each anchor the links found are given as a tree, so a group of g near copies
    makes at most g links at an anchor and not g squared.
    """
    parts, width = _shape(threshold)

    def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy()
        row, key, home = anchors(fp.view(np.uint64), parts, width)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(home)], ["key", "id", "home"])

    spread = map_batches(fps.select("fp"), replicate, "key long, id long, home boolean")
    dealt = deal_tiles(spread, AT_ONCE, HOT_BROADCAST)
    return dealt.select("key", "id", "home", "low", "high").repartition("key").sortWithinPartitions("key").mapInArrow(_links_at_anchors(threshold), "src long, dst long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, threshold: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`; component_id is the smallest id reachable by links."""
    fps = materialize(fingerprints(docs, id_col, text_col, words_in_shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")))
    found = connected_components(fingerprint_links(nodes, threshold))
    # what a hot class or a hot fingerprint is joined with is written first: the join is then a stage of its own, which deals hot groups out
    own = checkpoint(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    least = checkpoint(own.groupBy("root").agg(F.min("id").alias("component_id")))
    classes = own.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("id", "fp", "component_id")


def near_copies(docs: DataFrame, row: Column, text_col: str = "text", words_in_shingle: int = 5, similarity: float = 0.8, threshold: int = 3) -> DataFrame:
    """(row, class_row): classes of near copies, named by their smallest row; `row` is as in `near_set_classes`.

    Two texts are linked if their fingerprints differ in `threshold` bits at most (found at
    the anchors), and also if their shingle sets have a Jaccard similarity of `similarity`
    or more: what is beyond the anchors' reach is found and checked on whole sets. The
    classes are those of all these links together.
    """
    by_print = simhash_classes(docs.select(row.cast("long").alias("row"), F.col(text_col).alias("text")), "row", "text", words_in_shingle, threshold)
    by_set = near_set_classes(docs, row, F.col(text_col), similarity, words_in_shingle)
    both = materialize(by_set.select("row", "class_row").join(by_print.select(F.col("id").alias("row"), "component_id"), "row"))
    # a class goes by one of its rows, so rows join the classes of the one kind with those of the other
    links = both.where("class_row <> component_id").select(F.col("class_row").alias("src"), F.col("component_id").alias("dst")).distinct()
    found = connected_components(links)
    return both.join(found, F.col("class_row") == F.col("node"), "left").select("row", F.coalesce("component", "class_row").alias("class_row"))
