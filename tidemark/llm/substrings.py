"""Exact removal of repeated byte strings with suffix arrays of shards.

Every `length`-byte window that starts in two places is found, whole texts and
all documents counted, matches never crossing texts:

1. Each window is named by its minimizer, the `k`-byte string in it of the smallest
   hash. Equal windows have equal minimizers at equal places, so only windows whose
   minimizer occurs twice can repeat. The windows that share one minimizer form a
   segment of the text.
2. Segments are dealt by minimizer. Equal segments are one entry with a count before
   anything is gathered.
3. The entries of a minimizer that occurs twice meet in one shard. Shards are ordered by
   induced sorting and their permuted common prefixes computed: a window repeats if it
   shares `length` bytes with a neighbour in the suffix array. An entry with copies
   stands twice in the array, which is found in its place by one sort of the entries. No
   window is told to repeat in another way. An entry that is the only one of its minimizer
   meets no other entry; those that follow one another in a text are sorted as one string,
   so the bytes in which they overlap are sorted once.
4. A minimizer with more than `hot` distinct segments (a passage in very many
   different surroundings) is not gathered: its segments are taken as texts again
   and named by longer minimizers. At the last level the minimizer is the window
   itself, for which counting is all.

The texts are written once, dealt by their row keys, so they are not shuffled again to
be cut or to lose their repeats.

Null texts are empty. Texts shorter than `length` lose nothing. Copies lose all of
their bytes. Each input row has a key of its own, so repeated and null ids are rows
like any other. Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed, materialize, text_slices, unused, whole_groups
from tidemark.llm.suffixes import permuted_prefixes, suffix_array

LENGTH = 200
#: Bytes of the minimizers, level by level; the last is the window itself.
LEVELS = (50, 160, 200)
HOT = 16384
#: Repeated minimizers up to this number are broadcast (about 30 bytes each), more are joined by a shuffle.
KEYS_BROADCAST = 1_000_000
#: Bytes of a text whose minimizers are worked out at once, and bytes of a shard.
CHUNK, SHARD = 1 << 19, 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    size = CHUNK + 512
    up = np.cumprod(np.r_[np.uint64(1), np.full(size, _MULTIPLIER, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)])
    return up, down


def _window_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of every k-byte string of `t`."""
    up, down = _powers()
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(t) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    if w == 1:
        return h
    blocks = np.r_[h, np.full(-len(h) % w, ~np.uint64(0))].reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def minimizers(text: bytes, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer, the leftmost of equal ones: its hash, the first window's start, the number of windows."""
    keys, starts, counts = [], [], []
    for base in range(0, max(len(text) - length + 1, 0), CHUNK):
        t = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - base), base)
        h = _window_hashes(t, k)
        low = _sliding_min(h, length - k + 1)
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])])  # a minimizer left behind ends its run, if an equal one follows too
        keys.append(low[first])
        starts.append(first + base)
        counts.append(np.diff(np.r_[first, len(low)]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def _segments(texts: DataFrame, k: int, length: int) -> DataFrame:
    """(key, segment, id, lo, windows, n) for (id, text, n); key and segment are hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for row, value in enumerate(part.column("text")):
                    text = value.as_buffer().to_pybytes() if value.is_valid else b""
                    key, lo, n = minimizers(text, k, length)
                    cut = zip(lo.tolist(), (lo + n + (length - 1)).tolist())
                    seg = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in cut), np.uint64, len(lo))
                    for c, x in zip(cols, (key.view(np.int64), seg.view(np.int64), np.full(len(lo), row), lo, n)):
                        c.append(x)
                key, seg, row, lo, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
                row = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key), "segment": pa.array(seg), "id": part.column("id").take(row),
                    "lo": pa.array(lo.astype(np.int32)), "windows": pa.array(n.astype(np.int32)), "n": part.column("n").take(row),
                })

    return texts.mapInArrow(run, "key long, segment long, id long, lo int, windows int, n long")


def _chains(cuts: list[dict], most: int) -> Iterator[list[dict]]:
    """The cuts of a text: each by itself, but those that are `alone` with the ones that follow them window by window, up to `most` windows."""
    chain: list[dict] = []
    for c in sorted(cuts, key=lambda c: c["lo"]):
        if not c["alone"]:
            yield [c]
            continue
        if chain and (chain[-1]["lo"] + chain[-1]["windows"] != c["lo"] or c["lo"] - chain[0]["lo"] >= most):
            yield chain
            chain = []
        chain.append(c)
    if chain:
        yield chain


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, n, text, parts): the bytes of the wanted segments (key, segment, n, id, lo, windows, alone), and which segments they hold one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_kind = pa.list_(pa.struct([("key", pa.int64()), ("segment", pa.int64()), ("windows", pa.int32())]))
        for batch in batches:
            for part in text_slices(batch):
                out: dict[str, list] = {"key": [], "n": [], "text": [], "parts": []}
                for value, cuts in zip(part.column("text"), part.column("cuts")):
                    text = value.as_buffer()
                    for chain in _chains(cuts.as_py(), CHUNK):
                        lo, hi = chain[0]["lo"], chain[-1]["lo"] + chain[-1]["windows"]
                        out["key"].append(chain[0]["key"])
                        out["n"].append(min(c["n"] for c in chain))
                        out["text"].append(text.slice(lo, hi - lo + length - 1).to_pybytes())
                        out["parts"].append([{x: c[x] for x in ("key", "segment", "windows")} for c in chain])
                kinds = {"key": pa.int64(), "n": pa.int64(), "text": pa.binary(), "parts": part_kind}
                yield pa.RecordBatch.from_pydict({x: pa.array(out[x], kind) for x, kind in kinds.items()})

    by_text = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "segment", "n", "lo", "windows", "alone")).alias("cuts"))
    schema = "key long, n long, text binary, parts array<struct<key:long,segment:long,windows:int>>"
    return texts.select("id", "text").join(by_text, "id").select("text", "cuts").mapInArrow(run, schema)


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one string, each closed by a separator, and how many bytes follow each place up to its separator."""
    s = np.frombuffer(b"\xff".join(texts) + b"\xff\xff", np.uint8) + np.uint8(2)  # UTF-8 has no 0xff: separators are 1, the end is 0
    s[-1] = 0
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return s, np.r_[np.repeat(np.cumsum(sizes) - 1, sizes), len(s) - 1] - np.arange(len(s))


def _repeats_in_shard(texts: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """Of each distinct segment the windows that start elsewhere too, from one suffix array of all of them, in which a segment that has copies stands twice.

    Each is sorted once; the suffixes of its second standing follow those of the first one by
    one, as equal suffixes do.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    once, _ = _symbols(texts)
    sa = suffix_array(once)
    again = [k for k, n in enumerate(copies) if n > 1]
    s, room = _symbols(texts + [texts[k] for k in again])
    twin = np.full(len(once), -1, np.int64)
    at = len(once) - 1
    for k in again:
        first = ends[k] - sizes[k]
        twin[first : ends[k] + 1] = np.arange(at, at + sizes[k] + 1)
        at += sizes[k] + 1
    both = np.stack((np.where(sa == len(once) - 1, len(s) - 1, sa), twin[sa]), axis=1).ravel()
    sa = both[both >= 0]
    shared = permuted_prefixes(s, sa, room)
    repeats = np.zeros(len(s), bool)
    near = np.flatnonzero(shared[sa[1:]] >= length) + 1  # neighbours in the array share a window
    repeats[sa[near]] = True
    repeats[sa[near - 1]] = True
    return [repeats[e - n : e - length + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


def _sort_shards(length: int):
    def shards(table: pa.Table) -> Iterator[pa.Table]:
        """About SHARD bytes of whole keys."""
        key = table.column("key").to_numpy()
        size = np.cumsum(pc.binary_length(table.column("text")).to_numpy())
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = np.r_[0, size[first[1:] - 1]]
        start = first[np.r_[True, np.diff(before // SHARD) > 0]]
        for a, b in zip(start, np.r_[start[1:], len(key)]):
            yield table.slice(int(a), int(b - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key", least=20_000):
            for shard in shards(group):
                found = _repeats_in_shard(shard.column("text").to_pylist(), shard.column("n").to_pylist(), length)
                out: dict[str, list] = {"key": [], "segment": [], "runs": []}
                for flags, parts in zip(found, shard.column("parts").to_pylist()):
                    at = 0
                    for p in parts:
                        out["key"].append(p["key"])
                        out["segment"].append(p["segment"])
                        out["runs"].append(_runs(flags[at : at + p["windows"]]))
                        at += p["windows"]
                kinds = {"key": pa.int64(), "segment": pa.int64(), "runs": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))}
                yield pa.RecordBatch.from_pydict({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    return run


def repeated_windows(texts: DataFrame, length: int = LENGTH, levels: tuple[int, ...] = LEVELS, hot: int = HOT) -> DataFrame:
    """(id, a, b): ranges [a, b) of starts of windows that start elsewhere too, for texts (id, text, n standing n times).

    The ranges of a text may touch but do not overlap.
    """
    rows = materialize(_segments(texts, levels[0], length))
    keys = rows.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    keys = materialize(keys)
    small = keys.count() <= KEYS_BROADCAST
    found = rows.join(F.broadcast(keys), "key") if small else materialize(rows.join(keys, "key"))  # read twice; a broadcast join is no work
    classes = found.groupBy("key", "segment").agg(F.sum("n").alias("n"), F.min(F.struct("id", "lo", "windows")).alias("first"))
    classes = materialize(classes.select("key", "segment", "n", "first.*"))
    if levels[0] == length:  # a segment is one window here
        whole = classes.where("n > 1").select("key", "segment", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))).alias("runs"))
    else:
        met = materialize(classes.groupBy("key").agg(F.count("*").alias("distinct")))  # the join below is then a stage of its own, which deals a hot key out
        wanted = classes.join(met, "key")
        cut = _cut(texts, wanted.where(F.col("distinct") <= hot).withColumn("alone", F.col("distinct") == 1), length)
        sorted_ = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards(length), "key long, segment long, runs array<struct<a:int,b:int>>")
        whole = sorted_.where("size(runs) > 0")
        if met.where(F.col("distinct") > hot).limit(1).count():
            again = materialize(_cut(texts, wanted.where(F.col("distinct") > hot).withColumn("alone", F.lit(False)), length).withColumn("id", F.monotonically_increasing_id()))
            deeper = repeated_windows(again.select("id", "text", "n"), length, levels[1:], hot)
            runs = deeper.groupBy("id").agg(F.collect_list(F.struct(F.col("a").cast("int"), F.col("b").cast("int"))).alias("runs"))
            whole = whole.union(runs.join(again, "id").select("key", F.col("parts")[0]["segment"].alias("segment"), "runs"))
    out = found.join(whole, ["key", "segment"]).select("id", "lo", F.explode("runs").alias("r"))
    return out.select("id", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))


def _merged(runs: list[dict] | None, length: int) -> np.ndarray:
    """Removed byte ranges from window starts [a, b), as maximal runs."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    r = np.array(sorted((x["a"], x["b"] + length - 1) for x in runs), np.int64)
    reach = np.maximum.accumulate(r[:, 1])
    first = np.flatnonzero(np.r_[True, r[1:, 0] > reach[:-1]])
    return np.c_[r[first, 0], reach[np.r_[first[1:] - 1, len(r) - 1]]]


def _runs_by_text(texts: DataFrame, length: int, levels: tuple[int, ...], hot: int) -> DataFrame:
    windows = repeated_windows(texts.withColumn("n", F.lit(1).cast("long")), length, levels, hot)
    return windows.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, levels: tuple[int, ...] = LEVELS, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`; spans are maximal removed runs of bytes."""
    keyed = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")), "row")
    by_text = _runs_by_text(keyed.select(F.col("row").alias("id"), "text"), length, levels, hot).withColumnRenamed("id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                for value, runs in zip(part.column("text"), part.column("runs")):
                    text = value.as_buffer().to_pybytes() if value.is_valid else b""
                    spans = _merged(runs.as_py(), length)
                    edges = [0, *spans.ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(len(spans))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                columns = {"id": part.column("id")} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
                columns["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return keyed.join(by_text, "row", "left").mapInArrow(run, schema)


def strip_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, levels: tuple[int, ...] = LEVELS, hot: int = HOT) -> DataFrame:
    """The rows of `docs`, all columns, with the repeated bytes taken out of the text; a character that a cut would halve stays. Null texts stay null."""
    row, runs = unused(docs, "row"), unused(docs, "runs")
    keyed = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row)
    texts = keyed.select(F.col(row).alias("id"), F.col(text_col).cast("binary").alias("text"))
    by_text = _runs_by_text(texts, length, levels, hot).select(F.col("id").alias(row), F.col("runs").alias(runs))

    def strip(text: str | None, found: list[dict] | None) -> str | None:
        if not found or text is None:
            return text
        raw = text.encode()
        edges = [0, *_merged(found, length).ravel().tolist(), len(raw)]
        inside = lambda at: 0 < at < len(raw) and raw[at] & 0xC0 == 0x80
        for k in range(1, len(edges) - 1):
            while inside(edges[k]):
                edges[k] += 1 if k % 2 else -1
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                columns = {c: part.column(c) for c in names}
                columns[text_col] = pa.array([strip(t.as_py(), r.as_py()) for t, r in zip(part.column(text_col), part.column(runs))], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    names = docs.columns
    return keyed.join(by_text, row, "left").drop(row).mapInArrow(run, docs.schema)
