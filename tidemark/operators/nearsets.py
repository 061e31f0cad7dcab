"""Classes of texts whose word-shingle sets have a Jaccard similarity of at least a threshold.

Equal sets are one node. MinHash bands give the candidates: with the defaults a pair at
0.8 shares one of 24 bands of 4 with probability 0.999997. Every link is checked on the
whole sets. The pairs of a band group are not emitted: first each group compares its
members with one of them, its lead, and a member goes by the lead that it is linked to;
only members that go by different names are compared after that, group by group in tiles
of two blocks, of which each gives a tree of its links. A group with very many names (texts
that share a template and no more) is not compared as it stands: see `_by_rare_shingles`. A text of fewer words than a shingle has its whole
word sequence as its one shingle; texts without words, nulls included, are one set.
Empty tables give empty results; ties have no effect, a class is named by its smallest row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.operators.lineage import checkpoint, materialize

SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Members of a band group that a task compares with as many others at a time.
BLOCK = 256
#: Names in a band group (about) up to which its members are compared all with all.
NAMES = 2048
#: Shingles of a tile that are compared at once.
COLUMNS = 1 << 15
#: Texts or sets that a task is sent at a time. They are wide, so the session's own number may be more than its memory.
AT_A_TIME = 128


def hash_blocks(text: str | None, words_in_shingle: int, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included, A-Z lowered, for about `size` bytes of the text at a time.

    Of a text with fewer words than a shingle the whole word sequence is the one shingle.
    """
    raw = (text or "").encode().lower()  # bytes.split() cuts at \x20 and \x09-\x0D, bytes.lower() lowers A-Z only
    carried: list[bytes] = []
    at, told = 0, False
    while at < len(raw):
        end = at + size
        gap = SPACE.search(raw, end) if end < len(raw) else None
        end = gap.start() if gap else len(raw)
        words = carried + raw[at:end].split()
        at, n = end, len(words) - words_in_shingle + 1
        if n < 1:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        cut = map(slice, starts[:n].tolist(), ends[words_in_shingle - 1 :].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)), np.uint64, n)
        carried, told = words[n:], True
    if carried and not told:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text that is in lower case already."""
    found = np.zeros(0, np.uint64)
    for block in hash_blocks(text, words):
        found = np.union1d(found, block) if len(found) else np.unique(block)
    return found


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The MinHash keys of a set, one for each band."""
    if not len(h):
        return np.zeros(bands, np.int64)
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        low = np.minimum(low, ((a | np.uint64(1)) * h[k : k + 4096] + b).min(axis=1))
    low = low.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(low[k].tobytes(), k) for k in range(bands)], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted distinct arrays have a Jaccard similarity of at least `threshold`."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= threshold * (len(a) + len(b) - shared)


def _sketches(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys = [], []
            for t in batch.column("text"):
                h = shingle_set(t.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                keys.append(band_keys(h, bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "digest", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint64)


def _checked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(_set(a), _set(b), threshold) for a, b in zip(batch.column("ha"), batch.column("hb"))]
            yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` shares with each of `b`: the product of their incidence matrices, COLUMNS elements at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    at = [np.searchsorted(both, x) for x in flat]
    real = [np.flatnonzero((k < len(both)) & (both[np.minimum(k, len(both) - 1)] == x)) if len(both) else np.zeros(0, np.int64) for k, x in zip(at, flat)]
    for low in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - low)
        sides = []
        for side, n in ((0, len(a)), (1, len(b))):
            column = at[side][real[side]]
            use = (column >= low) & (column < low + width)
            m = np.zeros((n, width), np.float32)
            m[row[side][real[side]][use], column[use] - low] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _tree(component: np.ndarray, low: np.ndarray, high: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links of components that join the rows of a tile, low with high ones; rows of one component are joined already."""
    if (component == component[0]).all():
        return []
    i, j = np.flatnonzero(low), np.flatnonzero(high)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    shared = shared_counts([sets[k] for k in i], [sets[k] for k in j])
    near = (shared >= threshold * (size[i][:, None] + size[j][None, :] - shared)) & (component[i][:, None] != component[j][None, :])
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for x, y in np.argwhere(near).tolist():
        p, q = find(int(component[i[x]])), find(int(component[j[y]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((p, q))
    return links


def _tiles(threshold: float):
    """Tiles come sorted; one has at most two blocks of rows and is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            columns = [t.column(c).to_numpy() for c in ("component", "low", "high")]
            links = _tree(*columns, [_set(x) for x in t.column("hashes")], threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["src", "dst"])

        now, held = None, []
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else []
            for a, b in zip(first, np.r_[first[1:], len(tile)]):
                if tile[a] != now and held:
                    yield out(held)
                    held = []
                now = tile[a]
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield out(held)

    return run


def _compared(state: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): links between the components of groups (key, node, component), by tiles of two blocks of a group."""
    open_ = state.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    open_ = checkpoint(open_.where("a <> b").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    dealt = state.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiles = dealt.select(F.xxhash64("key", low, high).alias("tile"), "node", "component", (F.col("block") == low).alias("low"), (F.col("block") == high).alias("high"))
    return tiles.join(sets, "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(threshold), "src long, dst long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, some hundred thousand at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            h = _set(batch.column("hashes")[k]).view(np.int64)
            for at in range(0, len(h), 1 << 18):
                part = h[at : at + (1 << 18)]
                same = [pa.array(np.full(len(part), v, np.int64)) for v in (batch.column("node")[k].as_py(), batch.column("component")[k].as_py(), len(h))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], ["node", "component", "size", "shingle"])


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, node, component): other groups for the nodes of crowded band groups, in which all pairs at the threshold meet.

    Shingles are ordered by how many of these sets hold them, rare ones first. Two sets of
    sizes m and n that are alike share t * max(m, n) shingles at least, so one of the first
    m - ceil(t * m) + 1 of the one is among the first n - ceil(t * n) + 1 of the other: those are
    the groups. What a template brings into every text is frequent and stands last.
    """
    spread = materialize(nodes.join(sets, "node").select("node", "component", "hashes").mapInArrow(_spread, "node long, component long, size long, shingle long"))
    counts = checkpoint(spread.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"))
    ranked = spread.join(counts, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(1)), "shingle")))
    first = ranked.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1) & F.col("held").isNotNull())
    return materialize(first.select(F.col("shingle").alias("key"), "node", "component"))


@contextmanager
def _few_at_a_time(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends at most AT_A_TIME rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(AT_A_TIME if int(was) <= 0 else min(int(was), AT_A_TIME)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def near_set_classes(docs: DataFrame, row: Column, text: Column, threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """(row, set_row, class_row) for each row of `docs`: the smallest row with an equal set, and the smallest one reached by links. `row` must be distinct, not null, and the same each time that `docs` is read.

    What a group is joined with is written first, so that the join is a stage of its own and a hot group is dealt to several tasks.
    All that Python does is run in here, a few texts at a time; what is left to run are joins.
    """
    with _few_at_a_time(docs.sparkSession):
        return _near_set_classes(docs, row, text, threshold, words, bands, rows)


def _near_set_classes(docs: DataFrame, row: Column, text: Column, threshold: float, words: int, bands: int, rows: int) -> DataFrame:
    read = docs.select(row.cast("long").alias("row"), F.lower(text).alias("text"))
    sketches = materialize(read.mapInArrow(_sketches(bands, rows, words), "row long, digest binary, keys array<long>"))
    nodes = sketches.groupBy("digest").agg(F.min("row").alias("node"))
    firsts = sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = firsts.select(F.col("row").alias("node"), F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    met = checkpoint(banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"))
    groups = materialize(banded.join(met, "key").select("key", "node"))
    named = groups.select("node").distinct()
    sets = materialize(read.join(named.withColumnRenamed("node", "row"), "row", "left_semi").mapInArrow(_sets(words), "node long, hashes binary"))

    # each group compares its members with one of them, its lead
    lead = checkpoint(groups.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("lead")))
    pairs = groups.join(lead, "key").where("node <> lead").select(F.col("node").alias("src"), F.col("lead").alias("dst")).distinct()
    a, b = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("src", "ha"), ("dst", "hb")))
    led = checkpoint(pairs.join(a, "src").join(b, "dst").select("src", "dst", "ha", "hb").mapInArrow(_checked(threshold), "src long, dst long"))
    # a node goes by the lead that it is linked to; rows of a group that go by one name are joined already
    label = led.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.xxhash64("dst")).alias("to"))
    state = groups.join(label, "node", "left").select("key", "node", F.coalesce("to", "node").alias("component"))
    large = checkpoint(state.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > NAMES).select("key"))
    crowded, met = large, None
    if not large.isEmpty():  # names are counted in large groups only: a count of them is dear, and hardly any group is large
        names = state.join(large, "key", "left_semi").groupBy("key").agg(F.approx_count_distinct("component").alias("names"))
        crowded = checkpoint(names.where(F.col("names") > NAMES).select("key"))
    if not crowded.isEmpty():
        rare = _by_rare_shingles(state.join(crowded, "key", "left_semi").select("node", "component").distinct(), sets, threshold)
        met = _compared(rare, sets, threshold)
        state = state.join(crowded, "key", "left_anti")
    links = _compared(state, sets, threshold)
    met = links if met is None else links.union(met)
    found = connected_components(led.union(met))
    classes = nodes.join(found, "node", "left").select("digest", F.col("node").alias("set_row"), F.coalesce("component", "node").alias("class_row"))
    return sketches.select("row", "digest").join(classes, "digest").select("row", "set_row", "class_row")
