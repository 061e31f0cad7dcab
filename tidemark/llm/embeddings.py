"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised; a table's bucket is the tuple of `floor((a . v + b) / width)`
for its `projections` Gaussian directions a. With the defaults a pair at cosine 0.93
shares a bucket of one of the tables with probability 0.999, closer pairs with more.
In a bucket the cosines are computed in double precision.

Equal vectors of a label are one entry with a count and a number of its own, so copies
are never paired and ids take no part in the linking: a row with a null id, or with an
id that other rows have too, is a vector like any other. A pair that meets in several
tables counts in the first of them. No pair leaves a task: a bucket gives each member's
number of links and a tree of its links. A bucket with more than `at_once` members is
dealt to several tasks, each comparing one block of it with another, so counts stay
exact and no task holds the whole bucket.

A component is named by its smallest id that is not null, by null if it has none; `kept`
tells whether a row has that name. Vectors that are null, empty, zero or hold a null or
a non-finite component, and vectors with a null label, link with nothing and are a
component each. Vectors of different lengths do not link. Further columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, deal_tiles, map_batches, materialize, pairs_in_groups, smallest_labels, whole_groups
from tidemark.llm.components import connected_components

TABLES, PROJECTIONS, WIDTH, SEED = 22, 8, 2.0, 20240817
AT_ONCE, HOT_BROADCAST = 4096, 50_000


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    a = rng.standard_normal((dim, tables * projections))
    return a, rng.uniform(0, width, tables * projections), rng.integers(0, 1 << 63, (tables, projections), np.int64).astype(np.uint64) | np.uint64(1)


def signatures(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """A 64-bit name of the bucket in each table, for the rows of `unit`."""
    a, b, names = _directions(unit.shape[1], tables, projections, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    x = (cells * names).sum(axis=2, dtype=np.uint64) + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in column]).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(node, own, n, label, vector): each distinct usable vector of a label once, as bytes, with its smallest id and count."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = v.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fit)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.asarray(x.values, np.float32).tobytes() for x in batch.column("v")]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], ["id", "label", "vector"])

    packed = map_batches(usable, pack, "id long, label long, vector binary")
    return packed.groupBy("label", "vector").agg(F.min("id").alias("own"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())


def _links(threshold: float, tables: int, projections: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "key", least=20_000):
            key, node, n, low, high, turn, label = (group.column(c).to_numpy() for c in ("key", "id", "n", "low", "high", "turn", "label"))
            packed = group.column("vector").combine_chunks()
            lengths = np.array([len(v.as_buffer()) for v in packed])
            for size in np.unique(lengths):  # normally one
                at = np.flatnonzero(lengths == size)
                unit = _unit(_matrix(packed.take(pa.array(at))))
                names = signatures(unit, tables, projections, width)
                k, own_label, own_turn, own_n, is_low, is_high = key[at], label[at], turn[at], n[at], low[at], high[at]
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                ends = np.r_[starts[1:], len(k)]
                last = np.repeat(ends, ends - starts)
                links, root = np.zeros(len(k), np.int64), np.arange(len(k))
                after = np.arange(1, len(k) + 1)  # each pair once, from its earlier row
                for i, j in pairs_in_groups(after, last, np.flatnonzero(last > after), limit=200_000):
                    near = np.flatnonzero((own_label[i] == own_label[j]) & ((is_low[i] & is_high[j]) | (is_high[i] & is_low[j])))
                    near = near[np.einsum("ij,ij->i", unit[i[near]], unit[j[near]]) >= threshold]
                    i, j = i[near], j[near]
                    root = smallest_labels(len(k), i, j, root)
                    new = np.argmax(names[i] == names[j], axis=1) == own_turn[i]  # a pair counts in the first table that it meets in
                    for x, y in ((i[new], j[new]), (j[new], i[new])):
                        links += np.bincount(x, own_n[y], len(k)).astype(np.int64)
                told = np.flatnonzero((links > 0) | (root != np.arange(len(k))))
                own = node[at]
                yield pa.RecordBatch.from_pydict({"id": pa.array(own[told]), "links": pa.array(links[told]), "root": pa.array(own[root[told]])})

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, at_once: int = AT_ONCE,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`."""
    entries = materialize(_entries(vectors, id_col, vector_col, label_col))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column("vector")
        lengths = np.array([len(v.as_buffer()) for v in packed])
        label = batch.column("label").to_numpy().astype(np.uint64)
        keys = np.zeros((len(lengths), tables), np.uint64)
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            keys[at] = signatures(_unit(_matrix(packed.take(pa.array(at)))), tables, projections, width)
        keys = (keys + label[:, None] * np.uint64(0x94D049BB133111EB)).view(np.int64)
        row = pa.array(np.repeat(np.arange(len(lengths)), tables))
        columns = {c: batch.column(c).take(row) for c in ("id", "n", "label", "vector")}
        turn = np.tile(np.arange(tables, dtype=np.int32), len(lengths))
        return pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "turn": pa.array(turn), **columns})

    schema = "key long, turn int, id long, n long, label long, vector binary"
    dealt = deal_tiles(map_batches(entries.select(F.col("node").alias("id"), "n", "label", "vector"), spread, schema), at_once, HOT_BROADCAST)
    met = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links(threshold, tables, projections, width), "id long, links long, root long")
    met = materialize(met)
    found = connected_components(met.select(F.col("id").alias("src"), F.col("root").alias("dst")).distinct()).withColumnRenamed("node", "linked")
    links = met.groupBy(F.col("id").alias("of")).agg(F.sum("links").alias("links"))
    # what a hot class or a hot vector is joined with is written first: the join is then a stage of its own, which deals hot groups out
    own = checkpoint(entries.select("node", "own").join(found, F.col("node") == F.col("linked"), "left").select("node", "own", F.coalesce("component", "node").alias("class")))
    least = checkpoint(own.groupBy("class").agg(F.min("own").alias("component_id")))
    classes = own.join(least, "class").select(F.col("node").alias("of"), "component_id", F.lit(True).alias("usable"))
    told = entries.select(F.col("node").alias("of"), "n", "label", "vector").join(links, "of", "left").join(classes, "of")
    told = told.select("label", "vector", "usable", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.array([np.nan if c is None else c for c in v.as_py()], np.float32).tobytes() if v.is_valid else None for v in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "label", "vector"])

    rows = map_batches(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>").alias("v")), pack, "id long, label long, vector binary")
    out = rows.join(told, ["label", "vector"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
