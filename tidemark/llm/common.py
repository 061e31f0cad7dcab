"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import bucketed, checkpoint, materialize, shared_folder  # noqa: F401

#: Characters of text that one step of a Python task holds at a time.
CHUNK_CHARS = 8_000_000
#: Characters of one text that are taken apart at a time.
BLOCK_CHARS = 1 << 20
_GAP = re.compile(r"(?<=\S)[ \t\r\n]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def within(df: DataFrame, size: Column, most: int, order: list[Column]) -> DataFrame:
    """The first rows of `df`, a checkpoint of a bounded number of rows, whose sizes add up to at most `most`: what the driver can hold. All of them, if they do."""
    if (df.agg(F.sum(size)).first()[0] or 0) <= most:
        return df
    upto = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("upto", upto).where(F.col("upto") <= most).drop("upto")


def text_blocks(text: str | None, size: int | None = None) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut before white space that follows other characters; concatenated they are the text."""
    text, size, at = text or "", size or BLOCK_CHARS, 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end] if at or gap else text
        at = end


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply `step` to each Arrow batch of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns and arrays of them, also where there is no session."""
    kind = lambda t: pa.list_(_ARROW[t[6:-1]]) if t.startswith("array<") else _ARROW[t]
    return pa.schema([(name, kind(t)) for name, t in (column.split() for column in ddl.split(", "))])


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).nbytes
    if sizes <= limit:
        yield batch
        return
    lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
    group = (np.cumsum(lengths) // limit).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def map_text(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, column: str = "text") -> DataFrame:
    """As `map_batches`, with batches cut so that a task holds little text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                out = step(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[pa.Table]:
    """From batches sorted by the integer column `key`, tables of about `least` rows that cut no group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        joined = pa.Table.from_batches(held)
        keys = joined.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield joined.slice(0, cut)
        held = joined.slice(cut).to_batches()
        rows = joined.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def pairs_in_groups(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j), i from `left` and j from i's group [starts[i], ends[i]), about `limit` at a time."""
    width = (ends - starts)[left]
    if not len(left):
        return
    for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(width) // limit)) + 1):
        rows, n = left[part], width[part]
        i = np.repeat(rows, n)
        first = np.repeat(np.cumsum(n) - n, n)
        yield i, np.arange(len(i)) - first + np.repeat(starts[rows], n)


def smallest_labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For rows 0..n-1 linked by the pairs (i, j), the smallest row number that each one reaches."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            break
        low = np.minimum(a, b)
        np.minimum.at(label, np.maximum(a, b), low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def deal_tiles(rows: DataFrame, at_once: int, broadcast_most: int) -> DataFrame:
    """Deal the groups of (key, id, ...) to tasks: columns `low` and `high` are added, and a low and a high row of one key are to be compared.

    A key with more than `at_once` rows is split into blocks, and each two blocks make a
    tile, which has a key of its own and at most `2 * at_once` rows; low rows of a tile
    are those of its one block, high rows those of the other. Every pair of rows of a
    key meets in exactly one tile, so counts add up and no task holds a whole hot group.
    The hot keys are few (one for each `at_once` rows at most) and counted first: up to
    `broadcast_most` of them are broadcast, more are joined by a shuffle.
    """
    hot = checkpoint(rows.groupBy("key").count().where(F.col("count") > at_once).select("key", F.ceil(F.col("count") / at_once).alias("blocks")))
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumns({"low": F.lit(True), "high": F.lit(True)})
    rows = rows.join(F.broadcast(hot) if n_hot <= broadcast_most else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.withColumns({"low": F.col("block") == first, "high": F.col("block") == second, "tile": F.xxhash64("key", first, second)})
    return rows.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.col("tile"))).drop("blocks", "block", "other", "tile")
