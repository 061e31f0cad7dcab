"""Mining of hard negatives by vertical scans of decomposed vectors (BOND).

Components are scaled and floored to integers and scores are integer inner products, so
every comparison is exact. Rows are written in blocks whose dimensions are columns. For an
anchor a block is read dimension by dimension in the order of the anchor's magnitudes,
largest first. After a few dimensions a row's score lies between its partial sum plus the
least and plus the most that the remaining dimensions can contribute, by the block's
smallest and largest component of each. Rows that can't matter any more leave the
candidate bitmap; the few that stay are read to the end, where their scores are exact.

There are two scans. For positives (the best rows of the anchor's label) a row leaves when
its upper bound is below the `k`-th best lower bound, or score, known. For negatives each
positive opens a window of scores (a share of its own score); a row leaves when it lies
outside of every window for sure, or below as many rows that are in the window for sure as
are asked for.

The anchors are a stated query set, held against all rows. They are packed in blocks too;
a round takes a share of the anchor blocks that `round_bytes` bounds, broadcasts those and
reads the row blocks where they are, so the rows are never shuffled for the scan, and a task
hands on at most the best few for each anchor. A table with more anchors takes more rounds.

Defined results: rows with a null label, a null vector or a null or non-finite component
take no part; vectors of other lengths are not compared. Rows are told apart by a number of
their own: repeated ids are different rows, null ids come last among equal scores. If scores
might not fit 55 bits, an error is raised. Further columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Rows of a block, anchors of an anchor block, bytes of the anchors of a round, dimensions between two looks at the bounds.
BLOCK_ROWS, ANCHOR_ROWS, ROUND_BYTES, STRIDE = 8192, 512, 32 << 20, 8
NO_ID = (1 << 63) - 1  # a null id in a task: comes last
_BLOCK = "dim int, rows binary, ids binary, labels binary, vectors binary"
_HIT = "anchor long, window int, row long, id long, score long"


def usable(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, id, label, v): rows that take part, with integer components."""
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floored = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(label.isNotNull() & whole).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), floored.alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks of one vector length, sorted by label; vectors dimension by dimension. Windows, if the rows have some, go along."""
    windowed = "windows" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        waiting = 0

        def block(dim: int) -> pa.RecordBatch:
            part = sorted(held.pop(dim), key=lambda r: r[2])
            x = np.array([r[3] for r in part], np.float64).reshape(len(part), dim)
            if x.size and np.abs(x).max() ** 2 * dim >= 1 << 55:
                raise ArithmeticError("components are too large for scores of 55 bits")
            columns = [np.array([r[k] for r in part], np.int64) for k in range(3)] + [x.T.astype(np.int64)]
            if windowed:
                columns.append(np.concatenate([r[4] for r in part]))
            names = ["dim", "rows", "ids", "labels", "vectors", *["windows"] * windowed]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names)

        for batch in batches:
            more = (w.values.to_numpy() for w in batch.column("windows")) if windowed else [None] * batch.num_rows
            for row, i, label, v, own in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "label")), batch.column("v"), more):
                v = v.values.to_numpy()
                part = held.setdefault(len(v), [])
                part.append((row, NO_ID if i is None else i, label, v, own))
                waiting += 1
                if len(part) == size:
                    waiting -= size
                    yield block(len(v))
            if waiting > 4 * size:  # vectors of very many lengths
                yield from map(block, list(held))
                waiting = 0
        yield from map(block, list(held))

    return rows.mapInArrow(run, _BLOCK + ", windows binary" * windowed)


class Block:
    """A block's columns, and what the remaining dimensions can contribute."""

    def __init__(self, dim: int, rows: bytes, ids: bytes, labels: bytes, vectors: bytes):
        self.rows, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
        self.vectors = np.frombuffer(vectors, np.int64).reshape(dim, len(self.rows))
        self.low, self.high = self.vectors.min(axis=1), self.vectors.max(axis=1)
        self.most = max(int(np.abs(self.vectors).max(initial=0)), 1)
        self.columns = self.vectors.astype(np.int32) if self.most < 1 << 31 else self.vectors

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, alive, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(candidates that stay, their exact scores). `alive(low, high)` tells from bounds of the scores which candidates may still matter."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        low, high = anchor * self.low, anchor * self.high
        least, most = np.minimum(low, high)[order], np.maximum(low, high)[order]
        rest_low, rest_high = least.sum(), most.sum()
        fits = int(np.abs(anchor).max(initial=0)) * self.most * len(anchor) < 1 << 31
        anchor, partial = (anchor.astype(np.int32), np.zeros(len(candidates), np.int32)) if fits else (anchor, np.zeros(len(candidates), np.int64))
        for at in range(0, len(order), stride):
            dims = order[at : at + stride]
            for d in dims:
                column = self.columns[d]
                partial += anchor[d] * (column if len(candidates) == len(column) else column[candidates])
            rest_low -= least[at : at + stride].sum()
            rest_high -= most[at : at + stride].sum()
            stays = alive(partial + rest_low, partial + rest_high)
            if not stays.all():
                candidates, partial = candidates[stays], partial[stays]
                if not len(candidates):
                    break
        return candidates, partial.astype(np.int64)


def _best(k: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first k by descending score, then id, then row."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]


def _batch(anchor, window, row, ids, score) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (anchor, window, row, ids, score)]
    ids = pa.array(columns[3], mask=columns[3] == NO_ID)
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), ids, pa.array(columns[4])], ["anchor", "window", "row", "id", "score"])


class Kept:
    """The best few of each anchor and window that a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def worst(self, key: tuple[int, int]) -> int | None:
        """The score of the last one, once there are k."""
        held = self.held.get(key)
        return int(held[0][-1]) if held is not None and len(held[0]) == self.k else None

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(scores):
            return
        if (held := self.held.get(key)) is not None:
            scores, ids, rows = (np.concatenate(x) for x in zip(held, (scores, ids, rows)))
        at = _best(self.k, scores, ids, rows)
        self.held[key] = (scores[at], ids[at], rows[at])

    def batches(self) -> Iterator[pa.RecordBatch]:
        items = list(self.held.items())
        for at in range(0, len(items), 10_000):
            part = items[at : at + 10_000]
            full = [[np.full(len(v[0]), key[k], np.int64) for key, v in part] for k in range(2)]
            yield _batch(full[0], full[1], [v[2] for _, v in part], [v[1] for _, v in part], [v[0] for _, v in part])


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(k)
        for rows, anchors, _ in _met(batches):
            for at in range(len(anchors.rows)):
                same = rows.of_label(anchors.labels[at])
                candidates = np.arange(same.start, same.stop)
                candidates = candidates[rows.rows[candidates] != anchors.rows[at]]
                key = (int(anchors.rows[at]), 0)
                worst = kept.worst(key)

                def alive(low: np.ndarray, high: np.ndarray, worst=worst) -> np.ndarray:
                    known = np.partition(low, -k)[-k] if len(low) >= k else None
                    limit = max((x for x in (known, worst) if x is not None), default=None)
                    return np.ones(len(low), bool) if limit is None else high >= limit

                found, scores = rows.scan(anchors.vectors[:, at], candidates, alive)
                kept.add(key, scores, rows.ids[found], rows.rows[found])
        yield from kept.batches()

    return run


def _negatives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(k)
        for rows, anchors, windows in _met(batches):
            for at in range(len(anchors.rows)):
                own = windows[windows[:, 0] == anchors.rows[at]] if len(windows) else windows
                if not len(own):
                    continue
                same = rows.of_label(anchors.labels[at])
                candidates = np.r_[0 : same.start, same.stop : len(rows.rows)]
                bounds = [(int(w), int(lo), int(hi), kept.worst((int(anchors.rows[at]), int(w)))) for _, w, lo, hi in own]

                def alive(low: np.ndarray, high: np.ndarray, bounds=bounds) -> np.ndarray:
                    stays = np.zeros(len(low), bool)
                    for _, lo, hi, worst in bounds:
                        sure = low[(low >= lo) & (high <= hi)]
                        limit = max([lo, *[worst] * (worst is not None), *([np.partition(sure, -k)[-k]] if len(sure) >= k else [])])
                        stays |= (high >= limit) & (low <= hi)
                    return stays

                found, scores = rows.scan(anchors.vectors[:, at], candidates, alive)
                for w, lo, hi, _ in bounds:
                    inside = (scores >= lo) & (scores <= hi)
                    kept.add((int(anchors.rows[at]), w), scores[inside], rows.ids[found[inside]], rows.rows[found[inside]])
        yield from kept.batches()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block, np.ndarray]]:
    """Row blocks, each with an anchor block and the anchors' windows as (row, window, low, high)."""
    last, block = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c, r=r: batch.column(c)[r].as_py()
            name = get("block")
            if name != last:  # a block's anchor blocks follow each other
                last, block = name, Block(get("dim"), get("rows"), get("ids"), get("labels"), get("vectors"))
            anchors = Block(get("dim"), get("a_rows"), get("a_ids"), get("a_labels"), get("a_vectors"))
            windows = np.frombuffer(get("windows"), np.int64).reshape(-1, 4) if "windows" in batch.schema.names else np.zeros((0, 4), np.int64)
            yield block, anchors, windows


def _rounds(blocks: DataFrame, anchors: DataFrame, round_bytes: int, scan, k: int) -> DataFrame:
    """The best k of each anchor and window over all row blocks. The anchor blocks of a round, of checked size, are broadcast; the row blocks stay where they are."""
    size, n = anchors.agg(F.coalesce(F.sum(F.length("vectors")), F.lit(0)), F.count("*")).first()
    rounds = max(1, min(-(-size // round_bytes), n))
    named = anchors.select("dim", *(F.col(c).alias(f"a_{c}") for c in ("rows", "ids", "labels", "vectors")), *[c for c in anchors.columns if c == "windows"])
    found = None
    for turn in range(rounds):
        own = named if rounds == 1 else named.where(F.pmod(F.xxhash64("a_rows"), F.lit(rounds)) == turn)
        met = blocks.join(F.broadcast(own), "dim").mapInArrow(scan, _HIT)
        found = met if found is None else found.unionByName(met)
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return materialize(found).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
    least: int = 50, most: int = 95, scale: int = 256, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(anchor, anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on `id`) and each of its best rows of its label the best rows of other labels with a score of `least` to `most` percent of the positive's."""
    rows = materialize(usable(vectors, label, id_col, vector_col, scale))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    blocks = materialize(_packed(rows.repartition(n), block_rows).withColumn("block", F.monotonically_increasing_id()))
    chosen = materialize(rows.where(is_anchor))
    best = materialize(_rounds(blocks, materialize(_packed(chosen, anchor_rows)), round_bytes, _positives(positives), positives))
    floor = lambda x: f"({x} - pmod({x}, 100)) div 100"
    window = F.array(F.col("anchor"), F.col("rank").cast("long"), F.expr(f"-({floor(f'(-{least} * score)')})"), F.expr(floor(f"({most} * score)")))
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.flatten(F.collect_list(window)).alias("windows"))  # `positives` for each anchor at most
    hits = _rounds(blocks, materialize(_packed(chosen.join(windows, "row"), anchor_rows)), round_bytes, _negatives(negatives), negatives)
    pairs = best.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = hits.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "window"]).join(names, "anchor")
    return out.select("anchor", "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
