"""Point-in-time, range, reconciling and set joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.carry import bucket_of, last_known, with_carry
from tidemark.operators.lineage import checkpoint, materialize

_BLANK = re.compile(rb"[\x20\x09-\x0d]")

#: A side of a range join or a grid up to this many rows is broadcast.
SMALL_ROWS = 200_000


def is_small(df: DataFrame) -> bool:
    """Whether `df` has at most SMALL_ROWS rows. A count is summed in the tasks, where a limit would send rows of every partition to one."""
    return df.count() <= SMALL_ROWS


def null_safe_join(a: DataFrame, b: DataFrame, key: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null; the key stands once, as with a join by names. Other columns must differ in name."""
    right = b.withColumnsRenamed({k: f"_key_{k}" for k in key})
    j = a.join(right, reduce(lambda x, y: x & y, (a[k].eqNullSafe(right[f"_key_{k}"]) for k in key)), how)
    if how in ("left_anti", "left_semi"):
        return j
    return j.withColumns({k: F.coalesce(k, f"_key_{k}") for k in key}).drop(*(f"_key_{k}" for k in key))


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], by: list[str], cols: list[str], tolerance: str | None = None, direction: str = "backward", bucket: int | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it (`forward`: the earliest at or after), equal times matching.

    Both sides are tagged and united, and cut into buckets of time (`bucket` seconds); a
    window over (by, bucket) carries the last right row along from the one that earlier
    buckets hand over. So there is no range product, and one key may hold all rows. `on`
    are the time columns; of right rows at one time the last by `cols` counts. A left row
    without a time, or with a null in `by`, matches nothing.
    """
    lt, rt = on
    back = direction == "backward"
    whole = left.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in [lt, *by])))
    partial = left.where(reduce(lambda x, y: x | y, (F.col(c).isNull() for c in [lt, *by])))
    matched = _asof(whole, right, on, by, cols, tolerance, back, bucket)
    nothing = {c: F.lit(None).cast(matched.schema[c].dataType) for c in matched.columns if c not in left.columns}
    return matched.unionByName(partial.withColumns(nothing))


def _asof(left: DataFrame, right: DataFrame, on: tuple[str, str], by: list[str], cols: list[str], tolerance: str | None, back: bool, bucket: int | None) -> DataFrame:
    lt, rt = on
    keep = [F.col(c).alias(c) for c in left.columns]
    left_rows = left.select(*keep, F.col(lt).alias("_t"), F.lit(1 if back else 0).alias("_side"), F.lit(None).cast(right.select(F.struct(rt, *cols)).schema[0].dataType).alias("_r"))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in by else F.col(c) for c in left.columns]
    right_rows = right.where(F.col(rt).isNotNull()).select(*empty, F.col(rt).alias("_t"), F.lit(0 if back else 1).alias("_side"), F.struct(rt, *cols).alias("_r"))
    both = left_rows.unionByName(right_rows)
    both = with_carry(both, by, bucket_of(both, "_t", bucket), {"_r": (F.max("_r") if back else F.min("_r"), last_known)}, backwards=not back)
    order = [F.col("_t"), F.col("_side"), F.col("_r")] if back else [F.desc("_t"), F.desc("_side"), F.desc("_r")]
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("_carry"), *order)
    last = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = both.withColumn("_m", last).where((F.col("_side") == (1 if back else 0)) & ~F.col("_carry"))
    if tolerance is not None:
        near = F.col(f"_m.{rt}") >= F.col("_t") - F.expr(f"interval {tolerance}") if back else F.col(f"_m.{rt}") <= F.col("_t") + F.expr(f"interval {tolerance}")
        j = j.withColumn("_m", F.when(near, F.col("_m")))
    return j.select(*left.columns, F.col(f"_m.{rt}").alias(f"matched_{rt}"), *(F.col(f"_m.{c}").alias(c) for c in cols))


def interval_join(events: DataFrame, ranges: DataFrame, ts: str, start: str, end: str, by: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Events in [start, end). Both sides are cut into time buckets, so it is an equi-join with a residual; few ranges are broadcast."""
    b = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    last = F.floor((F.unix_micros(end) - 1) / (1_000_000 * bucket_seconds))
    r = ranges.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(b(start), last)))
    e = events.withColumn("_b", b(ts))
    return e.join(F.broadcast(r) if is_small(r) else r, [*by, "_b"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")


def enrich(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Add a dimension's columns; it is broadcast if a count of at most SMALL_ROWS + 1 rows says that it is small."""
    return df.join(F.broadcast(dim) if is_small(dim) else dim, on, "left")


def reconcile(local: DataFrame, remote: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Full diff of two books: matched, missing_local, missing_remote or mismatch, with a delta for each column."""
    a = local.select(*key, *(F.col(c).alias(f"local_{c}") for c in cols), F.lit(1).alias("_a"))
    b = remote.select(*key, *(F.col(c).alias(f"remote_{c}") for c in cols), F.lit(1).alias("_b"))
    j = null_safe_join(a, b, key, "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(f"local_{c}").eqNullSafe(F.col(f"remote_{c}")) for c in cols))
    state = F.when(F.col("_a").isNull(), "missing_local").when(F.col("_b").isNull(), "missing_remote").when(same, "matched").otherwise("mismatch")
    return j.select(*key, state.alias("state"), *((F.col(f"local_{c}") - F.col(f"remote_{c}")).alias(f"delta_{c}") for c in cols))


def duplicates_between(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `a` whose key `b` has too."""
    return a.join(b.select(*key).distinct(), key, "left_semi")


def parity(offline: DataFrame, online: DataFrame, key: list[str], col: str, tol: float = 1e-9) -> DataFrame:
    """Whether online values equal offline ones within a tolerance; a value on one side only does not."""
    j = null_safe_join(offline.select(*key, F.col(col).alias("offline")), online.select(*key, F.col(col).alias("online")), key, "full_outer")
    both_null = F.col("offline").isNull() & F.col("online").isNull()
    return j.withColumn("equal", both_null | F.coalesce(F.abs(F.col("offline") - F.col("online")) <= tol, F.lit(False)))


def deviation(modelled: DataFrame, actual: DataFrame, key: list[str], col: str, by: list[str]) -> DataFrame:
    """Modelled against actual values: rows, mean, mean absolute and largest deviation by group."""
    j = modelled.select(*key, *[b for b in by if b not in key], F.col(col).alias("m")).join(actual.select(*key, F.col(col).alias("a")), key)
    d = F.col("a") - F.col("m")
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("largest"))


def unique_match(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """A key's only value, or a conflict if there are several rows; one is never picked."""
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.first(value).alias("v"))
    return out.select(*key, "n", F.when(F.col("n") > 1, "conflict").otherwise("match").alias("state"), F.when(F.col("n") == 1, F.col("v")).alias(value))


def param_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every parameter set. The grid is a bounded list: more than SMALL_ROWS sets is an error."""
    if not is_small(grid):
        raise ValueError(f"a grid of over {SMALL_ROWS} parameter sets")
    return df.crossJoin(F.broadcast(grid))


def ngrams(text: Column, n: int) -> Column:
    """The distinct word n-grams of a lower-cased text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[^\\s]+"), 0)
    m = F.greatest(F.size(words) - (n - 1), F.lit(0))
    shifted = [F.slice(words, F.lit(k + 1), m).alias(str(k)) for k in range(n)]
    return F.array_distinct(F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *(z[str(k)] for k in range(n)))))


def _gram_names(text: bytes, n: int, bits: int, block: int = 1 << 20) -> np.ndarray:
    """The distinct names (hashes of `bits` bits) of the word n-grams of a text: the words are hashed once, block by block, and n of them combined as a polynomial."""
    found, carried, at = [np.zeros(0, np.uint64)], np.zeros(0, np.uint64), 0
    while at < len(text):
        gap = _BLANK.search(text, at + block) if at + block < len(text) else None
        end = gap.start() if gap else len(text)
        words = text[at:end].split()  # at ASCII white space
        h = np.r_[carried, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))]
        at, m = end, len(h) - n + 1
        if m > 0:
            name = np.zeros(m, np.uint64)
            for k in range(n):
                name = (name ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                name ^= name >> np.uint64(29)
            found.append(np.unique(name >> np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64))
        carried = h[max(m, 0) :] if n > 1 else h[:0]
    return np.unique(np.concatenate(found))


def _named(df: DataFrame, keep: list[str], n: int, bits: int, known: np.ndarray | None = None) -> DataFrame:
    """(keep, hash) for the n-grams of the column `_words`; of `known` hashes only, if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_gram_names(t.as_buffer().to_pybytes() if t.is_valid else b"", n, bits) for t in batch.column("_words")]
            if known is not None:
                names = [x[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x] if len(known) else x[:0] for x in names]
            row = pa.array(np.repeat(np.arange(len(names)), [len(x) for x in names]))
            flat = np.concatenate(names) if names else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keep), pa.array(flat.view(np.int64))], [*keep, "hash"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("hash", T.LongType())])
    return df.select(*keep, F.col("_words").cast("binary").alias("_words")).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", item_col: str = "item_id", bits: int = 64) -> DataFrame:
    """Documents that share word n-grams with a benchmark item, and how many of its n-grams.

    N-grams meet by hashed names. Those of a benchmark of up to SMALL_ROWS n-grams go to the
    tasks, so that only hits leave a document; a larger one is joined. What met is then
    checked word by word in the few texts concerned.
    """
    grams = materialize(benchmark.select(item_col, F.explode(ngrams(F.col("text"), n)).alias("gram")))
    b = materialize(_named(grams.withColumn("_words", F.col("gram")), [item_col, "gram"], n, bits))
    small = is_small(b)
    known = np.sort(np.array([r.hash for r in b.select("hash").distinct().collect()], np.int64).view(np.uint64)) if small else None
    d = _named(docs.select(id_col, F.lower("text").alias("_words")), [id_col], n, bits, known)
    met = checkpoint(d.join(F.broadcast(b) if small else b, "hash").select(id_col, item_col, "gram"))
    ids = met.select(id_col).distinct()
    texts = docs.join(F.broadcast(ids) if is_small(ids) else ids, id_col, "left_semi")
    padded = texts.select(id_col, F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[^\\s]+"), 0), " "), F.lit(" ")).alias("_words"))
    sure = met.join(padded, id_col).where(F.contains("_words", F.concat(F.lit(" "), "gram", F.lit(" "))))
    return sure.select(id_col, item_col, "gram").distinct().groupBy(id_col, item_col).agg(F.count("*").alias("shared"))


def merged_names(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """The distinct names of either side."""
    return a.select(col).union(b.select(col)).distinct()


def set_delta_rows(before: DataFrame, after: DataFrame, by: list[str], item: str) -> DataFrame:
    """X2 in rows: (by, item, state) with the state added, removed or kept; a group may have any number of members."""
    x = before.select(*by, item).distinct().withColumn("_b", F.lit(True))
    y = after.select(*by, item).distinct().withColumn("_a", F.lit(True))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("kept")
    return null_safe_join(x, y, [*by, item], "full_outer").select(*by, item, state.alias("state"))


def set_delta(before: DataFrame, after: DataFrame, by: list[str], item: str) -> DataFrame:
    """By group the members added, removed and kept, as sorted lists, for groups whose members fit a row; `set_delta_rows` has no such bound."""
    rows = set_delta_rows(before, after, by, item)
    pick = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col(item)))).alias(state)
    return rows.groupBy(*by).agg(*map(pick, ("added", "removed", "kept")))


def bounded_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """O1: the first n rows with the full count and whether rows were cut."""
    total = df.count()
    return df.orderBy(*order).limit(n).withColumns({"total": F.lit(total), "truncated": F.lit(total > n)})


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """O2: the first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def detect_many(df: DataFrame, key: Column) -> str:
    """O3: none, one or many rows meet a condition; at most two are fetched."""
    return ("none", "one", "many")[len(df.where(key).limit(2).collect())]
