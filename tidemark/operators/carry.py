"""Windows over groups of any size: a group is cut into buckets of its order, and each bucket starts from what the earlier ones carry over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.lineage import materialize

#: Width of a bucket: seconds of a time, units of a number.
SECONDS, UNITS = 86_400, 1_000_000


def bucket_of(df: DataFrame, col: str, width: int | None = None) -> Column:
    """The bucket of an ordering column, a time or a number; in the same order as the column."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / (1_000_000 * (width or SECONDS)))
    return F.floor(F.col(col) / (width or UNITS))


def with_carry(df: DataFrame, by: list[str], bucket: Column, carried: dict[str, tuple[Column, Callable[[Column], Column]]], backwards: bool = False) -> DataFrame:
    """`df` with its bucket `_b`, and one row more for each group and bucket, marked by `_carry`, with what the earlier buckets (`backwards`: the later ones) carry over.

    `carried` has for each column the aggregate of a bucket and how aggregates of several
    buckets combine, as a window function. A window over (by, _b) that takes the `_carry`
    row first then gives what one over `by` would, with tasks as small as a bucket: the
    window over whole groups sees one row for each bucket. Other columns of `_carry` rows
    are null.
    """
    rows = df.withColumn("_b", bucket)
    summed = rows.groupBy(*by, "_b").agg(*(agg.alias(name) for name, (agg, _) in carried.items()))
    before = Window.partitionBy(*by).orderBy(F.desc("_b") if backwards else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    told = summed.select(*by, "_b", *(how(F.col(name)).over(before).alias(name) for name, (_, how) in carried.items()), F.lit(True).alias("_carry"))
    return rows.withColumn("_carry", F.lit(False)).unionByName(told, allowMissingColumns=True)


def last_known(col: Column) -> Column:
    return F.last(col, ignorenulls=True)


def ranked(df: DataFrame, by: list[str], order: list[str], bucket: int | None = None, name: str = "_rank") -> DataFrame:
    """The number of each row, from 0, in the order of its group: counts are carried from bucket to bucket of the first order column."""
    rows = with_carry(df.withColumn("_n", F.lit(1).cast("long")), by, bucket_of(df, order[0], bucket), {"_n": (F.count("*"), F.sum)})
    upto = Window.partitionBy(*by, "_b").orderBy(F.desc("_carry"), *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum("_n").over(upto) - 1).where(~F.col("_carry")).drop("_n", "_b", "_carry")


#: Rows that one composition of maps takes at a time.
RADIX = 64
Compose = Callable[[Column, Column], Column]


def _folded(rows: DataFrame, by: list[str], compose: Compose, identity: Column, radix: int) -> DataFrame:
    """(by, _rank, _map) of blocks of `radix` rows, each with the composition of its maps."""
    maps = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_map"))), lambda x: x["_map"])
    return rows.groupBy(*by, F.floor(F.col("_rank") / radix).alias("_block")).agg(F.aggregate(maps, identity, compose).alias("_map")).withColumnRenamed("_block", "_rank")


def compose_all(rows: DataFrame, by: list[str], compose: Compose, identity: Column, radix: int = RADIX) -> DataFrame:
    """(by, _map): the maps of each group composed in the order of `_rank`, earlier maps first.

    Composition is associative, so `radix` maps become one, level by level: a group may have
    any number of rows, and no task sees more than `radix` of one.
    """
    most = rows.agg(F.max("_rank")).first()[0] or 0
    out = rows.select(*by, "_rank", "_map")
    while True:
        out = _folded(out, by, compose, identity, radix)
        if most < radix:
            return out.drop("_rank")
        most //= radix


def compose_before(rows: DataFrame, by: list[str], compose: Compose, identity: Column, radix: int = RADIX, most: int | None = None) -> DataFrame:
    """`rows`, a written table, with `_before`: the composition of the maps of all rows before it in its group, by `_rank`. Blocks of `radix` rows start from what the blocks before them make, which is told in the same way."""
    if most is None:
        most = rows.agg(F.max("_rank")).first()[0] or 0
    block = F.floor(F.col("_rank") / radix)
    marked = rows.withColumns({"_block": block, "_start": F.lit(False)})
    if most >= radix:
        blocks = materialize(_folded(rows.select(*by, "_rank", "_map"), by, compose, identity, radix))
        started = compose_before(blocks, by, compose, identity, radix, most // radix)
        starts = started.select(*by, F.col("_rank").alias("_block"), F.lit(-1).cast("long").alias("_rank"), F.col("_before").alias("_map"), F.lit(True).alias("_start"))
        marked = marked.unionByName(starts, allowMissingColumns=True)
    before = Window.partitionBy(*by, "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumn("_before", F.aggregate(F.collect_list("_map").over(before), identity, compose))
    return out.where(~F.col("_start")).drop("_block", "_start")
