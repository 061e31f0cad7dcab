"""Bars from trades, resampling, and sequence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import bucket_of, last_known, with_carry


def trades_to_bars(trades: DataFrame, width: str = "1 hour") -> DataFrame:
    """A1: OHLCV per instrument and window; open and close by (ts, seq). One shuffle, all aggregates partial."""
    at = F.struct("ts", "seq")
    out = trades.groupBy("instrument", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("n"),
    )
    return out.select("instrument", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n")


def resample_bars(bars: DataFrame, width: str, base_per_bar: int) -> DataFrame:
    """A2: wider bars from base bars only, with the number of base bars and whether all are there."""
    out = bars.groupBy("instrument", F.window("bar_start", width).alias("w")).agg(
        F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_start").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_base"),
    )
    return out.select("instrument", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n_base", (F.col("n_base") == base_per_bar).alias("complete"))


def dedup_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`, which must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def check_monotonic(df: DataFrame, by: str, arrival: str, ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """In arrival order, rows behind the latest time seen so far and rows that repeat the time before. An instrument is cut into buckets of its arrival order."""
    rows = df.withColumns({"_high": F.col(ts), "_last": F.struct(F.col(ts).alias("v"))})
    rows = with_carry(rows, [by], bucket_of(df, arrival, bucket), {"_high": (F.max("_high"), F.max), "_last": (F.max_by("_last", arrival), last_known)})
    w = Window.partitionBy(by, "_b").orderBy(F.desc("_carry"), arrival)
    seen = F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumns({"out_of_order": F.coalesce(F.col(ts) < seen, F.lit(False)), "duplicate_time": F.coalesce(F.col(ts) == F.lag("_last").over(w)["v"], F.lit(False))})
    return out.where(~F.col("_carry")).select(*df.columns, "out_of_order", "duplicate_time")


def find_gaps(bars: DataFrame, width: str) -> DataFrame:
    """Missing intervals [gap_start, gap_end) per instrument and how many bars they hold."""
    step = F.expr(f"interval {width}")
    end = F.col("bar_start") + step
    nxt = F.lead("bar_start").over(Window.partitionBy("instrument").orderBy("bar_start"))
    out = bars.select("instrument", end.alias("gap_start"), nxt.alias("gap_end")).where("gap_end > gap_start")
    seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + step)
    return out.withColumn("missing", ((F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start")) / seconds).cast("bigint"))


def fill_grid(bars: DataFrame, width: str) -> DataFrame:
    """W3, filled form: the start of every bar that is missing between an instrument's first and last."""
    ends = bars.groupBy("instrument").agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b"))
    grid = ends.select("instrument", F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("bar_start"))
    return grid.join(bars.select("instrument", "bar_start"), ["instrument", "bar_start"], "left_anti")


def check_sequence(df: DataFrame, by: str, order: list[str], seq: str = "seq", bucket: int | None = None) -> DataFrame:
    """Jumps and repeats of a sequence number. An instrument is cut into buckets of the first order column."""
    rows = df.withColumn("_last", F.struct(F.col(seq).alias("v")))
    rows = with_carry(rows, [by], bucket_of(df, order[0], bucket), {"_last": (F.max_by("_last", F.struct(*order)), last_known)})
    step = F.col(seq) - F.lag("_last").over(Window.partitionBy(by, "_b").orderBy(F.desc("_carry"), *order))["v"]
    out = rows.withColumn("step", step).where(~F.col("_carry"))
    return out.select(*df.columns, "step", F.coalesce(F.col("step") > 1, F.lit(False)).alias("is_break"), F.coalesce(F.col("step") == 0, F.lit(False)).alias("is_duplicate"))


def gap_rate(bars: DataFrame, width: str) -> DataFrame:
    """Missing bars over expected bars per instrument."""
    seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {width}"))
    out = bars.groupBy("instrument").agg(F.count("*").alias("present"), ((F.unix_timestamp(F.max("bar_start")) - F.unix_timestamp(F.min("bar_start"))) / F.first(seconds) + 1).cast("bigint").alias("expected"))
    return out.withColumn("gap_rate", F.try_divide(F.col("expected") - F.col("present"), F.col("expected")))
