"""Features over bars, trades and quotes, and labels. Frames end at the current row or before it, never after; labels look ahead on purpose.

All bar features share one window specification (instrument, bar_start), so a chain of them has one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.carry import bucket_of, with_carry
from tidemark.operators.joins import asof_join, null_safe_join
from tidemark.operators.lineage import materialize


def by_bar() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("bar_start")


def trailing(n: int) -> WindowSpec:
    return by_bar().rowsBetween(1 - n, 0)


def _full(value: Column, n: int) -> Column:
    """A rolling value only where the frame holds n rows."""
    return F.when(F.count(F.lit(1)).over(trailing(n)) >= n, value)


def zscore(col: Column, n: int) -> Column:
    sd = F.stddev_samp(col).over(trailing(n))
    return _full((col - F.avg(col).over(trailing(n))) / F.when(sd > 0, sd), n)


def log_return(k: int = 1) -> Column:
    """Null where either price is not positive."""
    was = F.lag("close", k).over(by_bar())
    return F.when((F.col("close") > 0) & (was > 0), F.log(F.when(F.col("close") > 0, F.col("close"))) - F.log(F.when(was > 0, was)))


def returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 4, 24)) -> DataFrame:
    """Simple and log returns over several horizons."""
    cols = {f"ret_{k}": F.try_divide(F.col("close"), F.lag("close", k).over(by_bar())) - 1 for k in horizons}
    return bars.withColumns(cols | {f"logret_{k}": log_return(k) for k in horizons})


def volatility(bars: DataFrame, n: int = 24) -> DataFrame:
    """Realised volatility, mean high-low range, and a jump proxy: realised less bipower variation."""
    b = bars.withColumn("_r", log_return())
    b = b.withColumn("_x", F.abs("_r") * F.abs(F.lag("_r").over(by_bar())))
    rv, bv = F.sum(F.col("_r") * F.col("_r")).over(trailing(n)), F.sum("_x").over(trailing(n)) * 1.5707963267948966
    return b.withColumns({
        "vol": _full(F.stddev_samp("_r").over(trailing(n)), n), "range": _full(F.avg(F.col("high") - F.col("low")).over(trailing(n)), n),
        "jump": _full(F.greatest(rv - bv, F.lit(0.0)), n),
    }).drop("_r", "_x")


#: Rows that an earlier-and-smaller count compares directly; beyond, blocks of that many are merged two by two.
LEAF = 64


def smaller_before(df: DataFrame, by: list[Column], order: str, value: str, name: str, leaf: int = LEAF) -> DataFrame:
    """For each row the number of earlier rows of its group with a smaller value (nulls are not smaller).

    Rows of a block of `leaf` in time are compared in a frame of that size. At each level
    above, blocks are paired, and rows of the later block count the smaller ones of the
    earlier block by one running sum in the order of values: n log n rows in all, and no
    frame that grows.
    """
    keys = [f"_g{k}" for k in range(len(by))]
    rows = df.withColumns(dict(zip(keys, by))).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    rows = materialize(rows)
    near = F.collect_list(value).over(Window.partitionBy(*keys, F.floor(F.col("_i") / leaf)).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn(name, F.size(F.filter(near, lambda v: v < F.col(value))).cast("long"))
    most = rows.agg(F.max("_i")).first()[0] or 0
    levels = [k for k in range(40) if leaf << k <= most]
    if levels:
        block = F.floor(F.col("_i") / F.element_at(F.array(*(F.lit(leaf << k) for k in levels)), F.col("_level") + 1))
        dealt = rows.select(*keys, "_i", F.col(value).alias("_v"), F.explode(F.array(*map(F.lit, levels))).alias("_level")).withColumn("_block", block)
        dealt = dealt.withColumns({"_early": F.col("_block") % 2 == 0, "_pair": F.floor(F.col("_block") / 2)})
        upto = Window.partitionBy(*keys, "_level", "_pair").orderBy("_v", "_early").rowsBetween(Window.unboundedPreceding, 0)
        counted = dealt.withColumn("_n", F.count_if(F.col("_early") & F.col("_v").isNotNull()).over(upto)).where(~F.col("_early"))
        far = counted.groupBy(*keys, "_i").agg(F.sum("_n").alias("_far"))
        out = null_safe_join(out, far, [*keys, "_i"], "left").withColumn(name, F.col(name) + F.coalesce("_far", F.lit(0)))
    return out.select(*df.columns, name)


def volume_surprise(bars: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Volume over its mean at the same hour of all earlier days, and the share of those days below it."""
    hour = F.hour("bar_start")
    past = Window.partitionBy("instrument", hour).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, -1)
    told = bars.withColumns({"_mean": F.avg("volume").over(past), "_seen": F.count("volume").over(past)})
    told = smaller_before(told, [F.col("instrument"), hour], "bar_start", "volume", "_below", leaf)
    return told.select(*bars.columns, F.try_divide(F.col("volume"), F.col("_mean")).alias("volume_ratio"), F.try_divide(F.col("_below"), F.nullif(F.col("_seen"), F.lit(0).cast("long"))).alias("volume_percentile"))


def basis(marked: DataFrame, n: int = 24) -> DataFrame:
    """(mark - index) / index and its z-score, from rows (instrument, bar_start, mark, index)."""
    return marked.withColumn("basis", F.try_divide(F.col("mark") - F.col("index"), F.col("index"))).withColumn("basis_z", zscore(F.col("basis"), n))


def funding_deviation(funding: DataFrame, n: int = 3) -> DataFrame:
    """Each rate less the rolling mean of its own kind (predicted and settled are never mixed)."""
    w = Window.partitionBy("instrument", "kind").orderBy("ts").rowsBetween(1 - n, 0)
    return funding.withColumn("deviation", F.when(F.count(F.lit(1)).over(w) >= n, F.col("rate") - F.avg("rate").over(w)))


def oi_price_state(df: DataFrame) -> DataFrame:
    """The state by the signs of the changes of open interest and price."""
    d_oi, d_px = F.col("oi") - F.lag("oi").over(by_bar()), F.col("close") - F.lag("close").over(by_bar())
    state = F.when((d_oi > 0) & (d_px > 0), "long_build").when((d_oi > 0) & (d_px < 0), "short_build").when((d_oi < 0) & (d_px > 0), "short_cover").when((d_oi < 0) & (d_px < 0), "long_exit").when(d_oi.isNotNull() & d_px.isNotNull(), "flat")
    return df.withColumn("oi_state", state)


def flow_imbalance(trades: DataFrame, bucket: int, seconds: int | None = None) -> DataFrame:
    """Signed imbalance in equal-volume buckets of each instrument's trades in (ts, seq) order. The running volume is carried from one span of `seconds` to the next."""
    rows = with_carry(trades.withColumn("_v", F.col("qty")), ["instrument"], bucket_of(trades, "ts", seconds), {"_v": (F.sum("_v"), F.sum)})
    upto = F.sum("_v").over(Window.partitionBy("instrument", "_b").orderBy(F.desc("_carry"), "ts", "seq").rowsBetween(Window.unboundedPreceding, -1))
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    dealt = rows.withColumn("bucket", F.floor(F.coalesce(upto, F.lit(0)) / bucket)).where(~F.col("_carry"))
    out = dealt.groupBy("instrument", "bucket").agg(F.sum(signed).alias("signed"), F.sum("qty").alias("volume"))
    return out.withColumn("imbalance", F.try_divide(F.col("signed"), F.col("volume")))


def flow_imbalance_by_time(trades: DataFrame, width: str) -> DataFrame:
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    out = trades.groupBy("instrument", F.window("ts", width).alias("w")).agg(F.sum(signed).alias("signed"), F.sum("qty").alias("volume"))
    return out.select("instrument", F.col("w.start").alias("bar_start"), "signed", "volume", F.try_divide(F.col("signed"), F.col("volume")).alias("imbalance"))


def book_features(ticker: DataFrame) -> DataFrame:
    """Spread, mid and top-of-book imbalance."""
    size = F.col("bid_size") + F.col("ask_size")
    return ticker.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2, "book_imbalance": F.try_divide(F.col("bid_size") - F.col("ask_size"), size)})


def regime(df: DataFrame, col: str = "vol", n: int = 24) -> DataFrame:
    """Calm, normal or stressed by mean and deviation of the trailing frame."""
    mean, sd = F.avg(col).over(trailing(n)), F.stddev_samp(col).over(trailing(n))
    full = F.count(col).over(trailing(n)) >= n
    return df.withColumn("regime", F.when(full & (F.col(col) > mean + sd), "stressed").when(full & (F.col(col) < mean - sd), "calm").when(full, "normal"))


def build_features(
    bars: DataFrame, lookback: int = 24, version: str = "f1", width: str = "1 hour", marks: DataFrame | None = None, funding: DataFrame | None = None,
    interest: DataFrame | None = None, flow: DataFrame | None = None, book: DataFrame | None = None, surprise: bool = False,
) -> DataFrame:
    """One table of features of each bar, with a flag for enough history and the feature version.

    Always returns, volatility, regime and volume z-score (W5, W6, W13); with `surprise` W7.
    Of the tables that are given: `marks` (instrument, bar_start, mark, index) adds W8, `flow`
    (instrument, bar_start, imbalance) W11. What has times of its own joins point in time, as
    known at the end of the bar: settled `funding` (instrument, kind, ts, rate) as W9,
    `interest` (instrument, ts, oi) as W10, `book` (instrument, ts, quotes) as W12.
    """
    out = regime(volatility(returns(bars), lookback), "vol", lookback).withColumn("volume_z", zscore(F.col("volume").cast("double"), lookback))
    out = out.withColumns({"enough": F.count(F.lit(1)).over(by_bar().rowsBetween(-lookback, 0)) > lookback, "feature_version": F.lit(version)})
    if surprise:
        out = volume_surprise(out)
    if marks is not None:
        out = out.join(basis(marks, lookback).select("instrument", "bar_start", "basis", "basis_z"), ["instrument", "bar_start"], "left")
    if flow is not None:
        out = out.join(flow.select("instrument", "bar_start", "imbalance"), ["instrument", "bar_start"], "left")
    timed = out.withColumn("_end", F.col("bar_start") + F.expr(f"interval {width}"))
    known = lambda df, right, cols: asof_join(df, right, ("_end", "ts"), ["instrument"], cols).drop("matched_ts")
    if funding is not None:
        told = funding_deviation(funding).where("kind = 'settled'").select("instrument", "ts", F.col("rate").alias("funding_rate"), F.col("deviation").alias("funding_deviation"))
        timed = known(timed, told, ["funding_rate", "funding_deviation"])
    if interest is not None:
        timed = oi_price_state(known(timed, interest, ["oi"]))
    if book is not None:
        timed = known(timed, book_features(book), ["spread", "mid", "book_imbalance"])
    return timed.drop("_end")


# --- labels ---------------------------------------------------------------------
def label_forward_return(bars: DataFrame, horizon: int = 3, delay: int = 1) -> DataFrame:
    """L1: return from t + delay to t + delay + horizon, with the time at which it settles; null at the right edge."""
    a, b = F.lead("close", delay).over(by_bar()), F.lead("close", delay + horizon).over(by_bar())
    return bars.withColumns({"label": F.try_divide(b, a) - 1, "label_end": F.lead("bar_start", delay + horizon).over(by_bar())})


def label_net(labelled: DataFrame, fee: float = 0.00055, slippage: float = 0.0001, funding: str | None = None) -> DataFrame:
    """L2: the label less fee and slippage on both ways and the funding paid over the hold."""
    paid = F.coalesce(F.col(funding), F.lit(0.0)) if funding else F.lit(0.0)
    return labelled.withColumn("label_net", F.col("label") - 2 * (fee + slippage) - paid)


def funding_over_hold(labelled: DataFrame, settled: DataFrame, start: str, end: str) -> DataFrame:
    """Settled rates with start < settle_ts <= end, summed, by an equi-join on day buckets."""
    from tidemark.operators.joins import interval_join

    holds = labelled.where(F.col(end).isNotNull()).select("instrument", start, (F.col(start) + F.expr("interval 1 microsecond")).alias("_s"), (F.col(end) + F.expr("interval 1 microsecond")).alias("_e"))
    rates = settled.select("instrument", F.col("ts").alias("settle_ts"), "rate")
    met = interval_join(rates, holds, "settle_ts", "_s", "_e", ["instrument"]).groupBy("instrument", start).agg(F.sum("rate").alias("funding_paid"))
    return labelled.join(met, ["instrument", start], "left")


def label_direction(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """L3: -1, 0 or 1 by the net return."""
    return df.withColumn("direction", F.when(F.col("label_net") > threshold, 1).when(F.col("label_net") < -threshold, -1).when(F.col("label_net").isNotNull(), 0))


def label_first_touch(bars: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    """L3, path form: the barrier that a following close crosses first within the horizon; 0 if none is, null without a whole horizon."""
    ahead = F.array(*(F.try_divide(F.lead("close", k).over(by_bar()), F.col("close")) - 1 for k in range(1, horizon + 1)))
    touched = F.filter(F.transform(ahead, lambda r: F.when(r >= up, 1).when(r <= -down, -1)), lambda x: x.isNotNull())
    whole = F.lead("close", horizon).over(by_bar()).isNotNull()
    return bars.withColumn("touch", F.when(whole, F.coalesce(F.try_element_at(touched, F.lit(1)), F.lit(0))))
