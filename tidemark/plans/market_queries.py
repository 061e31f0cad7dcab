"""Queries for bars, joins, features and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.operators.lineage import shared_folder
from tidemark.plans.base import BARS, FILLS, TRADES, query
from tidemark.sources import ingest as I
from tidemark.sources.tables import fills, ntz, table, trades


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trades_to_bars(trades(spark, sf_dir), "1 hour")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for queries that write what they read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _r(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


# --- sources -------------------------------------------------------------------
@query("""select o_orderstatus, count(*) as n_rows, count(distinct o_orderkey) as n_keys, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts from orders group by 1""")
def c4_land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed twice is landed once: the second landing only appends what is not there."""
    o, path = table(spark, sf_dir, "orders"), fresh_path(spark, "landed")
    I.land_raw(o.where("o_orderkey % 2 = 0"), path, ["o_orderkey"], ["o_orderstatus"])
    for _ in range(2):
        I.land_raw(o, path, ["o_orderkey"], ["o_orderstatus"])
    return table_at(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))


@query("""select event_type, count(*) as n_rows, count(distinct event_id) as n_keys, min(ts) as first_ts, max(ts) as last_ts from events group by 1""")
def c5_build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_manifest(table(spark, sf_dir, "events"), ["event_type"], "event_id", "ts").drop("digest")


@query("""select user_id, case when user_id % 5 = 0 then 'mismatch' when user_id % 7 = 0 then 'missing' else 'match' end as state from (select distinct user_id from events)""")
def c6_verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.build_manifest(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts")
    actual = m.where("user_id % 5 = 0 or user_id % 7 <> 0").withColumn("digest", F.when(F.col("user_id") % 5 == 0, "other").otherwise(F.col("digest")))
    return I.verify_manifest(m, actual, ["user_id"])


@query("""select 'ev-' || substr(sha256('{"c_mktsegment":"' || c_mktsegment || '"}'), 1, 16) as snapshot_id, 1 as n from customer group by c_mktsegment""")
def c7_store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "snapshots")
    for _ in range(2):
        I.store_snapshot(table(spark, sf_dir, "customer").select("c_mktsegment"), path, ["c_mktsegment"])
    return table_at(spark, path).groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query("""select source, count(*) as n from (select case when event_id % 3 = 0 then 'live' when event_id % 3 = 1 then 'recent' else 'backfill' end as source from events) group by 1""")
def c10_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    parts = [("live", e.where("event_id % 3 = 0")), ("recent", e.where("event_id % 3 <= 1")), ("backfill", e)]
    return I.union_sources(parts, ["event_id"], ["ts"]).groupBy("source").agg(F.count("*").alias("n"))


# --- bars -----------------------------------------------------------------------
@query(f"with {BARS} select instrument, bar_start, open, high, low, close, volume, n from bars")
def a1_trades_to_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(bars(spark, sf_dir), "bar_start")


@query(f"""with {BARS} select instrument, time_bucket(interval '4 hours', bar_start) as bar_start, first(open order by bar_start) as open, max(high) as high, min(low) as low,
    last(close order by bar_start) as close, sum(volume)::bigint as volume, count(*) as n_base, count(*) = 4 as complete from bars group by 1, 2""")
def a2_resample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(B.resample_bars(bars(spark, sf_dir), "4 hours", 4), "bar_start")


@query(f"""with {TRADES} select account, instrument, seq, price from trades qualify row_number() over (partition by account, instrument order by ts desc, seq desc) = 1""")
def w1_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return B.dedup_latest(t, ["account", "instrument"], [F.desc("ts"), F.desc("seq")]).select("account", "instrument", "seq", "price")


@query(f"""with {TRADES}, a as (select *, seq % 7 * 1000000000 + seq as arrival from trades)
    select instrument, count(*) filter (where ooo) as out_of_order, count(*) filter (where dup) as duplicates from
    (select instrument, coalesce(ts < max(ts) over (partition by instrument order by arrival rows between unbounded preceding and 1 preceding), false) as ooo,
        coalesce(ts = lag(ts) over (partition by instrument order by arrival), false) as dup from a) group by 1""")
def w2_check_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("arrival", F.col("seq") % 7 * 1_000_000_000 + F.col("seq"))
    return B.check_monotonic(t, "instrument", "arrival").groupBy("instrument").agg(F.count_if("out_of_order").alias("out_of_order"), F.count_if("duplicate_time").alias("duplicates"))


_GAPS = "gaps as (select * from (select instrument, bar_start + interval 1 hour as gap_start, lead(bar_start) over (partition by instrument order by bar_start) as gap_end from bars) where gap_end > gap_start)"


@query(f"with {BARS}, {_GAPS} select instrument, gap_start, gap_end, (epoch(gap_end - gap_start) / 3600)::bigint as missing from gaps")
def w3_find_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(B.find_gaps(bars(spark, sf_dir), "1 hour"), "gap_start", "gap_end")


@query(f"with {BARS}, {_GAPS} select instrument, unnest(range(gap_start, gap_end, interval 1 hour)) as bar_start from gaps")
def w3_fill_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(B.fill_grid(bars(spark, sf_dir), "1 hour"), "bar_start")


@query("""select event_type as instrument, seq, step, coalesce(step > 1, false) as is_break, coalesce(step = 0, false) as is_duplicate from
    (select event_type, event_id // 2 as seq, event_id // 2 - lag(event_id // 2) over (partition by event_type order by ts, event_id) as step from events)""")
def w4_check_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("instrument"), "ts", "event_id", F.floor(F.col("event_id") / 2).alias("seq"))
    return B.check_sequence(e, "instrument", ["ts", "event_id"]).select("instrument", "seq", "step", "is_break", "is_duplicate")


@query(f"""with {BARS}, g as (select instrument, count(*) as present, (epoch(max(bar_start) - min(bar_start)) / 3600 + 1)::bigint as expected from bars group by 1)
    select *, round((expected - present) / expected, 6) as gap_rate from g""")
def a16_gap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.gap_rate(bars(spark, sf_dir), "1 hour"), "gap_rate")


# --- joins ------------------------------------------------------------------------
@query(f"""with {BARS}, b as (select instrument, bar_start + interval 1 hour as known_ts, close as last_close from bars)
    select t.instrument, t.seq, b.known_ts as matched_known_ts, b.last_close from trades t asof left join b on t.instrument = b.instrument and t.ts >= b.known_ts""")
def j1_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bars(spark, sf_dir).select("instrument", (F.col("bar_start") + F.expr("interval 1 hour")).alias("known_ts"), F.col("close").alias("last_close"))
    out = J.asof_join(trades(spark, sf_dir).select("instrument", "ts", "seq"), known, ("ts", "known_ts"), ["instrument"], ["last_close"])
    return ntz(out.select("instrument", "seq", "matched_known_ts", "last_close"), "matched_known_ts")


@query(f"""with {BARS}, b as (select instrument, bar_start + interval 1 hour as known_ts, close as last_close from bars)
    select t.instrument, t.seq, case when b.known_ts >= t.ts - interval 90 minute then b.last_close end as last_close from trades t asof left join b on t.instrument = b.instrument and t.ts >= b.known_ts""")
def j1_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bars(spark, sf_dir).select("instrument", (F.col("bar_start") + F.expr("interval 1 hour")).alias("known_ts"), F.col("close").alias("last_close"))
    out = J.asof_join(trades(spark, sf_dir).select("instrument", "ts", "seq"), known, ("ts", "known_ts"), ["instrument"], ["last_close"], tolerance="90 minutes")
    return out.select("instrument", "seq", "last_close")


@query(f"""with {BARS}, b as (select instrument, bar_start as at_ts, open as next_open from bars)
    select t.instrument, t.seq, b.at_ts as matched_at_ts, b.next_open from trades t asof left join b on t.instrument = b.instrument and t.ts <= b.at_ts""")
def j1_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = bars(spark, sf_dir).select("instrument", F.col("bar_start").alias("at_ts"), F.col("open").alias("next_open"))
    out = J.asof_join(trades(spark, sf_dir).select("instrument", "ts", "seq"), nxt, ("ts", "at_ts"), ["instrument"], ["next_open"], direction="forward")
    return ntz(out.select("instrument", "seq", "matched_at_ts", "next_open"), "matched_at_ts")


@query(f"""with {BARS}, r as (select instrument, bar_start as s, bar_start + interval 150 minute as e from bars where n >= 2)
    select t.instrument, r.s as range_start, count(*) as n, sum(t.qty)::bigint as qty from trades t join r on t.instrument = r.instrument and t.ts >= r.s and t.ts < r.e group by 1, 2""")
def j2_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).where("n >= 2").select("instrument", F.col("bar_start").alias("s"), (F.col("bar_start") + F.expr("interval 150 minutes")).alias("e"))
    out = J.interval_join(trades(spark, sf_dir), r, "ts", "s", "e", ["instrument"], 3600 * 6)
    return ntz(out.groupBy("instrument", F.col("s").alias("range_start")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty")), "range_start")


@query("""select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def j3_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    out = J.enrich(J.enrich(table(spark, sf_dir, "customer"), n, ["c_nationkey"]), table(spark, sf_dir, "region"), ["r_regionkey"])
    return out.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""with a as (select o_orderkey as k, o_totalprice as px from orders where o_orderkey % 10 <> 1), b as (select o_orderkey as k, case when o_orderkey % 10 = 3 then o_totalprice + 1 else o_totalprice end as px from orders where o_orderkey % 10 <> 2)
    select k, case when a.k is null then 'missing_local' when b.k is null then 'missing_remote' when a.px = b.px then 'matched' else 'mismatch' end as state, round(a.px - b.px, 6) as delta_px from a full join b using (k)""")
def j4_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("px"))
    remote = o.where("k % 10 <> 2").withColumn("px", F.when(F.col("k") % 10 == 3, F.col("px") + 1).otherwise(F.col("px")))
    return _r(J.reconcile(o.where("k % 10 <> 1"), remote, ["k"], ["px"]), "delta_px")


@query("select event_type, count(*) as overlap from events where event_id % 3 = 0 and event_id % 2 = 0 group by 1")
def j6_duplicates_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return J.duplicates_between(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("overlap"))


@query(f"with {BARS} select instrument, bar_start, hour(bar_start) % 6 <> 0 as equal from bars where hour(bar_start) % 8 <> 7 union all select instrument, bar_start, false from bars where hour(bar_start) % 8 = 7")
def j10_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.stream import stream_features

    t = trades(spark, sf_dir)
    online = stream_features(t, "1 hour", "1 hour").select("instrument", F.col("start").alias("bar_start"), F.col("volume").cast("double").alias("x"))
    offline = B.trades_to_bars(t, "1 hour").select("instrument", "bar_start", F.col("volume").cast("double").alias("x"))
    # planted: online values that are off, and bars that one side lacks
    online = online.where(F.hour("bar_start") % 8 != 7).withColumn("x", F.col("x") + F.when(F.hour("bar_start") % 6 == 0, 0.5).otherwise(0.0))
    return ntz(J.parity(offline, online, ["instrument", "bar_start"], "x").select("instrument", "bar_start", "equal"), "bar_start")


@query(f"""with {FILLS}, a as (select order_id, sum(notional) as v from fills group by 1)
    select o_orderstatus, count(*) as n, round(avg(v - o_totalprice), 4) as mean, round(avg(abs(v - o_totalprice)), 4) as mean_abs, round(max(abs(v - o_totalprice)), 4) as largest from orders join a on o_orderkey = order_id group by 1""")
def j11_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = fills(spark, sf_dir).groupBy(F.col("order_id").alias("k")).agg(F.sum("notional").alias("v"))
    modelled = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return _r(J.deviation(modelled, actual, ["k"], "v", ["o_orderstatus"]), "mean", "mean_abs", "largest", n=4)


@query("""select o_custkey, count(*) as n, case when count(*) > 1 then 'conflict' else 'match' end as state, case when count(*) = 1 then min(o_orderkey) end as o_orderkey from orders group by 1""")
def j12_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_match(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query(f"with {BARS} select x as threshold, instrument, count(*) filter (where close > x) as above from bars, (values (50.0::double), (100.0::double), (150.0::double)) as g(x) group by 1, 2")
def j13_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(50.0,), (100.0,), (150.0,)], "threshold double")
    return J.param_grid(bars(spark, sf_dir), grid).groupBy("threshold", "instrument").agg(F.count_if(F.col("close") > F.col("threshold")).alias("above"))


_GRAMS = """select {k}, array_to_string(w[i:i + 7], ' ') as g from (select {k}, regexp_extract_all(lower(text), '[^\\s]+') as w from {t}), unnest(range(1, len(w) - 6)) as r(i)"""


@query(f"""with d as (select distinct * from ({_GRAMS.format(k="doc_id", t="documents")})), b as (select distinct * from ({_GRAMS.format(k="item_id", t="benchmark")})) select doc_id, item_id, count(*) as shared from d join b using (g) group by 1, 2""")
def j14_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- features ------------------------------------------------------------------------
_W = "(partition by instrument order by bar_start"
_L24 = "(partition by instrument order by bar_start rows between 23 preceding and current row)"


@query(f"""with {BARS} select instrument, bar_start, """ + ", ".join(f"round(close / lag(close, {k}) over {_W}) - 1, 6) as ret_{k}, round(case when close > 0 and lag(close, {k}) over {_W}) > 0 then ln(close) - ln(lag(close, {k}) over {_W})) end, 6) as logret_{k}" for k in (1, 4, 24)) + " from bars")
def w5_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [f"{p}_{k}" for k in (1, 4, 24) for p in ("ret", "logret")]
    return _r(ntz(X.returns(bars(spark, sf_dir)).select("instrument", "bar_start", *cols), "bar_start"), *cols)


_VOL = f"""r as (select *, ln(close) - ln(lag(close) over {_W})) as r from bars), x as (select *, abs(r) * abs(lag(r) over {_W})) as x from r),
    v as (select *, case when count(*) over {_L24} >= 24 then stddev_samp(r) over {_L24} end as vol, case when count(*) over {_L24} >= 24 then avg(high - low) over {_L24} end as range_,
    case when count(*) over {_L24} >= 24 then greatest(sum(r * r) over {_L24} - 1.5707963267948966 * sum(x) over {_L24}, 0.0) end as jump from x)"""


@query(f"""with {BARS}, {_VOL} select instrument, bar_start, round(vol, 5) as vol, round(range_, 5) as range, round(jump, 5) as jump from v""")
def w6_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ntz(X.volatility(bars(spark, sf_dir)).select("instrument", "bar_start", "vol", "range", "jump"), "bar_start"), "vol", "range", "jump", n=5)


@query(f"""with {BARS}, h as (select *, avg(volume) over w as mean, list(volume) over w as seen from bars window w as (partition by instrument, hour(bar_start) order by bar_start rows between unbounded preceding and 1 preceding))
    select instrument, bar_start, round(volume / nullif(mean, 0), 6) as volume_ratio, round(len(list_filter(seen, lambda v: v < volume)) / nullif(len(seen), 0), 6) as volume_percentile from h""")
def w7_volume_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ntz(X.volume_surprise(bars(spark, sf_dir)).select("instrument", "bar_start", "volume_ratio", "volume_percentile"), "bar_start"), "volume_ratio", "volume_percentile")


@query(f"""with {BARS}, m as (select instrument, bar_start, close as mark, avg(close) over (partition by bar_start) as index from bars), b as (select *, (mark - index) / nullif(index, 0) as basis from m)
    select instrument, bar_start, round(basis, 5) as basis, round(case when count(*) over {_L24} >= 24 then (basis - avg(basis) over {_L24}) / nullif(stddev_samp(basis) over {_L24}, 0) end, 4) as basis_z from b""")
def w8_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bars(spark, sf_dir).select("instrument", "bar_start", F.col("close").alias("mark"), F.avg("close").over(Window.partitionBy("bar_start")).alias("index"))
    return _r(_r(ntz(X.basis(m).select("instrument", "bar_start", "basis", "basis_z"), "bar_start"), "basis", n=5), "basis_z", n=4)


@query(f"""with {TRADES}, f as (select instrument, time_bucket(interval '8 hours', ts) as ts, case when side = 'BUY' then 'predicted' else 'settled' end as kind, avg(price) as rate from trades group by 1, 2, 3)
    select instrument, kind, ts, round(case when count(*) over w >= 3 then rate - avg(rate) over w end, 5) as deviation from f window w as (partition by instrument, kind order by ts rows between 2 preceding and current row)""")
def w9_funding_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trades(spark, sf_dir).groupBy("instrument", F.window("ts", "8 hours").alias("w"), F.when(F.col("side") == "BUY", "predicted").otherwise("settled").alias("kind")).agg(F.avg("price").alias("rate"))
    out = X.funding_deviation(f.select("instrument", "kind", F.col("w.start").alias("ts"), "rate"))
    return _r(ntz(out.select("instrument", "kind", "ts", "deviation"), "ts"), "deviation", n=5)


@query(f"""with {BARS}, s as (select instrument, date_trunc('hour', ts) as bar_start, sum(case when side = 'BUY' then qty else -qty end) as net from trades group by 1, 2),
    o as (select b.*, sum(net) over (partition by b.instrument order by b.bar_start rows between unbounded preceding and current row) as oi from bars b join s using (instrument, bar_start)),
    d as (select instrument, bar_start, oi - lag(oi) over {_W}) as a, close - lag(close) over {_W}) as p from o)
    select instrument, bar_start, case when a > 0 and p > 0 then 'long_build' when a > 0 and p < 0 then 'short_build' when a < 0 and p > 0 then 'short_cover' when a < 0 and p < 0 then 'long_exit' when a is not null and p is not null then 'flat' end as oi_state from d""")
def w10_oi_price_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = X.flow_imbalance_by_time(trades(spark, sf_dir), "1 hour").select("instrument", "bar_start", "signed")
    oi = bars(spark, sf_dir).join(flow, ["instrument", "bar_start"]).withColumn("oi", F.sum("signed").over(X.by_bar().rowsBetween(Window.unboundedPreceding, 0)))
    return ntz(X.oi_price_state(oi).select("instrument", "bar_start", "oi_state"), "bar_start")


@query(f"""with {TRADES}, c as (select *, coalesce(sum(qty) over (partition by instrument order by ts, seq rows between unbounded preceding and 1 preceding), 0) // 500 as bucket from trades)
    select instrument, bucket::bigint as bucket, sum(case when side = 'BUY' then qty else -qty end)::bigint as signed, sum(qty)::bigint as volume, round(sum(case when side = 'BUY' then qty else -qty end) / nullif(sum(qty), 0), 6) as imbalance from c group by 1, 2""")
def w11_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(X.flow_imbalance(trades(spark, sf_dir), 500), "imbalance")


@query(f"""with {TRADES} select instrument, seq, round(0.02::double * qty, 6) as spread, round(price, 6) as mid, round((2 * qty - 100) / 102, 6) as book_imbalance from trades""")
def w12_book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).select("instrument", "seq", (F.col("price") - 0.01 * F.col("qty")).alias("bid"), (F.col("price") + 0.01 * F.col("qty")).alias("ask"), (F.col("qty") + 1).alias("bid_size"), (101 - F.col("qty")).alias("ask_size"))
    return _r(X.book_features(t).select("instrument", "seq", "spread", "mid", "book_imbalance"), "spread", "mid", "book_imbalance")


_REGIME = f"""g as (select *, avg(vol) over {_L24} as m, stddev_samp(vol) over {_L24} as s, count(vol) over {_L24} as c from v),
    rg as (select *, case when c >= 24 and vol > m + s then 'stressed' when c >= 24 and vol < m - s then 'calm' when c >= 24 then 'normal' end as regime from g)"""


@query(f"with {BARS}, {_VOL}, {_REGIME} select instrument, bar_start, regime from rg")
def w13_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(X.regime(X.volatility(bars(spark, sf_dir))).select("instrument", "bar_start", "regime"), "bar_start")


@query(f"""with {BARS}, {_VOL}, {_REGIME} select instrument, bar_start, regime, round(vol, 5) as vol, round(close / lag(close, 4) over {_W}) - 1, 6) as ret_4, round(case when count(*) over {_L24} >= 24 then (volume - avg(volume) over {_L24}) / nullif(stddev_samp(volume) over {_L24}, 0) end, 4) as volume_z,
    count(*) over (partition by instrument order by bar_start rows between 24 preceding and current row) > 24 as enough, 'f1' as feature_version from rg""")
def w14_build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.build_features(bars(spark, sf_dir)).select("instrument", "bar_start", "regime", F.round("vol", 5).alias("vol"), F.round("ret_4", 6).alias("ret_4"), F.round("volume_z", 4).alias("volume_z"), "enough", "feature_version")
    return ntz(out, "bar_start")


_END = "bar_start + interval 1 hour"


@query(f"""with {BARS}, {_VOL}, {_REGIME}, flow as (select instrument, date_trunc('hour', ts) as bar_start, sum(case when side = 'BUY' then qty else -qty end) / nullif(sum(qty), 0) as imbalance from trades group by 1, 2),
    bs as (select instrument, bar_start, close / nullif(avg(close) over (partition by bar_start), 0) - 1 as basis from bars),
    fund as (select instrument, time_bucket(interval '8 hours', ts) as ts, avg(price) as rate from trades where side = 'SELL' group by 1, 2), fd as (select *, case when count(*) over w >= 3 then rate - avg(rate) over w end as dev from fund window w as (partition by instrument order by ts rows between 2 preceding and current row)),
    oi as (select instrument, ts, max(run) as oi from (select *, sum(case when side = 'BUY' then qty else -qty end) over (partition by instrument order by ts, seq rows between unbounded preceding and current row) as run from trades) group by 1, 2),
    bk as (select instrument, ts, max(struct_pack(price := price, qty := qty)) as q from trades group by 1, 2), h as (select *, avg(volume) over w as vmean, list(volume) over w as seen from bars window w as (partition by instrument, hour(bar_start) order by bar_start rows between unbounded preceding and 1 preceding)),
    j as (select rg.*, f.rate, f.dev, o.oi, b.q, imbalance, basis, volume / nullif(vmean, 0) as volume_ratio, len(list_filter(seen, lambda v: v < rg.volume)) / nullif(len(seen), 0) as volume_percentile from rg join flow using (instrument, bar_start) join bs using (instrument, bar_start) join (select instrument, bar_start, vmean, seen from h) hh using (instrument, bar_start)
        asof left join fd f on f.instrument = rg.instrument and f.ts <= rg.{_END} asof left join oi o on o.instrument = rg.instrument and o.ts <= rg.{_END} asof left join bk b on b.instrument = rg.instrument and b.ts <= rg.{_END}),
    d as (select *, oi - lag(oi) over {_W}) as a, close - lag(close) over {_W}) as p from j)
    select instrument, bar_start, round(volume_ratio, 5) as volume_ratio, round(volume_percentile, 6) as volume_percentile, round(case when count(*) over {_L24} >= 24 then (basis - avg(basis) over {_L24}) / nullif(stddev_samp(basis) over {_L24}, 0) end, 3) as basis_z, round(imbalance, 6) as imbalance, round(rate, 5) as funding_rate, round(dev, 4) as funding_deviation,
        case when a > 0 and p > 0 then 'long_build' when a > 0 and p < 0 then 'short_build' when a < 0 and p > 0 then 'short_cover' when a < 0 and p < 0 then 'long_exit' when a is not null and p is not null then 'flat' end as oi_state,
        round(q.price, 6) as mid, round(0.02::double * q.qty, 6) as spread, round((2 * q.qty - 100) / 102, 6) as book_imbalance from d""")
def w14_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 to W13 in one table: what has times of its own as it was known at the end of each bar."""
    t, b = trades(spark, sf_dir), bars(spark, sf_dir)
    marks = b.select("instrument", "bar_start", F.col("close").alias("mark"), F.avg("close").over(Window.partitionBy("bar_start")).alias("index"))
    fund = t.groupBy("instrument", F.window("ts", "8 hours").alias("w"), F.when(F.col("side") == "BUY", "predicted").otherwise("settled").alias("kind")).agg(F.avg("price").alias("rate")).select("instrument", "kind", F.col("w.start").alias("ts"), "rate")
    run = F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).over(Window.partitionBy("instrument").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    oi = t.select("instrument", "ts", run.alias("oi")).groupBy("instrument", "ts").agg(F.max("oi").alias("oi"))
    quote = t.groupBy("instrument", "ts").agg(F.max(F.struct("price", "qty")).alias("q"))
    book = quote.select("instrument", "ts", (F.col("q.price") - 0.01 * F.col("q.qty")).alias("bid"), (F.col("q.price") + 0.01 * F.col("q.qty")).alias("ask"), (F.col("q.qty") + 1).alias("bid_size"), (101 - F.col("q.qty")).alias("ask_size"))
    out = X.build_features(b, marks=marks, funding=fund, interest=oi, flow=X.flow_imbalance_by_time(t, "1 hour"), book=book, surprise=True)
    cols = {"volume_ratio": 5, "volume_percentile": 6, "basis_z": 3, "imbalance": 6, "funding_rate": 5, "funding_deviation": 4, "mid": 6, "spread": 6, "book_imbalance": 6}
    return ntz(out.select("instrument", "bar_start", "oi_state", *(F.round(c, n).alias(c) for c, n in cols.items())), "bar_start")


_LABEL = f"lab as (select *, lead(close, 4) over {_W}) / lead(close, 1) over {_W}) - 1 as label, lead(bar_start, 4) over {_W}) as label_end from bars)"


@query(f"with {BARS}, {_LABEL} select instrument, bar_start, round(label, 6) as label, label_end from lab")
def l1_label_forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ntz(X.label_forward_return(bars(spark, sf_dir)).select("instrument", "bar_start", "label", "label_end"), "bar_start", "label_end"), "label")


_FUND = "fund as (select instrument, time_bucket(interval '8 hours', ts) as ts, avg(price) / 1e6 as rate from trades group by 1, 2)"
_NET = "net as (select l.*, coalesce(p.paid, 0.0) as paid, label - 2 * 0.00065 - coalesce(p.paid, 0.0) as label_net from lab l left join (select l.instrument, l.bar_start, sum(f.rate) as paid from lab l join fund f on f.instrument = l.instrument and f.ts > l.bar_start and f.ts <= l.label_end group by 1, 2) p using (instrument, bar_start))"


def _net_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = trades(spark, sf_dir).groupBy("instrument", F.window("ts", "8 hours").alias("w")).agg((F.avg("price") / 1e6).alias("rate")).select("instrument", F.col("w.start").alias("ts"), "rate")
    lab = X.funding_over_hold(X.label_forward_return(bars(spark, sf_dir)), settled, "bar_start", "label_end")
    return X.label_net(lab, funding="funding_paid")


@query(f"with {BARS}, {_LABEL}, {_FUND}, {_NET} select instrument, bar_start, round(label_net, 6) as label_net from net")
def l2_label_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ntz(_net_labels(spark, sf_dir).select("instrument", "bar_start", "label_net"), "bar_start"), "label_net")


@query(f"with {BARS}, {_LABEL}, {_FUND}, {_NET} select instrument, bar_start, case when label_net > 0.01 then 1 when label_net < -0.01 then -1 when label_net is not null then 0 end as direction from net")
def l3_label_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(X.label_direction(_net_labels(spark, sf_dir), 0.01).select("instrument", "bar_start", "direction"), "bar_start")


@query(f"""with {BARS}, a as (select instrument, bar_start, """ + ", ".join(f"lead(close, {k}) over {_W}) / close - 1 as r{k}" for k in range(1, 5)) + """ from bars)
    select instrument, bar_start, case when r4 is null then null """ + " ".join(f"when r{k} >= 0.2 then 1 when r{k} <= -0.2 then -1" for k in range(1, 5)) + " else 0 end as touch from a")
def l3_label_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(X.label_first_touch(bars(spark, sf_dir), 0.2, 0.2, 4).select("instrument", "bar_start", "touch"), "bar_start")


# --- sets and limits ----------------------------------------------------------------
@query("""select event_id, ts, (select count(*) from events) as total, (select count(*) from events) > 50 as truncated from events order by ts desc, event_id desc limit 50""")
def o1_bounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.bounded_rows(table(spark, sf_dir, "events").select("event_id", "ts"), 50, [F.desc("ts"), F.desc("event_id")])


@query("""select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank from events qualify rank <= 3""")
def o2_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.top_k_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query("""select 'all' as which, 'many' as found from orders having count(*) > 1 union all select 'one', 'one' from orders having count(*) filter (where o_orderkey = (select min(o_orderkey) from orders)) = 1
    union all select 'none', 'none' from orders having count(*) filter (where o_orderkey < 0) = 0""")
def o3_detect_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = o.agg(F.min("o_orderkey")).first()[0]
    found = {"all": F.lit(True), "one": F.col("o_orderkey") == first, "none": F.col("o_orderkey") < 0}
    return spark.createDataFrame([(which, J.detect_many(o, key)) for which, key in found.items()], "which string, found string")


@query("select c_mktsegment as name from customer union select upper(event_type) from events")
def x1_merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.merged_names(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), table(spark, sf_dir, "events").select(F.upper("event_type").alias("name")), "name")


@query("""with b as (select distinct user_id, event_type from events where event_id % 2 = 0), a as (select distinct user_id, event_type from events where event_id % 2 = 1),
    j as (select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, a.user_id is not null as ia, b.user_id is not null as ib from b full join a on a.user_id = b.user_id and a.event_type = b.event_type)
    select user_id, coalesce(list(event_type order by event_type) filter (where not ib), []) as added, coalesce(list(event_type order by event_type) filter (where not ia), []) as removed, coalesce(list(event_type order by event_type) filter (where ia and ib), []) as kept from j group by 1""")
def x2_set_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return J.set_delta(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_type")
