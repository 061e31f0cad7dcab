"""Queries for orders, fills, costs, risk and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import ledger as L
from tidemark.plans.base import BARS, FILLS, TRADES, query
from tidemark.plans.market_queries import _W, _r, bars
from tidemark.sources.tables import fills, ntz, table, trades
from tidemark.streaming import stream as T


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).withColumns({"fee": F.col("notional") * F.col("fee_rate"), "slippage": F.col("notional") * 0.0001, "transfer": -F.col("notional") * F.col("rebate_rate")})


@query(f"""with {FILLS} select venue, 0.0::double as spread, 0.0::double as impact, 0.0::double as borrow, 0.0::double as funding, 0.0::double as failure, round(sum(notional * fee_rate), 2) as fee, round(sum(notional * 0.0001), 2) as slippage, round(-sum(notional * rebate_rate), 2) as transfer,
    round(sum(notional * fee_rate) + sum(notional * 0.0001) - sum(notional * rebate_rate), 2) as total_cost, count(*) as fills from fills group by 1""")
def a11_cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(L.cost_breakdown(_costs(spark, sf_dir), ["venue"]), "fee", "slippage", "transfer", "total_cost", n=2)


@query(f"""with {FILLS}, r as (select venue, case when side = 'SELL' then notional else -notional end as alpha, -0.0001 * notional as execution, 0.0::double as funding, -notional * fee_rate as fee, notional * rebate_rate as rebate from fills)
    select venue, round(sum(alpha), 1) as gross, round(sum(alpha + execution + funding + fee + rebate), 1) as net, round(sum(alpha), 1) as alpha, round(sum(execution), 1) as execution, 0.0::double as funding, round(sum(fee), 1) as fee, round(sum(rebate), 1) as residual from r group by 1""")
def a12_pnl_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    rows = f.select("venue", (-L.signed("notional")).alias("alpha"), (-0.0001 * F.col("notional")).alias("execution"), F.lit(0.0).alias("funding"), (-F.col("notional") * F.col("fee_rate")).alias("fee"), (F.col("notional") * F.col("rebate_rate")).alias("rebate"))
    rows = rows.withColumns({"gross": F.col("alpha"), "net": F.col("alpha") + F.col("execution") + F.col("funding") + F.col("fee") + F.col("rebate")})
    return _r(L.pnl_attribution(rows, ["venue"]), "gross", "net", "alpha", "execution", "funding", "fee", "residual", n=1)


@query("""select l_orderkey % 100 as account, l_returnflag as flag, count(*) as n, round(sum(l_quantity), 2) as total from lineitem group by 1, 2""")
def w16_positions_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last running position of each account and flag is its total: the running form is checked row by row below."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("account"), F.col("l_returnflag").alias("flag"), F.lit("BUY").alias("side"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("notional"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    p = L.positions_from_fills(li, ["account", "flag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "notional"])
    return p.groupBy("account", "flag").agg(F.count("*").alias("n"), F.round(F.max("position"), 2).alias("total"))


@query(f"""with {TRADES} select account, instrument, seq, cast(sum(case when side = 'BUY' then qty else -qty end) over w as bigint) as position, round(sum(case when side = 'BUY' then qty * price else -qty * price end) over w, 4) as position_notional
    from trades window w as (partition by account, instrument order by ts, seq rows between unbounded preceding and current row)""")
def w16_positions_from_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("notional", F.col("qty") * F.col("price"))
    p = L.positions_from_fills(t, ["account", "instrument"], ["ts", "seq"])
    return _r(p.select("account", "instrument", "seq", "position", "position_notional"), "position_notional", n=4)


@query(f"""with {TRADES} select account, instrument, seq, 0.0::double as realised, sum(qty) over w::double as open_qty, round(case when sum(qty) over w > 0 then sum(qty * price) over w / sum(qty) over w else 0 end, 8) as avg_cost
    from trades where side = 'BUY' window w as (partition by account, instrument order by seq rows between unbounded preceding and current row)""".replace("sum(qty) over w::double", "cast(sum(qty) over w as double)"))
def w22_average_cost_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys only: nothing is realised and the average is the running mean."""
    t = trades(spark, sf_dir).where("side = 'BUY'").withColumns({"notional": F.col("qty") * F.col("price"), "qty": F.col("qty").cast("double")})
    return _r(L.average_cost_pnl(t.select("account", "instrument", "seq", "side", "qty", "notional"), ["account", "instrument"], ["seq"]), "avg_cost", n=8)


@query(f"""with recursive {TRADES}, t as (select account, instrument, row_number() over (partition by account, instrument order by seq) as k, case when side = 'BUY' then qty else -qty end::double as move, case when qty = 0 then 0.0 else price end::double as price from trades),
    r(account, instrument, k, held, cost, gain) as (select account, instrument, 0::bigint, 0.0::double, 0.0::double, 0.0::double from t where k = 1
        union all select t.account, t.instrument, t.k, held + move,
            case when held * move < 0 then case when abs(move) > abs(held) then price else cost end when held + move <> 0 then (abs(held) * cost + abs(move) * price) / abs(held + move) else cost end,
            gain + case when held * move < 0 then least(abs(move), abs(held)) * (price - cost) * sign(held) else 0 end
        from r join t on t.account = r.account and t.instrument = r.instrument and t.k = r.k + 1)
    select account, instrument, round(arg_max(gain, k), 4) as realised, arg_max(held, k) as open_qty from r group by 1, 2""")
def w22_average_cost_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumns({"notional": F.col("qty") * F.col("price"), "qty": F.col("qty").cast("double")})
    out = L.average_cost_pnl(t.select("account", "instrument", "seq", "side", "qty", "notional"), ["account", "instrument"], ["seq"])
    return out.groupBy("account", "instrument").agg(F.round(F.sum("realised"), 4).alias("realised"), F.max_by("open_qty", "seq").alias("open_qty"))


@query("""select o_custkey as account, o_orderstatus as instrument, round(sum(abs(o_totalprice)), 2) as gross, round(sum(case when o_orderkey % 2 = 0 then o_totalprice else -o_totalprice end), 2) as net,
    grouping(o_custkey, o_orderstatus)::bigint as level from orders group by rollup (o_custkey, o_orderstatus) having grouping(o_custkey, o_orderstatus) < 3""")
def a20_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("instrument"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("notional"))
    return _r(L.exposure(o, "account", "instrument", "notional"), "gross", "net", n=2)


@query("""with o as (select o_custkey as account, o_orderstatus as instrument, case when o_orderkey % 2 = 0 then o_totalprice else -o_totalprice end as n, case when o_orderkey % 3 > 0 then (o_orderkey % 7 - 3) * 0.0001 end as rate, c_acctbal as equity from orders join customer on o_custkey = c_custkey)
    select account, instrument, round(sum(abs(n)), 2) as gross, round(sum(n), 2) as net, round(max(equity), 2) as equity, round(sum(n * coalesce(rate, 0)), 2) as funding, round(sum(abs(n)) / nullif(max(equity), 0), 3) as leverage, grouping(account, instrument)::bigint as level
    from o group by rollup (account, instrument) having grouping(account, instrument) < 3""")
def a20_exposure_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leverage and the funding that positions pay; an unknown rate pays nothing."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("equity")), "o_custkey")
    o = o.select(F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("instrument"), F.when(key % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("notional"), F.when(key % 3 > 0, (key % 7 - 3) / 10_000).alias("rate"), "equity")
    return _r(_r(L.exposure(o, "account", "instrument", "notional", "equity", "rate"), "gross", "net", "equity", "funding", n=2), "leverage", n=3)


@query(f"""with {FILLS}, f as (select order_id, sum(notional) as filled from fills group by 1)
    select o_orderpriority, count(*) as orders, round(avg(case when o_orderpriority like '4%' or o_orderpriority like '5%' then 1.0 else 0.0 end), 6) as maker_share, round(avg((o_orderstatus = 'F')::int), 6) as fill_rate, round(avg((o_orderstatus = 'O')::int), 6) as open_rate, round(avg((o_orderstatus = 'P')::int), 6) as partial_rate,
    round(avg((filled - o_totalprice) / o_totalprice), 4) as deviation from orders left join f on o_orderkey = order_id group by 1""")
def a14_execution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir).groupBy(F.col("order_id").alias("o_orderkey")).agg(F.sum("notional").alias("filled"))
    o = table(spark, sf_dir, "orders").join(f, "o_orderkey", "left")
    o = o.select("o_orderpriority", F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("intended"), "filled", F.col("o_orderpriority").rlike("^[45]").alias("maker"))
    return _r(_r(L.execution_quality(o, ["o_orderpriority"]), "maker_share", "fill_rate", "open_rate", "partial_rate"), "deviation", n=4)


@query("""select o_orderpriority, count(d) as n, round(quantile_cont(d, 0.5), 4) as p50, round(quantile_cont(d, 0.95), 4) as p95, round(quantile_cont(d, 0.99), 4) as p99 from (select o_orderpriority, abs(date_diff('day', o_orderdate, l_shipdate)) as d from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def a15_latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _r(L.latency_quantiles(j.select("o_orderpriority", F.abs(F.datediff("l_shipdate", "o_orderdate")).alias("d")), ["o_orderpriority"], "d"), "p50", "p95", "p99", n=4)


@query("""select l_returnflag, count(l_extendedprice) as n, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by 1""")
def a15_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By selection, as groups of over a million rows are."""
    return _r(L.latency_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", large=0, sketch=100), "p50", "p95", "p99", n=4)


@query("""with m as (select user_id, event_id, event_type = 'error' as c, row_number() over (partition by user_id order by ts, event_id) - sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) as i from events)
    select user_id, min(event_id) as first, max(event_id) as last, count(*) as length from m where c group by user_id, i""")
def w17_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return L.streaks(e, ["user_id"], ["event_id"], F.col("event_type") == "error")


@query(f"""with {BARS}, r as (select instrument, bar_start, 1 - low / nullif(high, 0) as dd, volume::double as v from bars)
    select instrument, bar_start, list_filter([case when dd >= 0.9 or dd is null then 'dd' end, case when v >= 150 then 'v' end], lambda x: x is not null) as breaches,
    case when coalesce(dd >= 0.99, false) or v >= 400 then 'HALT' when dd is null or dd >= 0.9 or v >= 150 then 'REDUCE_ONLY' else 'NORMAL' end as risk_state from r""")
def w19_risk_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).select("instrument", "bar_start", (1 - F.try_divide("low", "high")).alias("dd"), F.col("volume").cast("double").alias("v"))
    return ntz(L.risk_breaches(r, {"dd": (0.9, 0.99), "v": (150.0, 400.0)}).select("instrument", "bar_start", "breaches", "risk_state"), "bar_start")


_V24 = "(partition by instrument order by bar_start rows between 23 preceding and current row)"


@query(f"""with {BARS}, r as (select *, ln(close) - ln(lag(close) over {_W})) as r from bars), v as (select *, case when count(*) over {_V24} >= 24 then stddev_samp(r) over {_V24} end as vol, case when close > 100 then 1 else -1 end as sig from r)
    select instrument, bar_start, round(case when vol > 0 then greatest(least(sig * 0.2 / vol, 1.0), -1.0) end, 5) as target, case when vol is null or vol <= 0 then 'no-volatility' end as refused from v""")
def w20_target_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.features import volatility

    v = volatility(bars(spark, sf_dir)).withColumn("sig", F.when(F.col("close") > 100, 1).otherwise(-1))
    out = L.target_position(v, "sig", "vol", 0.2, 1.0).withColumn("target", F.when(F.col("vol") > 0, F.col("target")))
    return _r(ntz(out.select("instrument", "bar_start", "target", "refused"), "bar_start"), "target", n=5)


@query("""with w as (select event_type, date_trunc('week', ts) as week, avg(value) / stddev_samp(value) as sharpe, count(*) filter (where event_id % 10 = 0)::double / count(*) as dd from events group by 1, 2)
    select event_type, week, case when max(dd) over w2 >= 0.11 then 'roll_back' when count(*) over w2 >= 2 and min(sharpe) over w2 >= 1.0 then 'promote' else 'hold' end as decision from w window w2 as (partition by event_type order by week rows between 1 preceding and current row)""")
def w21_scale_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("week")).agg((F.avg("value") / F.stddev_samp("value")).alias("sharpe"), (F.count_if(F.col("event_id") % 10 == 0) / F.count("*")).alias("dd"))
    return ntz(L.scale_ladder(w, "event_type", "week", "sharpe", "dd", deep=0.11).select("event_type", "week", "decision"), "week")


@query("""with w as (select event_type, date_trunc('week', ts) as week, avg(value) / stddev_samp(value) as sharpe, count(*) filter (where event_id % 10 = 0)::double / count(*) as dd, case when event_type <> 'view' then avg(value) / 100 - 1 end as slip from events group by 1, 2)
    select event_type, week, case when max(dd) over w2 >= 0.11 or coalesce(max(abs(slip)) over w2 >= 0.02, false) then 'roll_back' when count(*) over w2 >= 2 and count(slip) over w2 >= 2 and min(sharpe) over w2 >= 0.5 then 'promote' else 'hold' end as decision
    from w window w2 as (partition by event_type order by week rows between 1 preceding and current row)""")
def w21_scale_ladder_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide slippage error rolls back, an unknown one never promotes."""
    w = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("week")).agg(
        (F.avg("value") / F.stddev_samp("value")).alias("sharpe"), (F.count_if(F.col("event_id") % 10 == 0) / F.count("*")).alias("dd"), (F.avg("value") / 100 - 1).alias("slip"))
    w = w.withColumn("slip", F.when(F.col("event_type") != "view", F.col("slip")))
    return ntz(L.scale_ladder(w, "event_type", "week", "sharpe", "dd", good=0.5, deep=0.11, slippage_error="slip", wide=0.02).select("event_type", "week", "decision"), "week")


# --- batch twins of the streams ------------------------------------------------------
@query("select event_type, count(*) as n from events group by 1")
def t1_stream_dedup_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.unionByName(e.where("event_id % 5 = 0")).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""with {TRADES} select instrument, date_trunc('hour', ts) as start, count(*) as n, sum(qty)::bigint as volume, round(sum(case when side = 'BUY' then qty else -qty end) / nullif(sum(qty), 0), 6) as imbalance, round(avg(price), 8) as mean_price, round(stddev_samp(price), 7) as sd_price from trades group by 1, 2""")
def t3_stream_features_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.stream_features(trades(spark, sf_dir), "1 hour", "1 hour").drop("end")
    return _r(_r(_r(ntz(out, "start"), "imbalance"), "mean_price", n=8), "sd_price", n=7)


@query("""with h as (select event_type, max(ts) - interval 3 day as high from events group by 1) select e.event_type as instrument, count(*) as late, max(epoch(date_trunc('second', high)) - epoch(date_trunc('second', ts)))::bigint as largest
    from events e join h using (event_type) where ts < high - interval 10 minute group by 1""")
def t4_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    high = t.groupBy(F.lower("instrument").alias("instrument")).agg((F.max("ts") - F.expr("interval 3 days")).alias("high_ts"))
    _, late = T.late_rows(t.withColumn("instrument", F.lower("instrument")), high)
    return late.groupBy("instrument").agg(F.count("*").alias("late"), F.max("lateness").alias("largest"))


@query(f"""with {TRADES}, n as (select distinct instrument from trades union all select 'GHOST'), l as (select instrument, max(ts) as last_ts from trades where instrument <> 'VIEW' or ts < timestamp '2024-01-10' group by 1)
    select n.instrument, case when last_ts is null then 'unknown' when epoch(timestamp '2024-02-01') - floor(epoch(last_ts)) <= 259200 then 'pass' else 'fail' end as gate from n left join l using (instrument)""")
def t5_freshness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    required = t.select("instrument").distinct().union(spark.createDataFrame([("GHOST",)], "instrument string"))
    rows = t.where((F.col("instrument") != "VIEW") | (F.col("ts") < F.lit("2024-01-10").cast("timestamp")))
    clock = F.lit("2024-02-01").cast("timestamp")
    last = T.freshness_gate(rows, required, clock, 259_200)
    return last.select("instrument", "gate")


@query(f"""with {BARS}, k as (select instrument, bar_start, row_number() over (partition by instrument order by bar_start) as i, count(*) over (partition by instrument) as c from bars)
    select instrument, bar_start, case when i % 5 = 2 and i < c then 'backfill' else 'live' end as source from k where not (i % 5 = 2 and i = c)""")
def t6_gap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = bars(spark, sf_dir)
    w = Window.partitionBy("instrument").orderBy("bar_start")
    live = b.withColumn("i", F.row_number().over(w)).where("i % 5 <> 2").drop("i")
    return ntz(T.gap_repair(live, b, "1 hour").select("instrument", "bar_start", "source"), "bar_start")


@query("""with e as (select user_id, count(*) filter (where event_type = 'signup') as s from events group by 1) select user_id, s > 0 as started from e""")
def t7_order_state_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order that was ever new has a known state; the fold itself is held against a plain one in the tests."""
    return _orders(spark, sf_dir).select("user_id", (F.col("state") != "UNKNOWN").alias("started"))


_KINDS = {"signup": "NEW", "view": "PARTIAL", "purchase": "FILLED", "error": "REJECTED", "click": "CANCELLED"}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for p in _KINDS.items() for x in p))[F.col("event_type")]
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))
    again = e.where("seq % 3 = 0")  # delivered twice
    return L.order_state(e.unionByName(again), "user_id", ["ts", "seq"], "kind")


_FOLLOWS_SQL = " or ".join(f"(s = '{state}' and kind in ({', '.join(repr(x) for x in after)}))" for state, after in L.FOLLOWS.items() if state and after)


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, case event_type when 'signup' then 'NEW' when 'view' then 'PARTIAL' when 'purchase' then 'FILLED' when 'error' then 'REJECTED' when 'click' then 'CANCELLED' end as kind from events),
    r(user_id, k, s, illegal, seen) as (select user_id, 0::bigint, null::varchar, 0, null::varchar from e where k = 1
        union all select e.user_id, e.k, case when same then s when good then kind else s end, case when same or good then illegal else illegal + 1 end, kind
        from (select r.*, e.kind, coalesce(r.seen = e.kind, false) and e.kind <> 'PARTIAL' as same, coalesce(s is null and kind = 'NEW', false) or coalesce({_FOLLOWS_SQL}, false) as good from r join e on e.user_id = r.user_id and e.k = r.k + 1) x join e on e.user_id = x.user_id and e.k = x.k + 1)
    select user_id, coalesce(arg_max(coalesce(s, 'UNKNOWN'), k), 'UNKNOWN') as state, arg_max(illegal, k)::int as illegal from r group by 1""".replace("e.user_id, e.k, case", "e.user_id, e.k, case").replace("then kind else s end", "then x.kind else s end").replace("illegal + 1 end, kind", "illegal + 1 end, x.kind"))
def t7_order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)


@query("""with e as (select user_id, event_id, ts, event_type = 'signup' as reset, case event_type when 'error' then 1 when 'purchase' then case when value > 300 then 2 else 0 end else 0 end as sev from events),
    g as (select *, sum(reset::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as epoch_ from e),
    l as (select *, max(case when reset then 0 else sev end) over (partition by user_id, epoch_ order by ts, event_id rows between unbounded preceding and current row) as level from g)
    select event_id, case when level >= 2 then 'HALT' when level = 1 then 'REDUCE_ONLY' else 'NORMAL' end as switch from l""")
def t8_kill_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when(F.col("event_type") == "error", 1).when((F.col("event_type") == "purchase") & (F.col("value") > 300), 2).otherwise(0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("reset"), sev.alias("sev"))
    return L.kill_switch(e, "user_id", ["ts", "event_id"], "sev", "reset").select("event_id", "switch")


@query(f"""with {BARS}, s as (select instrument, bar_start, case when close > open then 1 else 0 end as signal, coalesce(close / lag(close) over {_W}) - 1, 0.0) as ret from bars), p as (select *, coalesce(lag(signal) over {_W}), 0) as position from s)
    select instrument, bar_start, position, round(position * ret - abs(position - coalesce(lag(position) over {_W}), 0)) * 0.00065, 5) as net from p""")
def t9_shadow_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.features import returns

    b = returns(bars(spark, sf_dir), (1,))
    signals = b.select("instrument", "bar_start", F.when(F.col("close") > F.col("open"), 1).otherwise(0).alias("signal"))
    prices = b.select("instrument", F.col("bar_start").alias("price_ts"), F.col("close").alias("price"), F.coalesce("ret_1", F.lit(0.0)).alias("ret"))
    return _r(ntz(T.shadow_ledger(signals, prices).select("instrument", "bar_start", "position", "net"), "bar_start"), "net", n=5)


_METRICS = f"{TRADES}, m as (select instrument, date_trunc('hour', ts) as start, count(*) as n, count(*) filter (where qty < 20) as rejects from trades group by 1, 2)"


@query(f"with {_METRICS}, a as (select *, coalesce(lag(rejects / n > 0.3) over (partition by instrument order by start), false) as was from m) select instrument, start, n, rejects from a where rejects / n > 0.3 and not was")
def t10_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("qty", F.when(F.col("qty") < 20, 0).otherwise(F.col("qty")))
    return ntz(T.alerts(T.stream_metrics(t, "1 hour"), 0.3).select("instrument", "start", "n", "rejects"), "start")


@query(f"with {BARS} select instrument, bar_start, open, high, low, close, volume, n from bars")
def t2_stream_bars_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(B.trades_to_bars(trades(spark, sf_dir), "1 hour"), "bar_start")
