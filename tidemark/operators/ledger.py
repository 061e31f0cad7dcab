"""Orders, fills, positions, costs and risk: state is derived by windows and never updated in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import RADIX, bucket_of, compose_all, compose_before, last_known, with_carry
from tidemark.operators.joins import is_small, null_safe_join
from tidemark.operators.lineage import materialize

COSTS = ("fee", "spread", "slippage", "impact", "borrow", "funding", "transfer", "failure")
SEVERITY = {"NORMAL": 0, "REDUCE_ONLY": 1, "HALT": 2}


def signed(col: str) -> Column:
    return F.when(F.col("side") == "BUY", F.col(col)).otherwise(-F.col(col))


def cost_breakdown(fills: DataFrame, by: list[str], parts: tuple[str, ...] = COSTS) -> DataFrame:
    """Each cost part that the table has, summed, and their total; a part that is absent is zero."""
    have = [p for p in parts if p in fills.columns]
    sums = [F.coalesce(F.sum(p), F.lit(0.0)).alias(p) if p in have else F.lit(0.0).alias(p) for p in parts]
    out = fills.groupBy(*by).agg(*sums, F.count("*").alias("fills"))
    return out.withColumn("total_cost", reduce(lambda a, b: a + b, (F.col(p) for p in parts)))


def pnl_attribution(rows: DataFrame, by: list[str], parts: tuple[str, ...] = ("alpha", "execution", "funding", "fee")) -> DataFrame:
    """Net split into its parts and a residual, gross apart; the parts and the residual add up to net."""
    out = rows.groupBy(*by).agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"), *(F.sum(p).alias(p) for p in parts))
    return out.withColumn("residual", F.col("net") - reduce(lambda a, b: a + b, (F.col(p) for p in parts)))


def positions_from_fills(fills: DataFrame, by: list[str], order: list[str], bucket: int | None = None) -> DataFrame:
    """Running signed quantity and notional, carried from one bucket of the first order column to the next."""
    rows = fills.withColumns({"_q": signed("qty"), "_n": signed("notional")})
    rows = with_carry(rows, by, bucket_of(fills, order[0], bucket), {"_q": (F.sum("_q"), F.sum), "_n": (F.sum("_n"), F.sum)})
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("_carry"), *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"position": F.sum("_q").over(w), "position_notional": F.sum("_n").over(w)})
    return out.where(~F.col("_carry")).select(*fills.columns, "position", "position_notional")


def average_cost_pnl(fills: DataFrame, by: list[str], order: list[str], bucket: int | None = None, radix: int = RADIX) -> DataFrame:
    """Realised profit by average cost, fills in order within each account and instrument.

    The position before a fill is a carried sum. Given it, a fill turns the average cost c
    into a * c + b: a fill that adds mixes its price in, one that reduces leaves c alone, one
    that crosses zero (or starts from it) has a = 0 and forgets c. Such maps compose, so the
    cost before each fill comes from compositions of blocks and no task walks a whole group.
    """
    names = [c for c in fills.columns if c in {*by, *order}]
    qty = F.coalesce(F.col("qty").cast("double"), F.lit(0.0))
    price = F.when(qty != 0, F.coalesce(F.col("notional").cast("double"), F.lit(0.0)) / qty).otherwise(0.0)
    moves = fills.select(*names, F.when(F.col("side") == "BUY", qty).otherwise(-qty).alias("_q"), price.alias("_p"), F.lit(1).cast("long").alias("_n"))
    rows = with_carry(moves, by, bucket_of(fills, order[0], bucket), {"_q": (F.sum("_q"), F.sum), "_n": (F.count("*"), F.sum)})
    w = Window.partitionBy(*by, "_b").orderBy(F.desc("_carry"), *order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_held": F.coalesce(F.sum("_q").over(before), F.lit(0.0)), "open_qty": F.sum("_q").over(upto), "_rank": F.sum("_n").over(upto) - 1}).where(~F.col("_carry"))
    held, move, after, p = F.col("_held"), F.col("_q"), F.col("open_qty"), F.col("_p")
    against, crosses = held * move < 0, F.abs("_q") > F.abs("_held")
    a = F.when(against, F.when(crosses, 0.0).otherwise(1.0)).when(after != 0, F.abs(held) / F.abs(after)).otherwise(1.0)
    b = F.when(against, F.when(crosses, p).otherwise(0.0)).when(after != 0, F.abs(move) * p / F.abs(after)).otherwise(0.0)
    mapped = materialize(rows.select(*names, "_q", "_p", "_held", "open_qty", "_rank", F.struct(a.alias("a"), b.alias("b")).alias("_map")))
    then = lambda first, second: F.struct((second["a"] * first["a"]).alias("a"), (second["a"] * first["b"] + second["b"]).alias("b"))
    told = compose_before(mapped, by, then, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), radix)
    cost = F.col("_before.b")
    realised = F.when(against, F.least(F.abs(move), F.abs(held)) * (p - cost) * F.signum(held)).otherwise(0.0)
    return told.select(*names, realised.alias("realised"), "open_qty", F.when(after != 0, F.col("_map.a") * cost + F.col("_map.b")).otherwise(0.0).alias("avg_cost"))


def exposure(positions: DataFrame, account: str, instrument: str, notional: str, equity: str | None = None, funding_rate: str | None = None) -> DataFrame:
    """Gross and net notional per instrument and in total (instrument null), leverage where equity is given, and where a funding rate is the funding that the positions pay (negative: receive) at it."""
    aggs = [F.sum(F.abs(notional)).alias("gross"), F.sum(notional).alias("net")]
    if equity:
        aggs.append(F.max(equity).alias("equity"))
    if funding_rate:
        aggs.append(F.sum(F.col(notional) * F.coalesce(funding_rate, F.lit(0.0))).alias("funding"))
    out = positions.rollup(account, instrument).agg(*aggs, F.grouping_id().alias("level")).where("level < 3")
    return out.withColumn("leverage", F.try_divide("gross", "equity")) if equity else out


def execution_quality(orders: DataFrame, by: list[str]) -> DataFrame:
    """Shares of makers, fills, cancels and rejects, and the mean deviation of fills from intent."""
    n = F.count("*")
    share = lambda c: F.try_divide(F.count_if(c), n)
    return orders.groupBy(*by).agg(n.alias("orders"), share(F.col("maker")).alias("maker_share"), share(F.col("state") == "F").alias("fill_rate"), share(F.col("state") == "O").alias("open_rate"), share(F.col("state") == "P").alias("partial_rate"), F.avg(F.try_divide(F.col("filled") - F.col("intended"), F.col("intended"))).alias("deviation"))


#: Rows of a group from which exact quantiles are found by selection, and how finely the sketch that narrows it divides ranks.
LARGE_GROUP, SKETCH = 1_000_000, 10_000


def exact_quantiles(df: DataFrame, by: list[str], col: str, quantiles: dict[str, float], sketch: int = SKETCH) -> DataFrame:
    """Quantiles of each group as `percentile` gives them, without holding its values: a sketch tells an interval that surely holds the two ranks of each quantile, a scan counts what lies below and in it, and only what lies in it is sorted, equal values once."""
    x = F.col("_x")
    work = df.select(*by, F.col(col).cast("double").alias("_x")).where(x.isNotNull())
    names, at = list(quantiles), list(quantiles.values())
    ends = [p for q in at for p in (max(0.0, q - 3 / sketch), min(1.0, q + 3 / sketch))]
    told = materialize(work.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, sketch).alias("_e")))
    everything = F.array(*(F.lit(float(v)) for _ in at for v in ("-inf", "inf")))
    told = told.withColumn("_e", F.when(F.col("_n") > 10 * sketch, F.col("_e")).otherwise(everything))  # a sketch does not divide the ranks of few rows
    met = null_safe_join(work, F.broadcast(told) if is_small(told) else told, by, "inner")
    inside = [(x >= F.col("_e")[2 * k]) & (x <= F.col("_e")[2 * k + 1]) for k in range(len(at))]
    below = [F.count_if(x < F.col("_e")[2 * k]).alias(f"_b{k}") for k in range(len(at))]
    counts = met.groupBy(*by).agg(F.max("_n").alias("n"), *below)
    near = met.select(*by, "_x", F.explode(F.array_compact(F.array(*(F.when(i, k) for k, i in enumerate(inside))))).alias("_k"))
    values = near.groupBy(*by, "_k", "_x").agg(F.count("*").alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    j = null_safe_join(values, F.broadcast(counts) if is_small(counts) else counts, by, "inner")
    last = F.col("_b0") if len(at) == 1 else F.element_at(F.array(*(F.col(f"_b{k}") for k in range(len(at)))), F.col("_k") + 1)
    place = F.element_at(F.array(*map(F.lit, at)), F.col("_k") + 1) * (F.col("n") - 1)
    lower, upper = F.floor(place), F.ceil(place)
    picked = j.withColumns({"_lo": lower, "_hi": upper, "_p": place}).groupBy(*by, "_k", "n").agg(F.min(F.when(last + F.col("_upto") > F.col("_lo"), x)).alias("a"), F.min(F.when(last + F.col("_upto") > F.col("_hi"), x)).alias("b"), F.max("_lo").alias("lo"), F.max("_p").alias("p"))
    value = F.when(F.col("p") == F.col("lo"), F.col("a")).otherwise((F.col("lo") + 1 - F.col("p")) * F.col("a") + (F.col("p") - F.col("lo")) * F.col("b"))
    return picked.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_k") == k, value)).alias(name) for k, name in enumerate(names)))


def latency_quantiles(df: DataFrame, by: list[str], col: str, exact: bool = True, large: int = LARGE_GROUP, sketch: int = SKETCH) -> DataFrame:
    """P50, P95 and P99. The exact form takes groups of more than `large` rows by selection; the other one is approximate. The exact form reads its values several times, so they are written first, and what gives them runs once."""
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if not exact:
        return df.groupBy(*by).agg(F.count(col).alias("n"), *(F.percentile_approx(col, s, 10_000).alias(n) for n, s in q.items()))
    df = materialize(df.select(*by, col))
    sizes = df.groupBy(*by).agg(F.count(col).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= large:
        return df.groupBy(*by).agg(F.count(col).alias("n"), *(F.percentile(col, s).alias(n) for n, s in q.items()))
    none = sizes.where("_n = 0").select(*by, F.col("_n").alias("n"), *(F.lit(None).cast("double").alias(c) for c in q))
    return exact_quantiles(df, by, col, q, sketch).unionByName(none)


def period_extremes(bt: DataFrame, by: list[str], ts: str = "bar_start") -> DataFrame:
    """The worst day and the deepest weekly drawdown of each group."""
    day = bt.groupBy(*by, F.date_trunc("day", ts).alias("day")).agg(F.sum("net").alias("net"))
    week = Window.partitionBy(*by, F.date_trunc("week", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = day.withColumn("upto", F.sum("net").over(week))
    run = run.withColumn("drawdown", F.greatest(F.max("upto").over(week), F.lit(0.0)) - F.col("upto"))
    return run.groupBy(*by).agg(F.min("net").alias("worst_day"), F.max("net").alias("best_day"), F.max("drawdown").alias("weekly_drawdown"))


def streaks(df: DataFrame, by: list[str], order: list[str], cond: Column) -> DataFrame:
    """Runs of rows that meet a condition: start and end of the order columns, and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_c", F.coalesce(cond, F.lit(False)))
    island = F.row_number().over(w) - F.sum(F.col("_c").cast("int")).over(w)
    runs = marked.withColumn("_i", island).where("_c")
    return runs.groupBy(*by, "_i").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("_i")


def risk_breaches(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """For each column its (reduce, halt) limits; the worst gives NORMAL, REDUCE_ONLY or HALT. A null measure is not safe: REDUCE_ONLY."""
    level = [F.when(F.col(c) >= halt, 2).when((F.col(c) >= reduce_) | F.col(c).isNull(), 1).otherwise(0) for c, (reduce_, halt) in limits.items()]
    worst = F.greatest(*level, F.lit(0))
    names = F.array_compact(F.array(*(F.when(x > 0, F.lit(c)) for c, x in zip(limits, level))))
    return df.withColumns({"breaches": names, "risk_state": F.when(worst == 2, "HALT").when(worst == 1, "REDUCE_ONLY").otherwise("NORMAL")})


def target_position(df: DataFrame, signal: str, vol: str, target_vol: float, limit: float) -> DataFrame:
    """The signal scaled to a target volatility and clipped; refused (null, with a reason) without a volatility."""
    raw = F.col(signal) * F.try_divide(F.lit(target_vol), F.when(F.col(vol) > 0, F.col(vol)))
    return df.withColumns({"target": F.greatest(F.least(raw, F.lit(limit)), F.lit(-limit)), "refused": F.when(F.col(vol).isNull() | (F.col(vol) <= 0), "no-volatility").when(F.col(signal).isNull(), "no-signal")})


def scale_ladder(weekly: DataFrame, by: str, week: str, sharpe: str, drawdown: str, weeks: int = 2, good: float = 1.0, deep: float = 0.1, slippage_error: str | None = None, wide: float = 0.5) -> DataFrame:
    """Promote, hold or roll back from trailing weeks: all good Sharpe, shallow drawdown and, where it is told, slippage as modelled promote; a deep drawdown or a slippage error of `wide` or more (either sign) rolls back; an unknown slippage error does not promote."""
    w = Window.partitionBy(by).orderBy(week).rowsBetween(1 - weeks, 0)
    full = F.count(F.lit(1)).over(w) >= weeks
    off = F.coalesce(F.max(F.abs(slippage_error)).over(w) >= wide, F.lit(False)) if slippage_error else F.lit(False)
    told = F.count(slippage_error).over(w) >= weeks if slippage_error else F.lit(True)
    return weekly.withColumn("decision", F.when((F.max(drawdown).over(w) >= deep) | off, "roll_back").when(full & told & (F.min(sharpe).over(w) >= good), "promote").otherwise("hold"))


# --- state machines in batch form ------------------------------------------------
#: What may follow a state of an order; None is an order that nothing is known of.
FOLLOWS = {
    None: ("NEW",),
    "NEW": ("PARTIAL", "FILLED", "CANCELLED", "REJECTED", "EXPIRED", "UNKNOWN"),
    "PARTIAL": ("PARTIAL", "FILLED", "CANCELLED", "EXPIRED", "UNKNOWN"),
    "FILLED": (),
    "CANCELLED": (),
    "REJECTED": (),
    "EXPIRED": (),
    "UNKNOWN": ("NEW", "PARTIAL", "FILLED", "CANCELLED", "REJECTED", "EXPIRED"),
}
ORDER_STATES = list(FOLLOWS)


def follow(state: str | None, kind: str) -> tuple[str | None, int]:
    """The state of an order after an event, and 1 if the event is illegal in it."""
    return (kind, 0) if kind in FOLLOWS[state] else (state, 1)


def _as_map(pairs: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(to.cast("int").alias("to"), n.cast("long").alias("illegal")) for to, n in pairs))


def order_state(events: DataFrame, key: str, order: list[str], kind: str, bucket: int | None = None, radix: int = RADIX) -> DataFrame:
    """T7, batch form: each order's last legal state and the illegal transitions; an event told twice, and a kind told twice in a row that is not PARTIAL, count once.

    An event is a function from the eight states to a state and a count of illegal
    transitions. Functions compose, so a history of any length is a mergeable aggregate.
    """
    return order_states(order_histories(events, key, order, kind, bucket, radix), key)


def order_states(histories: DataFrame, key: str) -> DataFrame:
    """What `order_histories` tell, by names."""
    names = F.array(*(F.lit(s or "UNKNOWN") for s in ORDER_STATES))
    return histories.select(key, names[F.col("at")].alias("state"), F.col("illegal").cast("int").alias("illegal"))


#: The bucket of the events that histories go on from, before all others.
_KNOWN = -(1 << 62)


def order_histories(events: DataFrame, key: str, order: list[str], kind: str, bucket: int | None = None, radix: int = RADIX, known: DataFrame | None = None) -> DataFrame:
    """(key, at, illegal) for each order, `at` the number of its state; with `known`, histories so far that these events follow, also `last`, the last event of each order."""
    last = F.struct(*order, "_kind")
    rows = events.select(F.col(key), *(F.col(c) for c in dict.fromkeys(order) if c != key), F.coalesce(kind, F.lit("")).alias("_kind")).dropDuplicates()
    at = bucket_of(rows, order[0], bucket)
    if known is not None:
        told = null_safe_join(rows, known.select(key, F.col("last").alias("_told")), [key], "left")
        rows = told.where(~F.coalesce(last.eqNullSafe(F.col("_told")), F.lit(False))).drop("_told").withColumn("_known", F.lit(False))
        rows = materialize(rows.unionByName(known.select(key, "last.*", F.lit(True).alias("_known"))))
        at = F.when(F.col("_known"), F.lit(_KNOWN)).otherwise(at)
    rows = rows.withColumns({"_last": F.col("_kind"), "_n": F.lit(1).cast("long")})
    rows = with_carry(rows, [key], at, {"_last": (F.max_by("_kind", last), last_known), "_n": (F.count("*"), F.sum)})
    w = Window.partitionBy(key, "_b").orderBy(F.desc("_carry"), *order, "_kind")
    rows = rows.withColumns({"_seen": last_known(F.col("_last")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_rank": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1}).where(~F.col("_carry"))
    now = F.col("_kind")
    to = F.array_position(F.array(*(F.lit(s or "") for s in ORDER_STATES)), now) - 1
    moved = _as_map([(F.when(now.isin(*after), to).otherwise(k), F.when(now.isin(*after), 0).otherwise(1)) if after else (F.lit(k), F.lit(1)) for k, after in enumerate(FOLLOWS.values())])
    still = _as_map([(F.lit(k), F.lit(0)) for k in range(len(FOLLOWS))])
    idle = (F.col("_seen") == now) & (now != "PARTIAL")
    if known is not None:
        idle = F.col("_known") | idle
    mapped = materialize(rows.select(key, "_rank", F.when(idle, still).otherwise(moved).alias("_map"), *([] if known is None else [F.when(~F.col("_known"), last).alias("_event")])))
    then = lambda first, second: F.transform(first, lambda x: F.struct(second[x["to"]]["to"].alias("to"), (x["illegal"] + second[x["to"]]["illegal"]).alias("illegal")))
    whole = compose_all(mapped, [key], then, still, radix)
    if known is None:
        return whole.select(key, F.col("_map")[0].alias("m")).select(key, F.col("m.to").alias("at"), "m.illegal")
    newest = mapped.groupBy(key).agg(F.max("_event").alias("_event"))
    both = null_safe_join(null_safe_join(whole, newest, [key], "inner"), known.select(key, F.col("at").alias("_at"), F.col("illegal").alias("_illegal"), F.col("last").alias("_told")), [key], "left")
    both = both.withColumn("m", F.col("_map")[F.coalesce("_at", F.lit(0))])
    return both.select(key, F.col("m.to").alias("at"), (F.col("m.illegal") + F.coalesce("_illegal", F.lit(0))).alias("illegal"), F.coalesce("_event", "_told").alias("last"))


def kill_switch(events: DataFrame, by: str, order: list[str], severity: str, reset: str) -> DataFrame:
    """T8, batch form: the largest severity since the last explicit reset; it never falls otherwise."""
    w = Window.partitionBy(by).orderBy(*order)
    out = events.withColumn("_e", F.sum(F.col(reset).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(by, "_e").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    level = F.max(F.when(F.col(reset), 0).otherwise(F.col(severity))).over(run)
    return out.withColumn("level", level).withColumn("switch", F.when(F.col("level") >= 2, "HALT").when(F.col("level") == 1, "REDUCE_ONLY").otherwise("NORMAL")).drop("_e")
