"""Structured Streaming forms of the bars, checks and state machines. Each has a batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.bars import find_gaps
from tidemark.operators.joins import asof_join
from tidemark.operators.ledger import follow, order_histories, order_states
from tidemark.operators.lineage import materialize
from tidemark.operators.research import run_vector_bt
from tidemark.sources.ingest import path_exists as _exists

LATENESS = "10 minutes"


def stream_dedup(stream: DataFrame, key: list[str], delay: str = LATENESS, ts: str = "ts") -> DataFrame:
    """Drop events that are delivered again within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def stream_bars(stream: DataFrame, width: str, delay: str = LATENESS, more: dict[str, Column] | None = None) -> DataFrame:
    """Bars of (instrument, ts, seq, price, qty), each emitted once when the watermark has passed it; `more` are further aggregates of a bar's trades."""
    at = F.struct("ts", "seq")
    more = more or {}
    out = stream.withWatermark("ts", delay).groupBy("instrument", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n"), *(c.alias(name) for name, c in more.items()),
    )
    return out.select("instrument", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n", *more)


def stream_features(stream: DataFrame, length: str, slide: str, delay: str = LATENESS) -> DataFrame:
    """Sliding-window features: trades, volume, signed imbalance, mean and deviation of price."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    source = stream.withWatermark("ts", delay) if stream.isStreaming else stream
    out = source.groupBy("instrument", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.sum(signed).alias("signed"), F.avg("price").alias("mean_price"), F.stddev_samp("price").alias("sd_price"))
    return out.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume", F.try_divide("signed", "volume").alias("imbalance"), "mean_price", "sd_price")


def late_rows(batch: DataFrame, high_water: DataFrame, delay: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """T4: (in time, too late) rows of a batch against each instrument's journalled high-water mark, with the lateness in seconds."""
    j = batch.join(high_water.select("instrument", "high_ts"), "instrument", "left")
    late = F.coalesce(F.col("ts") < F.col("high_ts") - F.expr(f"interval {delay}"), F.lit(False))
    return j.where(~late).drop("high_ts"), j.where(late).withColumn("lateness", F.unix_timestamp("high_ts") - F.unix_timestamp("ts"))


def late_rows_stream(stream: DataFrame, path: str, delay: str = LATENESS) -> None:
    """T4 over a stream, until its input is used up: each batch against the high-water marks of all batches before it.

    In time and late rows and the marks are written by batch under `path` (on_time, late,
    marks); a batch that is run again overwrites its own partitions and reads the marks of
    the one before it, so replays change nothing.
    """
    spark = stream.sparkSession

    def marks_before(batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], "instrument string, high_ts timestamp")
        return spark.read.schema("instrument string, high_ts timestamp").parquet(f"{path}/marks/batch_id={batch_id - 1}")

    def one(batch: DataFrame, batch_id: int) -> None:
        before = marks_before(batch_id)
        on_time, late = late_rows(batch, before, delay)
        on_time.write.mode("overwrite").parquet(f"{path}/on_time/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        after = before.unionByName(batch.select("instrument", F.col("ts").alias("high_ts"))).groupBy("instrument").agg(F.max("high_ts").alias("high_ts"))
        after.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def fold_batches(stream: DataFrame, path: str, states: dict[str, str], step: Callable[[DataFrame, dict[str, DataFrame], int], dict[str, DataFrame]], once: bool = True):
    """Run a stream with state in tables: `step(batch, states as they were, batch id)` gives the states as they are now and rows for sinks, by name.

    Each is written as the partition batch_id=k of its table under `path`. A batch that is
    run again reads the states of the one before it and overwrites its own partitions, so
    replays change nothing. `states` has the schemas of the states; versions that no replay
    can need are deleted, sinks stay. `once`: until the input is used up, else as it comes.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        before = {}
        for name, schema in states.items():
            at = f"{path}/{name}/batch_id={batch_id - 1}"
            before[name] = spark.read.schema(schema).parquet(at) if batch_id else spark.createDataFrame([], schema)
        batch.persist()
        try:
            for name, rows in step(batch, before, batch_id).items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        for name in states:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/batch_id={batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint")
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def bar_features_stream(bars: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], keep: int, arrive: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """T3, row frames: the features of each closed bar of a stream, by `build` (any of W5-W14 over bars) on the bar and the `keep` bars of its instrument before it.

    `keep` is the longest frame of `build`, frames of frames added up; the values are then
    those of the batch form. Bars come in the order of their time, as closed windows do.
    `arrive` adds what the instruments of one bar make together (an index), once. Under
    `path`: features, and the last `keep` bars of each instrument by batch.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrive(bars.sparkSession.createDataFrame([], bars.schema)).schema.fields)

    def step(batch: DataFrame, before: dict[str, DataFrame], _: int) -> dict[str, DataFrame]:
        both = before["history"].withColumn("_new", F.lit(False)).unionByName(arrive(batch).withColumn("_new", F.lit(True)))
        latest = Window.partitionBy("instrument").orderBy(F.desc("bar_start"))
        history = both.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= keep).drop("_k", "_new")
        return {"features": build(both).where("_new").drop("_new"), "history": history}

    fold_batches(bars, path, {"history": kinds}, step)


def freshness_stream(stream: DataFrame, path: str, required: DataFrame, max_age_seconds: int) -> None:
    """T5 over a stream: after each batch the gate of each required instrument at the newest time that any has reached, written by batch under `path`/gates; the newest times are kept as in `late_rows_stream`."""
    spark = stream.sparkSession
    kind = "instrument string, ts timestamp"

    def one(batch: DataFrame, batch_id: int) -> None:
        known = batch.select("instrument", "ts")
        if batch_id:
            known = known.unionByName(spark.read.schema(kind).parquet(f"{path}/last/batch_id={batch_id - 1}"))
        known.groupBy("instrument").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{path}/last/batch_id={batch_id}")
        last = spark.read.schema(kind).parquet(f"{path}/last/batch_id={batch_id}")
        clock = last.agg(F.max("ts")).first()[0]
        freshness_gate(last, required, clock, max_age_seconds).write.mode("overwrite").parquet(f"{path}/gates/batch_id={batch_id}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def last_states(stream: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Run a stream of updated states to its end, its batches written under `path`, and give the last state of each key."""
    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what stateful processors need
    try:
        stream.writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, was)
    states = spark.read.option("basePath", f"{path}/states").schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/states")
    others = [c for c in stream.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(key, "s.*")


def freshness_gate(rows: DataFrame, required: DataFrame, clock, max_age_seconds: int) -> DataFrame:
    """T5: pass, fail or unknown (no data) for each required instrument at a given clock."""
    last = rows.groupBy("instrument").agg(F.max("ts").alias("last_ts"))
    age = F.unix_timestamp(F.lit(clock)) - F.unix_timestamp("last_ts")
    return required.select("instrument").distinct().join(last, "instrument", "left").withColumn("age", age).withColumn("gate", F.when(F.col("age").isNull(), "unknown").when(F.col("age") <= max_age_seconds, "pass").otherwise("fail"))


def gap_repair(journal: DataFrame, backfill: DataFrame, width: str) -> DataFrame:
    """Bars of the journal and, for its gaps, those of the backfill, with their source."""
    gaps = find_gaps(journal, width)
    w = F.expr(f"interval {width}")
    wanted = gaps.select("instrument", F.explode(F.sequence("gap_start", F.col("gap_end") - w, w)).alias("bar_start"))
    refill = backfill.join(wanted, ["instrument", "bar_start"], "left_semi")
    return journal.withColumn("source", F.lit("live")).unionByName(refill.withColumn("source", F.lit("backfill")))


def gap_repair_stream(rows: DataFrame, path: str, width: str) -> None:
    """T6 over a stream of live and backfill bars (instrument, bar_start, ..., source `live` or `backfill`) in any order: the table under `path`/repaired is at all times what `gap_repair` gives for what has arrived.

    A backfill bar counts where its instrument has no live bar between its first and last
    one. What has arrived is kept by day (`path`/arrived), with the first and last live bar
    of each instrument by batch (`path`/ends). A batch reads and overwrites the days that it
    has rows of, and those that a first or last live bar has moved over, where waiting
    backfill may now count. Both are unions of sets, so replays change nothing.
    """
    spark = rows.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    day = F.to_date("bar_start")

    def held(days: DataFrame) -> DataFrame:
        if not _exists(spark, f"{path}/arrived"):
            return spark.createDataFrame([], f"{kinds}, day date")
        return spark.read.schema(f"{kinds}, day date").parquet(f"{path}/arrived").join(F.broadcast(days), "day", "left_semi")

    def step(batch: DataFrame, before: dict[str, DataFrame], _: int) -> dict[str, DataFrame]:
        live = batch.where("source = 'live'").groupBy("instrument").agg(F.min("bar_start").alias("first"), F.max("bar_start").alias("last"))
        ends = materialize(before["ends"].unionByName(live).groupBy("instrument").agg(F.min("first").alias("first"), F.max("last").alias("last")))
        was = before["ends"].select("instrument", F.col("first").alias("f"), F.col("last").alias("l"))
        moved = ends.join(was, "instrument", "left").select(F.array(F.struct(F.col("first").alias("a"), F.coalesce("f", "last").alias("b")), F.struct(F.coalesce("l", "first").alias("a"), F.col("last").alias("b"))).alias("spans"))
        over = moved.select(F.explode("spans").alias("s")).where("s.a < s.b").select(F.explode(F.sequence(F.to_date("s.a"), F.to_date("s.b"))).alias("day"))
        days = materialize(batch.select(day.alias("day")).union(over).distinct())  # a row for each day of the calendar at most
        told = batch.withColumn("day", day)
        arrived = materialize(held(days).select(told.columns).unionByName(told).dropDuplicates(["instrument", "bar_start", "source"]))
        arrived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/arrived")
        is_live = F.max((F.col("source") == "live").cast("int")).over(Window.partitionBy("instrument", "bar_start"))
        seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {width}"))
        on_grid = F.pmod(F.unix_timestamp("bar_start") - F.unix_timestamp("first"), seconds) == 0
        counts = arrived.withColumn("_live", is_live).join(ends, "instrument", "left").where((F.col("source") == "live") | (F.col("_live") == 0) & on_grid & (F.col("bar_start") > F.col("first")) & (F.col("bar_start") < F.col("last")))
        counts.select(told.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/repaired")
        return {"ends": ends}

    fold_batches(rows, path, {"ends": "instrument string, first timestamp, last timestamp"}, step)


class OrderState(StatefulProcessor):
    """The state of an order across batches, by the same transitions as the batch form; events of a batch are taken in (ts, seq) order. The last event is kept, so one that is delivered again in a later batch counts once."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, illegal int, seen string, last string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, illegal, seen, last = self.state.get() if self.state.exists() else (None, 0, None, None)
        events = pd.concat([r[["ts", "seq", "kind"]] for r in rows]).sort_values(["ts", "seq", "kind"]).drop_duplicates()
        for ts, seq, kind in events.itertuples(index=False):
            event = f"{ts}|{seq}|{kind}"
            if event != last and (kind != seen or kind == "PARTIAL"):
                state, wrong = follow(state, kind or "")
                illegal, seen = illegal + wrong, kind
            last = event
        self.state.update((state, illegal, seen, last))
        yield pd.DataFrame({"key": [key[0]], "state": [state or "UNKNOWN"], "illegal": [illegal]})

    def close(self) -> None:
        pass


def order_state_stream(stream: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """T7 over a stream of (key, ts, seq, kind). With `ttl_ms` an order that is not heard of for so long is forgotten."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(OrderState(ttl_ms), f"key {kind}, state string, illegal int", "Update", "None" if ttl_ms is None else "ProcessingTime")


def order_states_stream(stream: DataFrame, path: str, key: str) -> DataFrame:
    """T7 over a stream of (key, ts, seq, kind) with the states in a table, until its input is used up: the state of each order at the end.

    A batch is composed as in the batch form, so there is no step in Python for an order, and
    an order may have any number of events. The last event of each order is kept: delivered
    again in a later batch it counts once.
    """
    spark, fields = stream.sparkSession, dict(stream.dtypes)
    kinds = f"key {fields[key]}, at int, illegal long, last struct<ts:{fields['ts']},seq:{fields['seq']},_kind:string>"

    def step(batch: DataFrame, before: dict[str, DataFrame], _: int) -> dict[str, DataFrame]:
        return {"orders": order_histories(batch.withColumnRenamed(key, "key"), "key", ["ts", "seq"], "kind", known=before["orders"])}

    fold_batches(stream, path, {"orders": kinds}, step)
    if not _exists(spark, f"{path}/orders"):
        return order_states(spark.createDataFrame([], kinds), "key")
    states = spark.read.schema(f"{kinds}, batch_id long").parquet(f"{path}/orders")
    return order_states(states.where(F.col("batch_id") == states.agg(F.max("batch_id")).first()[0]), "key")


def kill_switch_stream(stream: DataFrame, key: str) -> DataFrame:
    """T8 over a stream of (key, ts, seq, severity, reset): the largest severity since the last reset, in the order of (ts, seq) across batches. The newest event of each level tells it, so the state is three maxima."""
    at = F.struct("ts", "seq")
    newest = lambda cond: F.max(F.when(cond, at))
    reset = F.coalesce("reset", F.lit(False))
    out = stream.groupBy(F.col(key).alias("key")).agg(newest(reset).alias("r"), newest(~reset & (F.col("severity") >= 1)).alias("low"), newest(~reset & (F.col("severity") >= 2)).alias("high"))
    since = lambda c: F.coalesce(F.col(c) > F.col("r"), F.col(c).isNotNull())
    return out.select("key", F.when(since("high"), "HALT").when(since("low"), "REDUCE_ONLY").otherwise("NORMAL").alias("switch"))


def shadow_ledger(signals: DataFrame, prices: DataFrame, cost: float = 0.00065) -> DataFrame:
    """Virtual orders of signals (instrument, bar_start, signal) at the price known then, with costs and equity; append-only rows for `foreachBatch`."""
    priced = asof_join(signals, prices, ("bar_start", "price_ts"), ["instrument"], ["price", "ret"])
    return run_vector_bt(priced, cost)


_LEDGER = "instrument string, bar_start timestamp, signal double, ret double, price double, position double, turnover double, gross double, cost double, net double, equity_gross double, equity_net double"


def shadow_ledger_stream(rows: DataFrame, path: str, cost: float = 0.00065, delay: str = LATENESS) -> None:
    """T9 over a stream of signals and prices: rows (instrument, ts, signal) or (instrument, ts, price, ret), the others null.

    A signal is settled when the newest time of all rows is `delay` past it: until then
    prices that come late still count. Under `path`, append-only by batch: ledger (what the
    batch form gives for the settled signals), late (signals behind the settled time, which
    change nothing). The states are the signals that wait, the prices that they may need
    (for each instrument the last settled one and all later), the last two ledger rows of
    each instrument, and the settled time.
    """
    states = {"waiting": "instrument string, bar_start timestamp, signal double", "prices": "instrument string, price_ts timestamp, price double, ret double", "book": _LEDGER, "clock": "ts timestamp"}

    def step(batch: DataFrame, before: dict[str, DataFrame], _: int) -> dict[str, DataFrame]:
        was = before["clock"].agg(F.max("ts")).first()[0]
        newest = batch.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("ts"))
        clock = materialize(before["clock"].unionByName(newest).agg(F.max("ts").alias("ts")))
        now = F.lit(clock.first()[0]).cast("timestamp")
        came = batch.where("signal is not null").select("instrument", F.col("ts").alias("bar_start"), F.col("signal").cast("double").alias("signal"))
        is_late = F.coalesce(F.col("bar_start") <= F.lit(was).cast("timestamp"), F.lit(False))
        signals = before["waiting"].unionByName(came.where(~is_late))
        prices = before["prices"].unionByName(batch.where("price is not null").select("instrument", F.col("ts").alias("price_ts"), "price", "ret"))
        due, book = signals.where(F.col("bar_start") <= now), before["book"]
        priced = asof_join(due, prices, ("bar_start", "price_ts"), ["instrument"], ["price", "ret"]).drop("matched_price_ts")
        # two rows of the ledger stand before the new ones, for the position and its change
        known = book.select("instrument", "bar_start", "signal", "price", "ret", F.lit(False).alias("_new"))
        bt = run_vector_bt(priced.withColumn("_new", F.lit(True)).unionByName(known), cost).where("_new")
        equity = book.groupBy("instrument").agg(F.max_by("equity_gross", "bar_start").alias("_g"), F.max_by("equity_net", "bar_start").alias("_n"))
        run = Window.partitionBy("instrument").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
        bt = bt.join(equity, "instrument", "left").withColumns({"equity_gross": F.coalesce("_g", F.lit(0.0)) + F.sum("gross").over(run), "equity_net": F.coalesce("_n", F.lit(0.0)) + F.sum("net").over(run)})
        names = [c.split()[0] for c in _LEDGER.split(", ")]
        ledger = materialize(bt.select(*(F.col(c).cast(t) for c, t in (x.split() for x in _LEDGER.split(", ")))))
        last = Window.partitionBy("instrument").orderBy(F.desc("bar_start"))
        new_book = book.unionByName(ledger).withColumn("_k", F.row_number().over(last)).where("_k <= 2").select(names)
        settled = Window.partitionBy("instrument").orderBy(F.desc(F.when(F.col("price_ts") <= now, F.col("price_ts"))), F.desc("price"), F.desc("ret"))
        needed = prices.withColumn("_k", F.row_number().over(settled)).where((F.col("_k") == 1) | F.coalesce(F.col("price_ts") > now, F.lit(True))).drop("_k")
        return {"ledger": ledger, "late": came.where(is_late), "waiting": signals.where(~F.coalesce(F.col("bar_start") <= now, F.lit(False))), "prices": needed, "book": new_book, "clock": clock}

    fold_batches(rows, path, states, step)


def stream_metrics(rows: DataFrame, width: str = "1 minute", reference: str | None = None) -> DataFrame:
    """For each window and instrument its events, rejects (no quantity), newest time, the longest wait inside it in seconds, and with a `reference` price column the mean absolute relative deviation from it."""
    source = rows.withWatermark("ts", LATENESS) if rows.isStreaming else rows
    off = {"deviation": F.avg(F.abs(F.try_divide(F.col("price") - F.col(reference), F.col(reference))))} if reference else {}
    out = source.groupBy("instrument", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("qty") == 0).alias("rejects"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *(c.alias(k) for k, c in off.items()))
    return out.select("instrument", F.col("w.start").alias("start"), "n", "rejects", F.try_divide(F.col("rejects").cast("double"), F.col("n")).alias("reject_share"), "first_ts", "last_ts", *off)


def alerts(metrics: DataFrame, limit: float) -> DataFrame:
    """Windows whose reject share crosses a limit while the window before did not: one alert for each run of breaches."""
    bad = F.try_divide("rejects", "n") > limit
    before = F.lag(bad).over(Window.partitionBy("instrument").orderBy("start"))
    return metrics.withColumn("_a", bad & ~F.coalesce(before, F.lit(False))).where("_a").drop("_a")


_RULE_STATE = "instrument string, rule string, breached boolean, start timestamp"


def _breaches(metrics: DataFrame, rules: DataFrame, last_seen: DataFrame, width: str) -> DataFrame:
    """(instrument, rule, start, value, breached) for each window and rule (rule, metric, most). Beside the metrics of a window a rule may name `gap`: the windows without any event since the one before."""
    seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {width}"))
    both = metrics.withColumn("_new", F.lit(True)).unionByName(last_seen.select("instrument", F.col("last_start").alias("start"), F.lit(False).alias("_new")), allowMissingColumns=True)
    wait = F.unix_timestamp("start") - F.unix_timestamp(F.lag("start").over(Window.partitionBy("instrument").orderBy("start")))
    rows = both.withColumn("gap", F.coalesce(wait / seconds - 1, F.lit(0.0))).where("_new")
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    long = rows.select("instrument", "start", F.explode(F.map_from_arrays(F.array(*map(F.lit, numeric)), F.array(*(F.col(c).cast("double") for c in numeric)))).alias("metric", "value"))
    return long.join(F.broadcast(rules), "metric").select("instrument", "rule", "start", "value", F.coalesce(F.col("value") > F.col("most"), F.lit(False)).alias("breached"))


def alert_rules(metrics: DataFrame, rules: DataFrame, width: str, silence: tuple[float, object] | None = None) -> DataFrame:
    """T10, batch form: the first window of each run of breaches of each rule; with `silence` = (seconds, clock) also the instruments that have not been heard of for longer at the clock, or were not between two windows."""
    last = metrics.groupBy("instrument").agg(F.max("start").alias("last_start")).where("false")
    b = _breaches(metrics, rules, last, width)
    before = F.lag("breached").over(Window.partitionBy("instrument", "rule").orderBy("start"))
    edges = b.withColumn("_e", F.col("breached") & ~F.coalesce(before, F.lit(False))).where("_e").select("instrument", "rule", "start", "value")
    if silence is None:
        return edges
    most, clock = silence
    w = Window.partitionBy("instrument").orderBy("start")
    quiet = metrics.withColumn("_next", F.coalesce(F.lead("start").over(w), F.lit(clock).cast("timestamp")))
    waited = F.unix_timestamp("_next") - F.unix_timestamp("start")
    return edges.unionByName(quiet.where(waited > most).select("instrument", F.lit("silence").alias("rule"), "start", F.lit(float(most)).alias("value")))


def alerts_stream(metrics: DataFrame, path: str, rules: DataFrame, width: str, silence_seconds: float) -> None:
    """T10 over a stream of windows of `stream_metrics`: one alert for each run of breaches, however many batches it lasts, and one for each silence, raised by the clock (the newest window of any instrument) without a row of the silent instrument.

    Under `path`: alerts by batch, and as states whether each rule is in breach, the last
    window of each instrument, and whether its silence has been told.
    """

    def step(batch: DataFrame, before: dict[str, DataFrame], _: int) -> dict[str, DataFrame]:
        known = before["seen"]
        b = _breaches(batch, rules, known, width)
        both = b.withColumn("_new", F.lit(True)).unionByName(before["rules"].select("instrument", "rule", "start", F.lit(None).cast("double").alias("value"), "breached", F.lit(False).alias("_new")))
        was = F.lag("breached").over(Window.partitionBy("instrument", "rule").orderBy("start"))
        edges = both.withColumn("_e", F.col("_new") & F.col("breached") & ~F.coalesce(was, F.lit(False))).where("_e").select("instrument", "rule", "start", "value")
        state = both.groupBy("instrument", "rule").agg(F.max_by("breached", "start").alias("breached"), F.max("start").alias("start")).select(*(c.split()[0] for c in _RULE_STATE.split(", ")))
        # silences: between two windows, and from the last one to the clock; one that has been told is not told again when it ends
        starts = batch.select("instrument", "start", F.lit(False).alias("told")).unionByName(known.select("instrument", F.col("last_start").alias("start"), "told"))
        clock = starts.agg(F.max("start")).first()[0]
        w = Window.partitionBy("instrument").orderBy("start")
        waited = F.unix_timestamp(F.coalesce(F.lead("start").over(w), F.lit(clock).cast("timestamp"))) - F.unix_timestamp("start")
        marked = materialize(starts.withColumn("_quiet", waited > silence_seconds))
        quiet = marked.where("_quiet and not told").select("instrument", F.lit("silence").alias("rule"), "start", F.lit(float(silence_seconds)).alias("value"))
        seen = marked.groupBy("instrument").agg(F.max("start").alias("last_start"), F.max_by(F.col("told") | F.col("_quiet"), "start").alias("told"))
        return {"alerts": edges.unionByName(quiet), "rules": state, "seen": seen}

    fold_batches(metrics, path, {"rules": _RULE_STATE, "seen": "instrument string, last_start timestamp, told boolean"}, step)


def replay(stream: DataFrame, name: str, mode: str = "append") -> list[Row]:
    """Run a stream over what has arrived into a memory table and give its rows: for tests and reports, not for production sinks."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()
