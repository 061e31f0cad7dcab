"""Queries that run a stream over the given files to its end: what has arrived is read, state is kept, and the sink's table is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.base import BARS, ORACLES, TRADES, query
from tidemark.plans.ledger_queries import _KINDS
from tidemark.operators import features as X
from tidemark.operators.lineage import materialize
from tidemark.plans.market_queries import _L24, _REGIME, _VOL, _W, _r, bars, fresh_path
from tidemark.sources import ingest as I
from tidemark.sources.tables import EVENTS, ntz, read_table
from tidemark.streaming import stream as T


def _folder(spark: SparkSession) -> str:
    return fresh_path(spark, "stream")


#: Rows of each batch from which a batch is written as several files, and how many.
MANY_ROWS, FILES = 1_000_000, 8


def _in_files(spark: SparkSession, rows: DataFrame, batch: str, batches: int = 4) -> DataFrame:
    """Rows as a stream of several batches, one after the other: `batch` is the number of a row's batch, in SQL. All batches have as many files, which one trigger takes."""
    path = _folder(spark)
    sizes = {r[0]: r[1] for r in rows.groupBy(F.expr(batch).alias("k")).count().collect()}
    files = FILES if min(sizes.get(k, 0) for k in range(batches)) >= MANY_ROWS else 1
    for k in range(batches):  # dealt in turn, so that no file of many rows is empty; the source takes files by their times
        rows.where(f"{batch} = {k}").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _arrivals(spark: SparkSession, sf_dir: str, order: str, batches: int = 4) -> DataFrame:
    """The trades as a stream of several batches: `order` is the number of a row's batch, in SQL over events."""
    return _as_trades(_in_files(spark, read_table(spark, f"{sf_dir}/events.parquet", EVENTS), order, batches))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.read_stream(spark, f"{sf_dir}/events.parque[t]", EVENTS)  # a pattern: the table may be one file or a folder


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_trades(_events(spark, sf_dir))


def _as_trades(events: DataFrame) -> DataFrame:
    return events.select(
        F.upper("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.regexp_extract("props", "-?[0-9]+", 0).cast("bigint").alias("qty"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("user_id").alias("account"),
    )


def _run(stream: DataFrame) -> DataFrame:
    """Append a stream's output to a table until its input is used up, and read the table."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession)
    query_ = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("select event_type, count(*) as n, sum(user_id)::bigint as users from events group by 1")
def c8_read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(_events(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def c9_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journalled, then run again from the same checkpoint: the second run adds nothing."""
    path = _folder(spark)
    for _ in range(2):
        I.journal(_events(spark, sf_dir), f"{path}/journal", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/journal").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select upper(event_type) as instrument, count(*) as n from events group by 1")
def t1_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _trades(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(T.stream_dedup(twice, ["seq"])).groupBy("instrument").agg(F.count("*").alias("n"))


@query(f"with {BARS} select instrument, bar_start, open, high, low, close, volume, n from bars where bar_start + interval 1 hour <= (select max(ts) from events) - interval 10 minute")
def t2_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that the watermark has closed."""
    return ntz(_run(T.stream_bars(_trades(spark, sf_dir), "1 hour")), "bar_start")


@query(f"""with {TRADES}, s as (select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from trades), closed as (select * from s where start + interval 2 hour <= (select max(ts) from events) - interval 10 minute)
    select instrument, start, count(*) as n, sum(qty)::bigint as volume, round(sum(case when side = 'BUY' then qty else -qty end) / nullif(sum(qty), 0), 6) as imbalance, round(avg(price), 8) as mean_price from closed group by 1, 2""")
def t3_stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(T.stream_features(_trades(spark, sf_dir), "2 hours", "1 hour")).select("instrument", "start", "n", "volume", "imbalance", "mean_price")
    return _r(_r(ntz(out, "start"), "imbalance"), "mean_price", n=8)


_CLOSED = f"{TRADES}, m as (select instrument, date_trunc('hour', ts) as start, count(*) as n, count(*) filter (where qty < 20) as rejects from trades group by 1, 2)"


@query(f"with {_CLOSED} select instrument, start, n, rejects from m where start + interval 1 hour <= (select max(ts) from events) - interval 10 minute")
def t10_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir).withColumn("qty", F.when(F.col("qty") < 20, 0).otherwise(F.col("qty")))
    return ntz(_run(T.stream_metrics(t, "1 hour")).select("instrument", "start", "n", "rejects"), "start")


@query(f"""with {TRADES}, b as (select *, seq % 4 as batch from trades), m as (select instrument, batch, max(ts) as t from b group by 1, 2),
    h as (select b.instrument, b.seq, b.ts, (select max(t) from m where m.instrument = b.instrument and m.batch < b.batch) as high from b)
    select seq, coalesce(ts < high - interval 10 minute, false) as late, case when ts < high - interval 10 minute then epoch(date_trunc('second', high))::bigint - epoch(date_trunc('second', ts))::bigint end as lateness from h""")
def t4_late_rows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches that each go over the whole time, so later ones bring late rows; the sinks together hold every row once."""
    path = _folder(spark)
    T.late_rows_stream(_arrivals(spark, sf_dir, "event_id % 4"), path)
    on_time = spark.read.parquet(f"{path}/on_time").select("seq", F.lit(False).alias("late"), F.lit(None).cast("bigint").alias("lateness"))
    return on_time.unionByName(spark.read.parquet(f"{path}/late").select("seq", F.lit(True).alias("late"), "lateness"))


@query(f"""with {TRADES}, b as (select *, case when instrument = 'VIEW' then 0 else (day(ts) - 1) // 8 end as batch from trades where instrument <> 'VIEW' or day(ts) <= 8), k as (select unnest([0, 1, 2, 3]) as batch),
    n as (select instrument, k.batch from (select distinct instrument from trades union all select 'GHOST'), k), l as (select n.instrument, n.batch, (select max(ts) from b where b.instrument = n.instrument and b.batch <= n.batch) as last_ts, (select max(ts) from b where b.batch <= n.batch) as clock from n)
    select instrument, batch, case when last_ts is null then 'unknown' when floor(epoch(clock)) - floor(epoch(last_ts)) <= 86400 then 'pass' else 'fail' end as gate from l""")
def t5_freshness_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of eight days; one instrument falls silent after the first and another is never seen."""
    path = _folder(spark)
    days = "cast((day(ts) - 1) / 8 as int)"
    arrived = _arrivals(spark, sf_dir, f"case when event_type <> 'view' then {days} when day(ts) <= 8 then 0 else -1 end")
    instruments = read_table(spark, f"{sf_dir}/events.parquet", EVENTS).select(F.upper("event_type").alias("instrument")).distinct()
    T.freshness_stream(arrived, path, instruments.union(spark.createDataFrame([("GHOST",)], "instrument string")), 86_400)
    return spark.read.parquet(f"{path}/gates").select("instrument", F.col("batch_id").cast("int").alias("batch"), "gate")


@query(ORACLES["t7_order_state"])
def t7_order_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of the batch form, state kept over four batches."""
    kind = F.create_map(*(F.lit(x) for p in _KINDS.items() for x in p))[F.lower("instrument")]
    orders = _arrivals(spark, sf_dir, "cast((day(ts) - 1) / 8 as int)").select(F.col("account").alias("user_id"), "ts", "seq", kind.alias("kind"))
    return T.order_states_stream(orders, _folder(spark), "user_id").withColumnRenamed("key", "user_id")


@query(f"""with s as ({ORACLES["t8_kill_switch"]}) select user_id, arg_max(switch, (ts, event_id)) as switch from s join events using (event_id) group by 1""")
def t8_kill_switch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch of each account at the end, state kept over four batches."""
    severity = F.when(F.col("instrument") == "ERROR", 1).when((F.col("instrument") == "PURCHASE") & (F.col("price") > 300), 2).otherwise(0)
    events = _arrivals(spark, sf_dir, "cast((day(ts) - 1) / 8 as int)").select(F.col("account").alias("user_id"), "ts", "seq", severity.alias("severity"), (F.col("instrument") == "SIGNUP").alias("reset"))
    return T.last_states(T.kill_switch_stream(events, "user_id"), _folder(spark)).withColumnRenamed("key", "user_id")


_CLOSED_BARS = "bar_start + interval 1 hour <= (select max(ts) from events) - interval 10 minute"


@query(f"""with {BARS}, s as (select instrument, date_trunc('hour', ts) as bar_start, sum(case when side = 'BUY' then qty else -qty end) as net from trades group by 1, 2), {_VOL}, {_REGIME},
    xx as (select rg.*, net, net / nullif(volume, 0) as imbalance, close / nullif(avg(close) over (partition by bar_start), 0) - 1 as basis, close - lag(close) over {_W}) as dp, row_number() over {_W}) as k from rg join s using (instrument, bar_start))
    select instrument, bar_start, round(close / lag(close, 24) over {_W}) - 1, 6) as ret_24, round(vol, 5) as vol, regime, round(case when count(*) over {_L24} >= 24 then (volume - avg(volume) over {_L24}) / nullif(stddev_samp(volume) over {_L24}, 0) end, 4) as volume_z,
        round(case when count(*) over {_L24} >= 24 then (basis - avg(basis) over {_L24}) / nullif(stddev_samp(basis) over {_L24}, 0) end, 3) as basis_z, round(imbalance, 6) as imbalance,
        case when k = 1 then null when net > 0 and dp > 0 then 'long_build' when net > 0 and dp < 0 then 'short_build' when net < 0 and dp > 0 then 'short_cover' when net < 0 and dp < 0 then 'long_exit' else 'flat' end as oi_state
    from xx qualify {_CLOSED_BARS}""")
def t3_bar_features_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row frames of 24 bars over bars that close in four batches; the index of a bar is the mean close of its instruments."""
    path = _folder(spark)
    signed = F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")))
    closed = T.stream_bars(_arrivals(spark, sf_dir, "cast((day(ts) - 1) / 8 as int)"), "1 hour", more={"signed": signed})
    with_index = lambda b: b.withColumns({"mark": F.col("close"), "index": F.avg("close").over(Window.partitionBy("bar_start"))})

    def build(b: DataFrame) -> DataFrame:
        out = X.basis(X.build_features(b))
        # open interest is the running signed quantity: only its last step counts
        oi = out.withColumn("oi", F.sum("signed").over(X.by_bar().rowsBetween(Window.unboundedPreceding, 0)))
        return X.oi_price_state(oi).withColumn("imbalance", F.try_divide("signed", "volume"))

    T.bar_features_stream(closed, path, build, 60, with_index)
    out = spark.read.parquet(f"{path}/features").select("instrument", "bar_start", "ret_24", "vol", "regime", "volume_z", "basis_z", "imbalance", "oi_state")
    return _r(_r(_r(_r(ntz(out, "bar_start"), "ret_24", "imbalance"), "vol", n=5), "volume_z", n=4), "basis_z", n=3)


@query(ORACLES["t6_gap_repair"])
def t6_gap_repair_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and backfill bars in four batches, each in no order of time."""
    path = _folder(spark)
    b = bars(spark, sf_dir).withColumn("i", F.row_number().over(X.by_bar()))
    both = b.where("i % 5 <> 2").withColumn("source", F.lit("live")).unionByName(b.withColumn("source", F.lit("backfill"))).drop("i")
    T.gap_repair_stream(_in_files(spark, materialize(both), "cast(pmod(xxhash64(instrument, bar_start, source), 4) as int)"), path, "1 hour")
    return ntz(spark.read.parquet(f"{path}/repaired").select("instrument", "bar_start", "source"), "bar_start")


@query(f"select * from ({ORACLES['t9_shadow_ledger']}) where bar_start <= (select date_trunc('hour', max(ts)) from events) - interval 9 day")
def t9_shadow_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and prices of eight days in each batch, every third price one batch late; a signal waits nine days for its price."""
    path = _folder(spark)
    b = X.returns(bars(spark, sf_dir), (1,))
    signal = b.select("instrument", F.col("bar_start").alias("ts"), F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0).alias("signal"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("ret"))
    price = b.select("instrument", F.col("bar_start").alias("ts"), F.lit(None).cast("double").alias("signal"), F.col("close").cast("double").alias("price"), F.coalesce("ret_1", F.lit(0.0)).alias("ret"))
    late = "price is not null and hour(ts) % 3 = 0 and day(ts) < 25"
    T.shadow_ledger_stream(_in_files(spark, materialize(signal.unionByName(price)), f"cast((day(ts) - 1) / 8 as int) + if({late}, 1, 0)"), path, delay="9 days")
    return _r(ntz(spark.read.parquet(f"{path}/ledger").select("instrument", "bar_start", F.col("position").cast("int").alias("position"), "net"), "bar_start"), "net", n=5)


#: Rules of the alerts: name, metric, and the most that is no breach.
_RULES = [("rejects", "reject_share", 0.3), ("gap", "gap", 1.0), ("deviation", "deviation", 1.5)]
_RULES_SQL = ", ".join(f"('{r}', '{m}', {x}::double)" for r, m, x in _RULES)
_RULE_METRICS = f"""{TRADES}, w as (select instrument, date_trunc('hour', ts) as start, count(*) filter (where qty < 20)::double / count(*) as reject_share, avg(abs((price - 100.0) / 100.0)) as deviation from trades group by 1, 2),
    m as (select *, coalesce(epoch(start) - epoch(lag(start) over (partition by instrument order by start)), 3600) / 3600 - 1 as gap from w where start + interval 1 hour <= (select max(ts) from events) - interval 10 minute),
    v as (select instrument, start, unnest(['reject_share', 'deviation', 'gap']) as metric, unnest([reject_share, deviation, gap]) as value from m),
    b as (select v.*, rule, value > most as breached from v join (values {_RULES_SQL}) r(rule, metric, most) using (metric)),
    e as (select *, coalesce(lag(breached) over (partition by instrument, rule order by start), false) as was from b),
    q as (select instrument, start, epoch(coalesce(lead(start) over (partition by instrument order by start), (select max(start) from m))) - epoch(start) as waited from m)"""


@query(f"with {_RULE_METRICS} select instrument, rule, start, round(value, 6) as value from e where breached and not was union all select instrument, 'silence', start, 10800.0 from q where waited > 10800")
def t10_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows closed in four batches against a table of rules; a breach that goes on over batches is told once, as is a silence."""
    path = _folder(spark)
    t = _arrivals(spark, sf_dir, "cast((day(ts) - 1) / 8 as int)").withColumns({"qty": F.when(F.col("qty") < 20, 0).otherwise(F.col("qty")), "reference": F.lit(100.0)})
    T.alerts_stream(T.stream_metrics(t, "1 hour", "reference"), path, spark.createDataFrame(_RULES, "rule string, metric string, most double"), "1 hour", 10_800)
    return _r(ntz(spark.read.parquet(f"{path}/alerts").select("instrument", "rule", "start", "value"), "start"), "value")
