"""Streams over files against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators.bars import trades_to_bars
from tidemark.sources import ingest as I
from tidemark.sources.tables import EVENTS, trades
from tidemark.streaming import stream as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def arrived(spark, tmp_path):
    """Trades as files in a folder, several batches."""
    t = trades(spark, SF)
    for k in range(4):  # one file after the other, as time goes on
        t.where((F.col("seq") >= 250 * k) & (F.col("seq") < 250 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return t, str(tmp_path / "in"), tmp_path


def stream(spark, t, path):
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_read_stream_and_journal_replays_to_the_same(spark, tmp_path):
    events = spark.read.schema(EVENTS).parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        I.journal(I.read_stream(spark, str(tmp_path / "in"), EVENTS), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_stream_dedup(spark, arrived):
    t, path, _ = arrived
    twice = stream(spark, t, path).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = T.replay(T.stream_dedup(twice, ["seq"]).select("seq"), "dedup")
    assert len(rows) == t.count()


def test_stream_bars_equal_closed_batch_bars(spark, arrived):
    t, path, _ = arrived
    got = {(r.instrument, r.bar_start): r for r in T.replay(T.stream_bars(stream(spark, t, path), "1 hour"), "bars")}
    want = {(r.instrument, r.bar_start): r for r in trades_to_bars(t, "1 hour").collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == r for k, r in got.items())


def test_stream_features_equal_batch(spark, arrived):
    t, path, _ = arrived
    got = {(r.instrument, r.start): r.volume for r in T.replay(T.stream_features(stream(spark, t, path), "2 hours", "1 hour"), "features")}
    want = {(r.instrument, r.start): r.volume for r in T.stream_features(t, "2 hours", "1 hour").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_stateful_order_state_and_kill_switch(spark, arrived):
    t, path, tmp_path = arrived
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {"SIGNUP": "NEW", "VIEW": "PARTIAL", "PURCHASE": "FILLED", "ERROR": "REJECTED", "CLICK": "CANCELLED"}
    kind = F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("instrument")]
    own = lambda df: df.select("account", "ts", "seq", kind.alias("kind"), F.when(F.col("instrument") == "ERROR", 1).otherwise(0).alias("severity"), (F.col("instrument") == "SIGNUP").alias("reset"))
    rows = T.replay(T.order_state_stream(own(stream(spark, t, path)).drop("severity", "reset"), "account"), "orders", "update")
    got = {r.key: (r.state, r.illegal) for r in rows}
    want = {r.account: (r.state, r.illegal) for r in L.order_state(own(t), "account", ["ts", "seq"], "kind").collect()}
    assert got == want
    rows = T.replay(T.kill_switch_stream(own(stream(spark, t, path)).drop("kind"), "account"), "switch", "update")
    last = {r.account: r.switch for r in L.kill_switch(own(t), "account", ["ts", "seq"], "severity", "reset").orderBy("ts", "seq").collect()}
    assert {r.key: r.switch for r in rows} == last


def test_late_rows_freshness_and_repair(spark, arrived):
    t, _, _ = arrived
    high = t.groupBy("instrument").agg((F.max("ts") - F.expr("interval 1 day")).alias("high_ts"))
    on_time, late = T.late_rows(t, high)
    assert on_time.count() + late.count() == t.count() and late.where("lateness <= 600").count() == 0
    bars = trades_to_bars(t, "1 hour")
    live = bars.where("hour(bar_start) % 6 <> 3")
    fixed = T.gap_repair(live, bars, "1 hour")
    assert fixed.groupBy("instrument", "bar_start").count().where("count > 1").count() == 0
    assert fixed.where("source = 'backfill'").count() > 0
