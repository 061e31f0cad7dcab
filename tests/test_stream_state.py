"""Streams with state in tables: a batch that is run again changes nothing, and the result is that of the batch form."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import stream as T

T0 = datetime(2024, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def arrive(spark, folder, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_last_batch_again(path):
    """As if the driver had been lost after the batch's writes and before its commit."""
    commits = f"{path}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    return last


def test_gap_repair_in_any_order_with_replays(spark, tmp_path):
    schema = "instrument string, bar_start timestamp, close double, source string"
    live = [("A", hours(h), 1.0, "live") for h in (0, 1, 4, 5, 60)] + [("B", hours(h), 1.0, "live") for h in (3, 9)]
    back = [(i, hours(h), 2.0, "backfill") for i in "AB" for h in (0, 2, 3, 6, 30, 61)] + [("C", hours(1), 2.0, "backfill")]
    late = [("A", hours(2), 1.0, "live"), ("A", hours(3), 2.0, "backfill")]  # a live bar where backfill stood, and backfill told twice
    path = str(tmp_path / "out")
    stream = arrive(spark, str(tmp_path / "in"), schema, [back, live[:3], live[3:], late])
    T.gap_repair_stream(stream(), path, "1 hour")

    def told():
        return sorted((r.instrument, r.bar_start, r.source) for r in spark.read.parquet(f"{path}/repaired").collect())

    first = told()
    everything = spark.createDataFrame(back + live + late, schema).dropDuplicates(["instrument", "bar_start", "source"])
    twin = T.gap_repair(everything.where("source = 'live'").drop("source"), everything.where("source = 'backfill'").drop("source"), "1 hour")
    assert first == sorted((r.instrument, r.bar_start, r.source) for r in twin.collect())
    assert run_last_batch_again(path) == 3
    T.gap_repair_stream(stream(), path, "1 hour")
    assert told() == first


def test_shadow_ledger_with_late_prices_and_signals(spark, tmp_path):
    schema = "instrument string, ts timestamp, signal double, price double, ret double"
    signals = [("A", hours(h), float(h % 3 - 1), None, None) for h in range(20)]
    prices = [("A", hours(h) - timedelta(minutes=5), None, 100.0 + h, 0.01 * (h % 4)) for h in range(20)]
    batches = [signals[:6] + prices[:3], signals[6:12] + prices[5:9] + prices[3:5], signals[12:] + prices[9:], [("A", hours(2), 1.0, None, None), ("B", hours(30), 1.0, None, None)]]
    path = str(tmp_path / "out")
    stream = arrive(spark, str(tmp_path / "in"), schema, batches)
    for _ in range(2):
        T.shadow_ledger_stream(stream(), path, delay="4 hours")
        got = {r.bar_start: (r.position, r.price, round(r.net, 9), round(r.equity_net, 9), round(r.equity_gross, 9)) for r in spark.read.parquet(f"{path}/ledger").collect()}
        twin = T.shadow_ledger(spark.createDataFrame([(i, t, s) for i, t, s, _, _ in signals], "instrument string, bar_start timestamp, signal double"), spark.createDataFrame([(i, t, p, r) for i, t, _, p, r in prices], "instrument string, price_ts timestamp, price double, ret double"))
        want = {r.bar_start: (float(r.position), r.price, round(r.net, 9), round(r.equity_net, 9), round(r.equity_gross, 9)) for r in twin.collect()}
        assert got == want and len(got) == 20
        assert [(r.instrument, r.bar_start) for r in spark.read.parquet(f"{path}/late").collect()] == [("A", hours(2))]
        run_last_batch_again(path)


def test_breaches_and_silences_are_told_once(spark, tmp_path):
    schema = "instrument string, start timestamp, reject_share double"
    rows = {"A": {0: 0.1, 1: 0.5, 2: 0.6, 3: 0.7, 4: 0.1, 5: 0.9}, "B": {0: 0.9, 6: 0.9}, "C": {0: 0.0}}
    batches = [[(i, hours(h), v) for i, at in rows.items() for h, v in at.items() if lo <= h < hi] for lo, hi in ((0, 2), (2, 3), (3, 5), (5, 6), (6, 7))]
    rules = spark.createDataFrame([("rejects", "reject_share", 0.3), ("gap", "gap", 3.0)], "rule string, metric string, most double")
    path = str(tmp_path / "out")
    stream = arrive(spark, str(tmp_path / "in"), schema, batches)
    want = sorted([("A", "rejects", hours(1)), ("A", "rejects", hours(5)), ("B", "rejects", hours(0)), ("B", "gap", hours(6)), ("B", "silence", hours(0)), ("C", "silence", hours(0))])
    for _ in range(2):
        T.alerts_stream(stream(), path, rules, "1 hour", 3 * 3600)
        assert sorted((r.instrument, r.rule, r.start) for r in spark.read.parquet(f"{path}/alerts").collect()) == want
        run_last_batch_again(path)
    twin = T.alert_rules(spark.createDataFrame([r for b in batches for r in b], schema), rules, "1 hour", (3 * 3600, hours(6)))
    assert sorted((r.instrument, r.rule, r.start) for r in twin.collect()) == want


def test_features_of_closed_bars_equal_the_batch_ones(spark, tmp_path):
    schema = "instrument string, bar_start timestamp, open double, high double, low double, close double, volume double"
    bars = [(i, hours(h), 1.0, 2.0 + h % 7, 1.0, 1.5 + (h * 7 + k) % 5, float((h * 13 + k) % 11)) for k, i in enumerate("ABC") for h in range(90) if (h + k) % 9]
    from tidemark.operators.features import build_features

    path = str(tmp_path / "out")
    stream = arrive(spark, str(tmp_path / "in"), schema, [[b for b in bars if lo <= b[1] < hi] for lo, hi in ((hours(a), hours(a + 18)) for a in range(0, 90, 18))])
    cols = ["ret_4", "vol", "jump", "regime", "volume_z", "enough"]
    want = sorted(map(tuple, build_features(spark.createDataFrame(bars, schema), 12).select("instrument", "bar_start", *(F.round(c, 9) if c not in ("regime", "enough") else c for c in cols)).collect()), key=lambda r: r[:2])
    for _ in range(2):
        T.bar_features_stream(stream(), path, lambda b: build_features(b, 12), 30)
        got = spark.read.parquet(f"{path}/features").select("instrument", "bar_start", *(F.round(c, 9) if c not in ("regime", "enough") else c for c in cols)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
        run_last_batch_again(path)
    assert len([d for d in os.listdir(f"{path}/history") if d.startswith("batch")]) <= 2
