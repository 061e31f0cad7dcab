"""States by composed maps against plain walks, with few rows to a block so that there are many levels."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import ledger as L
from tidemark.sources import ingest as I
from tidemark.streaming import stream as T


def walk(rows):
    held, cost, out = 0.0, 0.0, []
    for _, side, qty, notional in rows:
        move, price, gain = (qty if side == "BUY" else -qty), (notional / qty if qty else 0.0), 0.0
        if held * move < 0:
            gain = min(abs(move), abs(held)) * (price - cost) * (1 if held > 0 else -1)
            cost = price if abs(move) > abs(held) else cost
        elif held + move:
            cost = (abs(held) * cost + abs(move) * price) / abs(held + move)
        held += move
        out.append((gain, held, cost if held else 0.0))
    return out


@pytest.mark.parametrize("radix,bucket", [(2, 7), (4, 50), (64, 1000)])
def test_average_cost_of_one_hot_account(spark, radix, bucket):
    rng = random.Random(radix)
    rows = [(k, rng.choice(["BUY", "SELL"]), float(rng.randrange(0, 6)), 0.0) for k in range(400)]
    rows = [(k, s, q, q * rng.uniform(5, 20)) for k, s, q, _ in rows]
    df = spark.createDataFrame([("hot", *r) for r in rows] + [("other", 3, "BUY", 2.0, 10.0), ("other", 4, None, None, None)], "a string, seq int, side string, qty double, notional double").repartition(5)
    got = L.average_cost_pnl(df, ["a"], ["seq"], bucket, radix).orderBy("a", "seq").collect()
    want = walk(rows) + [(0.0, 2.0, 5.0), (0.0, 2.0, 5.0)]
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r.realised, r.open_qty, r.avg_cost) == pytest.approx(w, abs=1e-9)


def fold(events):
    state, illegal, seen = None, 0, None
    for _, _, kind in sorted(set(events)):
        if kind == seen and kind != "PARTIAL":
            continue
        if kind in L.FOLLOWS[state]:
            state = kind
        else:
            illegal += 1
        seen = kind
    return state or "UNKNOWN", illegal


@pytest.fixture(scope="module")
def histories():
    rng = random.Random(5)
    kinds = [k for k in L.ORDER_STATES if k] + ["ODD"]
    out = {k: [(rng.randrange(5), rng.randrange(4), rng.choice(kinds)) for _ in range(rng.randrange(1, 30))] for k in range(40)}
    out[99] = [(0, 1, "NEW"), (0, 2, "FILLED"), (0, 3, "PARTIAL"), (0, 3, "PARTIAL")]
    return out


@pytest.mark.parametrize("radix", [2, 3, 64])
def test_order_states(spark, histories, radix):
    rows = [(k, *e) for k, events in histories.items() for e in events]
    df = spark.createDataFrame(rows, "k int, ts int, seq int, kind string").repartition(4)
    got = {r.k: (r.state, r.illegal) for r in L.order_state(df, "k", ["ts", "seq"], "kind", 2, radix).collect()}
    assert got == {k: fold(events) for k, events in histories.items()}
    assert L.order_state(df.where("false"), "k", ["ts", "seq"], "kind").count() == 0


def test_order_states_across_batches_with_redelivery(spark, tmp_path, histories):
    """The last event of a batch is delivered again with the next one."""
    rows = sorted({(e[0], e[1], e[2], k) for k, events in histories.items() for e in events})
    parts = [[r for r in rows if r[0] == b] for b in range(5)]
    path = str(tmp_path / "in")
    for b, part in enumerate(parts):
        again = {r[3]: r for r in sorted(parts[b - 1])}.values() if b else []
        spark.createDataFrame([(r[3], r[0], r[1], r[2]) for r in [*part, *again]], "k int, ts int, seq int, kind string").coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema("k int, ts int, seq int, kind string").option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.key: (r.state, r.illegal) for r in T.last_states(T.order_state_stream(files, "k"), str(tmp_path / "out")).collect()}
    assert got == {k: fold(events) for k, events in histories.items()}


def test_landing_of_null_keys_and_differing_rows(spark, tmp_path):
    path, schema = str(tmp_path / "raw"), "k int, v string, m map<string,int>, p string"
    rows = [(None, "x", {"a": 1}, "p"), (1, "y", None, None), (2, "z", {"b": 1, "a": 2}, "q"), (2, "z", {"a": 2, "b": 1}, "q")]
    df = spark.createDataFrame(rows, schema)
    for _ in range(3):
        I.land_raw(df, path, ["k"], ["p"])
    assert spark.read.schema(schema).parquet(path).count() == 3
    with pytest.raises(ValueError, match="differ"):
        I.land_raw(spark.createDataFrame([(5, "a", None, "q"), (5, "b", None, "q")], schema), path, ["k"], ["p"])
    with pytest.raises(ValueError, match="differ"):
        I.land_raw(spark.createDataFrame([(None, "other", None, "p")], schema), path, ["k"], ["p"])
    bad = str(tmp_path / "bad")
    for _ in range(2):
        I.land_raw(spark.createDataFrame([(5, "a", None, "q"), (5, "b", None, "q"), (6, "c", None, "q"), (2, "changed", None, "q")], schema), path, ["k"], ["p"], bad)
    assert sorted(r.v for r in spark.read.schema(schema).parquet(path).collect()) == ["c", "x", "y", "z"]
    assert sorted(r.v for r in spark.read.parquet(bad).collect()) == ["a", "b", "changed"]


def test_landing_reads_its_own_partitions_only(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.range(100).withColumn("p", F.col("id") % 10)
    I.land_raw(df, path, ["id"], ["p"])
    plan = I._landed(df.where("p = 3"), path, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(p" in plan and "3)" in plan


def test_null_times_and_keys_match_nothing(spark):
    left = spark.createDataFrame([("a", 5), ("a", None), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 7, 11), (None, 5, 12), ("a", None, 13)], "k string, rt int, v int")
    for direction, best in (("backward", 10), ("forward", 11)):
        got = J.asof_join(left, right, ("t", "rt"), ["k"], ["v"], direction=direction, bucket=3).collect()
        assert sorted((r.k or "", r.t or 0, r.v or 0) for r in got) == [("", 5, 0), ("a", 0, 0), ("a", 5, best)]


def test_null_keys_equal_null_keys(spark):
    m = spark.createDataFrame([(None, "d"), ("x", "e")], "p string, digest string")
    assert {(r.p, r.state) for r in I.verify_manifest(m, m, ["p"]).collect()} == {(None, "match"), ("x", "match")}
    assert {(r.p, r.state) for r in J.reconcile(m.withColumn("n", F.lit(1)), m.withColumn("n", F.lit(2)), ["p"], ["n"]).collect()} == {(None, "mismatch"), ("x", "mismatch")}


def test_equal_maps_have_one_id(spark):
    from tidemark.operators import research as R

    df = spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)")
    assert df.select(I.snapshot_id(["m"], df.schema)).distinct().count() == 1
    assert R.register_run(df, spark.createDataFrame([], "run_id string"), ["m"]).count() == 1


def test_order_states_in_tables_across_batches(spark, tmp_path, histories):
    """As above with the states in tables; a batch that is run again changes nothing."""
    from test_stream_state import run_last_batch_again

    rows = sorted({(e[0], e[1], e[2], k) for k, events in histories.items() for e in events})
    parts = [[r for r in rows if r[0] == b] for b in range(5)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b, part in enumerate(parts):
        again = {r[3]: r for r in sorted(parts[b - 1])}.values() if b else []
        spark.createDataFrame([(r[3], r[0], r[1], r[2]) for r in [*part, *again]], "k int, ts int, seq int, kind string").coalesce(1).write.mode("append").parquet(path)
    files = lambda: spark.readStream.schema("k int, ts int, seq int, kind string").option("maxFilesPerTrigger", 1).parquet(path)
    for again in (False, True):
        if again:
            run_last_batch_again(out)
        got = {r.key: (r.state, r.illegal) for r in T.order_states_stream(files(), out, "k").collect()}
        assert got == {k: fold(events) for k, events in histories.items()}


def test_kill_switch_with_late_events(spark, tmp_path):
    """A reset and a severity that come a batch late count at their own time, as in the batch form, and no Python runs."""
    schema = "k int, ts int, seq int, severity int, reset boolean"
    batches = [[(1, 5, 1, 2, False), (2, 1, 2, 1, False), (3, 9, 3, 3, True)], [(1, 4, 4, 0, True), (2, 3, 5, 0, True), (3, 8, 6, 2, False), (4, 1, 7, 0, False)], [(2, 4, 8, 1, False), (2, 4, 9, 0, None)]]
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    switch = T.kill_switch_stream(stream, "k")
    assert "Python" not in switch._jdf.queryExecution().analyzed().toString()
    assert {r.key: r.switch for r in T.last_states(switch, str(tmp_path / "out")).collect()} == {1: "HALT", 2: "REDUCE_ONLY", 3: "NORMAL", 4: "NORMAL"}


def test_batches_of_many_files(spark, tmp_path, monkeypatch):
    from tidemark.plans import stream_queries as Q

    monkeypatch.setattr(Q, "MANY_ROWS", 100)
    stream = Q._in_files(spark, spark.range(1200), "cast(id % 3 as int)", 3)
    query = stream.withColumn("b", stream["id"] % 3).writeStream.foreachBatch(lambda df, k: seen.append((sorted(r.b for r in df.select("b").distinct().collect()), df.count())))
    seen = []
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [([k], 400) for k in range(3)]
