"""One instrument that holds nearly all rows is cut into buckets: the results are those of a window over the whole of it, and tasks are many."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.operators import ledger as L


@pytest.fixture(scope="module")
def trades(spark):
    k = F.col("id")
    ts = F.timestamp_seconds(1_700_000_000 + (k * 7919 % 5003) * 60)
    who = F.when(k % 97 == 0, None).when(k % 11 == 0, "B").otherwise("A")
    return spark.range(5000).select(
        who.alias("instrument"), F.when(k % 301 != 5, ts).alias("ts"), k.alias("seq"), F.when(k % 53 == 3, None).otherwise(k * 31 % 40).alias("qty"),
        F.when(k % 3 == 0, "BUY").otherwise("SELL").alias("side"), (k * 17 % 101).cast("double").alias("notional"), (k * 7919 % 5003).alias("arrival"),
    ).cache()


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("bucket", [600, 7200, 10**9])
def test_checks_and_sums(trades, bucket):
    whole = Window.partitionBy("instrument")
    w = whole.orderBy("arrival")
    seen = F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = trades.withColumns({"out_of_order": F.coalesce(F.col("ts") < seen, F.lit(False)), "duplicate_time": F.coalesce(F.col("ts") == F.lag("ts").over(w), F.lit(False))})
    cols = ["instrument", "seq", "out_of_order", "duplicate_time"]
    assert rows(B.check_monotonic(trades, "instrument", "arrival", bucket=bucket), *cols) == rows(want, *cols)

    known = trades.where("ts is not null")
    step = F.col("arrival") - F.lag("arrival").over(whole.orderBy("ts", "seq"))
    assert rows(B.check_sequence(known, "instrument", ["ts", "seq"], "arrival", bucket=bucket), "instrument", "seq", "step") == rows(known.withColumn("step", step), "instrument", "seq", "step")

    run = whole.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = known.withColumns({"position": F.sum(L.signed("qty")).over(run), "position_notional": F.sum(L.signed("notional")).over(run)})
    cols = ["instrument", "seq", "position", "position_notional"]
    assert rows(L.positions_from_fills(known, ["instrument"], ["ts", "seq"], bucket=bucket), *cols) == rows(want, *cols)
    one, many = X.flow_imbalance(known, 500, seconds=10**9), X.flow_imbalance(known, 500, seconds=bucket)
    assert rows(many, *one.columns) == rows(one, *one.columns)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, "2 hours"])
def test_asof(trades, direction, tolerance):
    left = trades.where("seq % 2 = 0").select("instrument", "ts", "seq")
    right = trades.where("seq % 40 = 1").select("instrument", F.col("ts").alias("at"), F.col("seq").alias("v"))
    join = lambda bucket: J.asof_join(left, right, ("ts", "at"), ["instrument"], ["v"], tolerance, direction, bucket)
    assert rows(join(900), "instrument", "seq", "matched_at", "v") == rows(join(10**9), "instrument", "seq", "matched_at", "v")
    sure = left.where("instrument = 'A' and ts is not null").alias("l").join(right.alias("r"), (F.col("l.instrument") == F.col("r.instrument")) & ((F.col("at") <= F.col("ts")) if direction == "backward" else (F.col("at") >= F.col("ts"))), "left")
    best = sure.groupBy("seq").agg((F.max("at") if direction == "backward" else F.min("at")).alias("best"))
    if tolerance is None:
        got = join(900).where("instrument = 'A' and ts is not null").select("seq", F.col("matched_at").alias("best"))
        assert rows(got, "seq", "best") == rows(best, "seq", "best")


def test_a_hot_instrument_is_dealt_to_many_tasks(spark, trades):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = B.check_monotonic(trades.where("instrument = 'A'"), "instrument", "arrival", bucket=100)
        tasks = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 2500


def test_walks_hold_one_state(spark, trades):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over many batches
    try:
        known = trades.where("ts is not null and qty is not null").select("instrument", "seq", "side", F.col("qty").cast("double").alias("qty"), "notional")
        got = {(r.instrument, r.seq): (r.realised, r.open_qty) for r in L.average_cost_pnl(known, ["instrument"], ["seq"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, cost = {}, {}
    for r in sorted(known.collect(), key=lambda r: r.seq):
        h, c, move = held.get(r.instrument, 0.0), cost.get(r.instrument, 0.0), r.qty if r.side == "BUY" else -r.qty
        price, gain = r.notional / r.qty if r.qty else 0.0, 0.0
        if h * move < 0:
            gain = min(abs(move), abs(h)) * (price - c) * (1 if h > 0 else -1)
            c = price if abs(move) > abs(h) else c
        elif h + move:
            c = (abs(h) * c + abs(move) * price) / abs(h + move)
        held[r.instrument], cost[r.instrument] = h + move, c
        assert got[(r.instrument, r.seq)] == pytest.approx((gain, h + move))
    assert len(got) == known.count()
    assert L.average_cost_pnl(known.where("false"), ["instrument"], ["seq"]).count() == 0


def test_digests_of_sets(spark):
    from tidemark.operators import quality as Q

    df = spark.createDataFrame([("a", k) for k in range(500)] + [("b", None), ("c", 3), ("c", None)], "g string, x int")
    one, other = Q.set_digest(df, ["g"], "x"), Q.set_digest(df.orderBy(F.desc("x")).repartition(5), ["g"], "x")
    assert rows(one, "g", "digest", "members") == rows(other, "g", "digest", "members")
    assert {r.g: r.members for r in one.collect()} == {"a": 500, "b": 0, "c": 1}


def test_contamination_is_checked_word_by_word(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j"), (2, "a b c d e f g"), (3, None), (4, "A  B c\td e f g h")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i"), (8, None), (9, "a b c d e f g h")], "item_id int, text string")
    want = sorted([(1, 7, 2), (1, 9, 1), (4, 7, 1), (4, 9, 1)])
    assert sorted(map(tuple, J.contamination(docs, bench).collect())) == want
    assert sorted(map(tuple, J.contamination(docs, bench, bits=0).collect())) == want  # every n-gram collides
    monkeypatch.setattr(J, "SMALL_ROWS", 0)  # joined by a shuffle
    assert sorted(map(tuple, J.contamination(docs, bench).collect())) == want


def test_gram_names_of_blocks():
    text = b" ".join(b"w%d" % (k % 300) for k in range(5000))
    whole = J._gram_names(text, 8, 64)
    assert len(whole) == 300 and all((J._gram_names(text, 8, 64, block) == whole).all() for block in (1, 7, 100, 5000))


def test_set_delta_of_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, None), (None, "y")], "g int, m string")
    b = spark.createDataFrame([(1, "z"), (1, None), (None, "y")], "g int, m string")
    assert {(r.g, r.m, r.state) for r in J.set_delta_rows(a, b, ["g"], "m").collect()} == {(1, "x", "removed"), (1, "z", "added"), (1, None, "kept"), (None, "y", "kept")}
