"""Statistics against plain ones: models of folds, exact quantiles, earlier-and-smaller counts, the normal distribution."""

from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.functions.scalar import range_duration, repository_identity
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators import research as R

T0 = datetime(2024, 1, 1)


def test_normal_distribution(spark):
    n = NormalDist()
    xs, ps = [float(x) for x in np.linspace(-9, 9, 181)] + [40.0, -40.0], [float(p) for p in np.r_[np.linspace(0.001, 0.999, 199), 1e-9, 1 - 1e-9]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([n.cdf(x) for x in xs], rel=1e-9, abs=1e-15)
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([n.inv_cdf(p) for p in ps], rel=2e-9, abs=1e-8)
    odd = spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,)], "p double").select(normal_quantile(F.col("p")))
    assert [r[0] for r in odd.collect()] == [None] * 4


@pytest.mark.parametrize("n,leaf", [(1, 4), (300, 4), (300, 64), (5000, 16)])
def test_earlier_and_smaller(spark, n, leaf):
    rng = np.random.default_rng(n)
    v = [None if x % 17 == 0 else float(x) for x in rng.integers(0, 60, n)]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)] + [("b", 1, 2.0)], "g string, t int, v double").repartition(3)
    got = {(r.g, r.t): r.c for r in X.smaller_before(df, [F.col("g")], "t", "v", "c", leaf).collect()}
    want = {("a", k): sum(1 for y in v[:k] if y is not None and x is not None and y < x) for k, x in enumerate(v)} if n < 1000 else None
    if want is None:
        known = []
        import bisect

        want = {}
        for k, x in enumerate(v):
            want["a", k] = 0 if x is None else bisect.bisect_left(known, x)
            if x is not None:
                bisect.insort(known, x)
    assert got == want | {("b", 1): 0}


def test_quantiles_by_selection(spark):
    rng = np.random.default_rng(2)
    groups = {"skew": np.exp(rng.standard_normal(20_000) * 4), "ties": np.repeat([1.0, 2.0, 3.0], [9000, 500, 500]), "same": np.full(5000, 7.0), "few": np.array([3.0, 1.0]), "one": np.array([5.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in rng.permutation(xs)] + [("none", None), ("one", None), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: (r.n, r.p50, r.p95, r.p99) for r in L.latency_quantiles(df, ["g"], "x", large=1, sketch=200).collect()}
    want = {g: (len(xs), *np.quantile(xs, [0.5, 0.95, 0.99])) for g, xs in (groups | {None: np.array([4.0, 8.0])}).items()}
    assert got.pop("none") == (0, None, None, None)
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h in range(24 * 20):
        a, b = rng.standard_normal(2)
        rows.append((h, T0 + timedelta(hours=h), None if h % 50 == 7 else float(a), float(b * 3 + 1), float(0.5 * a - 0.2 * b + 0.1 * rng.standard_normal() + 0.3), T0 + timedelta(hours=h + 5)))
    return spark.createDataFrame(rows, "k int, ts timestamp, a double, b double, y double, label_end timestamp")


def test_running_sums_equal_assigned_rows(spark, labelled):
    for expanding in (False, True):
        folds = R.walk_forward(labelled, "ts", 6, 3, 3, expanding)
        numbers = sorted(r.fold for r in folds.collect())
        own = R.fit_folds(R.purge(R.assign_folds(labelled, folds, "ts"), "label_end"), numbers, ["a", "b"], "y")
        oof = R.predict_oof(labelled, folds, "ts", "label_end", ["a", "b"], "y")
        x, y = ({(r.fold, r.k): (r.prediction, r.reason) for r in df.collect()} for df in (own, oof))
        assert set(x) == set(y) and len(x) == len(numbers) * 72
        for k in x:
            assert x[k][1] == y[k][1] == ("null-feature" if k[1] % 50 == 7 else None)
            assert x[k][0] == (None if x[k][1] else pytest.approx(y[k][0], abs=1e-9))


def test_logistic_fit_is_at_its_optimum(spark, labelled):
    folds = R.walk_forward(labelled, "ts", 6, 3, 5)
    rows = R.assign_folds(labelled.withColumn("up", (F.col("y") > 0.3).cast("double")), folds, "ts")
    numbers = sorted(r.fold for r in folds.collect())
    models = R._logistic(R._complete(rows.where("role = 'train'"), ["a", "b"], "up"), numbers, ["a", "b"], "up")
    for k in numbers:
        own = [(1.0, r.a, r.b, r.up) for r in rows.where((F.col("fold") == k) & (F.col("role") == "train") & F.col("a").isNotNull()).collect()]
        x, up = np.array([o[:3] for o in own]), np.array([o[3] for o in own])
        w = np.array(models[k])
        sd = x.std(axis=0)
        gradient = x.T @ (up - 1 / (1 + np.exp(-x @ w))) - R.RIDGE * len(own) * np.r_[0.0, sd[1:] ** 2] * w
        assert np.abs(gradient).max() < 1e-6 * len(own)
    out = R.fit_folds(rows, numbers, ["a", "b"], "up", "logistic").where("reason is null")
    right = out.agg(F.avg(((F.col("prediction") > 0.5) == (F.col("up") > 0.5)).cast("double"))).first()[0]
    assert right > 0.85


@pytest.mark.parametrize("kind", ["linear", "logistic", "trees"])
def test_no_folds_and_folds_without_training_rows(spark, labelled, kind):
    rows = labelled.withColumns({"up": (F.col("y") > 0.3).cast("double"), "fold": F.when(F.col("k") < 100, 0).otherwise(1), "role": F.when(F.col("k") < 50, "test").when(F.col("k") < 100, "train").otherwise("test")})
    assert R.fit_folds(rows, [], ["a", "b"], "up", kind).count() == 0
    got = {(r.fold, r.reason): r.n for r in R.fit_folds(rows, [0, 1], ["a", "b"], "up", kind).groupBy("fold", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, None): 49, (0, "null-feature"): 1, (1, "no-model"): 380}


def test_ranges_and_repositories(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(seconds=1.5)), (T0, T0), (T0 + timedelta(1), T0), (None, T0)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(range_duration(F.col("a"), F.col("b"))).collect()] == [1.5, None, None, None]
    urls = {"https://u:p@h.example/o/n.git": "o/n", "git@h.example:o/n.git": "o/n", "ssh://git@h:22/o/n/": "o/n", "https://h/o/n?x=1": None, "https://h/o": None, "https://h/o/n/t": None, "o/n": None, "": None, "https://h/o/n.js": "o/n.js"}
    got = {r.u: r.r for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", repository_identity(F.col("u")).alias("r")).collect()}
    assert got == urls
