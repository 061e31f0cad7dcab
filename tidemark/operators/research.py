"""Folds, backtests, performance and validation statistics, models."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.operators.features import by_bar
from tidemark.operators.joins import interval_join, is_small, param_grid

BARS_PER_YEAR = 24 * 365


# --- folds ---------------------------------------------------------------------
def walk_forward(df: DataFrame, ts: str, train_days: int = 10, test_days: int = 5, step_days: int = 5, expanding: bool = False) -> DataFrame:
    """Folds by time over the range of `ts`: fold, train_start, train_end, test_start, test_end. Nothing is shuffled at random."""
    span = df.agg(F.date_trunc("day", F.min(ts)).alias("a"), F.max(ts).alias("b"))
    day = lambda n: F.make_dt_interval(F.lit(n))
    starts = span.select("a", "b", F.posexplode(F.sequence(F.col("a") + day(train_days), F.col("b"), day(step_days))).alias("fold", "test_start")).where(F.col("test_start") + day(test_days) <= F.col("b") + day(1))
    first = F.col("a") if expanding else F.col("test_start") - day(train_days)
    return starts.select("fold", first.alias("train_start"), F.col("test_start").alias("train_end"), "test_start", (F.col("test_start") + day(test_days)).alias("test_end"))


def assign_folds(df: DataFrame, folds: DataFrame, ts: str) -> DataFrame:
    """Rows with each fold that has them and their role, train or test: a range join on days, so a row only meets folds of its time."""
    ranges = folds.withColumn("_x", F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}_start").alias("_s"), F.col(f"{role}_end").alias("_e")) for role in ("test", "train")))))
    return interval_join(df, ranges.select(*folds.columns, "_x.*"), ts, "_s", "_e", []).drop("_s", "_e")


def purge(assigned: DataFrame, label_end: str) -> DataFrame:
    """Training rows whose label settles after the test window begins go."""
    return assigned.where((F.col("role") == "test") | (F.col(label_end) <= F.col("test_start")))


def embargo(rows: DataFrame, folds: DataFrame, ts: str, gap: str) -> DataFrame:
    """S3: rows within a gap after the test window of their fold go; `rows` carry `fold`."""
    ends = folds.select("fold", F.col("test_end").alias("_e"))
    j = rows.join(F.broadcast(ends) if is_small(ends) else ends, "fold")
    return j.where(~((F.col(ts) >= F.col("_e")) & (F.col(ts) < F.col("_e") + F.expr(f"interval {gap}")))).drop("_e")


def leakage_report(df: DataFrame, available: str, decision: str, label_start: str) -> DataFrame:
    """Rows that know too much: features from after the decision, labels that start before it."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(available) > F.col(decision)).alias("future_features"), F.count_if(F.col(label_start) <= F.col(decision)).alias("early_labels"))


def fold_overlap(assigned: DataFrame, key: list[str], label_end: str) -> DataFrame:
    """By fold of (fold, role, test_start) how many keys are in train and test at once, and how many training labels settle after the test begins; all are leaks."""
    both = assigned.groupBy("fold", *key).agg(F.bool_or(F.col("role") == "train").alias("_a"), F.bool_or(F.col("role") == "test").alias("_b"))
    shared = both.groupBy("fold").agg(F.count_if(F.col("_a") & F.col("_b")).alias("shared_keys"))
    late = assigned.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows"), F.count_if((F.col("role") == "train") & (F.col(label_end) > F.col("test_start"))).alias("late_labels"))
    return late.join(shared, "fold")


def prefix_stability(build, bars: DataFrame, cutoff: Column, key: list[str], cols: list[str]) -> DataFrame:
    """Rows whose features differ if built on the prefix alone; none if nothing looks ahead."""
    full, prefix = build(bars).where(cutoff), build(bars.where(cutoff))
    a, b = full.select(*key, F.struct(*cols).alias("x")), prefix.select(*key, F.struct(*cols).alias("y"))
    return a.join(b, key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))


# --- signals and backtests --------------------------------------------------------
def rule_signal(features: DataFrame, col: str, high: float, low: float, trend: bool = True) -> DataFrame:
    """M1: a readable baseline: 1 above `high`, -1 below `low` (reversal: the other way), else 0."""
    up, down = (1, -1) if trend else (-1, 1)
    return features.withColumn("signal", F.when(F.col(col) > high, up).when(F.col(col) < low, down).otherwise(0))


def run_vector_bt(df: DataFrame, cost: float | Column = 0.00065, extra_key: list[str] | None = None) -> DataFrame:
    """Rows (instrument, bar_start, signal, ret): the position known at t earns from t + 1; costs on each change; additive equity and drawdown."""
    w = Window.partitionBy("instrument", *(extra_key or [])).orderBy("bar_start")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    out = df.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0)))
    out = out.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    out = out.withColumns({"gross": F.col("position") * F.coalesce("ret", F.lit(0.0)), "cost": F.col("turnover") * cost}).withColumn("net", F.col("gross") - F.col("cost"))
    out = out.withColumns({"equity_gross": F.sum("gross").over(run), "equity_net": F.sum("net").over(run)})
    return out.withColumn("drawdown", F.greatest(F.max("equity_net").over(run), F.lit(0.0)) - F.col("equity_net"))


def performance(bt: DataFrame, by: list[str], bars_per_year: int = BARS_PER_YEAR) -> DataFrame:
    """Net and annualised return, volatility, Sharpe, largest drawdown, Calmar, hit rate, payoff ratio, turnover, mean holding time."""
    out = bt.groupBy(*by).agg(
        F.count("*").alias("bars"), F.sum("net").alias("net_return"), F.avg("net").alias("_m"), F.stddev_samp("net").alias("_s"), F.max("drawdown").alias("max_drawdown"),
        F.count_if(F.col("net") > 0).alias("_wins"), F.count_if(F.col("net") < 0).alias("_losses"), F.avg(F.when(F.col("net") > 0, F.col("net"))).alias("_win"), F.avg(F.when(F.col("net") < 0, -F.col("net"))).alias("_loss"),
        F.sum("turnover").alias("turnover"), F.count_if(F.col("position") != 0).alias("_held"), F.count_if(F.col("turnover") > 0).alias("_changes"),
    )
    year = out.withColumns({"annual_return": F.col("_m") * bars_per_year, "annual_vol": F.col("_s") * math.sqrt(bars_per_year)})
    return year.withColumns({
        "sharpe": F.try_divide("annual_return", F.when(F.col("annual_vol") > 0, F.col("annual_vol"))), "calmar": F.try_divide("annual_return", F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))),
        "hit_rate": F.try_divide(F.col("_wins"), F.nullif(F.col("_wins") + F.col("_losses"), F.lit(0))), "payoff": F.try_divide("_win", "_loss"), "holding_bars": F.try_divide(F.col("_held"), F.nullif(F.col("_changes"), F.lit(0))),
    }).drop("_m", "_s", "_wins", "_losses", "_win", "_loss", "_held", "_changes")


def cost_sensitivity(df: DataFrame, spark: SparkSession, base_cost: float, multipliers: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Net result at each multiple of the cost, and whether +50 % turns it to a loss."""
    grid = spark.createDataFrame([(float(m),) for m in multipliers], "multiplier double")
    bt = run_vector_bt(param_grid(df, grid), F.col("multiplier") * base_cost, ["multiplier"])
    out = bt.groupBy("instrument", "multiplier").agg(F.sum("net").alias("net"))
    worst = F.max(F.when((F.col("multiplier") == 1.5) & (F.col("net") <= 0), 1).otherwise(0)).over(Window.partitionBy("instrument"))
    return out.withColumn("rejected", worst == 1)


def capacity_curve(bt: DataFrame, spark: SparkSession, sizes: tuple[float, ...], k: float = 0.1) -> DataFrame:
    """Net return at growing size, impact k * sqrt(participation) on what is traded."""
    grid = spark.createDataFrame([(float(s),) for s in sizes], "size double")
    impact = F.when(F.col("volume") > 0, k * F.sqrt(F.col("size") * F.col("turnover") / F.col("volume")) * F.col("turnover")).otherwise(0.0)
    return param_grid(bt.select("instrument", "net", "turnover", F.col("volume").cast("double").alias("volume")), grid).groupBy("instrument", "size").agg(F.sum(F.col("net") - impact / 1000).alias("net_return"))


def param_stability(results: DataFrame, param: str, score: str, radius: float) -> DataFrame:
    """For each setting the mean and spread of the scores of settings within `radius`. Settings are dealt to cells of that width, each with the settings of the cells beside it, so no task sorts them all."""
    a = results.select(F.col(param).alias("p"), F.col(score).alias("s"))
    cell = F.floor(F.col("p") / radius) if radius else F.col("p")
    beside = a.withColumns({"_own": cell, "_cell": F.explode(F.array(cell - 1, cell, cell + 1) if radius else F.array(cell))})
    w = Window.partitionBy("_cell").orderBy("p").rangeBetween(-radius, radius)
    told = beside.withColumns({"near_mean": F.avg("s").over(w), "near_range": F.max("s").over(w) - F.min("s").over(w)}).where("_cell = _own")
    return told.select(F.col("p").alias(param), F.col("s").alias(score), "near_mean", "near_range")


def rank_candidates(results: DataFrame, gates: Column, order: list[Column], k: int) -> DataFrame:
    """Candidates that pass the gates, best first, at most k."""
    return results.where(gates).orderBy(*order).limit(k)


def run_id(cols: list[str], schema: T.StructType) -> Column:
    """The id of a run is a digest of everything that makes it: versions, ranges, parameters, seed, cost model, code; equal maps give equal ids."""
    from tidemark.functions.scalar import canonical_digest

    return F.concat(F.lit("run-"), F.substring(canonical_digest(cols, schema), 1, 16))


def register_run(runs: DataFrame, registry: DataFrame, cols: list[str]) -> DataFrame:
    """The rows to append to the registry: runs whose id it does not have, each once."""
    new = runs.withColumn("run_id", run_id(cols, runs.schema)).dropDuplicates(["run_id"])
    return new.join(registry.select("run_id"), "run_id", "left_anti")


def promote(history: DataFrame, alias: str = "alias", at: str = "at") -> DataFrame:
    """The run that each alias names now. History is append-only: a rollback is a further row that names an earlier run."""
    return history.groupBy(alias).agg(F.max_by("run_id", F.struct(at, "run_id")).alias("run_id"), F.count("*").alias("changes"))


def factor_ic(df: DataFrame, factor: str, label: str, period: str) -> DataFrame:
    """Pearson and rank correlation of a factor and the following return in each period."""
    d = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).withColumn("period", F.date_trunc(period, "bar_start"))
    r = lambda c: F.rank().over(Window.partitionBy("period").orderBy(c)).cast("double")
    return d.withColumns({"_rf": r(factor), "_rl": r(label)}).groupBy("period").agg(F.count("*").alias("n"), F.corr(factor, label).alias("ic"), F.corr("_rf", "_rl").alias("rank_ic"))


def factor_ic_summary(ics: DataFrame) -> DataFrame:
    """Over the periods the mean of each correlation, its deviation, and their ratio (IR)."""
    cols = ("ic", "rank_ic")
    stats = ics.agg(F.count("*").alias("periods"), *(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    return stats.withColumns({f"ir_{c}": F.try_divide(f"mean_{c}", F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}"))) for c in cols})


def quantile_buckets(df: DataFrame, factor: str, label: str, n: int = 5) -> DataFrame:
    """Mean following return by bucket of the factor within each instrument."""
    d = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    w = Window.partitionBy("instrument").orderBy(factor, "bar_start")
    return d.withColumn("bucket", F.ntile(n).over(w)).groupBy("instrument", "bucket").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"))


def correlation_matrix(df: DataFrame, col: str) -> DataFrame:
    """Correlation of each pair of instruments over the times that both have."""
    a = df.where(F.col(col).isNotNull()).select("bar_start", F.col("instrument").alias("a"), F.col(col).alias("x"))
    b = a.select("bar_start", F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, "bar_start").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))


def deflated_sharpe(trials: DataFrame, by: str, value: str) -> DataFrame:
    """The Sharpe ratio of each trial and the probability that it beats the expected best of that many trials without skill (Bailey and López de Prado), in column arithmetic."""
    s = trials.groupBy(by).agg(F.count(value).alias("n"), (F.avg(value) / F.stddev_samp(value)).alias("sharpe"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    all_ = s.agg(F.count("*").cast("double").alias("t"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v"))
    j = s.crossJoin(F.broadcast(all_))  # one row
    t, sr, euler = F.col("t"), F.col("sharpe"), 0.5772156649015329
    best = F.when((t > 1) & (F.col("v") > 0), F.sqrt("v") * ((1 - euler) * normal_quantile(1 - 1 / t) + euler * normal_quantile(1 - 1 / (t * math.e)))).otherwise(0.0)
    scale = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    z = F.when((F.col("n") > 1) & (scale > 0), (sr - best) * F.sqrt(F.col("n") - 1) / F.sqrt(scale))
    return j.select(by, "n", "sharpe", normal_cdf(z).alias("deflated"))


def pbo(returns: DataFrame, config: str, block: str, value: str, spark: SparkSession, blocks: int = 8) -> DataFrame:
    """Probability of backtest overfitting: over all halvings of the blocks, the share where the best config in sample ends at or below the median out of sample."""
    sums = returns.groupBy(config, block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    splits = [(k, list(c)) for k, c in enumerate(combinations(range(blocks), blocks // 2))]
    grid = spark.createDataFrame(splits, "split int, inside array<int>")
    inside = F.array_contains("inside", F.col(block).cast("int"))
    means = param_grid(sums, grid).groupBy("split", config).agg(
        F.try_divide(F.sum(F.when(inside, F.col("s"))), F.sum(F.when(inside, F.col("n")))).alias("is_mean"), F.try_divide(F.sum(F.when(~inside, F.col("s"))), F.sum(F.when(~inside, F.col("n")))).alias("oos_mean"),
    )
    ranked = means.withColumns({
        "best": F.row_number().over(Window.partitionBy("split").orderBy(F.desc("is_mean"), config)), "place": F.rank().over(Window.partitionBy("split").orderBy("oos_mean")), "configs": F.count("*").over(Window.partitionBy("split")),
    }).where("best = 1")
    return ranked.agg(F.count("*").alias("splits"), F.avg(F.when(F.col("place") / (F.col("configs") + 1) <= 0.5, 1.0).otherwise(0.0)).alias("pbo"))


def feature_drift(train: DataFrame, live: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """M4: population-stability index over fixed bin edges; 1e-6 is added to each share."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = F.width_bucket(F.col(col), F.lit(edges[0]), F.lit(edges[-1]), F.lit(len(edges) - 1))
        n = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
        return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))

    p, q = F.coalesce("p", F.lit(0.0)) + 1e-6, F.coalesce("q", F.lit(0.0)) + 1e-6
    return shares(train, "p").join(shares(live, "q"), "bin", "full_outer").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


RIDGE = 1e-3


def _sums(features: list[str], label: str, weight: Column | None = None) -> list[Column]:
    """The sums of products of (1, features) with each other and with the label: all that a least-squares fit needs of its rows."""
    xs = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    w = F.lit(1.0) if weight is None else weight
    pairs = [F.sum(w * xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    return pairs + [F.sum(w * x * F.col(label).cast("double")).alias(f"h{i}") for i, x in enumerate(xs)]


def _solve_ridge(sums: dict[str, float], p: int, ridge: float = RIDGE) -> list[float] | None:
    """Intercept and slopes of the least squares with a ridge on the features in units of their deviation; None without rows."""
    n = sums["g0_0"]
    if not n:
        return None
    mean = np.array([sums[f"g0_{i}"] for i in range(1, p + 1)]) / n
    cov = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(1, p + 1)] for i in range(1, p + 1)]) / n - np.outer(mean, mean)
    with_y = np.array([sums[f"h{i}"] for i in range(1, p + 1)]) / n - mean * sums["h0"] / n
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    used = sd > 1e-12 * (1 + np.abs(mean))
    slopes = np.zeros(p)
    if used.any():
        unit = np.outer(sd[used], sd[used])
        slopes[used] = np.linalg.solve(cov[np.ix_(used, used)] / unit + ridge * np.eye(int(used.sum())), with_y[used] / sd[used]) / sd[used]
    return [float(sums["h0"] / n - slopes @ mean), *map(float, slopes)]


def _predicted(test: DataFrame, models: dict[int, list[float] | None], features: list[str], link=lambda x: x) -> DataFrame:
    """Test rows with their fold's prediction, or null and the reason."""
    known = [(k, m) for k, m in models.items() if m is not None]
    coefs = test.sparkSession.createDataFrame(known, "fold int, _w array<double>").withColumn("fold", F.col("fold").cast(test.schema["fold"].dataType))
    whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features))
    linear = reduce(lambda a, b: a + b, (F.col("_w")[k + 1] * F.col(f) for k, f in enumerate(features)), F.col("_w")[0])
    out = test.join(F.broadcast(coefs), "fold", "left").withColumn("reason", F.when(F.col("_w").isNull(), "no-model").when(~whole, "null-feature"))
    return out.withColumn("prediction", F.when(F.col("reason").isNull(), link(linear))).drop("_w").select(*test.columns, "prediction", "reason")


def _complete(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*features, label])))


def _logistic(train: DataFrame, folds: list[int], features: list[str], label: str, steps: int = 25) -> dict[int, list[float] | None]:
    """Reweighted least squares of all folds at once: a step is one scan that sums the products of each fold with its weights."""
    p = len(features)
    spark, now = train.sparkSession, {k: np.zeros(p + 1) for k in folds}
    scale = {r["fold"]: np.maximum(np.nan_to_num(np.array([r[f"s{i}"] for i in range(p)], float)), 1e-12) for r in train.groupBy("fold").agg(*(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).collect()}
    done: dict[int, list[float] | None] = {k: None for k in folds if k not in scale}
    for _ in range(steps):
        todo = [k for k in folds if k not in done]
        if not todo:
            break
        coefs = spark.createDataFrame([(k, now[k].tolist()) for k in todo], "fold int, _w array<double>").withColumn("fold", F.col("fold").cast(train.schema["fold"].dataType))
        linear = reduce(lambda a, b: a + b, (F.col("_w")[i + 1] * F.col(f) for i, f in enumerate(features)), F.col("_w")[0])
        rows = train.join(F.broadcast(coefs), "fold").withColumn("_p", 1 / (1 + F.exp(-linear))).withColumn("_e", F.col(label) - F.col("_p"))
        weight = F.col("_p") * (1 - F.col("_p"))
        grams = [c for c in _sums(features, label, weight)][: (p + 1) * (p + 2) // 2]
        slopes = [F.sum((F.lit(1.0) if i == 0 else F.col(features[i - 1])) * F.col("_e")).alias(f"e{i}") for i in range(p + 1)]
        for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *grams, *slopes).collect():
            k = r["fold"]
            ridge = RIDGE * r["n"] * np.r_[0.0, scale[k] ** 2]
            hessian = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + np.diag(ridge)
            move = np.linalg.lstsq(hessian, np.array([r[f"e{i}"] for i in range(p + 1)]) - ridge * now[k], rcond=None)[0]
            now[k] = now[k] + move
            if np.abs(move[1:] * scale[k]).max(initial=abs(move[0])) < 1e-10:
                done[k] = now[k].tolist()
    return {k: done.get(k, now[k].tolist()) for k in folds}


def fit_folds(df: DataFrame, folds: list[int], features: list[str], label: str, kind: str = "linear", seed: int = 7) -> DataFrame:
    """M2: one model for each fold on its training rows (fold, role), predictions for its test rows only. kind: linear (ridge), logistic (label 0 or 1) or trees.

    Linear models of all folds come from the sums of products of one scan, logistic ones from
    one such scan a step. A test row with a null feature has a null prediction and the reason
    `null-feature`; one whose fold has no training rows `no-model`. No folds give no rows.
    """
    rows = df.where(F.col(label).isNotNull() & F.col("fold").isin(folds)) if folds else df.where("false")
    test, train = rows.where("role = 'test'"), _complete(rows.where("role = 'train'"), features, label)
    if kind == "linear":
        sums = {r["fold"]: r.asDict() for r in train.groupBy("fold").agg(*_sums(features, label)).collect()} if folds else {}
        return _predicted(test, {k: _solve_ridge(sums[k], len(features)) if k in sums else None for k in folds}, features)
    if kind == "logistic":
        return _predicted(test, _logistic(train, folds, features, label) if folds else {}, features, lambda x: 1 / (1 + F.exp(-x)))
    if kind != "trees":
        raise ValueError(f"no model of kind {kind}")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vectors = VectorAssembler(inputCols=features, outputCol="_f")
    out = _predicted(test, {}, features)
    whole = _complete(test, features, label)
    told = out.where("false")
    known = {r["fold"] for r in train.select("fold").distinct().collect()} if folds else set()
    for fold in sorted(known):
        model = GBTRegressor(featuresCol="_f", labelCol=label, maxIter=5, maxDepth=3, seed=seed).fit(vectors.transform(train.where(F.col("fold") == fold)))
        told = told.unionByName(model.transform(vectors.transform(whole.where(F.col("fold") == fold))).withColumn("reason", F.lit(None).cast("string")).select(out.columns))
    is_whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features))
    left = out.where(~F.col("fold").isin(list(known)) | ~is_whole if known else F.lit(True))
    return told.unionByName(left.withColumn("reason", F.when(F.col("fold").isin(list(known)) if known else F.lit(False), "null-feature").otherwise("no-model")))


def predict_oof(df: DataFrame, folds: DataFrame, ts: str, label_end: str, features: list[str], label: str, kind: str = "linear") -> DataFrame:
    """M2: out-of-fold predictions of unassigned rows for walk-forward folds (S1), training labels settled by the start of the test window.

    A fold trains on the rows whose label is settled by its test start, less those from
    before its training start. Both are prefixes in time, so the linear fits of all folds are
    differences of running sums of one scan, in which no row meets a fold. The folds are few
    and pass through the driver; where labels take longer to settle than the shortest training
    window, and for other kinds of models, rows are assigned to folds.
    """
    if not is_small(folds):
        raise ValueError("too many folds")
    plan = sorted(folds.select("fold", "train_start", "test_start").collect(), key=lambda f: f.test_start)
    numbers = [f.fold for f in plan]
    test = lambda: assign_folds(df.where(F.col(label).isNotNull()), folds, ts).where("role = 'test'")
    rows = _complete(df.where(F.col(label_end).isNotNull()), features, label)
    longest = rows.agg(F.max(F.unix_micros(label_end) - F.unix_micros(ts))).first()[0] if plan else None
    shortest = min((f.test_start - f.train_start for f in plan), default=None)
    ordered = all(a.train_start <= b.train_start for a, b in zip(plan, plan[1:]))
    if kind != "linear" or not ordered or (longest is not None and longest > shortest.total_seconds() * 1e6):
        return fit_folds(purge(assign_folds(df, folds, ts), label_end), numbers, features, label, kind)
    edges = lambda name: F.array(*(F.lit(f[name]) for f in plan))
    if not plan:
        return fit_folds(df.withColumns({"fold": F.lit(0), "role": F.lit("test")}).where("false"), [], features, label)
    known = F.size(F.filter(edges("test_start"), lambda e: e < F.col(label_end)))  # the first fold that knows the label
    gone = F.size(F.filter(edges("train_start"), lambda e: e <= F.col(ts)))  # the first fold that the row is too old for
    sums = rows.groupBy(known.alias("_known"), gone.alias("_gone")).agg(*_sums(features, label)).collect()
    models = {}
    for k, f in enumerate(plan):
        own = [s for s in sums if s["_known"] <= k < s["_gone"]]
        names = [c for c in (own[0].asDict() if own else {}) if not c.startswith("_")]
        models[f.fold] = _solve_ridge({c: sum(s[c] for s in own) for c in names}, len(features)) if own else None
    return _predicted(test(), models, features)


def challenger(champion: DataFrame, other: DataFrame, key: list[str], loss: str) -> DataFrame:
    """M3: paired comparison of two models on the same out-of-sample rows, by fold."""
    j = champion.select("fold", *key, F.col(loss).alias("a")).join(other.select("fold", *key, F.col(loss).alias("b")), ["fold", *key])
    return j.groupBy("fold").agg(F.count("*").alias("n"), F.avg("a").alias("champion"), F.avg("b").alias("challenger"), F.avg(F.col("b") - F.col("a")).alias("delta"), F.count_if(F.col("b") < F.col("a")).alias("wins"))
