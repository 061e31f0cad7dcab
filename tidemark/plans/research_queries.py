"""Queries for folds, backtests, statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normal as N
from tidemark.operators import features as X
from tidemark.operators import research as R
from tidemark.plans.base import BARS, query
from tidemark.plans.market_queries import _LABEL, _W, _r, bars
from tidemark.sources.tables import ntz, table

_FOLDS = """span as (select date_trunc('day', min(bar_start)) as a, max(bar_start) as b from bars), folds as (select (row_number() over (order by t) - 1)::int as fold, t - interval 10 day as train_start, t as train_end, t as test_start, t + interval 5 day as test_end
    from (select unnest(range(a + interval 10 day, b + interval 1 microsecond, interval 5 day)) as t, b from span) where t + interval 5 day <= b + interval 1 day)"""
_ROLE = """case when bar_start >= test_start and bar_start < test_end then 'test' when bar_start >= train_start and bar_start < train_end then 'train' end"""
_BT = f"""sig as (select instrument, bar_start, volume, coalesce(close / lag(close) over {_W}) - 1, 0.0) as ret, case when close / lag(close) over {_W}) - 1 > 0.1 then 1 when close / lag(close) over {_W}) - 1 < -0.1 then -1 else 0 end as signal from bars),
    pos as (select *, coalesce(lag(signal) over {_W}), 0) as position from sig), turn as (select *, abs(position - coalesce(lag(position) over {_W}), 0)) as turnover from pos)"""
_RUN = "(partition by instrument order by bar_start rows between unbounded preceding and current row)"
_BT1 = _BT + f""", net as (select *, position * ret as gross, turnover * 0.00065 as cost, position * ret - turnover * 0.00065 as net from turn),
    eq as (select *, sum(gross) over {_RUN} as equity_gross, sum(net) over {_RUN} as equity_net from net), bt as (select *, greatest(max(equity_net) over {_RUN}, 0.0) - equity_net as drawdown from eq)"""


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lab = X.label_forward_return(X.returns(bars(spark, sf_dir)))
    return lab, R.walk_forward(lab, "bar_start")


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.returns(bars(spark, sf_dir), (1,)).withColumn("ret", F.coalesce("ret_1", F.lit(0.0)))
    return R.rule_signal(b, "ret_1", 0.1, -0.1)


def _bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_vector_bt(_signal(spark, sf_dir))


@query(f"with {BARS}, {_FOLDS} select * from folds")
def s1_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(_folds(spark, sf_dir)[1], "train_start", "train_end", "test_start", "test_end")


@query(f"with {BARS}, {_LABEL}, {_FOLDS} select fold, {_ROLE} as role, count(*) as n from lab, folds where {_ROLE} = 'test' or ({_ROLE} = 'train' and label_end <= test_start) group by 1, 2")
def s2_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, folds = _folds(spark, sf_dir)
    return R.purge(R.assign_folds(lab, folds, "bar_start"), "label_end").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f"with {BARS}, {_FOLDS} select fold, count(*) as n from bars, folds where not (bar_start >= test_end and bar_start < test_end + interval 4 hour) group by 1")
def s3_embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    folds = R.walk_forward(b, "bar_start")
    rows = R.param_grid(b, folds.select("fold"))
    return R.embargo(rows, folds, "bar_start", "4 hours").groupBy("fold").agg(F.count("*").alias("n"))


@query(f"with {BARS} select count(*) as n_rows, count(*) filter (where hour(bar_start) % 5 = 0) as future_features, count(*) filter (where hour(bar_start) % 7 = 0) as early_labels from bars")
def s4_leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: features known an hour after the decision at some hours, and labels that start with the bar at others."""
    at = lambda n: F.col("bar_start") + F.make_dt_interval(hours=F.lit(n))
    late, early = F.hour("bar_start") % 5 == 0, F.hour("bar_start") % 7 == 0
    lab = bars(spark, sf_dir).withColumns({"available": F.when(late, at(2)).otherwise(at(1)), "decision": at(1), "label_start": F.when(early, at(1)).otherwise(at(2))})
    return R.leakage_report(lab, "available", "decision", "label_start")


@query(f"""with {BARS}, {_LABEL}, {_FOLDS}, r as (select *, {_ROLE} as role from lab, folds), wide as (select fold, test_start, label_end, instrument, bar_start, role from r where role is not null union all
        select fold, test_start, label_end, instrument, bar_start, 'train' from r where role = 'test' and hour(bar_start) = 7),
    k as (select fold, instrument, bar_start, bool_or(role = 'train') and bool_or(role = 'test') as both_ from wide group by all)
    select fold, count(*) filter (where role = 'train') as train_rows, count(*) filter (where role = 'test') as test_rows, count(*) filter (where role = 'train' and label_end > test_start) as late_labels,
        (select count(*) from k where k.fold = wide.fold and both_) as shared_keys from wide group by fold""")
def s4_fold_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not purged, so labels settle late, and with the test rows of one hour put into train."""
    lab, folds = _folds(spark, sf_dir)
    rows = R.assign_folds(lab, folds, "bar_start")
    leaked = rows.where((F.col("role") == "test") & (F.hour("bar_start") == 7)).withColumn("role", F.lit("train"))
    return R.fold_overlap(rows.unionByName(leaked), ["instrument", "bar_start"], "label_end")


@query(f"""with {BARS}, f as (select instrument, bar_start, lead(close, 4) over {_W}) as ahead from bars), p as (select instrument, bar_start, lead(close, 4) over {_W}) as ahead from bars where bar_start < timestamp '2024-01-15')
    select f.instrument, f.bar_start from f join p using (instrument, bar_start) where f.ahead is distinct from p.ahead""")
def s5_prefix_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features are stable, and so add no row; a column that looks four bars ahead is not, for the last four bars of each instrument."""
    cut = F.col("bar_start") < F.lit("2024-01-15").cast("timestamp")

    def build(b: DataFrame) -> DataFrame:
        return X.build_features(b).withColumn("ahead", F.lead("close", 4).over(X.by_bar()))

    key = ["instrument", "bar_start"]
    out = R.prefix_stability(build, bars(spark, sf_dir), cut, key, ["ret_1", "ret_24", "vol", "regime", "volume_z", "ahead"])
    stable = R.prefix_stability(X.build_features, bars(spark, sf_dir), cut, key, ["ret_1", "ret_24", "vol", "regime", "volume_z"])
    return ntz(out.select(*key).unionByName(stable.select(*key)), "bar_start")


@query(f"""with {BARS}, {_BT}, m as (select instrument, mult as multiplier, sum(position * ret - turnover * 0.00065 * mult) as net from turn, (values (1.0::double), (1.5::double), (2.0::double)) as g(mult) group by 1, 2)
    select instrument, multiplier, round(net, 5) as net, bool_or(multiplier = 1.5 and net <= 0) over (partition by instrument) as rejected from m""")
def s6_cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.cost_sensitivity(_signal(spark, sf_dir), spark, 0.00065), "net", n=5)


def _grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(float(k) / 20,) for k in range(1, 9)], "threshold double")
    b = R.param_grid(X.returns(bars(spark, sf_dir), (1,)).withColumn("ret", F.coalesce("ret_1", F.lit(0.0))), grid)
    b = b.withColumn("signal", F.when(F.col("ret") > F.col("threshold"), 1).when(F.col("ret") < -F.col("threshold"), -1).otherwise(0))
    return R.run_vector_bt(b, 0.00065, ["threshold"])


_GRID = f"""r0 as (select instrument, bar_start, coalesce(close / lag(close) over {_W}) - 1, 0.0) as ret from bars), g0 as (select r0.*, t::double / 20 as threshold from r0, range(1, 9) as g(t)),
    g1 as (select *, case when ret > threshold then 1 when ret < -threshold then -1 else 0 end as signal from g0), g2 as (select *, coalesce(lag(signal) over (partition by instrument, threshold order by bar_start), 0) as position from g1),
    g3 as (select *, position * ret - abs(position - coalesce(lag(position) over (partition by instrument, threshold order by bar_start), 0)) * 0.00065 as net from g2), score as (select threshold, sum(net) as score from g3 group by 1)"""


@query(f"""with {BARS}, {_GRID} select threshold, round(score, 4) as score, round(avg(score) over w, 4) as near_mean, round(max(score) over w - min(score) over w, 4) as near_range from score window w as (order by round(threshold * 20)::int range between 1 preceding and 1 following)""")
def s7_param_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _grid_scores(spark, sf_dir).groupBy((F.round(F.col("threshold") * 20)).cast("int").alias("k")).agg(F.max("threshold").alias("threshold"), F.sum("net").alias("score"))
    out = R.param_stability(s, "k", "score", 1)
    return _r(out.select((F.col("k") / 20).alias("threshold"), "score", "near_mean", "near_range"), "score", "near_mean", "near_range", n=4)


@query(f"""with {BARS}, {_GRID} select threshold, round(score, 4) as score from score where score > -1e9 order by round(score, 6) desc, threshold limit 3""")
def s8_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _grid_scores(spark, sf_dir).groupBy("threshold").agg(F.sum("net").alias("score"))
    return _r(R.rank_candidates(s, F.col("score") > -1e9, [F.desc(F.round("score", 6)), F.col("threshold")], 3), "score", n=4)


@query("""select c_mktsegment as alias, 'run-' || substr(sha256('{"c_name":"' || max(c_name) || '"}'), 1, 16) as run_id, count(*) as changes from customer group by 1""")
def s9_register_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs registered twice are there once; an alias names the last run given to it."""
    c = table(spark, sf_dir, "customer").select("c_name", F.col("c_mktsegment").alias("alias"), F.col("c_custkey").alias("at"))
    first = R.register_run(c.where("at % 2 = 0"), spark.createDataFrame([], "run_id string"), ["c_name"])
    registry = first.unionByName(R.register_run(c, first, ["c_name"]))
    return R.promote(registry)


@query(f"with {BARS}, {_BT} select instrument, bar_start, signal from sig")
def m1_rule_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(_signal(spark, sf_dir).select("instrument", "bar_start", "signal"), "bar_start")


@query(f"with {BARS}, {_BT1} select instrument, bar_start, position, turnover, round(gross, 5) as gross, round(net, 5) as net, round(equity_gross, 5) as equity_gross, round(equity_net, 5) as equity_net, round(drawdown, 5) as drawdown from bt")
def w15_run_vector_bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["gross", "net", "equity_gross", "equity_net", "drawdown"]
    return _r(ntz(_bt(spark, sf_dir).select("instrument", "bar_start", "position", "turnover", *cols), "bar_start"), *cols, n=5)


@query(f"""with {BARS}, {_BT1}, p as (select instrument, count(*) as bars, sum(net) as net_return, avg(net) * 8760 as annual_return, stddev_samp(net) * sqrt(8760) as annual_vol, max(drawdown) as max_drawdown, sum(turnover)::bigint as turnover,
    count(*) filter (where net > 0) as wins, count(*) filter (where net < 0) as losses, avg(net) filter (where net > 0) as win, avg(-net) filter (where net < 0) as loss, count(*) filter (where position <> 0) as held, count(*) filter (where turnover > 0) as changes from bt group by 1)
    select instrument, bars, round(net_return, 4) as net_return, round(annual_return, 3) as annual_return, round(annual_vol, 3) as annual_vol, round(max_drawdown, 4) as max_drawdown, turnover, round(annual_return / nullif(annual_vol, 0), 3) as sharpe, round(annual_return / nullif(max_drawdown, 0), 3) as calmar,
    round(wins / nullif(wins + losses, 0), 5) as hit_rate, round(win / loss, 4) as payoff, round(held / nullif(changes, 0), 4) as holding_bars from p""")
def a13_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.performance(_bt(spark, sf_dir), ["instrument"])
    p = _r(p, "net_return", "max_drawdown", "payoff", "holding_bars", n=4)
    return _r(_r(p, "annual_return", "annual_vol", "sharpe", "calmar", n=3), "hit_rate", n=5)


@query(f"""with {BARS}, {_BT1} select instrument, size, round(sum(net - case when volume > 0 then 0.1 * sqrt(size * turnover / volume) * turnover else 0 end / 1000), 4) as net_return from bt, (values (1.0::double), (10.0::double), (100.0::double)) as g(size) group by 1, 2""")
def a21_capacity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.capacity_curve(_bt(spark, sf_dir), spark, (1.0, 10.0, 100.0)), "net_return", n=4)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


_CDF_SQL = f"case when z > 0 then 1 - tail else tail end from (select *, case when abs(z) > 37 then 0.0 when abs(z) < 7.07106781186547 then exp(-z * z / 2) * {_horner('abs(z)', N.TAIL[0])} / {_horner('abs(z)', N.TAIL[1])} else exp(-z * z / 2) / ((abs(z) + 1.0 / (abs(z) + 2.0 / (abs(z) + 3.0 / (abs(z) + 4.0 / (abs(z) + 0.65))))) * 2.506628274631) end as tail from z)"
_TAIL_SQL = "{h0} / {h1}".format(h0=_horner("sqrt(-2 * ln(least(p, 1 - p)))", N.TAILS[0]), h1=_horner("sqrt(-2 * ln(least(p, 1 - p)))", N.TAILS[1]))
_QUANTILE_SQL = f"case when p < 0.02425 then {_TAIL_SQL} when p > 1 - 0.02425 then -({_TAIL_SQL}) else (p - 0.5) * {_horner('((p - 0.5) * (p - 0.5))', N.MIDDLE[0])} / {_horner('((p - 0.5) * (p - 0.5))', N.MIDDLE[1])} end"


@query(f"""with {BARS}, {_GRID}, m as (select threshold, count(net) as n, avg(net) as mu, stddev_samp(net) as sd from g3 group by 1), c as (select g3.threshold, avg(pow(net - mu, 2)) as m2, avg(pow(net - mu, 3)) as m3, avg(pow(net - mu, 4)) as m4 from g3 join m using (threshold) group by 1),
    s as (select m.threshold, n, mu / sd as sharpe, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) as kurt from m join c using (threshold)), a as (select count(*)::double as t, var_samp(sharpe) as v from s),
    p as (select unnest([1 - 1 / t, 1 - 1 / (t * exp(1))]) as p, unnest([1 - 0.5772156649015329, 0.5772156649015329]) as share from a), q as (select sum(share * ({_QUANTILE_SQL})) as q from p),
    z as (select threshold, n, sharpe, (sharpe - sqrt(v) * q) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from s, a, q)
    select threshold, n, round(sharpe, 6) as sharpe, round({_CDF_SQL.split(' from ', 1)[0]}, 6) as deflated from {_CDF_SQL.split(' from ', 1)[1]}""")
def a22_deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.deflated_sharpe(_grid_scores(spark, sf_dir), "threshold", "net"), "sharpe", "deflated")


@query(f"""with {BARS}, {_GRID}, b as (select threshold, (datediff('day', date '2024-01-01', bar_start::date) // 4) % 8 as block, sum(net) as s, count(net) as n from g3 group by 1, 2), masks as (select m from range(256) t(m) where bit_count(m) = 4),
    means as (select m, threshold, sum(s) filter ((m >> block) & 1 = 1) / sum(n) filter ((m >> block) & 1 = 1) as inside, sum(s) filter ((m >> block) & 1 = 0) / sum(n) filter ((m >> block) & 1 = 0) as outside from b, masks group by 1, 2),
    k as (select m, row_number() over (partition by m order by inside desc, threshold) as best, rank() over (partition by m order by outside) as place, count(*) over (partition by m) as configs from means)
    select count(*) as splits, avg(case when place / (configs + 1) <= 0.5 then 1.0 else 0.0 end) as pbo from k where best = 1""")
def a23_pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("bar_start", F.lit("2024-01-01").cast("date"))
    g = _grid_scores(spark, sf_dir).withColumn("block", F.pmod(F.floor(day / 4), F.lit(8)))
    return R.pbo(g, "threshold", "block", "net", spark)


@query(f"""with {BARS}, {_LABEL}, f as (select *, date_trunc('week', bar_start) as period, close / lag(close, 4) over {_W}) - 1 as factor from lab), d as (select * from f where factor is not null and label is not null),
    k as (select *, rank() over (partition by period order by factor)::double as rf, rank() over (partition by period order by label)::double as rl from d)
    select period, count(*) as n, round(corr(factor, label), 4) as ic, round(corr(rf, rl), 4) as rank_ic from k group by 1""")
def a17_factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = X.label_forward_return(X.returns(bars(spark, sf_dir)))
    return _r(ntz(R.factor_ic(lab, "ret_4", "label", "week"), "period"), "ic", "rank_ic", n=4)


@query(f"""with {BARS}, {_LABEL}, f as (select *, date_trunc('week', bar_start) as period, close / lag(close, 4) over {_W}) - 1 as factor from lab), d as (select * from f where factor is not null and label is not null),
    k as (select *, rank() over (partition by period order by factor)::double as rf, rank() over (partition by period order by label)::double as rl from d), i as (select period, corr(factor, label) as ic, corr(rf, rl) as rank_ic from k group by 1)
    select count(*) as periods, round(avg(ic), 4) as mean_ic, round(avg(rank_ic), 4) as mean_rank_ic, round(stddev_samp(ic), 4) as sd_ic, round(stddev_samp(rank_ic), 4) as sd_rank_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 3) as ir_ic, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 3) as ir_rank_ic from i""")
def a17_factor_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.factor_ic_summary(R.factor_ic(X.label_forward_return(X.returns(bars(spark, sf_dir))), "ret_4", "label", "week"))
    return _r(_r(out, "mean_ic", "mean_rank_ic", "sd_ic", "sd_rank_ic", n=4), "ir_ic", "ir_rank_ic", n=3)


@query(f"""with {BARS}, {_LABEL}, f as (select *, close / lag(close, 4) over {_W}) - 1 as factor from lab), d as (select *, ntile(5) over (partition by instrument order by factor, bar_start) as bucket from f where factor is not null and label is not null)
    select instrument, bucket, count(*) as n, round(avg(label), 4) as mean_label from d group by 1, 2""")
def a18_quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = X.label_forward_return(X.returns(bars(spark, sf_dir)))
    return _r(R.quantile_buckets(lab, "ret_4", "label"), "mean_label", n=4)


@query(f"""with {BARS}, r as (select instrument, bar_start, close / lag(close) over {_W}) - 1 as r from bars) select a.instrument as a, b.instrument as b, count(*) as n, round(corr(a.r, b.r), 4) as corr
    from r a join r b using (bar_start) where a.instrument < b.instrument and a.r is not null and b.r is not null group by 1, 2""")
def a19_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.correlation_matrix(X.returns(bars(spark, sf_dir), (1,)), "ret_1"), "corr", n=4)


@query(f"""with {BARS}, d as (select date_trunc('day', bar_start) as d, instrument, sum(net) as net from (select * from ({"with " + BARS + ", " + _BT1 + " select * from bt"})) group by 1, 2),
    u as (select *, sum(net) over (partition by instrument, date_trunc('week', d) order by d rows between unbounded preceding and current row) as upto from d),
    w as (select *, greatest(max(upto) over (partition by instrument, date_trunc('week', d) order by d rows between unbounded preceding and current row), 0.0) - upto as dd from u)
    select instrument, round(min(net), 4) as worst_day, round(max(net), 4) as best_day, round(max(dd), 4) as weekly_drawdown from w group by 1""")
def a24_period_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.ledger import period_extremes

    return _r(period_extremes(_bt(spark, sf_dir), ["instrument"]), "worst_day", "best_day", "weekly_drawdown", n=4)


_X = ("ret_1", "ret_4", "ret_24")


def _ridge_sql(where: str) -> str:
    """Closed form for three features in units of their deviation: Cramer's rule on the correlations plus the ridge."""
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    c = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    slope = lambda k: f"{det([[f'r{i}' if j == k else c[i][j] for j in range(3)] for i in range(3)])} / {det(c)}"
    sums = ", ".join([f"avg({x}) as m{k}, stddev_pop({x}) as s{k}, covar_pop({x}, label) / stddev_pop({x}) as r{k}" for k, x in enumerate(_X)] + [f"corr({_X[i]}, {_X[j]}) + {0.001 if i == j else 0.0} as c{i}{j}" for i in range(3) for j in range(i, 3)])
    lags = ", ".join(f"close / lag(close, {n}) over {_W}) - 1 as ret_{n}" for n in (1, 4, 24))
    return f"""with {BARS}, {_LABEL}, {_FOLDS}, x as (select *, {lags} from lab), t as (select fold, avg(label) as my, {sums} from x, folds
            where {_ROLE} = 'train' and label_end <= test_start and label is not null and ret_24 is not null and ret_4 is not null and ret_1 is not null group by fold),
        w as (select *, {", ".join(f"{slope(k)} as w{k}" for k in range(3))} from t)
        select instrument, bar_start, fold, round(my + {" + ".join(f"w{k} * ({x} - m{k}) / s{k}" for k, x in enumerate(_X))}, 5) as prediction, case when t2.ret_24 is null or t2.ret_4 is null or t2.ret_1 is null then 'null-feature' end as reason
        from (select x.*, fold as f from x, folds where {_ROLE} = 'test' and {where}) t2 join w on w.fold = t2.f"""


def _labelled_folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    lab, folds = _folds(spark, sf_dir)
    return R.purge(R.assign_folds(lab, folds, "bar_start"), "label_end"), sorted(r.fold for r in folds.select("fold").collect())


def _told(out: DataFrame) -> DataFrame:
    return ntz(out.select("instrument", "bar_start", "fold", F.round("prediction", 5).alias("prediction"), "reason"), "bar_start")


@query(_ridge_sql("label is not null"))
def m2_fit_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge of each fold; test rows without a whole day of history keep a null prediction and its reason."""
    rows, numbers = _labelled_folds(spark, sf_dir)
    return _told(R.fit_folds(rows, numbers, list(_X), "label"))


@query(_ridge_sql("label is not null"))
def m2_predict_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from running sums: no row meets a fold."""
    lab, folds = _folds(spark, sf_dir)
    return _told(R.predict_oof(lab, folds, "bar_start", "label_end", list(_X), "label"))


@query()
def m2_fit_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = _labelled_folds(spark, sf_dir)
    return _told(R.fit_folds(rows.withColumn("up", (F.col("label") > 0).cast("double")), numbers, list(_X), "up", "logistic"))


@query()
def m2_fit_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numbers = _labelled_folds(spark, sf_dir)
    return _told(R.fit_folds(rows, numbers, list(_X), "label", "trees"))


@query(f"""with {BARS}, {_LABEL}, {_FOLDS}, f as (select *, close / lag(close, 1) over {_W}) - 1 as m from lab), t as (select fold, abs(label) as a, abs(label - m) as b from f, folds where {_ROLE} = 'test' and label is not null and m is not null)
    select fold, count(*) as n, round(avg(a), 4) as champion, round(avg(b), 4) as challenger, round(avg(b - a), 4) as delta, count(*) filter (where b < a) as wins from t group by 1""")
def m3_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, folds = _folds(spark, sf_dir)
    test = R.assign_folds(lab, folds, "bar_start").where("role = 'test' and label is not null and ret_1 is not null")
    a, b = test.withColumn("loss", F.abs("label")), test.withColumn("loss", F.abs(F.col("label") - F.col("ret_1")))
    return _r(R.challenger(a, b, ["instrument", "bar_start"], "loss"), "champion", "challenger", "delta", n=4)


@query("""with p as (select least(greatest(floor(value / 50) + 1, 0), 11)::int as bin, count(*)::double / (select count(*) from events where event_id % 2 = 0) as p from events where event_id % 2 = 0 group by 1),
    q as (select least(greatest(floor(value / 50) + 1, 0), 11)::int as bin, count(*)::double / (select count(*) from events where event_id % 2 = 1) as q from events where event_id % 2 = 1 group by 1)
    select round(sum((coalesce(q, 0) - coalesce(p, 0)) * ln((coalesce(q, 0) + 1e-6) / (coalesce(p, 0) + 1e-6))), 6) as psi from p full join q using (bin)""")
def m4_feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    edges = [50.0 * k for k in range(11)]
    return _r(R.feature_drift(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value", edges), "psi")
