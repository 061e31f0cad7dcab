"""Queries for tri-state gates and comparisons of recorded facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.base import GATES, query
from tidemark.sources.tables import gates, ntz, table

_COUNTS = """s as (select subject, count(*) filter (where status = 'pass') as p, count(*) filter (where status = 'fail') as f, count(*) filter (where status not in ('pass', 'fail')) as u from gates group by 1)"""


@query("""select user_id, count(*) as count, count(*) filter (where event_type = 'click') as success, count(*) filter (where event_type = 'view') as pending, count(*) filter (where event_type = 'error') as failed,
    count(*) filter (where event_type not in ('click', 'view', 'error')) as skipped_or_unknown, bool_and(event_type = 'click') as all_success from events group by 1""")
def a3_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "pending").otherwise("skipped")
    return Q.state_rollup(table(spark, sf_dir, "events").withColumns({"conclusion": F.lit(None).cast("string"), "state": state}), ["user_id"], "conclusion", "state")


@query(f"""with {GATES}, {_COUNTS} select subject, p as pass, f as fail, u as unknown, coalesce((select list(name order by name) from gates g where g.subject = s.subject and status = 'fail'), []) as failed_gates,
    coalesce((select list(name order by name) from gates g where g.subject = s.subject and status not in ('pass', 'fail')), []) as unknown_gates from s""")
def a4_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gate_summary(gates(spark, sf_dir), ["subject"])


@query(f"""with {GATES}, {_COUNTS} select subject, case when f > 0 then 'fail' when u > 0 or p > 40 then 'partial' else 'pass' end as status from s""")
def a5_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.gate_summary(gates(spark, sf_dir), ["subject"])
    return s.select("subject", Q.overall_status(F.col("fail"), F.col("unknown"), F.lit(0), F.col("pass") > 40).alias("status"))


@query(f"""with {GATES}, {_COUNTS} select subject, p as pass, f as fail, u as unknown, case when f > 0 then 'fail' when u > 0 then 'partial' else 'pass' end as status, case when f = 0 and u = 0 then 'proceed' else 'stop' end as disposition,
    false as auto_remediation_allowed, (f + (select count(*) from gates g where g.subject = s.subject and status = 'fail' and name in (10, 20, 30)))::int as listed from s""")
def a6_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.disposition(gates(spark, sf_dir), ["subject"], identity=("10", "20", "30"))
    return out.withColumn("listed", F.size("failed_gates")).drop("failed_gates")


@query("""select o_custkey, count(*) as total, count(*) filter (where o_orderstatus = 'O') as unresolved, count(*) filter (where o_orderstatus = 'F') as resolved, count(*) filter (where o_orderstatus = 'P') as unknown_state,
    case when count(*) filter (where o_orderstatus = 'O') > 0 then 'fail' when count(*) filter (where o_orderstatus = 'P') > 0 then 'unknown' else 'pass' end as gate from orders group by 1""")
def a7_dependency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed")
    return Q.dependency_gate(table(spark, sf_dir, "orders").withColumn("state", state), ["o_custkey"])


@query("""with m as (select user_id, sha256(event_id::varchar) as h from events), b as (select user_id, substr(h, 1, 3) as k, sha256(string_agg(h, '' order by h)) as d, count(*) as n from m group by 1, 2)
    select user_id, sha256(string_agg(k || ':' || d, ',' order by k)) as digest, sum(n)::bigint as members from b group by 1""")
def a8_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.set_digest(table(spark, sf_dir, "events"), ["user_id"], "event_id")


@query("""select user_id, count(*) as ran, count(*) filter (where event_type <> 'error') as passed, count(*) filter (where event_type = 'error') as failed, min(event_id) filter (where event_type = 'error') as first_failure,
    case when count(*) = 100 and count(*) filter (where event_type = 'error') = 0 then 'pass' else 'fail' end as status from events group by 1""")
def a25_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.run_rollup(table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error"), ["user_id"], 100, "event_id", "event_id")


@query("""with w as (select distinct user_id, t from events, (values ('click'), ('view')) as n(t)) select w.user_id, bool_and(coalesce(x.t is not null, false)) as satisfied from w left join (select distinct user_id, event_type as t from events where event_id % 3 > 0) x on x.user_id = w.user_id and x.t = w.t group by 1""")
def a26_require_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = e.where("event_id % 3 > 0").select("user_id", F.col("event_type").alias("name"), F.lit("pass").alias("status")).distinct()
    names = spark.createDataFrame([("click",), ("view",)], "name string")
    return Q.require_all(g, e, names, "user_id")


@query("""select o_orderkey, list_filter([case when o_orderstatus = 'P' then 'partial' end, case when o_totalprice > 300000 then 'too-large' end, case when o_orderpriority like '1%' then 'urgent' end], lambda x: x is not null) as reasons,
    not (o_orderstatus = 'P' or o_totalprice > 300000 or o_orderpriority like '1%') as eligible from orders""")
def a27_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("o_orderstatus") == "P", "partial"), (F.col("o_totalprice") > 300000, "too-large"), (F.col("o_totalprice") > 400000, "too-large"), (F.col("o_orderpriority").startswith("1"), "urgent")]
    return Q.decide(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "reasons", "eligible")


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders) or c_custkey % 9 = 4""")
def j5_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' lists leave out every ninth customer on purpose."""
    areas = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 9 != 4, F.array(F.col("o_custkey"), F.col("o_custkey"))).otherwise(F.array().cast("array<bigint>")).alias("files"))
    return Q.uncovered(table(spark, sf_dir, "customer").select("c_custkey"), areas, "c_custkey")


@query("""with t as (select user_id, count(*) filter (where event_type = 'error') as bad, bool_or(event_type = 'purchase' ) as won from events where event_id % 4 > 0 group by 1) select user_id, bad = 0 and won as satisfied from t""")
def j7_required_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 4 > 0")
    observed = e.select("user_id", F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("category"))
    required = e.select("user_id", F.lit("purchase").alias("name")).distinct()
    return Q.required_satisfied(required, observed, "user_id")


@query("""with t as (select user_id, count(distinct event_type) as n from events group by 1) select user_id, case when user_id % 11 = 0 then 'unknown' when n = 5 and user_id % 5 > 0 then 'pass' else 'fail' end as gate from t""")
def j8_exact_set_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("observed"))
    kinds = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    df = e.withColumns({"expected": kinds, "count": F.when(F.col("user_id") % 11 > 0, F.size("observed")), "truncated": F.col("user_id") % 5 == 0})
    return Q.exact_set_gate(df, "observed", "expected", "count", "truncated").select("user_id", "gate")


@query("""select c_custkey, c_custkey % 4 = 0 as stable, list_filter([case when c_custkey % 4 = 1 then 'c_acctbal' end, case when c_custkey % 4 >= 2 then 'c_mktsegment' end], lambda x: x is not null) as changed from customer""")
def j9_snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    after = before.withColumns({"c_acctbal": F.when(k == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k == 2, "NONE").when(k == 3, None).otherwise(F.col("c_mktsegment"))})
    return Q.snapshot_drift(before, after, "c_custkey", ["c_mktsegment", "c_acctbal", "c_name"]).select("c_custkey", "stable", "changed")


@query("""select o_orderkey, o_orderkey % 3 > 0 and o_orderkey % 4 <> 1 as fresh, case when o_orderkey % 3 = 0 then 'head-changed' when o_orderkey % 4 = 1 then 'digest-changed' else 'fresh' end as reason from orders""")
def j15_is_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    art = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("h"), k).alias("head"), F.concat(F.lit("d"), k).alias("digest"))
    now = art.select("o_orderkey", F.when(k % 3 == 0, "other").otherwise(F.col("head")).alias("head"), F.when(k % 4 == 1, "other").when(k % 4 == 2, None).otherwise(F.col("digest")).alias("digest"))
    return Q.is_fresh(art, now, "o_orderkey").select("o_orderkey", "fresh", "reason")


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'partial' when o_orderkey % 3 = 0 then 'fail' else 'pass' end as status, case when o_orderkey % 5 > 0 and o_orderkey % 3 = 0 then ['o_orderstatus'] else [] end as conflicts from orders""")
def j16_source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = a.where("o_orderkey % 5 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    return Q.source_agreement(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""with e as (select user_id, max(ts) filter (where event_type = 'purchase') as c, max(ts) filter (where event_type = 'error') as r from events group by 1)
    select user_id, case when user_id % 9 = 0 then 'unknown' when c is not null and (r is null or c > r) then 'closed' else 'open' end as state, case when user_id % 9 > 0 and c is not null and (r is null or c > r) then c end as closed_at from e""")
def w18_latest_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "error", "reopen").when(F.col("event_type") == "signup", "open")
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") % 9 == 0).alias("cut"))
    return ntz(Q.latest_effective(e, "user_id", "ts", "kind", "seq", truncated="cut"), "closed_at")
