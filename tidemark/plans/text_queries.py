"""Queries for text side-data and usage accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import text as E
from tidemark.plans.base import BARS, query
from tidemark.plans.market_queries import bars, fresh_path
from tidemark.plans.scalar_queries import _secrets
from tidemark.sources import ingest as I
from tidemark.sources.tables import ntz, table


@query("""select min(doc_id) as doc_id, count(*) as copies from documents group by trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))""")
def e1_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dedup_exact(table(spark, sf_dir, "documents")).select("doc_id", "copies")


@query("""with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as words from documents),
    s as (select doc_id, case when len(words) <= 5 then [array_to_string(words, ' ')] else list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k : k + 4], ' ')))) end as shingles from w),
    sets as (select shingles, min(doc_id) as set_id, len(shingles) as n from s group by 1), one as (select set_id, n, unnest(shingles) as shingle from sets),
    links as (select a.set_id as a, b.set_id as b from one a join one b on a.shingle = b.shingle and a.set_id < b.set_id group by 1, 2 having count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*))),
    edges as (select a, b from links union select b, a from links), reach(id, r) as (select set_id, set_id from sets union select e.b, reach.r from reach join edges e on e.a = reach.id),
    classes as (select id, min(r) as class_id from reach group by 1)
    select s.doc_id, sets.set_id, classes.class_id from s join sets on s.shingles = sets.shingles join classes on classes.id = sets.set_id""")
def e2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its set of equal shingles and its class of near copies."""
    return E.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("""with l as (select doc_id, lang, coalesce(text, '') as t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') as lines from documents)
    select doc_id, list_filter([case when not coalesce(lang in ('en', 'de'), false) then 'language' end, case when length(t) < 50 or length(t) > 100000 then 'length' end, case when len(list_distinct(lines)) * 2 < len(lines) then 'repetition' end,
    case when length(t) - length(translate(t, '#*$%&|<>', '')) > 0.1 * length(t) then 'junk' end], lambda x: x is not null) as reasons from l""")
def e3_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.filter_docs(table(spark, sf_dir, "documents"), ["en", "de"]).select("doc_id", "reasons")


@query(f"""select doc_id, len(regexp_extract_all(x, '<redacted>')) as secret_hits, sha256(x) as sha from (select doc_id, {_secrets("replace(text, '/', ' ')")} as x from documents)""")
def e4_redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("/"), F.lit(" ")))
    out = E.redact_docs(d.withColumn("text", F.regexp_replace("text", "\\b([A-Za-z]):\\\\", "$1 ")))
    return out.select("doc_id", "secret_hits", F.sha2("text", 256).alias("sha"))


@query("""select lang, count(*) as docs, count(toxic) as labelled, sum(toxic)::bigint as toxic from documents left join labels using (doc_id) group by 1""")
def e5_attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.attach_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", ["toxic"])
    return out.groupBy("lang").agg(F.count("*").alias("docs"), F.count("toxic").alias("labelled"), F.sum("toxic").alias("toxic"))


@query(f"""with {BARS}, news as (select ['CLICK', 'VIEW', 'ERROR', 'SIGNUP', 'PURCHASE'][(doc_id % 5 + 1)::int] as instrument, timestamp '2024-01-01' + interval 1 minute * (doc_id % 43200) as ts, n_chars::double as score, doc_id % 500 as cluster from documents),
    f as (select instrument, cluster, min(ts) as ts, avg(score) as score from news group by 1, 2), w as (select instrument, date_trunc('hour', ts) + interval 1 hour as known_ts, count(*) as n_news, avg(score) as sentiment from f group by 1, 2)
    select b.instrument, b.bar_start, n_news, round(sentiment, 4) as sentiment from bars b asof left join w on b.instrument = w.instrument and b.bar_start >= w.known_ts""")
def e6_sentiment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["CLICK", "VIEW", "ERROR", "SIGNUP", "PURCHASE"]))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 60 * (F.col("doc_id") % 43200))
    news = table(spark, sf_dir, "documents").select(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("instrument"), ts.alias("ts"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 500).alias("cluster"))
    out = E.sentiment_features(news, bars(spark, sf_dir), "1 hour")
    return ntz(out.select("instrument", "bar_start", "n_news", F.round("sentiment", 4).alias("sentiment")), "bar_start")


@query("""select doc_id, strlen(text)::int as bytes, sha256(text) as sha256, ((length(text) - length(replace(text, 'the', ''))) / 3)::int as mentions,
    list_filter([case when not contains(text, '.') then '.' end, case when not contains(text, ',') then ',' end], lambda x: x is not null) as missing, list_filter([case when contains(text, '###') then '###' end], lambda x: x is not null) as forbidden,
    list_filter([case when contains(lower(text), 'license') then 'license' end], lambda x: x is not null) as traces from documents""")
def e7_token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.token_audit(table(spark, sf_dir, "documents"), [".", ","], ["###"], ["license"], "the").drop("lines")


@query("""select count(*) as documents, sum(case when text = '' then 0 else len(string_split(regexp_replace(text, '\n$', ''), chr(10))) end)::bigint as lines, sum(strlen(text))::bigint as bytes, sum((length(text) - length(replace(text, 'the', ''))) // 3)::bigint as mentions,
    count(*) filter (where not contains(text, '.') or not contains(text, ',')) as without_required, count(*) filter (where contains(text, '###')) as with_forbidden, count(*) filter (where contains(lower(text), 'license')) as with_traces,
    case when count(*) filter (where not contains(text, '.') or not contains(text, ',') or contains(text, '###') or contains(lower(text), 'license')) = 0 then 'pass' else 'fail' end as status from (select coalesce(text, '') as text from documents)""")
def e7_token_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.token_audit_totals(E.token_audit(table(spark, sf_dir, "documents"), [".", ","], ["###"], ["license"], "the"))


_USAGE = "u as (select role as phase, case when conv_id % 2 = 0 then 'a' else 'b' end as actor, length(text) as input, (length(text) // 2)::bigint as output, (length(text) // 3)::bigint as cached, (length(text) // 4)::bigint as reasoning from conversations)"


@query(f"""with {_USAGE}, c as (select phase, actor, sum(input)::bigint as input, sum(output)::bigint as output, sum(cached)::bigint as cached, sum(reasoning)::bigint as reasoning, grouping(phase, actor)::bigint as level from u group by cube (phase, actor))
    select *, input + output as total, input - cached as uncached, round(cached / nullif(input, 0), 6) as cache_hit, round((input + output) / (max(input + output) filter (where level = 3) over ()), 6) as share from c""")
def a9_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    u = table(spark, sf_dir, "conversations").select(F.col("role").alias("phase"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b").alias("actor"), n.alias("input"), F.floor(n / 2).alias("output"), F.floor(n / 3).alias("cached"), F.floor(n / 4).alias("reasoning"))
    return E.usage_rollup(u).withColumns({"cache_hit": F.round("cache_hit", 6), "share": F.round("share", 6)})


@query("""with a as (select conv_id // 2 as task, case when conv_id % 2 = 0 then 'before' else 'after' end as arm, sum(length(text))::bigint as tokens, count(*) as turns from conversations group by 1, 2),
    p as (select task, max(tokens) filter (where arm = 'before') as tokens_before, max(tokens) filter (where arm = 'after') as tokens_after, max(turns) filter (where arm = 'before') as tb, max(turns) filter (where arm = 'after') as ta from a group by 1)
    select task, tokens_before, tokens_after, tokens_after - tokens_before as tokens_delta, round((tokens_after - tokens_before) / nullif(tokens_before, 0) * 100, 4) as tokens_pct, case when tb is null or ta is null then 'NOT_COMPARABLE' when tb = ta then 'STRICT' else 'CONDITIONAL' end as comparability from p""")
def a10_compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 2).alias("task"), F.when(F.col("conv_id") % 2 == 0, "before").otherwise("after").alias("arm")).agg(F.sum(F.length("text")).alias("tokens"), F.count("*").alias("turns"))
    out = E.compare_arms(c.withColumn("kind", F.lit("chat")), ["task"], ["tokens"], ["kind"], ["turns"])
    return out.withColumn("tokens_pct", F.round("tokens_pct", 4))


@query("select role as level, count(*) as n, sum(length(text))::bigint as chars, min(conv_id::varchar || '/' || turn) as first_key from conversations group by 1")
def c3_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines in two appends and read back with the log's schema."""
    c, path = table(spark, sf_dir, "conversations"), fresh_path(spark, "log")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    log = c.select(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.col("role").alias("level"), F.lit("chat").alias("logger"), F.col("text").alias("message"), F.create_map(F.lit("key"), key).alias("extra"), "conv_id")
    for part in (0, 1):
        I.write_log(log.where(F.col("conv_id") % 2 == part), path)
    return I.read_log(spark, path).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"), F.min(F.col("extra")["key"]).alias("first_key"))


@query("""select doc_id, case when doc_id % 9 <> 4 then n_chars end as n_chars, doc_id % 9 = 4 as corrupt from documents""")
def c2_read_json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines on disk, every ninth of them cut short: those are kept apart as corrupt, with their text, and no row is lost."""
    path = fresh_path(spark, "json")
    line = F.to_json(F.struct("doc_id", "n_chars"))
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 4, F.replace(line, F.lit("}"), F.lit(""))).otherwise(line).alias("value")).write.text(path)
    read = I.read_json_strict(spark, path, T.StructType.fromDDL("doc_id bigint, n_chars bigint"), quarantine=True)
    corrupt = F.col("_corrupt_record").isNotNull()
    own = F.regexp_extract("_corrupt_record", '"doc_id":(-?[0-9]+)', 1).cast("bigint")
    return read.select(F.when(corrupt, own).otherwise(F.col("doc_id")).alias("doc_id"), F.when(~corrupt, F.col("n_chars")).alias("n_chars"), corrupt.alias("corrupt"))
