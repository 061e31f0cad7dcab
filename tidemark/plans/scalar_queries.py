"""Queries for the scans, scalar functions and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import quality as Q
from tidemark.plans.base import BARS, TRADES, query
from tidemark.sources.tables import EVENTS, ntz, read_table, table, trades


@query("select event_type, count(*) as n, sum(user_id)::bigint as users from events where value > 100 group by 1")
def c1_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, f"{sf_dir}/events.parquet", EVENTS)
    return df.where("value > 100").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+08:00"))).when(k == 2, F.concat(iso, F.lit("-05:00"))).when(k == 3, iso).otherwise(F.concat(F.lit("2026-02-30"), F.substring(iso, 11, 9), F.lit("Z")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


_INSTANTS = """texts as (select event_id, case event_id % 5 when 0 then iso || 'Z' when 1 then iso || '+08:00' when 2 then iso || '-05:00' when 3 then iso
    else '2026-02-30' || substr(iso, 11, 9) || 'Z' end as text from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso from events))"""


@query(f"""with {_INSTANTS} select event_id, case when event_id % 5 < 3 then timezone('UTC', try_cast(text as timestamptz)) end as utc,
    case event_id % 5 when 3 then 'naive' when 4 then 'invalid' end as reason from texts""")
def u1_parse_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _instants(spark, sf_dir).select("event_id", S.parse_utc(F.col("text")).alias("utc"), S.parse_reason(F.col("text")).alias("reason"))
    return ntz(df, "utc")


@query("select o_orderkey, o_orderdate - interval 8 hour as utc from orders")
def u2_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", S.to_utc(F.col("o_orderdate").cast("timestamp"), "Asia/Shanghai").alias("utc"))
    return ntz(df, "utc")


@query(f"with {_INSTANTS} select event_id, event_id % 5 in (0, 4) as is_utc from texts")
def u3_is_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).select("event_id", S.is_utc(F.col("text")).alias("is_utc"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when event_id % 3 = 0 or strftime(ts, '%f') = '000000' then '' else strftime(ts, '.%f') end || 'Z' as text from events""")
def u4_format_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", S.format_utc(F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", ts)).otherwise(ts)).alias("text"))


@query("select event_type, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def u5_ensure_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.ensure_aware(table(spark, sf_dir, "events"), ["ts"], assume_utc=True)
    return ntz(df.groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "first_ts", "last_ts")


@query("""select event_id, ts >= s and ts < s + interval 6 hour as inside, 21600 as seconds, true as valid
    from (select event_id, ts, date_trunc('day', ts) + interval 6 hour as s from events)""")
def u6_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 6 hours")
    end = start + F.expr("interval 6 hours")
    seconds = (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", S.in_range(F.col("ts").cast("timestamp"), start, end).alias("inside"), seconds.alias("seconds"), S.valid_range(start, end).alias("valid"))


@query("""select event_id, case when event_id % 3 > 0 then (event_id % 3) * (event_id % 1000) + 0.25 end as seconds from events where (event_id % 3) * (event_id % 1000) > 0 or event_id % 3 = 0
    union all select event_id, 0.25 from events where event_id % 3 > 0 and event_id % 1000 = 0""")
def u6_range_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of some seconds and a quarter, and every third one turned round or empty."""
    start, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    end = start + F.make_dt_interval(secs=F.when(k > 0, k * (F.col("event_id") % 1000) + 0.25).otherwise(-(F.col("event_id") % 2)).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select("event_id", S.range_duration(start, end).alias("seconds"))


@query("""select event_id, case when event_id % 4 = 1 then null else upper(event_type) || (event_id % 4) end as instrument from events""")
def n1_normalize_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.concat(F.lit("  "), F.col("event_type"), F.when(k == 1, "-x").otherwise(k.cast("string")), F.lit(" "))
    return table(spark, sf_dir, "events").select("event_id", S.normalize_instrument(raw).alias("instrument"))


@query(f"""with {TRADES} select instrument, ts, seq, price, qty, side, case when price <= 0 then 'price' when qty <= 0 then 'quantity' end as reject from trades""")
def n2_normalize_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp"))).alias("time_us"),
        F.col("value").cast("string").alias("price"), F.regexp_extract("props", "-?[0-9]+", 0).alias("quantity"), (F.col("event_id") % 2 == 1).alias("buyer_is_maker"),
    )
    return ntz(Q.normalize_trade(raw).select("instrument", "ts", "seq", "price", "qty", "side", "reject"), "ts")


@query(f"""with {TRADES} select instrument, ts, round(price - 0.01 * qty, 6) as bid, round(price + 0.01 * qty, 6) as ask, cast(qty + 1 as double) as bid_size, cast(101 - qty as double) as ask_size,
    case when qty = 0 then 'crossed' end as reject from trades""")
def n2_normalize_book_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    raw = t.select(F.lower("instrument").alias("symbol"), F.unix_micros("ts").alias("time_us"), (F.col("price") - 0.01 * F.col("qty")).cast("string").alias("bid"), (F.col("price") + 0.01 * F.col("qty")).cast("string").alias("ask"), (F.col("qty") + 1).cast("string").alias("bid_size"), (101 - F.col("qty")).cast("string").alias("ask_size"))
    out = Q.normalize_book_ticker(raw)
    return ntz(out.select("instrument", "ts", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "bid_size", "ask_size", "reject"), "ts")


@query("select doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) as title_sha256 from documents")
def n3_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.normalize_title(F.col("text")), 256).alias("title_sha256"))


@query("""select doc_id, 'doc/' || doc_id || '-' || coalesce(nullif(array_to_string(list_slice(regexp_extract_all(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '[0-9a-z]+'), 1, 12), '-'), ''), 'task') as slug from documents""")
def n4_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.slugify(F.concat(F.lit("[Doc] "), F.col("text")), F.concat(F.lit("doc/"), F.col("doc_id"), F.lit("-"))).alias("slug"))


@query("select page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/*$', '')) as key from pages")
def n5_url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.url_identity(F.col("url")).alias("key"))


@query("""select page_id, case page_id % 6 when 4 then null when 5 then null else 'Owner-' || page_id || '/name.' || (page_id % 6) end as repository from pages""")
def n5_repository_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with credentials, of the user@host form, with `.git`, slashes and a query; two have too many or too few parts."""
    name, k = F.concat(F.lit("Owner-"), F.col("page_id"), F.lit("/name."), F.col("page_id") % 6), F.col("page_id") % 6
    host = F.concat(F.regexp_replace("url", "^([a-z]+://)([^/]+).*$", "$1u:p@$2/"), name)
    forms = [F.concat(host, F.lit(".git")), F.concat(F.lit(" git@host.example:"), name, F.lit(".git ")), F.concat(host, F.lit("//")), F.concat(F.lit("ssh://git@host.example:22/"), name, F.lit("/")), F.concat(host, F.lit("/tree")), F.lit("https://host.example/alone.git")]
    return table(spark, sf_dir, "pages").select("page_id", S.repository_identity(F.coalesce(*(F.when(k == i, f) for i, f in enumerate(forms)))).alias("repository"))


@query("""select event_id, cast(regexp_extract(props, '-?[0-9]+') as bigint) as k, sha256(props) as body_sha256, length(props) as body_length,
    list_sort([event_type, 'user']) as names, null::varchar as digest from events""")
def n6_flatten_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    record = e.select("event_id", F.to_json(F.struct(F.col("props").alias("body"), F.array(F.lit("user"), F.col("event_type")).alias("names"), F.lit("none").alias("digest"), F.from_json("props", "k bigint").alias("facts"))).alias("record"))
    return Q.flatten_record(record, "record").select("event_id", "k", "body_sha256", "body_length", "names", "digest")


@query("""select c_custkey, '<redacted>' as Authorization, c_name as safe, '<redacted>' as nested_api_key, c_mktsegment as token_count, '<redacted>' as map_token, c_mktsegment as map_safe, null::bigint as deep_cookie, c_custkey as deep_kept,
    case c_custkey % 4 when 0 then '{"user": {"Password": "<redacted>", "name": "' || c_name || '"}, "tokens": [1]}' when 1 then '{"big": 1e400, "exact": 0.12345678901234567890, "note": "<redacted> ' || c_name || '"}'
        when 2 then '{"name": "' || c_name || '", <redacted>' else '"<redacted> ' || c_name || '"' end as payload from customer""")
def r1_redact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads are JSON with a list under a key, JSON with numbers that no double holds, JSON that breaks off in a secret, and JSON that is one string."""
    c = table(spark, sf_dir, "customer")
    shapes = [('{"user": {"Password": ["x"], "name": "', '"}, "tokens": [1]}'), ('{"big": 1e400, "exact": 0.12345678901234567890, "note": "Authorization: Basic dXNlcjpw ', '"}'), ('{"name": "', '", "password": "hunter2'), ('"password: hunter2 ', '"')]
    k = F.col("c_custkey") % 4
    payload = F.coalesce(*(F.when(k == i, F.concat(F.lit(a), F.col("c_name"), F.lit(b))) for i, (a, b) in enumerate(shapes)))
    nested = c.select(
        "c_custkey", F.col("c_name").alias("Authorization"), F.struct(F.col("c_name").alias("api_key"), F.col("c_name").alias("safe")).alias("nested"),
        F.col("c_mktsegment").alias("token_count"), F.create_map(F.lit("Token"), F.col("c_name"), F.lit("safe"), F.col("c_mktsegment")).alias("m"),
        F.create_map(F.lit("a"), F.create_map(F.lit("COOKIE"), F.col("c_custkey"), F.lit("kept"), F.col("c_custkey"))).alias("deep"),
        payload.alias("payload"),
    )
    out = S.redact_keys(nested, json_cols=("payload",))
    return out.select("c_custkey", "Authorization", F.col("nested.safe").alias("safe"), F.col("nested.api_key").alias("nested_api_key"), "token_count", F.col("m")["Token"].alias("map_token"), F.col("m")["safe"].alias("map_safe"), F.col("deep")["a"]["COOKIE"].alias("deep_cookie"), F.col("deep")["a"]["kept"].alias("deep_kept"), "payload")


def _replaced(sql: str, forms: list[str], by: str) -> str:
    """SQL that replaces every match of each expression in turn, as the operator does."""
    for form in forms:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, form.replace("'", "''").replace("{", "{{").replace("}", "}}"), by)
    return sql


#: What is secret, written out for DuckDB: key blocks, provider tokens, credentials, cookies, named values.
_SECRETS = [
    "-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(-[^-]+)*-----END [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----(\\s*[A-Za-z0-9+/=]{24,})*",
    "\\b(gh[pousr]_|glpat-|xox[bp]-)[\\w-]{20,}", "\\bgithub_pat_[\\w-]{22,}", "\\bnpm_[\\w-]{30,}", "\\bhf_[\\w-]{30,}", "\\b(AKIA|ASIA)[\\w-]{16,}",
    "(?i)\\b(proxy-)?authorization[\"'']?\\s*[:=]\\s*[\"'']?([a-z]+[ \\t]+)?\\S+", "(?i)\\bbearer\\s+[\\w.~+/=-]{16,}",
    "(?i)\\b(set-)?cookie[\"'']?\\s*[:=]\\s*(\"[^\"\\\\]*(\\\\.[^\"\\\\]*)*\"?|''[^'']*''?|[^\\r\\n]+)", "(?i)[\"'']?(password|secret|token|api[_-]?key)[\"'']?\\s*[:=]\\s*(\"[^\"\\\\]*(\\\\.[^\"\\\\]*)*\"?|''[^'']*''?|\\S+)",
]


def _secrets(sql: str) -> str:
    for form in _SECRETS:
        sql = f"regexp_replace({sql}, '{form}', '<redacted>', 'g')"
    return sql


_PATHS_SQL = _replaced("{}", S.path_formats(), "\\1" + S.PATH_REDACTED)


@query(f"select doc_id, sha256(x) as text_sha256, len(regexp_extract_all(x, '<redacted>')) as hits from (select doc_id, {_secrets('text')} as x from documents)")
def r2_redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", S.redact_text(F.col("text")).alias("x"))
    return df.select("doc_id", F.sha2("x", 256).alias("text_sha256"), F.regexp_count("x", F.lit(S.REDACTED)).alias("hits"))


@query(f"""select page_id, {_PATHS_SQL.format("url || ' /srv/data/' || page_id || ' C:\\data\\x and ''D:/y'' but a/b'")} as text from pages""")
def r3_redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("url"), F.lit(" /srv/data/"), F.col("page_id"), F.lit(" C:\\data\\x and 'D:/y' but a/b"))
    return table(spark, sf_dir, "pages").select("page_id", S.redact_paths(text).alias("text"))


@query("select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '//[^/@]*@', '//') as url from pages")
def r4_redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.regexp_replace("url", "^http://", "http://user:pw@")
    return table(spark, sf_dir, "pages").select("page_id", S.redact_url(secret).alias("url"))


@query("select c_custkey from customer where c_custkey % 7 = 3")
def r5_canary_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canary stands under sensitive keys everywhere and, in every seventh row, under a key that is not: those rows leak and no other."""
    c = table(spark, sf_dir, "customer")
    planted = F.concat(F.lit("CANARY-7731-"), F.col("c_name"))
    rows = c.select("c_custkey", planted.alias("password"), F.struct(planted.alias("Token"), F.when(F.col("c_custkey") % 7 == 3, planted).alias("note")).alias("nested"))
    return S.canary_rows(S.redact_keys(rows), "CANARY-7731").select("c_custkey")


#: Absolute paths, written out for DuckDB, whose `\s` leaves out the vertical tab.
_ABSOLUTE = ["(^|[^[:alnum:]])[A-Za-z]:[\\\\/][^\\s\\x0B''\"]+", "(^|[^[:alnum:]:/])/[^/\\s\\x0B''\"][^\\s\\x0B''\"]*"]


def _paths(sql: str) -> str:
    for form in _ABSOLUTE:
        sql = f"regexp_replace({sql}, '{form}', '\\1<absolute-path-redacted>', 'g')"
    return sql


@query(f"""select doc_id, length(y) as n, sha256(y) as sha from (select doc_id, case when regexp_matches(t, '^([A-Za-z]:[\\\\/]|/([^/]|$))') then '<absolute-path-redacted>'
    when length(x) <= 512 then x else substr(x, 1, 496) || '…<truncated>' end as y
    from (select doc_id, t, {_paths(_secrets("t"))} as x from (select doc_id, replace(text, chr(0), '') as t from documents)))""")
def b1_bound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", S.bound_text(F.col("text")).alias("y"))
    return df.select("doc_id", F.length("y").alias("n"), F.sha2("y", 256).alias("sha"))


@query(f"""select doc_id, length(y) as n, sha256(y) as sha from (select doc_id, case when length(x) <= 2000 then x else '<truncated>…' || right(x, 2000) end as y
    from (select doc_id, {_secrets("trim(replace(text, '/', ' '))")} as x from documents))""")
def b2_tail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", S.tail_text(F.replace("text", F.lit("/"), F.lit(" "))).alias("y"))
    return df.select("doc_id", F.length("y").alias("n"), F.sha2("y", 256).alias("sha"))


@query("""select user_id, list_slice(ids, 1, 50) as items, len(ids) as n, len(ids) > 50 as truncated from (select user_id, list(event_id order by event_id) as ids from events group by 1)""")
def b3_bound_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.bound_list(F.array_sort(F.collect_list("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(b.alias("b")).select("user_id", "b.items", F.col("b.count").alias("n"), "b.truncated")


@query(f"""select page_id, case when length(x) > 40 then substr(x, 1, 40) || chr(10) || '<truncated>' || chr(10) else x end as text, length(x) > 40 as truncated, sha256(x) as digest
    from (select page_id, {_secrets("replace(url, '/', ' ')")} as x from pages)""")
def b4_bound_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id", S.bound_bytes(F.replace("url", F.lit("/"), F.lit(" ")), 40).alias("b"))
    return df.select("page_id", "b.text", "b.truncated", F.col("b.sha256").alias("digest"))


@query("""select c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","m":{"a":' || c_custkey || ',"b":2},"missing":null,"s":{"x":"' || c_name || '","y":null}}') as digest from customer""")
def d1_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the map stand in either order, and the fields of the struct in the wrong one; the digests are those of sorted keys."""
    a, b = (F.lit("a"), F.col("c_custkey")), (F.lit("b"), F.lit(2).cast("bigint"))
    m = F.when(F.col("c_custkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    s = F.struct(F.lit(None).cast("string").alias("y"), F.col("c_name").alias("x"))
    df = table(spark, sf_dir, "customer").withColumns({"missing": F.lit(None).cast("string"), "m": m, "s": s})
    return df.select("c_custkey", S.canonical_digest(["s", "missing", "m", "c_mktsegment"], df.schema).alias("digest"))


@query("select event_id, event_id % 3 < 2 as ok from events")
def d2_is_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.sha2(F.col("event_id").cast("string"), 256)
    k = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", S.is_digest(F.when(k == 0, full).when(k == 1, F.upper(F.substring(full, 1, 40))).otherwise(F.substring(full, 1, 41))).alias("ok"))


@query("select event_id, case event_id % 4 when 0 then 'pass' when 1 then 'pass' when 2 then 'unknown' else 'fail' end as gate from events")
def d3_digest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, full = F.col("event_id") % 4, F.sha2(F.col("event_id").cast("string"), 256)
    actual = F.when(k == 2, None).when(k == 3, F.reverse(full)).otherwise(full)
    return table(spark, sf_dir, "events").select("event_id", S.digest_gate(actual, F.when(k != 0, full)).alias("gate"))


@query("""select event_id, case event_type when 'click' then 'success' when 'error' then 'failed' when 'view' then 'pending' else 'skipped-or-unknown' end as category from events""")
def k1_categorize_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "queued")
    return table(spark, sf_dir, "events").select("event_id", S.categorize_state(F.lit(""), state).alias("category"))


_MESSAGES = [
    ("Bad credentials", "authentication", "github-authentication-failure", 401), ("HTTP 403: upgrade your account", "plan-limit", "github-plan-limit-403", 403), ("http 403 secondary rate", "rate-limit", "github-rate-limit-403", 403),
    ("HTTP 403", "permission", "github-permission-403", 403), ("API rate limit reached", "rate-limit", "github-rate-limit", 429), ("Could not resolve host", "network", "network-failure", None), ("cannot parse reply", "schema-or-parse", "github-schema-or-parse-failure", None),
    ("odd", "unknown", "required-checks-query-failed", None), ("got 403, branch protection is not included", "plan-limit", "github-plan-limit-403", 403), ("http 403: needs sso", "scope-or-permission", "github-scope-or-sso-403", 403), ("answer 502", "service", "github-service-failure", None),
]


@query("select event_id, m.category, m.reason, m.http_status::int as http_status from events join (values {}) m(k, category, reason, http_status) on event_id % {} = m.k".format(
    ", ".join(f"({k}, '{c}', '{r}', {'null' if n is None else n})" for k, (_, c, r, n) in enumerate(_MESSAGES)), len(_MESSAGES)))
def k2_classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(m[0]) for m in _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.classify_error(F.concat_ws("\n", text, F.col("event_type"))).alias("e")).select("event_id", "e.*")


@query("""select event_id, case event_id % 4 when 0 then 'ok' when 1 then 'section-count' when 2 then 'duplicate' else 'missing' end as status, case when event_id % 4 = 0 then event_type end as caller from events""")
def k3_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    good = F.concat(F.lit("intro\n### Outcome\nCaller: "), F.col("event_type"), F.lit("\nResult: done\n### Next\nCaller: other"))
    body = F.when(k == 0, F.replace(good, F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.concat(good, F.lit("\n### Outcome"))).when(k == 2, F.replace(good, F.lit("Result: done"), F.lit("Result: done\nResult: twice"))).otherwise(F.replace(good, F.lit("Result: done"), F.lit("")))
    f = S.extract_fields(body, "### Outcome", ["caller", "result"])
    return table(spark, sf_dir, "events").select("event_id", f.alias("f")).select("event_id", "f.status", "f.caller")


@query("""select event_id, case event_id % 3 when 0 then '3 passed in 1s' when 1 then 'last <redacted> ' || event_type else 'boom <redacted> ' || event_type end as summary from events""")
def k4_summarize_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.lit("x\n3 passed in 1s\n")).when(k == 1, F.concat(F.lit("a\r\n last password: x "), F.col("event_type"), F.lit("\n\n"))).otherwise(F.concat(F.lit("boom token=abc "), F.col("event_type")))
    kind = F.when(k == 0, "tests").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", S.summarize_log(text, kind, {"tests": "[0-9]+ passed[^\\n]*"}, k == 2).alias("summary"))


@query("""select user_id, 'e' || max(event_id) as name, substr(sha256(max(event_id)::varchar), 1, 40) as digest from events group by 1""")
def k5_parse_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 40), F.lit("\te"), F.col("event_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("bad line\nzz\tx\n"), text).alias("text"))
    refs = Q.parse_refs(listed, "user_id", "text")
    return refs.groupBy("user_id").agg(F.max_by("name", "line").alias("name"), F.max_by("digest", "line").alias("digest"))


#: Documents that nest a status in ways of their own; `@` is the event's number.
_NESTED = [
    '{"items": [{"id": @}, {"content": {"STATUS": {"id": 1, "name": "done-@"}}}], "status": "late"}', '{"a": {"status": {"deep": [[{"Status": "in-@"}]]}}, "z": {"status": "last"}}', '{"a": {"status": null, "name": "no"}, "b": [1, {"status": @}]}',
    '{"name": "none", "tags": ["status"]}', '{"a": [{"b": [{"c": {"d": {"e": {"status": "deep-@"}}}}]}]}', '{"status": {"x": {"name": "inner"}, "name": "own-@"}}', '{"status": true, "Status": "second"}',
]


@query("""with d as (select event_id, replace(d, '@', event_id::varchar) as doc from events join (values {}) n(k, d) on event_id % {} = k),
    t as (select event_id, d.doc, t.* from d, json_tree(d.doc::json) t), hit as (select event_id, id as place, case when type = 'OBJECT' then json_extract_string(value, '$.name') else json_extract_string(doc, fullkey) end as v
        from t where lower(key) = 'status' and (type in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') or type = 'OBJECT' and json_type(value, '$.name') = 'VARCHAR'))
    select event_id, arg_min(v, place) as v from d left join hit using (event_id) group by event_id""".format(", ".join(f"({k}, '{d}')" for k, d in enumerate(_NESTED)), len(_NESTED)))
def k6_find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.element_at(F.array(*map(F.lit, _NESTED)), (F.col("event_id") % len(_NESTED) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", S.find_key(F.replace(doc, F.lit("@"), F.col("event_id").cast("string")), "status").alias("v"))


@query(f"with {BARS} select instrument, bar_start, list_filter([case when n % 7 = 0 then 'high' end, case when n % 5 = 0 then 'volume' end], lambda x: x is not null) as violations from bars")
def v1_validate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.bars import trades_to_bars

    b = trades_to_bars(trades(spark, sf_dir), "1 hour").withColumnRenamed("bar_start", "start").withColumn("end", F.col("start") + F.expr("interval 1 hour"))
    b = b.withColumn("high", F.when(F.col("n") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("n") % 5 == 0, -1.0).otherwise(F.col("volume").cast("double")))
    out = Q.validate_bars(b)
    return ntz(out.select("instrument", F.col("start").alias("bar_start"), F.filter("violations", lambda v: v.isin("high", "volume")).alias("violations")), "bar_start")


@query("""select o_orderkey, list_filter([case when o_totalprice > 400000 then 'o_totalprice:range' end, case when o_orderstatus = 'P' then 'o_orderstatus:allowed' end], lambda x: x is not null) as violations from orders""")
def v2_validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"o_orderkey": {"required": True, "unique": True}, "o_totalprice": {"required": True, "max": 400000.0}, "o_orderstatus": {"allowed": ["F", "O"]}}
    return Q.validate_records(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "violations")


@query("""select o_orderstatus, count(*) filter (where o_totalprice <= 400000) as accepted, count(*) filter (where o_totalprice > 400000) as quarantined from orders group by 1""")
def v3_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Q.split_valid(Q.validate_records(table(spark, sf_dir, "orders"), {"o_totalprice": {"max": 400000.0}}))
    both = good.select("o_orderstatus", F.lit(1).alias("g")).unionByName(bad.select("o_orderstatus", F.lit(0).alias("g")))
    return both.groupBy("o_orderstatus").agg(F.sum("g").alias("accepted"), F.sum(1 - F.col("g")).alias("quarantined"))


@query("""with a as (select user_id, bool_and(event_type <> 'error') as ok, count(*) as n, count(*) filter (where event_type = 'view') as bare from events group by 1)
    select user_id, bare as no_evidence, case when ok then 0 else 1 end as overall_violations from a""")
def v4_validate_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "not_verified").otherwise("verified")
    evidence = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.col("event_type")))
    area = F.struct(F.col("event_id").cast("string").alias("name"), status.alias("status"), F.array(F.col("props")).alias("files"), evidence.alias("evidence"), F.lit("risk").alias("remaining_risk"))
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(area).alias("areas")).withColumn("overall", F.lit("verified"))
    out = Q.validate_artifact(a)
    return out.select("user_id", F.size(F.filter("violations", lambda v: v.endswith("no-evidence"))).alias("no_evidence"), F.size(F.filter("violations", lambda v: v.startswith("overall"))).alias("overall_violations"))
