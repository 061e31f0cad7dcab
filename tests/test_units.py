"""Hand-made rows for the scalar functions, validators, gates and joins."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import joins as J
from tidemark.operators import ledger as L
from tidemark.operators import quality as Q
from tidemark.operators import research as R
from tidemark.operators import text as E
from tidemark.sources import ingest as I


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("2031-03-09T23:59:07Z", "2031-03-09T23:59:07Z"), ("2031-03-10T01:30:00+05:30", "2031-03-09T20:00:00Z"), ("2030-12-31T20:15:00-04:00", "2031-01-01T00:15:00Z"),
    ("2031-03-09T23:59:07.000250Z", "2031-03-09T23:59:07.000250Z"), ("", None), ("2031-04-31T10:00:00Z", None), ("2031-03-09T24:30:00Z", None), ("2031-03-09T10:00:00", None),
])
def test_parse_and_format(spark, text, want):
    assert one(spark, S.format_utc(S.parse_utc(F.col("t"))), t=text) == want
    if want is None:
        with pytest.raises(Exception, match="not an ISO instant"):
            one(spark, S.parse_utc(F.col("t"), strict=True), t=text)


@pytest.mark.parametrize("text, want", [("x Z", True), ("2026-01-01T00:00:00+00:00", True), ("2026-01-01T00:00:00+08:00", False), ("2026-01-01T00:00:00", False), (None, False)])
def test_is_utc(spark, text, want):
    assert one(spark, S.is_utc(F.col("t")), t=text) is want


def test_naive_columns_are_refused(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00' as ts")
    with pytest.raises(ValueError, match="ts"):
        S.ensure_aware(df, ["ts"])
    assert dict(S.ensure_aware(df, ["ts"], assume_utc=True).dtypes)["ts"] == "timestamp"


@pytest.mark.parametrize("raw, want", [(" btcusdt ", "BTCUSDT"), ("a" * 33, None), ("BTC-USD", None), ("", None), (None, None)])
def test_instruments(spark, raw, want):
    assert one(spark, S.normalize_instrument(F.col("t")), t=raw) == want


def test_titles_and_slugs(spark):
    assert one(spark, S.normalize_title(F.col("t")), t="  Ｆull  ﬁ Straße ") == "full fi strasse"
    assert one(spark, S.slugify(F.col("t"), "task/7-"), t="[Core] Émile's plan: 日本 v2") == "task/7-emile-s-plan-v2"
    assert one(spark, S.slugify(F.col("t")), t="日本") == "task"


def test_redaction(spark):
    assert one(spark, S.redact_text(F.col("t")), t="token: abc and Bearer abcdefghijklmnop1 ghp_" + "a" * 20) == "<redacted> and <redacted> <redacted>"
    assert one(spark, S.redact_paths(F.col("t")), t="see C:\\x\\y and /etc/passwd but https://a.b/c") == "see <absolute-path-redacted> and <absolute-path-redacted> but https://a.b/c"
    assert one(spark, S.redact_url(F.col("t")), t="HTTPS://u:p@Host.x:8080/a/b?q=1#f") == "https://host.x:8080/a/b"
    assert one(spark, S.redact_url(F.col("t")), t="no url") == "no url"
    assert one(spark, S.bound_text(F.col("t")), t="/etc/passwd and more") .startswith("<absolute-path-redacted>")
    assert one(spark, S.bound_text(F.col("t"), 20), t="x" * 30) == "xxxx…<truncated>"
    b = one(spark, S.bound_bytes(F.col("t"), 4), t="aéé日")
    assert b.text == "aé\n<truncated>\n" and b.truncated


def test_canary_is_nowhere(spark):
    df = spark.sql("""select named_struct('Api_Key', 'CANARY', 'items', array(named_struct('token', 'CANARY', 'safe', 's'))) as nested, 'CANARY' as Cookie,
        map('SECRET', 'CANARY', 'ok', 'v') as m, map('password', 7, 'n', 1) as numbers, map('token', named_struct('v', 'CANARY'), 'x', named_struct('v', 'kept')) as structs,
        map('x', named_struct('password', 'CANARY', 'q', 2)) as inner, array(map('cookie', 'CANARY')) as listed, 'kept' as cookie_jar, '{"a": [{"Token": {"b": "CANARY"}, "c": 1}]}' as js, 'no json, token: CANARY' as bad_js, cast(null as string) as no_js""")
    safe = S.redact_keys(df, json_cols=("js", "bad_js", "no_js"))
    assert S.canary_rows(df, "CANARY").count() == 1 and S.canary_rows(safe, "CANARY").count() == 0
    row = safe.first()
    assert row.nested["items"][0].safe == "s" and row.m["ok"] == "v" and row.cookie_jar == "kept"
    assert row.numbers == {"password": None, "n": 1} and row.structs["token"] is None and row.structs["x"].v == "kept" and row.inner["x"].q == 2
    assert row.js == '{"a": [{"Token": "<redacted>", "c": 1}]}' and row.bad_js == "no json, <redacted>" and row.no_js is None


@pytest.mark.parametrize("text, want", [
    ("HTTP 403 rate limit", ("rate-limit", 403)), ("http 403: upgrade", ("plan-limit", 403)), ("needs sso 403", ("scope-or-permission", 403)), (" 503", ("service", None)), ("x", ("unknown", None)), (None, ("unknown", None)),
    ("403 branch protection: not available", ("plan-limit", 403)), ("403 branch protection", ("permission", 403)), ("http 401 and 403", ("authentication", 401)), ("http 429", ("rate-limit", 429)),
])
def test_errors(spark, text, want):
    got = one(spark, S.classify_error(F.col("t")), t=text)
    assert (got.category, got.http_status) == want and got.reason.startswith(("github-", "network-", "required-"))


def test_logs_are_redacted(spark):
    def summary(text, kind="other", failed=False):
        return one(spark, S.summarize_log(F.col("t"), F.lit(kind), {"tests": "=+ ([^\\n]*passed[^\\n]*) =+"}, F.lit(failed)), t=text)

    assert summary("a\r\npassword: hunter2 C:\\x\n\n") == "<redacted> <absolute-path-redacted>"
    assert summary("== 3 passed ==\nmore", "tests") == "3 passed" and summary(" \n") == "pass"
    assert summary("a\ntoken=abc", failed=True) == "a\n<redacted>"
    assert len(summary("y" * 500)) == 240 - 16 + len("…<truncated>")


def test_digests_do_not_depend_on_order(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 2, 'a', 1) as y, named_struct('q', map('k', array(map('d', 1, 'c', 2)))) as u, named_struct('q', map('k', array(map('c', 2, 'd', 1)))) as v")
    d = [t.select(S.canonical_digest(["m"], t.schema).alias("d")).first().d for t in (df.select(F.col(c).alias("m")) for c in "xyuv")]
    assert d[0] == d[1] and d[2] == d[3] and d[0] != d[2]


def test_records_by_spec(spark):
    rows = [('{"a": {"n": 3, "t": "x"}, "l": ["b", 1, "a", null], "d": "' + "f" * 40 + '", "b": "body"}',), ('{"a": {"n": "3", "t": 4}, "l": "b", "d": "zz", "b": 5}',), ("broken",), (None,)]
    spec = {"n": ("a.n", "bigint"), "t": ("a.t", "string"), "l": ("l", "names"), "d": ("d", "digest"), "b": ("b", "body")}
    out = [tuple(r)[1:] for r in Q.flatten_record(spark.createDataFrame(rows, "j string"), "j", spec).collect()]
    import hashlib

    assert out[0] == (3, "x", ["a", "b"], "f" * 40, hashlib.sha256(b"body").hexdigest(), 4)
    assert out[1:] == [(None,) * 6] * 3


def test_overall_statuses(spark):
    area = "array(named_struct('name', 'a', 'status', 'verified', 'files', array('f'), 'evidence', array('e'), 'remaining_risk', cast(null as string)))"
    df = spark.sql(f"select {area} as areas, o as overall from values ('verified'), ('partial'), ('not_verified'), ('partially_verified'), (null) t(o)")
    out = {r.overall: r.violations for r in Q.validate_artifact(df).collect()}
    assert out == {"verified": [], "partial": [], "not_verified": [], "partially_verified": ["overall:invalid"], None: ["overall:invalid"]}


@pytest.mark.parametrize("body, want", [
    ("### Goal\nA: 1\nB: 2", "ok"), ("A: 1", "section-count"), ("### Goal\nA: 1\nA: 2\nB: 3", "duplicate"), ("### Goal\nA:\nB: 1", "empty"), ("### Goal\nA: 1\n## Next\nB: 2", "missing"), ("### Goal\r\nA: 1\r\nB: 2\r\n", "ok"), ("", "unavailable"), (None, "unavailable"),
])
def test_fields(spark, body, want):
    assert one(spark, S.extract_fields(F.col("t"), "### Goal", ["a", "b"]), t=body).status == want


def test_bars_with_nan_are_not_finite(spark):
    rows = [("A", 1.0, float("nan"), 0.5, 1.0, 1.0), ("B", 0.0, 1.0, -1.0, 0.0, 0.0), ("C", 1.0, 0.5, 0.5, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "instrument string, open double, high double, low double, close double, volume double").withColumns({"start": F.lit("2024-01-01").cast("timestamp"), "end": F.lit("2024-01-02").cast("timestamp")})
    assert {r.instrument: r.violations for r in Q.validate_bars(df).collect()} == {"A": ["finite"], "B": [], "C": ["high", "volume"]}
    good, bad = Q.split_valid(Q.validate_bars(df))
    assert (good.count(), bad.count()) == (1, 2)


def test_unknown_never_passes(spark):
    g = spark.createDataFrame([(1, "a", "pass"), (1, "b", None), (2, "a", "pass"), (3, "a", "strange"), (4, "a", "fail")], "s int, name string, status string")
    out = {r.s: r.status for r in Q.disposition(g, ["s"]).collect()}
    assert out == {1: "partial", 2: "pass", 3: "partial", 4: "fail"}
    e = spark.createDataFrame([(1, "OPEN"), (2, "CLOSED"), (3, None)], "s int, state string")
    assert {r.s: r.gate for r in Q.dependency_gate(e, ["s"]).collect()} == {1: "fail", 2: "pass", 3: "unknown"}
    none = Q.state_rollup(spark.createDataFrame([], "s int, state string"), [], "state").first()
    assert none["count"] == 0 and none.all_success is None


def test_asof_ties_and_tolerance(spark):
    left = spark.sql("select * from values ('a', timestamp '2024-01-01 10:00:00'), ('a', timestamp '2024-01-01 09:00:00'), ('b', timestamp '2024-01-01 10:00:00') t(k, ts)")
    right = spark.sql("select * from values ('a', timestamp '2024-01-01 10:00:00', 1), ('a', timestamp '2024-01-01 09:30:00', 2), ('a', null, 3) t(k, at, v)")
    rows = {(r.k, str(r.ts)[11:]): r.v for r in J.asof_join(left, right, ("ts", "at"), ["k"], ["v"]).collect()}
    assert rows == {("a", "10:00:00"): 1, ("a", "09:00:00"): None, ("b", "10:00:00"): None}
    ahead = {(r.k, str(r.ts)[11:]): r.v for r in J.asof_join(left, right, ("ts", "at"), ["k"], ["v"], direction="forward", tolerance="10 minutes").collect()}
    assert ahead[("a", "10:00:00")] == 1 and ahead[("a", "09:00:00")] is None


def test_average_cost_by_hand(spark):
    rows = [("x", 1, "BUY", 10.0, 100.0), ("x", 2, "BUY", 10.0, 200.0), ("x", 3, "SELL", 5.0, 100.0), ("x", 4, "SELL", 20.0, 200.0), ("x", 5, "BUY", 5.0, 25.0)]
    out = L.average_cost_pnl(spark.createDataFrame(rows, "a string, seq int, side string, qty double, notional double"), ["a"], ["seq"]).orderBy("seq").collect()
    assert [(r.realised, r.open_qty, r.avg_cost) for r in out] == [(0, 10, 10), (0, 20, 15), (25, 15, 15), (-75, -5, 10), (25, 0, 0)]


def test_order_fold(spark):
    rows = [("a", 1, "NEW"), ("a", 2, "PARTIAL"), ("a", 3, "FILLED"), ("a", 4, "CANCELLED"), ("b", 1, "FILLED"), ("c", 1, "NEW"), ("c", 1, "NEW"), ("c", 2, "UNKNOWN"), ("c", 3, "CANCELLED")]
    out = {r.k: (r.state, r.illegal) for r in L.order_state(spark.createDataFrame(rows, "k string, seq int, kind string"), "k", ["seq"], "kind").collect()}
    assert out == {"a": ("FILLED", 1), "b": ("UNKNOWN", 1), "c": ("CANCELLED", 0)}


def test_clusters(spark):
    chain = [(k, k + 1) for k in range(1, 90)]
    out = E.event_clusters(spark.createDataFrame([*chain, (205, 206), (7, 7)], "a int, b int"))
    assert {r.id: r.cluster for r in out.collect()} == {k: 1 for k in range(1, 91)} | {205: 205, 206: 205}


def test_landing_twice_is_landing_once(spark, tmp_path):
    df = spark.createDataFrame([(k, "A" if k % 2 else "B", "2024-01-01") for k in range(10)], "k int, instrument string, dt string")
    path = str(tmp_path / "raw")
    I.land_raw(df.where("k < 6"), path, ["k"], ["instrument", "dt"])
    I.land_raw(df, path, ["k"], ["instrument", "dt"])
    I.land_raw(df, path, ["k"], ["instrument", "dt"])
    landed = spark.read.parquet(path)
    assert landed.count() == 10 and landed.select("k").distinct().count() == 10
    manifest = I.file_manifest(spark, path)
    assert {r.state for r in I.verify_manifest(manifest, I.file_manifest(spark, path), ["path"]).collect()} == {"match"}


def test_logs_and_strict_json(spark, tmp_path):
    log = spark.sql("select '2024-01-01T00:00:00Z' as timestamp, 'INFO' as level, 'l' as logger, 'm' as message, map('k', 'v') as extra")
    path = str(tmp_path / "log")
    I.write_log(log, path)
    I.write_log(log, path)
    assert I.read_log(spark, path).count() == 2 and I.read_log(spark, path).first().extra == {"k": "v"}
    (tmp_path / "bad.json").write_text('{"k": 1}\n{broken\n')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k bigint")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        I.read_json_strict(spark, str(tmp_path / "bad.json"), schema).collect()
    rows = I.read_json_strict(spark, str(tmp_path / "bad.json"), schema, quarantine=True).collect()
    assert sorted(r._corrupt_record is None for r in rows) == [False, True]


def test_snapshots_are_content_addressed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    for _ in range(2):
        I.store_snapshot(df, str(tmp_path / "s"), ["s", "n"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_deflated_sharpe_and_pbo(spark):
    rows = [(c, k, ((k * 37 + c * 11) % 19 - 9) / 100 + c / 1000) for c in range(6) for k in range(80)]
    df = spark.createDataFrame(rows, "c int, k int, r double").withColumn("block", F.col("k") % 8)
    out = R.deflated_sharpe(df, "c", "r").collect()
    assert len(out) == 6 and all(0 <= r.deflated <= 1 for r in out)
    p = R.pbo(df, "c", "block", "r", spark).first()
    assert p.splits == 70 and 0 <= p.pbo <= 1


def test_contamination_shares_exact_grams(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, "X a b c d e f g h i")], "item_id int, text string")
    assert [tuple(r) for r in J.contamination(docs, bench).collect()] == [(1, 7, 2)]
