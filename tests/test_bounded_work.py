"""What the text functions do to a text they do once."""

import re

from pyspark.sql import functions as F

from tidemark.functions import scalar as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_redaction_stands_once_in_a_plan(spark):
    df = spark.createDataFrame([("x password=abc /srv/x",)], "t string")
    for cut in (S.bound_text, S.tail_text, S.bound_bytes):
        assert plan(df.select(cut(F.col("t")).alias("y"))).count("-----END") == 1


def test_hints_stand_in_every_match():
    said = ["-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "Proxy-Authorization: Basic abc", "BEARER " + "a" * 20, "Set-Cookie=x", "API-KEY: x", "ApiKey='x y'", "my_Token = 7", *(p + "a" * 40 for p in S.PROVIDER_TOKENS)]
    met = set()
    for k, (form, (cased, hints)) in enumerate(zip(S.secret_formats(), S.secret_hints(), strict=True)):
        for text in said:
            if re.search(form, text):
                met.add(k)
                assert any(h in (text if cased else text.lower()) for h in hints)
    assert len(met) == len(S.secret_formats())


def test_slugs_are_made_without_python(spark):
    import unicodedata

    one, many = S.ascii_forms()
    every = [(f"a {c}b",) for c in [*list(one)[::7], *many]] + [("[tag] Ünïcode… ½ straße 漢字 ﬁn № éa \U0001d400x",), ("漢" * 3000 + " late wörd",), ("w " * 490 + "half" * 9 + " é",), ("",), (None,)]
    df = spark.createDataFrame(every, "t string")
    out = df.select("t", S.slugify(F.col("t")).alias("slug"))
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    for t, slug in out.collect():
        bare = unicodedata.normalize("NFKD", re.sub(r"^\s*\[[^\]]+\]\s*", "", t or "")).encode("ascii", "ignore").decode().lower()
        assert slug == ("-".join(re.findall("[0-9a-z]+", bare)[:12]) or "task"), t


def test_lines_are_cut_once_in_a_plan(spark):
    df = spark.createDataFrame([("# H\nA: 1\nB: 2\n# N\nA: 3",)], "t string").select(S.extract_fields(F.col("t"), "# H", ["a", "b"]).alias("f")).select("f.*")
    assert plan(df).count("split(") == 1
    assert df.first().asDict() == {"status": "ok", "a": "1", "b": "2"}


def test_quantiles_work_out_their_values_once(spark):
    from tidemark.operators.ledger import latency_quantiles

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("id % 2 as g", "id as d").mapInArrow(count, "g long, d long")
    got = {r.g: (r.n, r.p50) for r in latency_quantiles(df, ["g"], "d", large=0, sketch=10).collect()}
    assert got == {0: (500, 499.0), 1: (500, 500.0)} and seen.value == 1000


def test_few_wide_rows_go_to_python_at_once(spark):
    from tidemark.operators import nearsets

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    most = spark.sparkContext.accumulator(0)

    def sizes(batches):
        for batch in batches:
            most.add(int(batch.num_rows > nearsets.AT_A_TIME))
            yield batch

    with nearsets._few_at_a_time(spark):
        assert spark.range(0, 3000, 1, 1).mapInArrow(sizes, "id long").count() == 3000
    assert most.value == 0 and spark.conf.get(name) == was
