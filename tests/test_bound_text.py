"""B1 on texts with paths, secrets and NUL: what is expected is written out."""

import hashlib

import oracle
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import scalar as S

PATH = "<absolute-path-redacted>"
#: Texts, and what is left of them at the limit of 512.
TEXTS = [
    ("/etc/passwd and more", PATH),
    ("/home/A B/my files/x.txt", PATH),
    ("C:\\Program Files\\x y", PATH),
    ("d:/data x", PATH),
    ("/srv/a " + "q" * 600, PATH),
    ("/token: abc def", PATH),
    ("\x00/\x00srv/a b", PATH),
    ("/", PATH),
    ("//host/share x", "//host/share x"),
    (" /srv/x y", f" {PATH} y"),
    ("see '/srv/x' and C:\\y\x0bz, https://a.b/c password=abc", f"see '{PATH}' and {PATH}\x0bz, https://a.b/c <redacted>"),
    ("a\x00b", "ab"),
    ("x" * 512, "x" * 512),
    ("é" * 513, "é" * 496 + "…<truncated>"),
    ("y" * 490 + " /srv/" + "z" * 40, ("y" * 490 + " " + PATH)[:496] + "…<truncated>"),
    ("日Bearer aaaaaaaaaaaaaaaa éghp_" + "b" * 20, "日<redacted> é<redacted>"),
    ("token\f: abc\fdef", "<redacted>\fdef"),
    ("", ""),
    (None, None),
]


def test_texts_that_begin_as_a_path_are_replaced_whole(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TEXTS)], "k int, t string")
    got = {r.k: r.y for r in df.select("k", S.bound_text(F.col("t")).alias("y")).collect()}
    assert [got[k] for k in range(len(TEXTS))] == [want for _, want in TEXTS]


def test_query_bounds_texts_as_they_are(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["b1_bound_text"](spark, str(tmp_path))
    assert oracle.differences(df, oracle.connect(str(tmp_path)), registry.ORACLES["b1_bound_text"]) == ""
    got = {r.doc_id: r.sha for r in df.collect()}
    assert got == {k: want if want is None else hashlib.sha256(want.encode()).hexdigest() for k, (_, want) in enumerate(TEXTS)}


def test_secrets_of_many_parts(spark):
    key = "-----BEGIN PRIVATE KEY-----"
    long = [key + " a-b" * 20000 + key.replace("BEGIN", "END"), key + ("\n" + "A" * 64) * 20000, 'password="' + "a\\n" * 20000 + '"']
    df = spark.createDataFrame([(t + " end",) for t in long], "t string")
    assert [r.y for r in df.select(S.bound_text(F.col("t")).alias("y")).collect()] == ["<redacted> end"] * 3
