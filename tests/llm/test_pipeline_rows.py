"""The pipeline's stages row by row: null and repeated ids, repeated rows, and further columns with names that the operators use."""

import pytest
from pyspark.sql import functions as F
from test_nearsets import plain_classes, texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def test_near_copy_stage_keeps_one_row_of_each_class(spark):
    rows = texts()
    data = [(k, t, None, None, None) for k, t in enumerate(rows)] + [(0, rows[0], None, None, None), (None, rows[0], None, None, None), (None, "alone without an id", None, None, None)] * 2
    docs = spark.createDataFrame(data, SCHEMA)
    out = corpus_pipeline.simhash_stage(spark, docs, "")
    want = sorted(set(plain_classes(rows)))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == want
    assert out.where("doc_id is null").count() == 1


def test_stages_keep_rows_and_columns(spark):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 900").orderBy("doc_id").limit(12).collect()]
    data = [(k // 2 if k % 3 else None, t, None if k % 4 else "en", None, None) for k, t in enumerate(own)] + [(50, None, None, None, None), (50, "", None, None, 0)]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(7) for c in ("row", "runs", "kept", "tokens", "rate", "p0", "score", "node", "id", "key", "class_row")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) <= len(data) and all(r.row == 7 and r.p0 == 7 for r in got), name
        if name == "suffix_array_dedup":
            assert len(got) == len(data)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(data)


def test_mixing_stage_is_the_same_each_time(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (sorted(r.doc_id for r in corpus_pipeline.mixing_stage(spark, d, SF).collect()) for d in (docs, docs.repartition(7)))
    assert one == other and 0 < len(one) <= docs.count()


def test_near_copy_stage_links_by_fingerprints(spark):
    from tidemark.llm.simhash import fingerprint

    said = " ".join(f"word{k}" for k in range(40))
    rows = [" ".join([said] * 60 + [f"tail{t}x{k}" for k in range(200)]) for t in range(2)] + ["some other text that is of no one's kind at all"]
    bits = [fingerprint(t, 5) for t in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 and plain_classes(rows) == [0, 1, 2]  # beyond the sets' similarity
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == [0, 2]
