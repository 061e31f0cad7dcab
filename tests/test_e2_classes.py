"""E2 returns a row for each document."""

from test_nearsets import plain_classes, texts

from tidemark import registry


def test_query_has_a_row_for_each_document(spark, tmp_path):
    rows = texts()
    data = [(k + 10, t) for k, t in enumerate(rows)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["e2_near_duplicates"](spark, str(tmp_path)).collect()}
    want = plain_classes(rows)
    assert len(got) == len(rows) and [got[k + 10].class_id for k in range(len(rows))] == [w + 10 for w in want]
    n = len(rows)
    assert got[n + 1].set_id == 10 and got[n + 3].set_id == got[n + 2].set_id == n + 2  # another case, and three short words
