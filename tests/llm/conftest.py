import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in every column, empty, blank and long texts, ties and repeated rows.
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "The cat sat on the mat. It was a fine day."), (5, "The cat sat on the mat. It was a fine day."),
    (6, "!!! ??? ..."), (7, "word " * 30_000), (8, "Un chat noir dort. Il fait beau."), (9, "日本語 テキスト 🎉"), (10, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with awkward rows, and with further columns whose names the operators use themselves."""
    rows = [(i, t, None if i == 4 else "en" if i != 8 else "fr", None if i == 5 else "s", None if t is None else len(t)) for i, t in ODD]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("id", "fp", "key", "score", "n", "u", "v", "node", "component", "tokens", "runs", "words", "rate", "p0", "domain", "label")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
