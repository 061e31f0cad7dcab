"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed base rules come first. Every further rule compares a ratio of the document
with a fence of its own group (language and source): the group's upper quartile plus
`reach` times the spread between its median and upper quartile, and at least `slack`
above the median. Quartiles come from a log-bucket sketch, a count for each bucket of
relative width 2 * `accuracy`: sketches merge by adding counts, so they are partial
sums before the shuffle, a hot source sends one row for each bucket and task, and a
group with fewer than `least` documents takes the merged sketch of its language, a
language that has fewer that of all documents. Fences are joined back on the group.

Only documents that the base rules keep enter the sketches. Null and empty texts have
no words and fail; null languages and sources form groups of their own. Repeated rows
count each time. Further columns are ignored. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: White space that parts words, and the characters that count as symbols.
SPACE, SYMBOLS = "\\x20\\x09-\\x0D", "#*$%&|<>"
ACCURACY, LEAST = 0.01, 100
#: Rule: numerator, denominator, reach and slack.
RULES = {
    "word_length": ("word_chars", "n_words", 6.0, 3.0),
    "symbols": ("n_symbols", "n_words", 6.0, 0.15),
    "dup_lines": ("n_dup_lines", "n_lines", 6.0, 0.30),
    "repeats": ("n_repeat_words", "n_words", 6.0, 0.35),
}
MIN_WORDS, MOST_REPEATS = 50, 0.5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source) and the counts of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    df = df.select(
        "id", "lang", "source",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "id", "lang", "source", "word_chars", "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    m = F.greatest(F.size("words") - 2, F.lit(0))
    triples = F.arrays_zip(F.slice("words", F.lit(1), m).alias("a"), F.slice("words", F.lit(2), m).alias("b"), F.slice("words", F.lit(3), m).alias("c"))
    df = df.withColumn("windows", F.transform(F.when(m > 0, triples), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))).drop("words")
    # windows that are equal stand side by side once sorted; only texts that have any are sorted
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    n = F.size("placed") - 1
    twins = F.zip_with(F.slice("placed", F.lit(1), n), F.slice("placed", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("starts", F.when(F.col("placed").isNotNull(), F.array_distinct(F.flatten(F.array_compact(twins))))).drop("placed")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("starts")


def _bucket(x: Column, accuracy: float) -> Column:
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    return F.when(x <= 0, F.lit(-100_000)).otherwise(F.ceil(F.log(x) / F.lit(gamma)).cast("int"))


def _value(bucket: Column, accuracy: float) -> Column:
    gamma = (1 + accuracy) / (1 - accuracy)
    return F.when(bucket == -100_000, 0.0).otherwise(F.lit(2 / (gamma + 1)) * F.pow(F.lit(gamma), bucket.cast("double")))


def sketch(values: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """(by..., rule, bucket, n) of rows (by..., rule, value): the mergeable sketch."""
    return values.groupBy(*by, "rule", _bucket(F.col("value"), accuracy).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """(by..., rule, total) and a column for each share: the first bucket that holds ceil(share * total) values."""
    group = Window.partitionBy(*by, "rule")
    run = sketches.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    picks = [_value(F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("total")), F.col("bucket"))), accuracy).alias(name) for name, s in shares.items()]
    return run.groupBy(*by, "rule").agg(F.max("total").alias("total"), *picks)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", accuracy: float = ACCURACY, least: int = LEAST) -> DataFrame:
    """The measures of each row of `docs`, base_failed, a boolean for each adaptive rule that it breaks, and kept."""
    measured = materialize(measures(docs, id_col, text_col, lang_col, source_col))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATS) * F.col("n_words"))
    measured = measured.withColumn("base_failed", base)
    ratio = {rule: F.col(a) / F.when(F.col(b) > 0, F.col(b)) for rule, (a, b, _, _) in RULES.items()}
    values = measured.where("not base_failed").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), r.alias("value")) for rule, r in ratio.items()))).alias("x"))
    own = sketch(values.select("lang", "source", "x.rule", "x.value"), ["lang", "source"], accuracy)
    shares = {"mid": 0.5, "high": 0.75}
    by_source = quantiles(own, ["lang", "source"], shares, accuracy)
    by_lang = quantiles(merge(own, ["lang"]), ["lang"], shares, accuracy)
    overall = quantiles(merge(own, []), [], shares, accuracy)
    fences = by_source.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.rule") == F.col("l.rule"))).join(overall.alias("o"), F.col("s.rule") == F.col("o.rule"))

    def of(name: str) -> Column:
        return F.when(F.col("s.total") >= least, F.col(f"s.{name}")).when(F.col("l.total") >= least, F.col(f"l.{name}")).otherwise(F.col(f"o.{name}"))

    fences = fences.select(F.col("s.lang").alias("g_lang"), F.col("s.source").alias("g_source"), F.col("s.rule").alias("rule"), of("mid").alias("mid"), of("high").alias("high"))
    limit = [F.max(F.when(F.col("rule") == rule, F.greatest(F.col("high") + reach * (F.col("high") - F.col("mid")), F.col("mid") + slack))).alias(f"max_{rule}") for rule, (_, _, reach, slack) in RULES.items()]
    fences = fences.groupBy("g_lang", "g_source").agg(*limit)
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    out = measured.join(fences, same, "left")
    breaks = {f"breaks_{rule}": F.coalesce(r > F.col(f"max_{rule}"), F.lit(False)) for rule, r in ratio.items()}
    out = out.withColumns(breaks)
    kept = ~F.col("base_failed")
    for name in breaks:
        kept &= ~F.col(name)
    return out.withColumn("kept", kept).drop("g_lang", "g_source")
