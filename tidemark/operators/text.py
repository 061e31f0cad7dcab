"""Text side-data: duplicates, filters, redaction with counts, labels, sentiment features, token audits; usage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.components import connected_components
from tidemark.operators.joins import asof_join
from tidemark.operators.lineage import checkpoint, materialize
from tidemark.operators.nearsets import near_set_classes


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each normalised text, the smallest id, with the number of copies. Aggregated, so copies never meet in a task."""
    key = F.sha2(S.normalize_title(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return docs.groupBy(key.alias("text_key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(id, set_id, class_id) for each row of `docs`: the smallest id with an equal shingle set, and the smallest id that links at the threshold reach. The members of a class are its rows, so nothing is lost by taking equal sets as one."""
    keyed = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    rows = near_set_classes(keyed, F.col("row"), F.col("text"), threshold, words).join(keyed.select("row", "id"), "row")
    sets = rows.groupBy("set_row", "class_row").agg(F.min("id").alias("set_id"))
    classes = checkpoint(sets.groupBy("class_row").agg(F.min("set_id").alias("class_id")))
    named = sets.join(classes, "class_row").select("set_row", "set_id", "class_id")
    return rows.join(named, "set_row").select(F.col("id").alias(id_col), "set_id", "class_id")


def event_clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster) for the ids of `pairs` (a, b); cluster is the smallest id reached, however long the chain."""
    found = connected_components(pairs, "a", "b")
    return found.select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def filter_docs(docs: DataFrame, langs: list[str], least: int = 50, most: int = 100_000, junk: float = 0.1, text_col: str = "text") -> DataFrame:
    """Documents with the rules that they break: language, length, repeated lines, share of symbols."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    rules = {
        "language": ~F.coalesce(F.col("lang").isin(*langs), F.lit(False)), "length": (F.length(text) < least) | (F.length(text) > most),
        "repetition": F.size(F.array_distinct(lines)) * 2 < F.size(lines), "junk": symbols > junk * F.length(text),
    }
    return docs.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))


def redact_docs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Redacted text and how many secrets and paths were hidden."""
    out = docs.withColumn(text_col, S.redact_text(F.col(text_col)))
    secrets = F.regexp_count(text_col, F.lit(S.REDACTED))
    out = out.withColumn("secret_hits", secrets).withColumn(text_col, S.redact_paths(F.col(text_col)))
    return out.withColumn("path_hits", F.regexp_count(text_col, F.lit(S.PATH_REDACTED)))


def attach_labels(docs: DataFrame, labels: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """E5: labels by key; a document without one keeps nulls, which are unknown and not 0, and says so."""
    marked = labels.select(key, *cols, F.lit(True).alias("_l"))
    return docs.join(marked, key, "left").withColumn("labelled", F.coalesce("_l", F.lit(False))).drop("_l")


def sentiment_features(news: DataFrame, bars: DataFrame, width: str) -> DataFrame:
    """News (instrument, ts, score, cluster): one row for each cluster and window, counted and averaged, joined to bars as known at their time."""
    first = news.groupBy("instrument", "cluster").agg(F.min("ts").alias("ts"), F.avg("score").alias("score"))
    windows = first.groupBy("instrument", F.window("ts", width).alias("w")).agg(F.count("*").alias("n_news"), F.avg("score").alias("sentiment"))
    known = windows.select("instrument", F.col("w.end").alias("known_ts"), "n_news", "sentiment")
    return asof_join(bars, known, ("bar_start", "known_ts"), ["instrument"], ["n_news", "sentiment"])


def token_audit(docs: DataFrame, required: list[str], forbidden: list[str], folded: list[str], mention: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, bytes, digest and mentions of each document, the required tokens that it lacks and the forbidden ones (`folded`: in any case) that it has."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    have = lambda words, text, want: F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)) == want, F.lit(w)) for w in words)))
    lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n")))
    return docs.select(
        id_col, lines.alias("lines"), F.octet_length(t).alias("bytes"), F.sha2(t, 256).alias("sha256"), ((F.length(t) - F.length(F.replace(t, F.lit(mention), F.lit("")))) / len(mention)).cast("int").alias("mentions"),
        have(required, t, F.lit(False)).alias("missing"), have(forbidden, t, F.lit(True)).alias("forbidden"), have(folded, F.lower(t), F.lit(True)).alias("traces"),
    )


def token_audit_totals(audited: DataFrame) -> DataFrame:
    """Over all audited documents their lines, bytes and mentions, how many lack or hold what they should not, and pass or fail."""
    bad = {"without_required": F.size("missing") > 0, "with_forbidden": F.size("forbidden") > 0, "with_traces": F.size("traces") > 0}
    sums = audited.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "bytes", "mentions")), *(F.count_if(c).alias(n) for n, c in bad.items()))
    return sums.withColumn("status", F.when(F.col("without_required") + F.col("with_forbidden") + F.col("with_traces") == 0, "pass").otherwise("fail"))


# --- usage -------------------------------------------------------------------------
def usage_rollup(usage: DataFrame, phase: str = "phase", actor: str = "actor") -> DataFrame:
    """Tokens by phase and actor with subtotals. Cached is part of input and reasoning part of output: neither is added again."""
    out = usage.cube(phase, actor).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cached").alias("cached"), F.sum("reasoning").alias("reasoning"), F.grouping_id().alias("level"))
    total = F.col("input") + F.col("output")
    all_ = F.max(F.when(F.col("level") == 3, total)).over(Window.partitionBy(F.lit(1)))
    return out.withColumns({"total": total, "uncached": F.col("input") - F.col("cached"), "cache_hit": F.try_divide("cached", "input"), "share": F.try_divide(total, all_)})


def compare_arms(df: DataFrame, key: list[str], metrics: list[str], identity: list[str], conditions: list[str], arm: str = "arm") -> DataFrame:
    """A10: before and after of each metric with delta and percentage, and how far the arms compare: STRICT if identity and conditions agree, CONDITIONAL if only conditions differ, else NOT_COMPARABLE. Unknown is not 0."""
    side = lambda c, s: F.max(F.when(F.col(arm) == s, F.col(c)))
    aggs: list[Column] = [side(m, s).alias(f"{m}_{s}") for m in metrics for s in ("before", "after")]
    same = lambda cols: F.array(*(F.coalesce(side(c, "before") == side(c, "after"), F.lit(False)) for c in cols)) if cols else F.array(F.lit(True))
    out = df.groupBy(*key).agg(*aggs, F.forall(same(identity), lambda x: x).alias("_i"), F.forall(same(conditions), lambda x: x).alias("_c"))
    for m in metrics:
        delta = F.col(f"{m}_after") - F.col(f"{m}_before")
        out = out.withColumns({f"{m}_delta": delta, f"{m}_pct": F.try_divide(delta, F.col(f"{m}_before")) * 100})
    return out.withColumn("comparability", F.when(~F.col("_i"), "NOT_COMPARABLE").when(F.col("_c"), "STRICT").otherwise("CONDITIONAL")).drop("_i", "_c")
