"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversations, embeddings, langid, licenses, mixing, negatives, packing, quality, simhash, sql, substrings, toxicity, weaklabels
from tidemark.llm.common import table


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return classes.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def _held_out(folds: int, fold: int):
    """Whether a row is held out; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(~_held_out(3, 1)))
    out = langid.predict(docs, profiles)
    return out.withColumnRenamed("id", "doc_id").select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~_held_out(5, 0)))
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = weaklabels.label_and_score(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("pattern").alias("votes"), "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Shares of all tokens that op9 mixes to.
MIX = {"clean": 0.80, "low": 0.15, "toxic": 0.05}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_of_labels(table(spark, sf_dir, "labels"))
    rates, domains = mixing.mix(table(spark, sf_dir, "documents"), labelled, weights=MIX)
    shares = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    return rates.select(F.col("kept").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"), *shares, "rate")


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

def _op7_sql() -> str:
    gamma = math.log((1 + quality.ACCURACY) / (1 - quality.ACCURACY))
    base = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    word = r"[^\x20\x09-\x0D]"
    ratios = " union all ".join(f"select doc_id, lang, source, '{r}' as rule, {a}::double / {b} as value from m where not base_failed and {b} > 0" for r, (a, b, _, _) in quality.RULES.items())
    limits = " ".join(f"when '{r}' then greatest(high + {reach} * (high - mid), mid + {slack})" for r, (_, _, reach, slack) in quality.RULES.items())

    def level(name: str, by: str) -> str:
        keys = by + ", " if by else ""
        return f"""
        {name}_run as (select {keys}rule, bucket, sum(n) over (partition by {keys}rule) as total, sum(n) over (partition by {keys}rule order by bucket) as upto
            from (select {keys}rule, bucket, count(*) as n from bucketed group by all)),
        {name} as (select {keys}rule, max(total) as total, min(bucket) filter (where upto >= ceil(0.5 * total)) as mid, min(bucket) filter (where upto >= ceil(0.75 * total)) as high
            from {name}_run group by all)"""

    value = lambda b: f"case when {b} = -100000 then 0.0 else {2 / (base + 1)!r}::double * pow({base!r}::double, {b}) end"
    pick = lambda c: f"case when s.total >= {quality.LEAST} then s.{c} when l.total >= {quality.LEAST} then l.{c} else o.{c} end"
    return f"""
    with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}+') as words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from documents),
        tri as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from t, unnest(range(1, len(words) - 1)) as r(i)),
        rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as c from tri) where c > 1),
        cov as (select doc_id, count(distinct p) as n from rep, unnest([i, i + 1, i + 2]) as u(p) group by doc_id),
        c as (select t.doc_id, lang, source, len(words)::bigint as n_words, len(lines)::bigint as n_lines, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
            (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
            coalesce(cov.n, 0)::bigint as n_repeat_words from t left join cov using (doc_id)),
        m as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {int(100 * quality.MOST_REPEATS)} * n_words as base_failed from c),
        v as ({ratios}),
        bucketed as (select *, case when value <= 0 then -100000 else ceil(ln(value) / {gamma!r}::double)::int end as bucket from v),
        {level("s", "lang, source")}, {level("l", "lang")}, {level("o", "")},
        f as (select s.lang, s.source, s.rule, {value(pick("mid"))} as mid, {value(pick("high"))} as high
            from s join l on s.lang is not distinct from l.lang and s.rule = l.rule join o on s.rule = o.rule),
        bad as (select distinct v.doc_id from v join f on v.lang is not distinct from f.lang and v.source is not distinct from f.source and v.rule = f.rule
            where value > case v.rule {limits} end)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from bad) as kept from m
    """


ORACLES: dict[str, str] = {
    "op7_quality_rules": _op7_sql(),
    "op11_conversation_repair": sql.conversation_repair(),
    "op13_hard_negatives": sql.hard_negatives(),
}
