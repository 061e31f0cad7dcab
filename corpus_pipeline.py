"""The corpus pipeline: documents through the text operators, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, simhash, substrings, toxicity
from tidemark.llm.common import checkpoint, materialize, shared_folder, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tokens of each domain that the mix keeps, as a share of what comes in.
MIX = {"clean": 1.0, "low": 0.5, "toxic": 0.25}

def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labelled ones calls toxic go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, that of the smallest id: linked by fingerprints that differ in 3 bits at most, or by a Jaccard similarity of 5-word shingles of 0.8 or more."""
    row = unused(docs, "row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = materialize(simhash.near_copies(keyed, F.col(row)).join(keyed.select(F.col(row).alias("row"), "doc_id"), "row"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    stay = checkpoint(classes.groupBy("class_row").agg(F.min(first)["row"].alias("stays")))
    gone = classes.join(stay, "class_row").where("row <> stays").select(F.col("row").alias(row))
    return keyed.join(gone, row, "left_anti").drop(row)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts."""
    cut = substrings.strip_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay at the rates that bring the domains' tokens nearest to the targets; chance is a hash of the id and the text. Documents that are clean for sure have the rate 1."""
    labelled = mixing.domain_of_labels(table(spark, sf_dir, "labels"))
    rates, _ = mixing.mix(docs, labelled, scale=MIX, max_rate=1.0, kept=F.struct(*docs.columns))
    chance = F.pmod(F.xxhash64("kept.doc_id", F.xxhash64("kept.text"), F.lit(9)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return rates.where(chance < F.col("rate")).select("kept.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: No stage can be stated in SQL as a whole; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return docs
