"""Landing, manifests, logs, snapshots and streams on files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import canonical_digest
from tidemark.operators.bars import dedup_latest
from tidemark.operators.joins import null_safe_join
from tidemark.operators.lineage import materialize
from tidemark.sources.tables import LOG


def read_json_strict(spark: SparkSession, path: str, schema: T.StructType, quarantine: bool = False) -> DataFrame:
    """JSON lines with a declared schema; a malformed line is an error, or with `quarantine` a row with `_corrupt_record`. Nothing is skipped."""
    if not quarantine:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """Append rows of the log schema as JSON lines."""
    df.select(*LOG.fieldNames()).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Partitions of a batch that are named in the read of what has landed; more are read without pruning.
MOST_PARTITIONS = 1000


def _landed(df: DataFrame, path: str, partition: list[str]) -> DataFrame:
    """What has landed in the partitions that `df` has rows in: they are named in the filter, so no other is read."""
    landed = df.sparkSession.read.schema(df.schema).parquet(path)
    own = df.select(*partition).distinct().limit(MOST_PARTITIONS + 1).collect() if partition else []
    if not 0 < len(own) <= MOST_PARTITIONS:
        return landed
    kinds = {c: df.schema[c].dataType for c in partition}
    one = lambda row: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.lit(row[c]).cast(kinds[c])) for c in partition))
    return landed.where(reduce(lambda x, y: x | y, map(one, own)))


def land_raw(df: DataFrame, path: str, key: list[str], partition: list[str], quarantine: str | None = None) -> None:
    """C4: append the rows whose key has not landed in the batch's partitions; landing again writes nothing, and what has landed is never touched. Null keys are keys.

    Rows are raw, so none is chosen over another: if rows of one key differ, in the batch or
    from what has landed, they are an error, or go to `quarantine` (again not twice) and the
    rest lands.
    """
    row = canonical_digest(df.columns, df.schema).alias("_row")  # tells rows apart, whatever types they hold
    batch = df.select("*", row).dropDuplicates(["_row"])
    held = df.select(*key).limit(0)
    if path_exists(df.sparkSession, path):
        landed = _landed(df, path, partition).select(*dict.fromkeys(key), row)
        batch, held = batch.join(landed.select("_row"), "_row", "left_anti"), landed.select(*key).distinct()
    told = materialize(batch)
    counts = told.groupBy(*key).agg(F.count("*").alias("_rows"))
    odd = materialize(null_safe_join(counts, held.withColumn("_landed", F.lit(True)), key, "left").where("_rows > 1 or _landed").select(*key))
    if quarantine is None and not odd.isEmpty():
        raise ValueError(f"rows of one key differ: {odd.limit(3).collect()}")
    if quarantine is not None:
        bad = null_safe_join(told, odd, key, "left_semi")
        if path_exists(df.sparkSession, quarantine):
            bad = bad.join(df.sparkSession.read.schema(df.schema).parquet(quarantine).select(row), "_row", "left_anti")
        bad.drop("_row").write.mode("append").parquet(quarantine)
    null_safe_join(told, odd, key, "left_anti").drop("_row").write.mode("append").partitionBy(*partition).parquet(path)


def build_manifest(df: DataFrame, part: list[str | Column], key: str, ts: str) -> DataFrame:
    """For each partition its rows, distinct keys, first and last time, and a digest of its keys that is free of order.

    The digest is of sorted block digests (keys dealt by hash to 256 blocks), so no task holds a whole partition's keys.
    """
    block = F.pmod(F.xxhash64(key), F.lit(256)).alias("_block")
    blocks = df.groupBy(*part, block).agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("k"), F.min(ts).alias("a"), F.max(ts).alias("b"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256).alias("d"),
    )
    names = [c for c in blocks.columns if c not in ("_block", "n", "k", "a", "b", "d")]
    return blocks.groupBy(*names).agg(F.sum("n").alias("n_rows"), F.sum("k").alias("n_keys"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("digest"))


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: list[str], value: str = "digest") -> DataFrame:
    """Match, mismatch, missing or extra for each entry."""
    a = manifest.select(*key, F.col(value).alias("_m"), F.lit(1).alias("_a"))
    b = actual.select(*key, F.col(value).alias("_v"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_m").eqNullSafe(F.col("_v")), "match").otherwise("mismatch")
    return null_safe_join(a, b, key, "full_outer").select(*key, state.alias("state"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def snapshot_id(cols: list[str], schema: T.StructType) -> Column:
    """`ev-` and 16 hex digits of the content's digest: the same content has the same id, in whatever order its maps stand."""
    return F.concat(F.lit("ev-"), F.substring(canonical_digest(cols, schema), 1, 16))


def store_snapshot(df: DataFrame, path: str, cols: list[str]) -> None:
    """Append the snapshots whose id is not stored yet, one for each id."""
    named = df.withColumn("snapshot_id", snapshot_id(cols, df.schema)).dropDuplicates(["snapshot_id"])
    if path_exists(df.sparkSession, path):
        named = named.join(df.sparkSession.read.schema(named.schema).parquet(path).select("snapshot_id"), "snapshot_id", "left_anti").select(named.columns)
    materialize(named).write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that arrive in a folder as a stream; another source is another format."""
    return spark.readStream.schema(schema).parquet(path)


def journal(stream: DataFrame, path: str, checkpoint: str):
    """Every batch into its own partition, overwritten when replayed, until the input is used up. Returns the finished query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def union_sources(sources: list[tuple[str, DataFrame]], key: list[str], tie: list[str]) -> DataFrame:
    """One row per key from several sources, the first named winning, with the name of its source."""
    out = None
    for rank, (name, df) in enumerate(sources):
        df = df.withColumns({"source": F.lit(name), "_rank": F.lit(rank)})
        out = df if out is None else out.unionByName(df)
    return dedup_latest(out, key, [F.col("_rank"), *map(F.col, tie)]).drop("_rank")
