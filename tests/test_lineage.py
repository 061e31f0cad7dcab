"""What is written on the way leaves no shuffles behind."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.operators.components import connected_components


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


@pytest.mark.parametrize("write", [lineage.checkpoint, lineage.materialize, lambda df: lineage.bucketed(df, "k")], ids=["checkpoint", "materialize", "bucketed"])
def test_a_written_table_leaves_no_shuffle_files(spark, write):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name), shuffle_files(spark)
    grouped = spark.range(5000).withColumn("k", F.col("id") % 100).groupBy("k").agg(F.sum("id").alias("s"))
    out = write(grouped.join(spark.range(100).withColumnRenamed("id", "k").repartition(5, "k"), "k"))
    assert not wait_for(lambda: shuffle_files(spark) - before)
    assert spark.conf.get(name) == was
    for _ in range(2):
        assert sorted(map(tuple, out.collect())) == [(k, sum(range(k, 5000, 100))) for k in range(100)]
    assert grouped.count() == 100  # what it was made of can still be run


def test_components_leave_no_shuffle_files(spark):
    links = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") - F.when(F.col("id") % 20 == 0, 0).otherwise(1)).alias("dst"))
    before = shuffle_files(spark)
    found = connected_components(links)
    assert not wait_for(lambda: shuffle_files(spark) - before)
    assert sorted(map(tuple, found.collect())) == [(k, k // 20 * 20) for k in range(60)]


def wait_for(left, seconds=10):
    """What is left when it has become nothing, or after some seconds: files are deleted in the background."""
    import time

    end = time.time() + seconds
    while (found := left()) and time.time() < end:
        time.sleep(0.1)
    return found
