"""Scans with declared schemas, and the canonical tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENTS = _schema(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=T.StringType(), value=T.DoubleType(), props=T.StringType())
ORDERS = _schema(o_orderkey=T.LongType(), o_custkey=T.LongType(), o_orderstatus=T.StringType(), o_totalprice=T.DoubleType(), o_orderdate=T.TimestampNTZType(), o_orderpriority=T.StringType())
LOG = _schema(timestamp=T.StringType(), level=T.StringType(), logger=T.StringType(), message=T.StringType(), extra=T.MapType(T.StringType(), T.StringType()))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A scan with a declared schema; nothing is inferred if one is given."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical trades from events: `ts` as a UTC instant."""
    e = read_table(spark, f"{sf_dir}/events.parquet", EVENTS)
    return e.select(
        F.upper("event_type").alias("instrument"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.regexp_extract("props", "-?[0-9]+", 0).cast("bigint").alias("qty"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("user_id").alias("account"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("instrument"), F.col("l_suppkey").alias("venue"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("notional"), F.col("l_discount").alias("rebate_rate"), F.col("l_tax").alias("fee_rate"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("click", "view"), "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "unknown").otherwise("odd")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("name"), status.alias("status"))


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    """Instants as zone-less timestamps, for results that are compared with other engines."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})
