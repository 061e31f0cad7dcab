"""All registered queries outside the text subpackage, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import dedup_latest, find_gaps, resample_bars, trades_to_bars
from tidemark.operators.quality import gate_summary, normalize_trade, overall_status
from tidemark.plans import gate_queries, ledger_queries, market_queries, research_queries, scalar_queries, stream_queries, text_queries  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES  # noqa: F401
from tidemark.sources.tables import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events to canonical trades, one per id, hourly and 4-hour bars, gaps, and a status for each instrument."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
        F.col("value").cast("string").alias("price"), F.regexp_extract("props", "-?[0-9]+", 0).alias("quantity"), (F.col("event_id") % 2 == 1).alias("buyer_is_maker"),
    )
    normal = normalize_trade(raw)
    trades = dedup_latest(normal.where("reject is null or reject = 'quantity'"), ["instrument", "seq"], [F.desc("ts"), F.col("price")])
    bars = trades_to_bars(trades, "1 hour")
    wide = resample_bars(bars, "4 hours", 4).groupBy("instrument").agg(F.count("*").alias("bars_4h"), F.count_if("complete").alias("complete_4h"))
    gaps = find_gaps(bars, "1 hour").groupBy("instrument").agg(F.sum("missing").alias("missing"))
    facts = wide.join(gaps, "instrument", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    gates = facts.select("instrument", F.explode(F.array(
        F.struct(F.lit("continuous").alias("name"), F.when(F.col("missing") == 0, "pass").otherwise("fail").alias("status")),
        F.struct(F.lit("whole_bars").alias("name"), F.when(F.col("complete_4h") == F.col("bars_4h"), "pass").otherwise("unknown").alias("status")),
    )).alias("g")).select("instrument", "g.*")
    summary = gate_summary(gates, ["instrument"])
    status = overall_status(F.col("fail"), F.col("unknown"), F.lit(0), F.lit(False))
    return facts.join(summary, "instrument").select("instrument", "bars_4h", "complete_4h", "missing", "failed_gates", "unknown_gates", status.alias("status"))
