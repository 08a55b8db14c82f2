"""Canonical quotes: from the driver's events, from Parquet, and clean-up at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """Deterministic two-sided quotes out of an event table (ten streams)."""
    cents = F.round(F.col("value") * 100).cast("long") % 90
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").alias("sequence_id"),
        F.floor(ts / 1000).cast("long").alias("timestamp_ms"),
        F.col("event_type").alias("market_id"),
        F.when(F.col("user_id") % 2 == 0, "UP").otherwise("DOWN").alias("asset_id"),
        ((cents + 1) / F.lit(100.0)).alias("bid"),
        ((cents + 2 + F.col("event_id") % 5) / F.lit(100.0)).alias("ask"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("bid_size"),
        (F.col("event_id") % 50 + 1).cast("double").alias("ask_size"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same in SQL (DuckDB), for the oracles.
QUOTES_SQL = """
q AS (
  SELECT event_id AS sequence_id, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS market_id,
         CASE WHEN user_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS asset_id,
         (CAST(round(value * 100) AS BIGINT) % 90 + 1) / 100.0::DOUBLE AS bid,
         (CAST(round(value * 100) AS BIGINT) % 90 + 2 + event_id % 5) / 100.0::DOUBLE AS ask,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS bid_size,
         CAST(event_id % 50 + 1 AS DOUBLE) AS ask_size
  FROM events
)"""
