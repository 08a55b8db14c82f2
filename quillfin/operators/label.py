"""Labels: physical-horizon moves, row shifts and candle closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import mid, move_label, move_threshold, spread
from ..model import FORBIDDEN_PREFIXES, QUOTE, Clock, stream_keys
from .asof import first_per_cell, forward_match


def physical_horizon(grid: DataFrame, events: DataFrame | None, clock: Clock) -> DataFrame:
    """Fresh grid rows with the first quote in [T + low, T + high] and the move's label.

    events: the target pool; None takes the fresh grid rows themselves. Rows without a
    target are dropped. Holds both clean and audit columns; see clean() and audit().
    """
    fresh = grid.where(~F.col("is_stale"))
    if events is None:
        pool = fresh.select(*stream_keys(grid.columns), F.col("grid_timestamp_ms").alias("timestamp_ms"), F.col("source_sequence_id").alias("sequence_id"), *QUOTE)
    elif clock.low % clock.step == 0:
        # T + low is a cell's start, so only a cell's first event can be the first match
        pool = first_per_cell(events.select(*stream_keys(events.columns), "timestamp_ms", "sequence_id", *QUOTE), clock.step)
    else:
        pool = events
    found = forward_match(fresh, pool, "grid_timestamp_ms", clock.low, clock.high, QUOTE).where(F.col("target").isNotNull())
    t_mid = mid(F.col("target.bid"), F.col("target.ask"))
    out = found.withColumns({"current_mid": mid(), "target_mid": t_mid, "threshold": move_threshold(spread(), clock.least_move)})
    out = out.withColumn("delta", F.col("target_mid") - F.col("current_mid"))
    return out.withColumn("label", move_label(F.col("delta"), F.col("threshold")))


def clean(labeled: DataFrame) -> DataFrame:
    """Grid columns and the label: nothing that knows the future."""
    keep = [c for c in labeled.columns if c not in ("target", "current_mid", "target_mid", "threshold", "delta", "label")]
    return drop_future(labeled.select(*keep, "label"))


def audit(labeled: DataFrame) -> DataFrame:
    keys = stream_keys(labeled.columns)
    return labeled.select(
        F.col("grid_timestamp_ms").alias("current_timestamp"),
        F.col("target.timestamp_ms").alias("target_timestamp"),
        (F.col("target.timestamp_ms") - F.col("grid_timestamp_ms")).alias("physical_horizon_ms"),
        "current_mid", "target_mid", "delta", "threshold", "label", *keys,
        F.col("source_sequence_id").alias("current_sequence_id"),
        F.col("target.sequence_id").alias("target_sequence_id"),
    )


def drop_future(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(FORBIDDEN_PREFIXES)])


def row_shift(df: DataFrame, value, horizon: int, order: list[str], keys: list[str]) -> DataFrame:
    """Label by the sign of value ``horizon`` rows ahead minus now; the last rows go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = df.withColumn("future_value", F.lead(value, horizon).over(w)).withColumn("now_value", value)
    change = F.col("future_value") - F.col("now_value")
    return ahead.where(F.col("future_value").isNotNull()).withColumn("label", F.when(change > 0, "UP").when(change < 0, "DOWN").otherwise("FLAT"))


def resolution(candles: DataFrame, window: str, time: str) -> DataFrame:
    """UP if the last close of a window is at or above its first open, else DOWN."""
    out = candles.groupBy(window).agg(F.min_by("open", time).alias("first_open"), F.max_by("close", time).alias("last_close"), F.count(F.lit(1)).alias("candles"))
    return out.withColumn("label", F.when(F.col("last_close") >= F.col("first_open"), "UP").otherwise("DOWN"))
