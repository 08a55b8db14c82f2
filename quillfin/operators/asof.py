"""As-of joins, forward range matches and interval counts on streams.

Both sides are put into one frame and resolved by window functions, so a join costs one
exchange on the stream's keys. Before that, events are reduced to the only one per stream
and grid cell that can match, by a partial aggregation that runs before the exchange: a
stream's rows are then bounded by its length in time, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import grid_ceil, grid_floor
from ..model import QUOTE, Clock, stream_keys


def last_per_cell(events: DataFrame, step: int) -> DataFrame:
    """Of each stream and cell (k * step - step, k * step] the last event by (ts, sequence)."""
    keys = stream_keys(events.columns)
    rest = [c for c in events.columns if c not in (*keys, "timestamp_ms", "sequence_id")]
    best = F.max(F.struct("timestamp_ms", "sequence_id", *rest)).alias("e")
    return events.groupBy(*keys, grid_ceil("timestamp_ms", step).alias("cell")).agg(best).select(*keys, "cell", "e.*")


def first_per_cell(events: DataFrame, step: int) -> DataFrame:
    """Of each stream and cell [k * step, k * step + step) the first event by (ts, sequence)."""
    keys = stream_keys(events.columns)
    rest = [c for c in events.columns if c not in (*keys, "timestamp_ms", "sequence_id")]
    best = F.min(F.struct("timestamp_ms", "sequence_id", *rest)).alias("e")
    return events.groupBy(*keys, grid_floor("timestamp_ms", step).alias("cell")).agg(best).select(*keys, "cell", "e.*")


def grid_bounds(events: DataFrame, step: int) -> DataFrame:
    keys = stream_keys(events.columns)
    ends = events.groupBy(*keys).agg(grid_ceil(F.min("timestamp_ms"), step).alias("lo"), grid_floor(F.max("timestamp_ms"), step).alias("hi"))
    return ends.where("lo <= hi")


def asof_grid(events: DataFrame, clock: Clock) -> DataFrame:
    """One row per stream and grid time inside the stream's own span, with the last event at
    or before it (equal times: the highest sequence), its age and whether it is stale."""
    keys = stream_keys(events.columns)
    quotes = last_per_cell(events.select(*keys, "timestamp_ms", "sequence_id", *QUOTE), clock.step)
    # the last event of a cell is known at the cell's end, so cells join the grid by equality
    grid = grid_bounds(events, clock.step).select(*keys, F.explode(F.sequence("lo", "hi", F.lit(clock.step))).alias("cell"))
    both = grid.join(quotes, [*keys, "cell"], "left")
    known = F.when(F.col("timestamp_ms").isNotNull(), F.struct("timestamp_ms", "sequence_id", *QUOTE))
    w = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("e", F.last(known, ignorenulls=True).over(w))
    age = F.col("cell") - F.col("e.timestamp_ms")
    return out.select(
        F.col("cell").alias("grid_timestamp_ms"),
        F.col("e.timestamp_ms").alias("source_timestamp_ms"),
        F.col("e.sequence_id").alias("source_sequence_id"),
        *keys,
        *[F.col(f"e.{c}").alias(c) for c in QUOTE],
        age.alias("event_age_ms"),
        (age > clock.stale).alias("is_stale"),
    )


def forward_match(rows: DataFrame, targets: DataFrame, time: str, low: int, high: int | None, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``target`` = struct(timestamp_ms, sequence_id, *columns) of the first
    target in [time + low, time + high] (equal times: the lowest sequence), null if none.
    ``high`` None: however late.

    One running window, from late to early: the last target met is the first one in time,
    so a stream costs a sort and one pass, whatever the width of the range.
    """
    keys = keys or stream_keys(rows.columns)
    names = rows.columns
    left = rows.select(*keys, (F.col(time) + low).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_o"), F.struct(*names).alias("_row"), F.lit(None).cast(_struct_type(targets, columns)).alias("_target"))
    right = targets.select(
        *keys, F.col("timestamp_ms").alias("_t"), F.lit(0).alias("_k"), F.col("sequence_id").cast("long").alias("_o"),
        F.lit(None).cast(rows.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_row"), F.struct("timestamp_ms", "sequence_id", *columns).alias("_target"),
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_k", F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("target", F.last("_target", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    if high is not None:
        found = found.withColumn("target", F.when(F.col("target.timestamp_ms") <= F.col("_t") - low + high, F.col("target")))
    return found.select("_row.*", "target")


def _struct_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct("timestamp_ms", "sequence_id", *columns).alias("s")).schema["s"].dataType


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str, columns: list[str], tolerance: int | None = None) -> DataFrame:
    """``left`` with ``match`` = struct(right_time, order, *columns) of the last right row at
    or before (equal times: the highest ``order``); null if none or older than tolerance."""
    names = left.columns
    kind = right.select(F.struct(F.col(right_time), F.col(order), *columns).alias("s")).schema["s"].dataType
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_o"), F.struct(*names).alias("_row"), F.lit(None).cast(kind).alias("_m"))
    b = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.col(order).cast("long").alias("_o"), F.lit(None).cast(left.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_row"),
        F.struct(F.col(right_time), F.col(order), *columns).alias("_m"),
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_k", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("match", F.last("_m", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    match: Column = F.col("match")
    if tolerance is not None:
        match = F.when(F.col("_t") - F.col(f"match.{right_time}") <= tolerance, match)
    return out.select("_row.*", match.alias("match"))


def interval_counts(grid: DataFrame, events: DataFrame, step: int) -> DataFrame:
    """``grid`` with source_events_in_interval: events in (T - step, T]; counted by cell."""
    keys = stream_keys(events.columns)
    cells = events.groupBy(*keys, grid_ceil("timestamp_ms", step).alias("grid_timestamp_ms")).agg(F.count(F.lit(1)).alias("source_events_in_interval"))
    return grid.join(cells, [*keys, "grid_timestamp_ms"], "left").withColumn("source_events_in_interval", F.coalesce("source_events_in_interval", F.lit(0)))
