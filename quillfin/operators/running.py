"""Global order without a global sort: row numbers, running sums and maxima by blocks.

A table is first summed up per time (or time block); only those sums, as many as there are
blocks, pass through one ordered window. Rows then add what came before their block.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a span of times (a day, if they are milliseconds).
SPAN = 86_400_000


def per_time(df: DataFrame, time: str) -> DataFrame:
    """(time, rows at it as _n, rows before it as _before): one row a distinct time.

    Times are summed up by spans of ``SPAN`` first; only the spans pass through one ordered
    window, times through one a span.
    """
    per = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n")).withColumn("_span", F.floor(F.col(time) / SPAN))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = per.groupBy("_span").agg(F.sum("_n").alias("_n")).select(F.col("_span").alias("_of"), ahead(Window.orderBy("_span")).alias("_base"))
    own = per.withColumn("_own", ahead(Window.partitionBy("_span").orderBy(time)))
    return own.join(spans, F.col("_span").eqNullSafe(F.col("_of"))).select(time, "_n", (F.col("_base") + F.col("_own")).alias("_before"))


def row_index(df: DataFrame, time: str, ties: list[str], name: str = "row_index", per: DataFrame | None = None) -> DataFrame:
    """0-based position in the order (time, ties). per: per_time(df), if it is there already."""
    before = (per_time(df, time) if per is None else per).select(time, "_before")
    own = Window.partitionBy(time).orderBy(*ties)
    return df.join(before, time).withColumn(name, F.col("_before") + F.row_number().over(own) - 1).drop("_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "n") -> DataFrame:
    """Adds a row's number (from 1) along ``order`` within its keys.

    block must not decrease along ``order``: rows are numbered by block, blocks are counted and
    summed up in order, so one key's rows are no one task.
    """
    rows = df.withColumn("_block", block)
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    base = per.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_block")], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_block")])
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return rows.join(base, on).select(*df.columns, (F.col("_base") + own).cast("long").alias(name))


def running(df: DataFrame, value: Column, order: list[str], block: Column, keys: list[str] | None = None) -> DataFrame:
    """Adds cum (running sum), peak (running maximum of cum) and drawdown = peak - cum.

    block must not decrease along ``order``; ``keys`` separate independent series. The peak
    starts at the first value, not at 0.
    """
    keys = keys or []
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({"_block": block, "_v": value}).withColumn("_cum", F.sum("_v").over(w)).withColumn("_peak", F.max("_cum").over(w))
    ends = local.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"), F.max("_peak").alias("_top"))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0))).withColumn("_high", F.max(F.col("_top") + F.col("_base")).over(ahead))
    out = local.join(carried.select(*keys, "_block", "_base", "_high"), [*keys, "_block"])
    out = out.withColumn("cum", F.col("_cum") + F.col("_base")).withColumn("peak", F.greatest(F.col("_peak") + F.col("_base"), "_high"))
    return out.withColumn("drawdown", F.col("peak") - F.col("cum")).drop("_block", "_v", "_cum", "_peak", "_base", "_high")
