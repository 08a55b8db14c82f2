"""Fixed-length windows of rows as nested arrays, their ids, masks and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FEATURES, stream_keys
from .running import row_index


def build(df: DataFrame, length: int = 10, time: str = "grid_timestamp_ms", columns: list[str] | None = None, keys: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Every full window of ``length`` rows per stream (and split, if there is one)."""
    columns = columns or FEATURES
    keys = keys or [*stream_keys(df.columns), *(["split"] if "split" in df.columns else [])]
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(length - 1), 0)
    label = ["label"] if "label" in df.columns else []
    out = df.select(*keys, F.col(time).alias("endpoint_timestamp_ms"), F.min(time).over(w).alias("start_timestamp_ms"), F.collect_list(F.array(*columns)).over(w).alias("feature_matrix"), *label)
    out = out.where(F.size("feature_matrix") == length).withColumn("sequence_length", F.lit(length))
    out = out.withColumnRenamed("label", "target") if label else out
    return row_index(out, "endpoint_timestamp_ms", keys, "sequence_id") if ids else out


def multiplicity(df: DataFrame, length: int, time: str, keys: list[str]) -> DataFrame:
    """Adds weight: in how many windows of ``length`` rows a row stands.

    Statistics over all cells of all windows then need no windows: each row counts by its
    weight.
    """
    up = Window.partitionBy(*keys).orderBy(time)
    i, n = F.row_number().over(up), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("weight", F.greatest(F.lit(0), F.least(i, F.lit(length), n - length + 1, n - i + 1)))


def last_step(matrix: Column | str, column: int) -> Column:
    return F.element_at(F.element_at(matrix, -1), column + 1)


def masks(matrix: str = "feature_matrix") -> dict[str, Column]:
    """warmup_mask (cell is null), step_valid (no cell of the step is null), key_padding."""
    warm = F.transform(matrix, lambda step: F.transform(step, lambda x: x.isNull()))
    valid = F.transform(matrix, lambda step: F.forall(step, lambda x: x.isNotNull()))
    return {"warmup_mask": warm, "step_valid": valid, "key_padding": F.transform(valid, lambda v: ~v)}


def causal_mask(length: int) -> Column:
    """length x length: true where a step may not look ahead."""
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    return F.transform(steps, lambda i: F.transform(steps, lambda j: j > i))


def scaled(matrix: str, centers: list[float], scales: list[float], clip: float | None = None) -> Column:
    """(x - center) / scale in every cell, clipped, nulls as 0."""
    c, s = F.array(*[F.lit(float(x)) for x in centers]), F.array(*[F.lit(float(x)) for x in scales])

    def cell(x, j):
        v = (x - F.get(c, j)) / F.get(s, j)
        v = F.least(F.greatest(v, F.lit(-clip)), F.lit(clip)) if clip is not None else v
        return F.coalesce(v, F.lit(0.0))

    return F.transform(matrix, lambda step: F.transform(step, cell))
