"""Scalers fitted on training rows only; parameters are one row a feature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def fit(df: DataFrame, columns: list[str], kind: str = "standard", weight: str | None = None, split: str = "train") -> DataFrame:
    """feature, center, scale, zero_variance from one long pass; a scale below EPS becomes 1.

    kind: standard (mean, population deviation), robust (median, interquartile range by
    linear interpolation), minmax. weight counts a row more than once.
    """
    if split.strip().lower() != "train":
        raise ValueError("a scaler is fitted on training rows only")
    long = df.unpivot([weight] if weight else [F.lit(1).alias("weight")], columns, "feature", "value") if weight else df.select(F.lit(1).alias("weight"), *columns).unpivot(["weight"], columns, "feature", "value")
    w = F.col(weight or "weight")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (w > 0))
    x, g = F.col("value"), long.groupBy("feature")
    if kind == "standard":
        # deviations from a value of the column keep the squares small
        base = g.agg(F.min("value").alias("base"))
        shifted = long.join(F.broadcast(base), "feature").withColumn("d", x - F.col("base"))
        sums = shifted.groupBy("feature", "base").agg(F.sum(w).alias("n"), F.sum(F.col("d") * w).alias("s1"), F.sum(F.col("d") * F.col("d") * w).alias("s2"))
        mean = F.col("s1") / F.col("n")
        out = sums.select("feature", (F.col("base") + mean).alias("center"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))).alias("raw"))
    elif kind == "robust":
        found = quantiles(long, [0.25, 0.5, 0.75], weight=weight or "weight")
        rows = [(f, m, high - low) for f, (low, m, high) in found.items()]  # a row a feature
        out = df.sparkSession.createDataFrame(rows, "feature string, center double, raw double")
    elif kind == "minmax":
        out = g.agg(F.min(x).alias("center"), (F.max(x) - F.min(x)).alias("raw"))
    else:
        raise ValueError(kind)
    return out.select("feature", "center", F.when(F.col("raw") < EPS, 1.0).otherwise(F.col("raw")).alias("scale"), (F.col("raw") < EPS).alias("zero_variance"))


def quantiles(long: DataFrame, wanted: list[float], *, weight: str = "weight", bins: int = 1024, few: int = 10_000) -> dict[str, list[float]]:
    """Exact quantiles of ``value`` by ``feature`` (linear interpolation between neighbours),
    each row counting ``weight`` times (a whole number).

    Selection by rounds of histograms: the values between two bounds fall into ``bins`` bins of
    equal width on a logarithmic scale, and each rank sought goes on in its bin, whose least and
    greatest value are the next bounds. A bin of at most ``few`` rows is sorted. The driver
    sees bins and at most ``few`` values a rank, tasks only partial sums; five rounds tell
    any doubles apart. ``long`` is kept for the rounds in memory or on executors' disks.
    """
    value = F.col("value").cast("double")
    # grows with the value; what it rounds together the last sort takes apart
    rows = long.select("feature", value.alias("v"), F.col(weight).cast("long").alias("w"), (F.signum(value) * F.log1p(F.least(F.abs(value), F.lit(1e290)) * 1e12)).alias("t")).persist()
    spark = long.sparkSession
    try:
        total = {r.feature: r for r in rows.groupBy("feature").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("c"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
        at: dict[tuple[str, int], tuple] = {}  # (feature, rank) -> least t, greatest t, rows, weight below
        for f, r in total.items():
            for q in wanted:
                p = q * (r.n - 1)
                for rank in (math.floor(p), math.ceil(p)):
                    at[f, rank] = (r.lo, r.hi, r.c, 0)
        inside = lambda spans: rows.join(F.broadcast(spark.createDataFrame(sorted(spans), "feature string, lo double, hi double")), "feature").where(F.col("t").between(F.col("lo"), F.col("hi")))  # noqa: E731  a few rows a feature
        while wide := {(f, lo, hi) for (f, _), (lo, hi, c, _) in at.items() if c > few and lo < hi}:
            nth = F.least(F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
            sums = inside(wide).groupBy("feature", "lo", "hi", nth.alias("bin")).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("c"), F.min("t").alias("least"), F.max("t").alias("most"))
            found: dict[tuple, list] = {}
            for r in sorted(sums.collect(), key=lambda r: r.bin):
                found.setdefault((r.feature, r.lo, r.hi), []).append(r)
            for (f, rank), (lo, hi, _, below) in at.items():
                for r in found.get((f, lo, hi), []) if (f, lo, hi) in wide else []:
                    if rank < below + r.n:
                        at[f, rank] = (r.least, r.most, r.c, below)
                        break
                    below += r.n
        values: dict[tuple, list] = {}
        if at:
            for r in inside({(f, lo, hi) for (f, _), (lo, hi, _, _) in at.items()}).groupBy("feature", "lo", "hi", "v").agg(F.sum("w").alias("n")).collect():
                values.setdefault((r.feature, r.lo, r.hi), []).append((r.v, r.n))
        picked = {}
        for (f, rank), (lo, hi, _, below) in at.items():
            for v, n in sorted(values[f, lo, hi]):
                below += n
                if rank < below:
                    picked[f, rank] = v
                    break
        out = {}
        for f, r in total.items():
            out[f] = []
            for q in wanted:
                p = q * (r.n - 1)
                low, high = picked[f, math.floor(p)], picked[f, math.ceil(p)]
                out[f].append(low + (high - low) * (p - math.floor(p)))
        return out
    finally:
        rows.unpersist()


def fit_sample(df: DataFrame, columns: list[str]) -> DataFrame:
    """The older scaler: mean and sample deviation, 1 where that is 0 or unknown."""
    long = df.select(*columns).unpivot([], columns, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("center"), F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def parameters(fitted: DataFrame, columns: list[str]) -> tuple[list[float], list[float]]:
    """Centers and scales in the order of ``columns`` (one row a feature is collected)."""
    got = {r.feature: r for r in fitted.collect()}
    return [got[c].center if c in got else 0.0 for c in columns], [got[c].scale if c in got else 1.0 for c in columns]


def transform(df: DataFrame, fitted: DataFrame, columns: list[str], clip: float | None = None, impute: bool = False) -> DataFrame:
    centers, scales = parameters(fitted, columns)
    out = {}
    for c, m, s in zip(columns, centers, scales):
        v = (F.col(c) - m) / s
        v = F.least(F.greatest(v, F.lit(-clip)), F.lit(clip)) if clip is not None else v
        out[c] = F.coalesce(v, F.lit(0.0)) if impute else v
    return df.withColumns(out)
