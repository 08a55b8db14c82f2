"""Classification, probability and calibration metrics as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import ratio

K = 3


def confusion(df: DataFrame, y: str = "y", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """One row a true class (all K, per key) with counts pred_0 .. pred_2; others are ignored."""
    keys = keys or []
    long = df.where(F.col(y).between(0, K - 1) & F.col(pred).between(0, K - 1)).groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))
    wide = long.groupBy(*keys, y).agg(*[F.coalesce(F.sum(F.when(F.col(pred) == k, F.col("n"))), F.lit(0)).alias(f"pred_{k}") for k in range(K)])
    every = (long.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")).withColumn(y, F.explode(F.array(*[F.lit(k) for k in range(K)])))
    return every.join(wide, [*keys, y], "left").fillna(0, [f"pred_{k}" for k in range(K)])


def class_report(cm: DataFrame, y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, support per class; 0 where undefined; rounded to 4 places."""
    keys = keys or []
    total = cm.groupBy(*keys).agg(*[F.sum(f"pred_{k}").alias(f"t{k}") for k in range(K)])
    own = F.get(F.array(*[F.col(f"pred_{k}") for k in range(K)]), F.col(y))
    said = F.get(F.array(*[F.col(f"t{k}") for k in range(K)]), F.col(y))
    support = F.col("pred_0") + F.col("pred_1") + F.col("pred_2")
    joined = cm.join(F.broadcast(total), keys) if keys else cm.join(F.broadcast(total))  # one row a key
    out = joined.withColumns({"precision": F.coalesce(ratio(own, said), F.lit(0.0)), "recall": F.coalesce(ratio(own, support), F.lit(0.0)), "support": support})
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)))
    return out.select(*keys, y, *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support", own.alias("hits"))


def summary(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1 of rounded class values."""
    n = F.sum("support")
    return report.groupBy(*(keys or [])).agg(
        ratio(F.sum("hits"), n).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"), n.alias("rows"),
    )


def true_probability(y: Column, probs: list[Column]) -> Column:
    return F.get(F.array(*probs), y)


def nll(y: Column, probs: list[Column], eps: float = 1e-15) -> Column:
    return -F.avg(F.log(F.greatest(true_probability(y, probs), F.lit(eps))))


def brier(y: Column, probs: list[Column]) -> Column:
    parts = [F.pow(p - F.when(y == k, 1.0).otherwise(0.0), F.lit(2.0)) for k, p in enumerate(probs)]
    return F.avg(parts[0] + parts[1] + parts[2])


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """All ``bins`` equal bins [lo, hi), the last closed, with counts, accuracy, confidence."""
    edges = [k * (1.0 / bins) for k in range(bins)]
    at = sum([F.when(F.col(confidence) >= e, 1).otherwise(0) for e in edges[1:]], F.lit(0))
    own = df.where(F.col(confidence).between(0.0, 1.0)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"lo": F.col("bin") * F.lit(1.0 / bins), "accuracy": F.coalesce("accuracy", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0))})


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"), F.sum("n").alias("rows"))


def coverage(df: DataFrame, confidence: str, correct: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold: rows at or above it, their share and accuracy; one pass."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    long = df.select(F.col(confidence).alias("c"), correct.cast("int").alias("ok"), t)
    hit = F.col("c") >= F.col("threshold")
    return long.groupBy("threshold").agg(F.count_if(hit).alias("covered"), F.avg(hit.cast("int")).alias("coverage"), F.avg(F.when(hit, F.col("ok"))).alias("accuracy"))


def temperature_grid(df: DataFrame, y: str, logits: list[str], temperatures: list[float]) -> DataFrame:
    """Negative log-likelihood at each temperature; rows are read once, in logit form."""
    t = F.explode(F.array(*[F.lit(x) for x in temperatures])).alias("temperature")
    long = df.select(y, *logits, t)
    z = [F.col(c) / F.col("temperature") for c in logits]
    top = F.greatest(*z)
    lse = top + F.log(sum([F.exp(x - top) for x in z[1:]], F.exp(z[0] - top)))
    return long.groupBy("temperature").agg(F.avg(lse - F.get(F.array(*z), F.col(y))).alias("nll"))


def fit_temperature(df: DataFrame, y: str, logits: list[str], low: float = 0.05, high: float = 10.0, tolerance: float = 1e-6, each: int = 9) -> float:
    """The temperature of least NLL: each pass evaluates ``each`` inner points of the bracket.

    NLL is convex in 1 / T, so the bracket around the best point holds the minimum. A
    minimum at a bound raises an error.
    """
    a, b = low, high
    while b - a > tolerance:
        points = [a + (b - a) * k / (each + 1) for k in range(each + 2)]
        got = {r.temperature: r.nll for r in temperature_grid(df, y, logits, points).collect()}
        best = min(range(len(points)), key=lambda k: got[points[k]])
        a, b = points[max(0, best - 1)], points[min(len(points) - 1, best + 1)]
    if a <= low + tolerance or b >= high - tolerance:
        raise ValueError("the best temperature lies at a bound")
    return (a + b) / 2
