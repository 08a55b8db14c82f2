"""Cluster-robust statistics, correlations and the block bootstrap."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import ratio
from .running import row_index


def cluster_robust(df: DataFrame, value: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """mean, se, t, clusters, n_eff of a mean whose rows depend on each other in clusters;
    a row for each value of ``by``, if given.

    Two sums a cluster are enough: the score S_c = sum(x) - n_c * mean.
    """
    by = by or []
    per = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    total = per.groupBy(*by).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.sum("ss").alias("all_ss"), F.count(F.lit(1)).alias("all_c"))
    score = F.col("s") - F.col("n") * F.col("all_s") / F.col("all_n")
    both = per.join(total, by) if by else per.join(F.broadcast(total))  # one row
    sums = both.groupBy(*by, "all_s", "all_n", "all_ss", "all_c").agg(F.sum(F.pow(score, F.lit(2.0))).alias("s2"), F.sum(F.pow(score, F.lit(4.0))).alias("s4"))
    mean, n, c = F.col("all_s") / F.col("all_n"), F.col("all_n"), F.col("all_c")
    iid = F.when(n > 1, F.sqrt(F.greatest((F.col("all_ss") - n * mean * mean) / (n - 1), F.lit(0.0)) / n)).otherwise(F.lit(0.0))
    se = F.when(c <= 1, iid).otherwise(F.sqrt(c / F.nullif(c - 1, F.lit(0)) * F.col("s2") / (n * n)))
    n_eff = F.when((c <= 1) | (F.col("s4") <= 1e-12), c.cast("double")).otherwise(F.least(F.col("s2") * F.col("s2") / F.nullif(F.col("s4"), F.lit(0.0)), c.cast("double")))
    out = sums.select(*by, mean.alias("mean"), se.alias("se"), c.alias("clusters"), n_eff.alias("n_eff"), n.alias("rows"))
    return out.withColumn("t", F.when(F.col("se") > 1e-12, F.col("mean") / F.col("se")).otherwise(0.0))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, correlation of every pair of columns, in one aggregate pass."""
    pairs = list(itertools.combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def condition_number(df: DataFrame, columns: list[str]) -> float:
    """Of the correlation matrix (as small as the number of columns)."""
    import numpy as np

    m = np.eye(len(columns))
    at = {c: k for k, c in enumerate(columns)}
    for r in correlations(df, columns).collect():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.correlation if r.correlation is not None else 0.0
    return float(np.linalg.cond(m))


def block_bootstrap(df: DataFrame, value: str, order: list[str], replicates: int = 2000, block: int = 5, seed: int = 42, leaf: int = 4096) -> DataFrame:
    """lo, median, hi of the mean over circular block resamples.

    A replicate draws ceil(n / block) block starts, each as likely. How many fall into a range
    of starts is binomial, so the draws of all replicates are split down a tree of ranges; each
    node's split is seeded by the node, so every leaf of ``leaf`` starts works its own counts
    out from the root, and no draw is a row: a leaf (a group of ``leaf + block - 1`` values)
    returns one array of ``replicates`` sums. Nulls take no part; an empty table gives no row.
    """
    rows = row_index(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), *order), order[0], order[1:] or order, "i")
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "lo double, median double, hi double, replicates long")
    leaf = max(leaf, block)
    draws = -(-n // block)
    # past the end the series starts again; a value is needed by the block - 1 starts before it
    places = F.transform(F.sequence(F.lit(0), F.lit((n + block - 2) // n)), lambda k: F.col("i") + k * n)
    placed = rows.select("_v", F.explode(places).alias("p")).where(F.col("p") < n + block - 1)
    first, last = F.floor(F.greatest(F.col("p") - (block - 1), F.lit(0)) / leaf), F.floor(F.least(F.col("p"), F.lit(n - 1)) / leaf)
    dealt = placed.select("p", "_v", F.explode(F.sequence(first, last)).alias("leaf"))

    def resample(key, group):
        import numpy as np
        import pandas as pd

        at, lo, hi = int(key[0]), 0, -(-n // leaf)
        counts = np.full(replicates, draws)
        ends = lambda k: min(k * leaf, n)
        while hi - lo > 1:
            half = (lo + hi) // 2
            left = np.random.default_rng([seed, lo, hi]).binomial(counts, (ends(half) - ends(lo)) / (ends(hi) - ends(lo)))
            counts, lo, hi = (left, lo, half) if at < half else (counts - left, half, hi)
        size = ends(at + 1) - ends(at)
        before = np.concatenate([[0.0], np.cumsum(group.sort_values("p")["_v"].to_numpy())])
        blocks = before[block : block + size] - before[:size]
        rng = np.random.default_rng([seed, n, lo, hi])
        sums = [float(blocks[rng.integers(0, size, c)].sum()) for c in counts]
        return pd.DataFrame({"sums": [sums]})

    partial = dealt.groupBy("leaf").applyInPandas(resample, "sums array<double>")
    means = partial.select(F.posexplode("sums").alias("replicate", "s")).groupBy("replicate").agg((F.sum("s") / (draws * block)).alias("m"))
    q = F.percentile("m", [0.025, 0.5, 0.975])
    return means.agg(q.alias("q"), F.count(F.lit(1)).alias("replicates")).select(F.get("q", 0).alias("lo"), F.get("q", 1).alias("median"), F.get("q", 2).alias("hi"), "replicates")


def bursts(df: DataFrame, time: str, order: list[str], gap: int, keys: list[str], name: str = "burst_id") -> DataFrame:
    """0-based number of the burst: a new one after a pause longer than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    new: Column = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, same: Column, order: list[str], keys: list[str]) -> DataFrame:
    """Lengths of runs of rows for which ``same`` (as the row before) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_same", same).withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def least_squares(df: DataFrame, y: str, xs: list[str], part: str) -> DataFrame:
    """term, beta, r2_train, r2_validation, condition of an ordinary least-squares fit.

    ``part`` tells 'train' from 'validation' rows; rows with a null in ``y`` or ``xs`` take no
    part. Predictors are scaled by the mean and deviation of the training rows. One aggregate
    gives both parts' covariances, so two rows reach the driver however large ``df``; residuals
    follow from these. condition is that of the predictors' correlation matrix. A constant
    predictor gets beta 0; without training rows the result is empty, without validation rows
    r2_validation is null.
    """
    import numpy as np

    names = [*xs, y]
    whole = df.where(F.col(part).isin("train", "validation")).dropna(subset=names)
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    sums = [F.avg(c).alias(f"m{k}") for k, c in enumerate(names)] + [F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]
    found = {r["_part"]: r for r in whole.groupBy(F.col(part).alias("_part")).agg(*sums).collect()}  # two rows
    schema = "term string, beta double, r2_train double, r2_validation double, condition double"
    if "train" not in found:
        return df.sparkSession.createDataFrame([], schema)

    def moments(row):
        cov = np.empty((len(names), len(names)))
        for a, b in pairs:
            cov[a, b] = cov[b, a] = row[f"c{a}_{b}"]
        return np.array([row[f"m{k}"] for k in range(len(names))]), cov

    mean, cov = moments(found["train"])
    dev = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale = np.divide(1.0, dev, out=np.zeros_like(dev), where=dev > 0)
    corr = cov[:-1, :-1] * np.outer(scale, scale)
    beta = np.linalg.lstsq(corr, cov[:-1, -1] * scale, rcond=None)[0]
    slope = beta * scale

    def r2(row):
        m, v = moments(row)
        off = m[-1] - mean[-1] - slope @ (m[:-1] - mean[:-1])
        rest = v[-1, -1] - 2 * slope @ v[:-1, -1] + slope @ v[:-1, :-1] @ slope + off * off
        return float(1 - rest / v[-1, -1]) if v[-1, -1] > 0 else None

    tail = (r2(found["train"]), r2(found["validation"]) if "validation" in found else None, float(np.linalg.cond(corr)) if (dev > 0).all() else None)
    rows = [("intercept", float(mean[-1]), *tail)] + [(x, float(b), *tail) for x, b in zip(xs, beta)]
    return df.sparkSession.createDataFrame(rows, schema)
