"""Purged time splits, walk-forward folds, named windows and their invariants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import per_time, row_index

TIES = ["market_id", "asset_id"]


def required_purge(label: int = 7000, feature: int = 5000, sequence: int = 10000, least: int = 20000, explicit: int | None = None) -> int:
    if explicit is not None and explicit < least:
        raise ValueError(f"a purge of {explicit} ms is below {least} ms")
    return explicit if explicit is not None else max(label + feature + sequence, least)


def ratio_split(df: DataFrame, purge: int, time: str = "grid_timestamp_ms", ties: list[str] | None = None, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), least: int = 10) -> DataFrame:
    """``df`` with column split: train, validation, test or purged.

    Sizes follow from the number of rows and the time span. Rows are counted per time once;
    cuts are found on these counts.
    """
    ties = ties or TIES
    per = per_time(df, time).persist()  # a row a distinct time; the questions below only ask this
    t, n, before = F.col(time), F.col("_n"), F.col("_before")
    at = per.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if not at.n:
        raise ValueError("empty dataset")
    if at.hi - at.lo <= 2 * purge or at.n < 3 * least:
        raise ValueError("too few rows or too short a span for three purged parts")
    per_purge = max(1, math.ceil(purge / max(1.0, (at.hi - at.lo) / max(1, at.n - 1))))
    usable = max(3 * least, at.n - 2 * per_purge)
    n_train = max(least, round(usable * ratios[0]))
    allowed = at.n - (2 * least + 2 * per_purge)
    n_train = min(n_train, allowed) if allowed >= least else n_train
    train_end = per.where(before < n_train).agg(F.max(t)).first()[0]
    rest = per.where(t >= train_end + purge).agg(F.coalesce(F.sum(n), F.lit(0)), F.min(before)).first()
    if rest[0] < 2 * least:
        raise ValueError("too few rows after the first purge")
    n_val = max(least, round(max(2 * least, rest[0] - per_purge) * (ratios[1] / (ratios[1] + ratios[2]))))
    n_val = min(n_val, rest[0] - least)
    # rows of the validation part may reach the last time that leaves enough rows for a test;
    # the first time beyond says how many there are before it
    latest = per.where(F.lit(at.n) - before >= least).agg(F.max(t)).first()[0]
    beyond = per.where((t >= train_end + purge) & (t > latest - purge)).agg(F.min(before)).first()[0]
    n_val = n_val if beyond is None else max(least, min(n_val, beyond - rest[1]))
    val_end = per.where((t >= train_end + purge) & (before < rest[1] + n_val)).agg(F.max(t)).first()[0]
    n_test = per.where(t >= val_end + purge).agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if n_test < least:
        raise ValueError("too few rows after the second purge")
    rows = row_index(df, time, ties, per=per)
    val = (t >= train_end + purge) & (F.col("row_index") < rest[1] + n_val)
    part = F.when(F.col("row_index") < n_train, "train").when(val, "validation").when(F.col(time) >= val_end + purge, "test").otherwise("purged")
    return rows.withColumn("split", part)


def market_split(df: DataFrame, purge: int, time: str = "grid_timestamp_ms", ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Cuts between whole markets where the gaps allow; the best cut by distance to ``ratios``.

    Returns the cut (k1, k2, score and the markets' order) as one row, or none. One row a
    market goes through the pairing.
    """
    m = df.groupBy("market_id").agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    w = Window.orderBy("lo", "market_id")
    m = m.withColumns({"k": F.row_number().over(w) - 1, "cum": F.sum("rows").over(w), "gap": F.col("lo") - F.lag("hi").over(w), "before": F.coalesce(F.lag("hi").over(w), F.lit(0))})
    m = m.withColumn("ahead", F.col("cum") - F.col("rows"))
    total = m.agg(F.sum("rows").alias("n"))
    cuts = m.where(F.col("gap") >= purge).select("k", "ahead")
    pairs = cuts.select(F.col("k").alias("k1"), F.col("ahead").alias("a1")).join(cuts.select(F.col("k").alias("k2"), F.col("ahead").alias("a2")), F.col("k1") < F.col("k2")).join(F.broadcast(total))
    score = F.abs(F.col("a1") / F.col("n") - ratios[0]) + F.abs((F.col("a2") - F.col("a1")) / F.col("n") - ratios[1]) + F.abs((F.col("n") - F.col("a2")) / F.col("n") - ratios[2])
    best = pairs.agg(F.min(F.struct(score.alias("score"), "k1", "k2", "a1", "a2", "n")).alias("b")).where("b IS NOT NULL")
    return best.select("b.k1", "b.k2", F.col("b.a1").alias("train_rows"), (F.col("b.a2") - F.col("b.a1")).alias("validation_rows"), (F.col("b.n") - F.col("b.a2")).alias("test_rows"), "b.score")


def snap_cuts(df: DataFrame, purge: int, time: str = "grid_timestamp_ms", ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """The best two cuts between markets as one row (from_validation, from_test: times; score), or none.

    A cut lies where the next market begins at least ``purge`` after the end of all markets
    before it, so markets that overlap stay together. For a first cut at share a of the rows
    the score falls with the second up to min(a + validation, 1 - test) and never falls after
    it: only the last cut before and the first from there on can be best. They are found by one
    ordered pass over one row a market, not by pairing all cuts.
    """
    m = df.groupBy("market_id").agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    w = Window.orderBy("lo", "market_id")
    end = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = m.select("lo", (F.sum("rows").over(w) - F.col("rows")).alias("ahead"), (F.col("lo") - end).alias("gap"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    cuts = m.where(F.col("gap") >= purge).select("lo", (F.col("ahead") / F.col("n")).alias("at"))
    goal = F.least(F.col("at") + ratios[1], F.lit(1 - ratios[2]))
    places = cuts.select(F.col("at").alias("x"), F.lit(0).alias("probe"), F.struct("at", "lo").alias("cut"))
    asked = cuts.select(F.greatest(goal, "at").alias("x"), F.lit(1).alias("probe"), F.struct("at", "lo").alias("cut"))
    # a cut at the very goal comes before the question, and so counts as the last one
    along = Window.orderBy("x", "probe", "cut")
    place = F.when(F.col("probe") == 0, F.col("cut"))
    near = places.union(asked).select("probe", "cut", F.last(place, True).over(along).alias("b"), F.first(place, True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("f"))
    pairs = near.where("probe = 1").select(F.col("cut").alias("one"), F.explode(F.array("b", "f")).alias("two")).where(F.col("two.at") > F.col("one.at"))
    a, b = F.col("one.at"), F.col("two.at")
    score = F.abs(a - ratios[0]) + F.abs(b - a - ratios[1]) + F.abs(1 - b - ratios[2])
    best = pairs.agg(F.min(F.struct(F.round(score, 12).alias("score"), F.col("one.lo").alias("from_validation"), F.col("two.lo").alias("from_test"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def snapped_split(df: DataFrame, purge: int, time: str = "grid_timestamp_ms", ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), ties: list[str] | None = None) -> DataFrame:
    """``df`` with column split: whole markets in each part where gaps between them allow
    it (:func:`snap_cuts`); otherwise the purged split by rows (:func:`ratio_split`)."""
    cut = snap_cuts(df, purge, time, ratios).first()  # one row
    if cut is None:
        return ratio_split(df, purge, time, ties, ratios).drop("row_index")
    t = F.col(time)
    return df.withColumn("split", F.when(t < cut.from_validation, "train").when(t < cut.from_test, "validation").otherwise("test"))


def invariants(split: DataFrame, time: str = "grid_timestamp_ms", columns: list[str] | None = None) -> DataFrame:
    """Per pair of parts: the purge actually kept, shared times, shared rows."""
    columns = columns or [c for c in split.columns if c not in ("split", "row_index")]
    rows = split.where("split <> 'purged'").withColumn("_h", F.sha2(F.to_json(F.struct(*columns)), 256))
    parts = [("train", "validation"), ("validation", "test"), ("train", "test")]
    ends = rows.groupBy("split").agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    per_time = rows.groupBy(F.col(time).alias("x")).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
    per_hash = rows.groupBy(F.col("_h").alias("x")).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
    wanted = df_of_pairs(split, parts)
    shared = lambda d, name: d.join(F.broadcast(wanted), F.array_contains("s", F.col("first")) & F.array_contains("s", F.col("second"))).groupBy("first", "second").agg(F.count(F.lit(1)).alias(name))
    out = wanted.join(ends.select(F.col("split").alias("first"), "hi"), "first", "left").join(ends.select(F.col("split").alias("second"), "lo"), "second", "left")
    out = out.join(shared(per_time, "shared_times"), ["first", "second"], "left").join(shared(per_hash, "shared_rows"), ["first", "second"], "left")
    return out.select("first", "second", (F.col("lo") - F.col("hi")).alias("purge_ms"), F.coalesce("shared_times", F.lit(0)).alias("shared_times"), F.coalesce("shared_rows", F.lit(0)).alias("shared_rows"))


def df_of_pairs(like: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return like.sparkSession.createDataFrame(pairs, "first string, second string")


def walk_forward(df: DataFrame, time: str, ties: list[str], folds: int = 3, train: float = 0.4, validation: float = 0.1, test: float = 0.1, purge: int = 20) -> DataFrame:
    """Rows by fold (1 ..) and part: expanding train, then validation and test after purges."""
    n = df.count()
    n_train, n_val, n_test = int(n * train), int(n * validation), int(n * test)
    if min(n_train, n_val, n_test) < 1 or n_train + n_val + n_test + (folds - 1) * n_test + 2 * purge > n:
        raise ValueError(f"too few rows for {folds} folds")
    spec = []
    for k in range(folds):
        a = n_train + k * n_test
        b = a + purge
        c = b + n_val + purge
        spec += [(k + 1, "train", 0, a), (k + 1, "validation", b, b + n_val), (k + 1, "test", c, c + n_test)]
    ranges = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(p).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, p, a, b in spec])
    rows = row_index(df, time, ties)
    hit = F.filter(ranges, lambda r: (F.col("row_index") >= r["a"]) & (F.col("row_index") < r["b"]))
    return rows.withColumn("_at", F.explode(hit)).select("*", "_at.fold", "_at.part").drop("_at")


def simple_cut(df: DataFrame, time: str, ties: list[str], train: float = 0.7, validation: float = 0.15, purge: int = 0) -> DataFrame:
    """int(n * ratio) cuts, with ``purge`` rows dropped before each later part."""
    n = df.count()
    a, b = int(n * train), int(n * (train + validation))
    k = F.col("row_index")
    part = F.when(k < a, "train").when((k >= a + purge) & (k < b), "validation").when(k >= b + purge, "test").otherwise("purged")
    return row_index(df, time, ties).withColumn("split", part)


def calibration_cut(df: DataFrame, time: str, at: int, purge: int) -> DataFrame:
    """Up to ``at``: calibration; from ``at`` + purge on: evaluation; both ends inclusive."""
    return df.withColumn("part", F.when(F.col(time) <= at, "calibration").when(F.col(time) >= at + purge, "evaluation").otherwise("purged"))


def named_windows(df: DataFrame, time: str, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Rows by windows given as index ranges [first, last] into the distinct sorted times."""
    index = row_index(df.select(time).distinct(), time, [time], "time_index")
    spec = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in windows])
    hit = F.filter(spec, lambda r: (F.col("time_index") >= r["a"]) & (F.col("time_index") <= r["b"]))
    return df.join(index, time).withColumn("_w", F.explode(hit)).select("*", "_w.window").drop("_w")
