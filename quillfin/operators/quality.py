"""Validators as tables of checks, and the gate before training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import mid
from ..model import CLASSES, FEATURES, stream_keys


def checks(one_row: DataFrame, specs: list[tuple[str, str, Column, Column]], warn: tuple[str, ...] = ()) -> DataFrame:
    """One row a check (name, category, status, observed) out of a one-row aggregate.

    A check named in ``warn`` gives WARNING instead of FAIL; an unknown condition fails.
    """
    status = lambda n, ok: F.when(ok, "PASS").otherwise("WARNING" if n in warn else "FAIL")
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), status(n, ok).alias("status"), seen.cast("double").alias("observed")) for n, c, ok, seen in specs])
    return one_row.select(F.explode(items).alias("c")).select("c.*")


def directional_transitions(labels: DataFrame, time: str, keys: list[str]) -> Column:
    """Counts changes of label of which a side is UP or DOWN."""
    return F.count_if((F.col("label") != F.col("_before")) & (F.col("label").isin("UP", "DOWN") | F.col("_before").isin("UP", "DOWN")))


def crossings(sequences: DataFrame) -> DataFrame:
    """crossing: windows of a later split that begin at or before the end of an earlier one."""
    ends = sequences.agg(*[F.max(F.when(F.col("split") == p, F.col("endpoint_timestamp_ms"))).alias(f"_{p}") for p in ("train", "validation")])
    start, split = F.col("start_timestamp_ms"), F.col("split")
    after_train = (split == "validation") & (start <= F.col("_train"))
    after_both = (split == "test") & (start <= F.greatest("_train", "_validation"))
    return sequences.join(F.broadcast(ends)).agg(F.count_if(after_train | after_both).alias("crossing"))  # one row


def constant_features(sequences: DataFrame, width: int, least: float = 1e-8) -> DataFrame:
    """constant: features whose variance over all cells of the training windows is below ``least``.

    Null cells do not count; a feature without any value is not constant.
    """
    steps = sequences.where("split = 'train'").select(F.explode("feature_matrix").alias("x"))
    one = steps.agg(*[F.var_pop(F.get("x", F.lit(j))).alias(f"v{j}") for j in range(width)])
    return one.select(sum(F.coalesce(F.col(f"v{j}") < least, F.lit(False)).cast("int") for j in range(width)).alias("constant"))


def null_cells(sequences: DataFrame, usable_from: int = 5) -> DataFrame:
    """cells and nulls (or NaN) per split and step; steps from ``usable_from`` on may have none."""
    steps = sequences.select("split", F.posexplode("feature_matrix").alias("step", "x"))
    empty = F.size(F.filter("x", lambda v: v.isNull() | F.isnan(v)))
    out = steps.groupBy("split", "step").agg(F.sum(F.size("x")).alias("cells"), F.sum(empty).alias("nulls"))
    return out.withColumn("status", F.when((F.col("step") < usable_from) | (F.col("nulls") == 0), "PASS").otherwise("FAIL"))


def null_features(sequences: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """cells and nulls (or NaN) per split, step and feature."""
    steps = sequences.select("split", F.posexplode("feature_matrix").alias("step", "x"))
    empty = [F.count_if(F.get("x", F.lit(j)).isNull() | F.isnan(F.get("x", F.lit(j)))).alias(f"n{j}") for j in range(len(names))]
    # one row a split and step comes out of the aggregate; only that is turned into rows by feature
    per = steps.groupBy("split", "step").agg(F.count(F.lit(1)).alias("cells"), *empty)
    return per.select("split", "step", "cells", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"n{j}").alias("nulls")) for j, n in enumerate(names)])))


def microstructure(features: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the share of rows in percent that keep to each bound: a positive spread, mid and
    microprice between bid and ask, an imbalance within [-1, 1]. Rows with a null in question do
    not keep to it. ``passed``: all shares are 100."""
    c = F.col
    bounds = {
        "spread_positive_pct": c("spread") > 0, "bid_mid_ask_pct": c("mid_price").between(c("bid"), c("ask")), "bid_micro_ask_pct": c("microprice").between(c("bid"), c("ask")),
        "depth_imbalance_valid_pct": c("depth_imbalance").between(-1.0, 1.0),
    }
    held = {n: F.count_if(F.coalesce(ok, F.lit(False))) for n, ok in bounds.items()}
    rows = F.count(F.lit(1))
    out = features.groupBy(*keys).agg(rows.alias("rows"), F.count_distinct("mid_price").alias("unique_mid_prices"), *[(k / rows * 100.0).alias(n) for n, k in held.items()], F.least(*held.values()).alias("_held"))
    return out.withColumn("passed", c("_held") == c("rows")).drop("_held")


def purge_gaps(sequences: DataFrame, least: int) -> DataFrame:
    """after, before, gap_ms, passed: from the last endpoint of one part to the first window's
    start of the next; a missing part gives a null gap, which does not pass."""
    ends = sequences.groupBy().agg(*[f(F.when(F.col("split") == p, F.col(c))).alias(f"{p}_{c[0]}") for p in ("train", "validation", "test") for f, c in ((F.min, "start_timestamp_ms"), (F.max, "endpoint_timestamp_ms"))])
    pairs = [F.struct(F.lit(a).alias("after"), F.lit(b).alias("before"), (F.col(f"{b}_s") - F.col(f"{a}_e")).alias("gap_ms")) for a, b in (("train", "validation"), ("validation", "test"))]
    return ends.select(F.inline(F.array(*pairs))).withColumn("passed", F.coalesce(F.col("gap_ms") >= least, F.lit(False)))


def gate(
    grid: DataFrame, labels: DataFrame, sequences: DataFrame, canonical: DataFrame, cross_session: int = 0, scaler_split: str = "train", scaler_valid: bool = True, length: int = 10, width: int = len(FEATURES),
    least_events=50_000, least_labels=10_000, least=(10_000, 7_000, 1_000, 1_000), least_mids=25, least_transitions=100, least_class=0.05, most_stale=0.2, most_constant=3, strict_variance=False,
) -> DataFrame:
    """The readiness checks, five on integrity and eleven on data.

    pipeline_valid: every integrity check passes; data_quality_pass: no check on data fails
    (a warning is no failure); training_ready: both. Constant features warn beyond
    ``most_constant`` unless ``strict_variance`` forbids any. Null cells are warm-up, to be
    imputed, and are counted by ``null_cells``, not here. Windows never leave a stream's
    session; ``cross_session`` is for windows that were built elsewhere.
    """
    keys = stream_keys(labels.columns)
    c, cells, inf = F.col, F.flatten("feature_matrix"), float("inf")
    shaped = (F.size("feature_matrix") == length) & F.forall("feature_matrix", lambda x: F.size(x) == width)
    one = sequences.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c("split") == p).alias(p) for p in ("train", "validation", "test")], F.count_if(~shaped).alias("misshapen"),
        F.coalesce(F.sum(F.size(F.filter(cells, F.isnan))), F.lit(0)).alias("nans"), F.coalesce(F.sum(F.size(F.filter(cells, lambda x: F.abs(x) == inf))), F.lit(0)).alias("infs"),
    )
    dup = sequences.groupBy("endpoint_timestamp_ms", *stream_keys(sequences.columns)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("dup"))
    w = Window.partitionBy(*keys).orderBy("grid_timestamp_ms")
    moves = labels.withColumn("_before", F.lag("label").over(w)).agg(directional_transitions(labels, "grid_timestamp_ms", keys).alias("moves"))
    classes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(c("label").isin(CLASSES)).alias("classes"), F.coalesce(F.sum("c"), F.lit(0)).alias("labels"), F.round(F.min("c") / F.sum("c"), 9).alias("share"))
    g = grid.agg(F.round(F.avg(F.col("is_stale").cast("int")), 9).alias("stale"), F.count_distinct(mid()).alias("mids"))
    events = canonical.agg(F.count(F.lit(1)).alias("events"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), [dup, moves, classes, g, events, crossings(sequences), constant_features(sequences, width)], one)  # each is one row
    scaler = scaler_split.strip().lower() == "train" and scaler_valid
    most = 0 if strict_variance else most_constant
    # fixed values: the checks' names
    out = checks(row, [
        ("sequence_dimensions", "pipeline_integrity", c("misshapen") == 0, c("misshapen")),
        ("duplicate_sequence_endpoints", "pipeline_integrity", c("dup") == 0, c("dup")),
        ("cross_split_leakage", "pipeline_integrity", c("crossing") == 0, c("crossing")),
        ("cross_session_leakage", "pipeline_integrity", F.lit(cross_session == 0), F.lit(cross_session)),
        ("scaler_fit_source", "pipeline_integrity", F.lit(scaler), F.lit(int(scaler))),
        ("canonical_observations_count", "data_quality", c("events") >= least_events, c("events")),
        ("labeled_observations_count", "data_quality", c("labels") >= least_labels, c("labels")),
        ("sequence_counts_sufficiency", "data_quality", (c("total") >= least[0]) & (c("train") >= least[1]) & (c("validation") >= least[2]) & (c("test") >= least[3]), c("total")),
        ("zero_nan_values", "data_quality", c("nans") == 0, c("nans")),
        ("zero_inf_values", "data_quality", c("infs") == 0, c("infs")),
        ("required_classes_present", "data_quality", c("classes") == len(CLASSES), c("classes")),
        ("class_balance_minimum", "data_quality", (c("classes") == len(CLASSES)) & (c("share") >= least_class), c("share")),
        ("price_diversity", "data_quality", c("mids") >= least_mids, c("mids")),
        ("directional_transitions", "data_quality", c("moves") >= least_transitions, c("moves")),
        ("staleness_threshold", "data_quality", c("stale") <= most_stale, c("stale")),
        ("feature_variance_audit", "data_quality", c("constant") <= most, c("constant")),
    ], warn=() if strict_variance else ("feature_variance_audit",))
    whole = Window.partitionBy(F.lit(0))  # sixteen rows
    valid = F.every((c("category") != "pipeline_integrity") | (c("status") == "PASS")).over(whole)
    good = F.every((c("category") != "data_quality") | (c("status") != "FAIL")).over(whole)
    return out.withColumns({"pipeline_valid": valid, "data_quality_pass": good, "training_ready": valid & good})
