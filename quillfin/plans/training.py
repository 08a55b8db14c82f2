"""Queries on splits, sequences, scaling and readiness for training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import CLASSES, FEATURES, STREAM
from ..operators import label, scale, sequence, split
from .base import FEATURES_SQL, LABEL_SQL, events, featured, features_sql, grid, labeled, query, with_

PURGE = split.required_purge(25_200_000, 18_000_000, 36_000_000)
KEYS = ["market_id", "asset_id", "grid_timestamp_ms"]
_ORDER = "ORDER BY grid_timestamp_ms, market_id, asset_id"

SPLIT_SQL = (
    LABEL_SQL
    + f""",
sp0 AS (SELECT *, row_number() OVER ({_ORDER}) - 1 AS k FROM labeled),
sp1 AS (SELECT count(*) AS n, max(grid_timestamp_ms) - min(grid_timestamp_ms) AS span FROM sp0),
sp2 AS (SELECT n, greatest(1, ceil({PURGE} / greatest(1.0::DOUBLE, span / greatest(1, n - 1)::DOUBLE))::BIGINT) AS pp FROM sp1),
sp3 AS (SELECT n, pp, least(greatest(10, round_even(greatest(30, n - 2 * pp) * 0.7::DOUBLE, 0)::BIGINT), n - (20 + 2 * pp)) AS n_train FROM sp2),
sp4 AS (SELECT sp3.*, (SELECT max(grid_timestamp_ms) FROM sp0 WHERE k < n_train) AS t_end FROM sp3),
sp5 AS (SELECT sp4.*, (SELECT count(*) FROM sp0 WHERE grid_timestamp_ms >= t_end + {PURGE}) AS rest, (SELECT min(k) FROM sp0 WHERE grid_timestamp_ms >= t_end + {PURGE}) AS k0 FROM sp4),
sp6 AS (SELECT *, least(greatest(10, round_even(greatest(20, rest - pp) * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE)), 0)::BIGINT), rest - 10) AS n_val FROM sp5),
sp7 AS (SELECT sp6.*, (SELECT max(grid_timestamp_ms) FROM sp0 WHERE grid_timestamp_ms >= t_end + {PURGE} AND k < k0 + n_val) AS v_end FROM sp6),
sp AS (
  SELECT sp0.*, CASE WHEN k < n_train THEN 'train' WHEN grid_timestamp_ms >= t_end + {PURGE} AND k < k0 + n_val THEN 'validation'
    WHEN grid_timestamp_ms >= v_end + {PURGE} THEN 'test' ELSE 'purged' END AS split
  FROM sp0 CROSS JOIN sp7
)"""
)


def split_rows(spark, sf_dir):
    return split.ratio_split(featured(spark, sf_dir), PURGE)


@query("split_ratio_purge", with_(SPLIT_SQL, "SELECT market_id, asset_id, grid_timestamp_ms, split FROM sp"))
def split_ratio_purge(spark, sf_dir):
    return split_rows(spark, sf_dir).select(*KEYS, "split")


@query(
    "split_invariants",
    with_(
        SPLIT_SQL,
        """, e AS (SELECT split, min(grid_timestamp_ms) AS lo, max(grid_timestamp_ms) AS hi FROM sp WHERE split <> 'purged' GROUP BY 1),
pr AS (SELECT * FROM (VALUES ('train', 'validation'), ('validation', 'test'), ('train', 'test')) t(first, second))
SELECT first, second, b.lo - a.hi AS purge_ms,
  (SELECT count(*) FROM (SELECT DISTINCT grid_timestamp_ms FROM sp WHERE split = first INTERSECT SELECT DISTINCT grid_timestamp_ms FROM sp WHERE split = second)) AS shared_times, 0 AS shared_rows
FROM pr JOIN e a ON a.split = first JOIN e b ON b.split = second""",
    ),
)
def split_invariants(spark, sf_dir):
    return split.invariants(split_rows(spark, sf_dir))


@query(
    "split_market_snap",
    """WITH m AS (SELECT 'M' || lpad((extract('month' FROM o_orderdate) + 12 * extract('year' FROM o_orderdate))::VARCHAR, 6, '0') AS market_id, o_orderkey, epoch_us(o_orderdate::TIMESTAMP) // 1000 + 864000000 * (extract('month' FROM o_orderdate) + 12 * extract('year' FROM o_orderdate)) AS t FROM orders),
a AS (SELECT market_id, count(*) AS rows, min(t) AS lo, max(t) AS hi FROM m GROUP BY 1),
b AS (SELECT *, row_number() OVER w - 1 AS k, sum(rows) OVER w - rows AS ahead, lo - lag(hi) OVER w AS gap, sum(rows) OVER () AS n FROM a WINDOW w AS (ORDER BY lo, market_id)),
c AS (SELECT x.k AS k1, y.k AS k2, x.ahead AS a1, y.ahead AS a2, x.n AS n, abs(x.ahead::DOUBLE / x.n - 0.7) + abs((y.ahead - x.ahead)::DOUBLE / x.n - 0.15) + abs((x.n - y.ahead)::DOUBLE / x.n - 0.15) AS score
  FROM b x JOIN b y ON x.k < y.k WHERE x.gap >= 432000000 AND y.gap >= 432000000)
SELECT k1, k2, a1::BIGINT AS train_rows, (a2 - a1)::BIGINT AS validation_rows, (n - a2)::BIGINT AS test_rows, round(score, 9) AS score FROM c ORDER BY c.score, k1, k2 LIMIT 1""",
)
def split_market_snap(spark, sf_dir):
    """Months stand in for markets, moved ten days apart each; the cut falls into gaps of five days or more."""
    month = F.month("o_orderdate") + 12 * F.year("o_orderdate")
    at = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long") + F.lit(864_000_000) * month.cast("long")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("M"), F.lpad(month.cast("string"), 6, "0")).alias("market_id"), at.alias("t"))
    return split.market_split(rows, 432_000_000, "t").withColumn("score", F.round("score", 9))


@query(
    "split_simple",
    with_(
        LABEL_SQL,
        f""", k AS (SELECT *, row_number() OVER ({_ORDER}) - 1 AS k, count(*) OVER () AS n FROM labeled)
SELECT market_id, asset_id, grid_timestamp_ms, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k >= floor(n * 0.7::DOUBLE) + 5 AND k < floor(n * 0.85::DOUBLE) THEN 'validation'
  WHEN k >= floor(n * 0.85::DOUBLE) + 5 THEN 'test' ELSE 'purged' END AS split FROM k""",
    ),
)
def split_simple(spark, sf_dir):
    return split.simple_cut(label.clean(labeled(spark, sf_dir)), "grid_timestamp_ms", split.TIES, purge=5).select(*KEYS, "split")


@query(
    "walk_forward",
    with_(
        LABEL_SQL,
        f""", k AS (SELECT grid_timestamp_ms, row_number() OVER ({_ORDER}) - 1 AS k, count(*) OVER () AS n FROM labeled),
s AS (SELECT DISTINCT floor(n * 0.4::DOUBLE)::BIGINT AS a, floor(n * 0.1::DOUBLE)::BIGINT AS v FROM k),
fo AS (SELECT i AS fold, a + (i - 1) * v AS te, v FROM s, range(1, 4) t(i)),
r AS (SELECT fold, 'train' AS part, 0 AS lo, te AS hi FROM fo UNION ALL SELECT fold, 'validation', te + 20, te + 20 + v FROM fo UNION ALL SELECT fold, 'test', te + 40 + v, te + 40 + 2 * v FROM fo)
SELECT fold::INT AS fold, part, count(*) AS rows, min(grid_timestamp_ms) AS first_ms, max(grid_timestamp_ms) AS last_ms FROM k JOIN r ON k.k >= r.lo AND k.k < r.hi GROUP BY ALL""",
    ),
)
def walk_forward(spark, sf_dir):
    rows = split.walk_forward(label.clean(labeled(spark, sf_dir)), "grid_timestamp_ms", split.TIES)
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("grid_timestamp_ms").alias("first_ms"), F.max("grid_timestamp_ms").alias("last_ms"))


@query(
    "split_calibration",
    with_(
        LABEL_SQL,
        f""", c AS (SELECT min(grid_timestamp_ms) + (max(grid_timestamp_ms) - min(grid_timestamp_ms)) // 2 AS mid_ms FROM labeled)
SELECT CASE WHEN grid_timestamp_ms <= mid_ms THEN 'calibration' WHEN grid_timestamp_ms >= mid_ms + {PURGE} THEN 'evaluation' ELSE 'purged' END AS part, count(*) AS rows,
       min(grid_timestamp_ms) AS first_ms, max(grid_timestamp_ms) AS last_ms FROM labeled, c GROUP BY 1""",
    ),
)
def split_calibration(spark, sf_dir):
    rows = labeled(spark, sf_dir).select("grid_timestamp_ms")
    lo, hi = rows.agg(F.min("grid_timestamp_ms"), F.max("grid_timestamp_ms")).first()
    out = split.calibration_cut(rows, "grid_timestamp_ms", lo + (hi - lo) // 2, PURGE)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("grid_timestamp_ms").alias("first_ms"), F.max("grid_timestamp_ms").alias("last_ms"))


_D = "OVER (PARTITION BY split, market_id, asset_id ORDER BY grid_timestamp_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
SEQUENCE_SQL = (
    SPLIT_SQL
    + f""",
sq0 AS (SELECT split, market_id, asset_id, grid_timestamp_ms AS endpoint_timestamp_ms, label AS target, (bid + ask) / 2.0 AS mid, ask - bid AS spread, count(*) {_D} AS c,
  min(grid_timestamp_ms) {_D} AS start_timestamp_ms, first_value((bid + ask) / 2.0) {_D} AS first_mid FROM sp WHERE split <> 'purged'),
sq AS (SELECT *, row_number() OVER (ORDER BY endpoint_timestamp_ms, market_id, asset_id, split) - 1 AS sequence_id FROM sq0 WHERE c = 10)"""
)


def sequences_of(spark, sf_dir):
    return sequence.build(split_rows(spark, sf_dir).where("split <> 'purged'"))


@query("sequences", with_(SEQUENCE_SQL, "SELECT sequence_id, endpoint_timestamp_ms, start_timestamp_ms, 10 AS sequence_length, market_id, asset_id, split, target, first_mid, mid AS last_mid, spread AS last_spread FROM sq"))
def sequences(spark, sf_dir):
    s = sequences_of(spark, sf_dir)
    return s.select(
        "sequence_id", "endpoint_timestamp_ms", "start_timestamp_ms", "sequence_length", "market_id", "asset_id", "split", "target",
        F.get(F.get("feature_matrix", 0), 0).alias("first_mid"), sequence.last_step("feature_matrix", 0).alias("last_mid"), sequence.last_step("feature_matrix", 1).alias("last_spread"),
    )


@query(
    "sequence_flatten",
    with_(SEQUENCE_SQL, f", t AS (SELECT split, market_id, asset_id, endpoint_timestamp_ms, count(*) OVER () AS n FROM sq) SELECT split, count(*) AS sequences, 110 * count(*) AS cells, 110 AS width FROM t GROUP BY split"),
)
def sequence_flatten(spark, sf_dir):
    flat = sequences_of(spark, sf_dir).withColumn("flat", F.flatten("feature_matrix"))
    return flat.groupBy("split").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.size("flat")).alias("cells"), F.max(F.size("flat")).alias("width"))


@query(
    "sequence_masks",
    with_(
        SPLIT_SQL,
        """, an AS (SELECT market_id, asset_id, grid_timestamp_ms, split, row_number() OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) AS j FROM sp),
vm AS (SELECT split, j, count(*) OVER w AS c, count_if(j <= 5) OVER w AS pad FROM an WHERE split <> 'purged' WINDOW w AS (PARTITION BY split, market_id, asset_id ORDER BY grid_timestamp_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT split, count(*) AS sequences, count_if(pad > 0) AS with_padding, sum(10 - pad)::BIGINT AS valid_steps FROM vm WHERE c = 10 GROUP BY split""",
    ),
)
def sequence_masks(spark, sf_dir):
    """Warm-up cells: the first five rows of a stream lack lags."""
    s = sequences_of(spark, sf_dir).withColumns(sequence.masks())
    bad = F.size(F.filter("key_padding", lambda x: x))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(bad > 0).alias("with_padding"), F.sum(10 - bad).alias("valid_steps"))


TRAIN_SQL = (
    FEATURES_SQL
    + SPLIT_SQL[len(LABEL_SQL) :]
    + """,
wt0 AS (SELECT feat.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY feat.market_id, feat.asset_id) AS c FROM feat JOIN sp USING (market_id, asset_id, grid_timestamp_ms) WHERE sp.split = 'train'
  WINDOW w AS (PARTITION BY feat.market_id, feat.asset_id ORDER BY grid_timestamp_ms)),
wt AS (SELECT *, greatest(0, least(i, 10, c - 9, c - i + 1)) AS weight FROM wt0),
long AS (UNPIVOT (SELECT weight, """
    + ", ".join(FEATURES)
    + " FROM wt) ON "
    + ", ".join(FEATURES)
    + " INTO NAME feature VALUE value)"
)


def train_rows(spark, sf_dir):
    rows = split_rows(spark, sf_dir).where("split = 'train'")
    return sequence.multiplicity(rows, 10, "grid_timestamp_ms", ["market_id", "asset_id"])


@query(
    "scaler_standard",
    with_(
        TRAIN_SQL,
        """SELECT feature, round(sum(weight * value) / sum(weight), 8) AS center,
  round(sqrt(greatest(sum(weight * (value - m) * (value - m)) / sum(weight), 0)), 8) AS scale, false AS zero_variance
FROM (SELECT *, sum(weight * value) OVER (PARTITION BY feature) / sum(weight) OVER (PARTITION BY feature) AS m FROM long WHERE weight > 0) GROUP BY feature""",
    ),
)
def scaler_standard(spark, sf_dir):
    return scale.fit(train_rows(spark, sf_dir), FEATURES, "standard", "weight").withColumns({"center": F.round("center", 8), "scale": F.round("scale", 8)})


@query(
    "scaler_robust",
    with_(
        TRAIN_SQL,
        """, r AS (SELECT feature, value FROM long, range(1, 11) t(rep) WHERE rep <= weight)
SELECT feature, round(quantile_cont(value, 0.5), 9) AS center, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS scale, false AS zero_variance FROM r GROUP BY feature""",
    ),
)
def scaler_robust(spark, sf_dir):
    return scale.fit(train_rows(spark, sf_dir), FEATURES, "robust", "weight").withColumns({"center": F.round("center", 9), "scale": F.round("scale", 9)})


@query("scaler_minmax", with_(TRAIN_SQL, "SELECT feature, round(min(value), 9) AS center, round(max(value) - min(value), 9) AS scale, false AS zero_variance FROM long WHERE weight > 0 GROUP BY feature"))
def scaler_minmax(spark, sf_dir):
    return scale.fit(train_rows(spark, sf_dir), FEATURES, "minmax", "weight").withColumns({"center": F.round("center", 9), "scale": F.round("scale", 9)})


@query(
    "scaler_sample",
    with_(TRAIN_SQL, "SELECT feature, round(avg(value), 8) AS center, round(coalesce(nullif(stddev_samp(value), 0), 1), 8) AS scale FROM long GROUP BY feature"),
)
def scaler_sample(spark, sf_dir):
    return scale.fit_sample(train_rows(spark, sf_dir), FEATURES).withColumns({"center": F.round("center", 8), "scale": F.round("scale", 8)})


@query(
    "scaled_imputed_mask",
    with_(
        TRAIN_SQL,
        """, p AS (SELECT quantile_cont(spread, 0.5) AS sc, quantile_cont(spread, 0.75) - quantile_cont(spread, 0.25) AS ss, quantile_cont(depth_imbalance, 0.5) AS dc,
  quantile_cont(depth_imbalance, 0.75) - quantile_cont(depth_imbalance, 0.25) AS ds FROM wt, range(1, 11) t(rep) WHERE rep <= weight)
SELECT feat.market_id, feat.asset_id, grid_timestamp_ms, round(greatest(least((spread - sc) / ss, 3), -3), 8) AS spread, round(greatest(least((depth_imbalance - dc) / ds, 3), -3), 8) AS depth_imbalance,
  feat.mid_return_5s IS NULL AS warmup
FROM feat, p""",
    ),
)
def scaled_imputed_mask(spark, sf_dir):
    """Robust scaling fitted on training windows, applied to all rows; clipped, nulls as 0."""
    cols = ["spread", "depth_imbalance"]
    fitted = scale.fit(train_rows(spark, sf_dir), cols, "robust", "weight")
    rows = featured(spark, sf_dir).withColumn("warmup", F.col("mid_return_5s").isNull())
    out = scale.transform(rows, fitted, cols, clip=3.0, impute=True)
    return out.select(*KEYS, F.round("spread", 8).alias("spread"), F.round("depth_imbalance", 8).alias("depth_imbalance"), "warmup")


@query(
    "class_weights",
    with_(LABEL_SQL, "SELECT c.label, coalesce(n, 0) AS rows, CASE WHEN n > 0 THEN round((SELECT count(*) FROM labeled)::DOUBLE / (3 * n), 9) ELSE 0.0 END AS weight FROM (VALUES ('DOWN'), ('FLAT'), ('UP')) c(label) LEFT JOIN (SELECT label, count(*) AS n FROM labeled GROUP BY 1) USING (label)"),
)
def class_weights(spark, sf_dir):
    counts = labeled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    every = spark.createDataFrame([(c,) for c in CLASSES], "label string")
    out = every.join(counts, "label", "left").join(F.broadcast(total))  # one row
    return out.select("label", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(F.round(F.col("total") / (3 * F.col("rows")), 9), F.lit(0.0)).alias("weight"))


#: Rows in splits with their place in the stream and the number of windows they stand in; cells.
CELLS_SQL = (
    SEQUENCE_SQL
    + ","
    + features_sql("labeled")
    + """,
wx0 AS (SELECT sp.split, feat.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY sp.split, feat.market_id, feat.asset_id) AS c FROM feat JOIN sp USING (market_id, asset_id, grid_timestamp_ms) WHERE sp.split <> 'purged'
  WINDOW w AS (PARTITION BY sp.split, feat.market_id, feat.asset_id ORDER BY grid_timestamp_ms)),
wx AS (SELECT *, greatest(0, least(i, 10, c - 9, c - i + 1)) AS weight FROM wx0),
cells AS (UNPIVOT (SELECT split, weight, """
    + ", ".join(FEATURES)
    + " FROM wx) ON "
    + ", ".join(FEATURES)
    + " INTO NAME feature VALUE value)"
)


@query(
    "quality_gate",
    with_(
        CELLS_SQL,
        """, n AS (SELECT count(*) AS total, count_if(split = 'train') AS tr, count_if(split = 'validation') AS va, count_if(split = 'test') AS te, count_if(c <> 10) AS bad FROM sq),
s AS (SELECT avg(is_stale::INT) AS stale, count(DISTINCT (bid + ask) / 2.0) AS mids FROM grid),
l AS (SELECT count_if(label IN ('DOWN', 'FLAT', 'UP')) AS n, min(c) / sum(c) AS least FROM (SELECT label, count(*) AS c FROM labeled GROUP BY 1)),
lc AS (SELECT count(*) AS n FROM labeled),
d AS (SELECT count(*) - count(DISTINCT (endpoint_timestamp_ms, market_id, asset_id)) AS d FROM sq),
tr AS (SELECT count_if(label <> p) AS t FROM (SELECT label, lag(label) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) AS p FROM labeled)),
bd AS (SELECT max(endpoint_timestamp_ms) FILTER (split = 'train') AS t_hi, max(endpoint_timestamp_ms) FILTER (split = 'validation') AS v_hi FROM sq),
cl AS (SELECT count_if((split = 'validation' AND start_timestamp_ms <= t_hi) OR (split = 'test' AND start_timestamp_ms <= greatest(t_hi, v_hi))) AS x FROM sq, bd),
ni AS (SELECT coalesce(sum(weight) FILTER (isnan(value)), 0) AS nans, coalesce(sum(weight) FILTER (isinf(value)), 0) AS infs FROM cells),
va AS (SELECT feature, sum(weight * value) / sum(weight) AS m FROM cells WHERE split = 'train' AND weight > 0 GROUP BY 1),
vb AS (SELECT feature, sum(weight * (value - m) * (value - m)) / sum(weight) AS v FROM cells JOIN va USING (feature) WHERE split = 'train' AND weight > 0 GROUP BY 1),
cf AS (SELECT count_if(v < 1e-8) AS k FROM vb),
ev AS (SELECT count(*) AS n FROM q),
c(name, category, ok, observed) AS (
  SELECT 'sequence_dimensions', 'pipeline_integrity', bad = 0, bad::DOUBLE FROM n
  UNION ALL SELECT 'duplicate_sequence_endpoints', 'pipeline_integrity', d = 0, d FROM d
  UNION ALL SELECT 'cross_split_leakage', 'pipeline_integrity', x = 0, x FROM cl
  UNION ALL SELECT 'cross_session_leakage', 'pipeline_integrity', true, 0
  UNION ALL SELECT 'scaler_fit_source', 'pipeline_integrity', true, 1
  UNION ALL SELECT 'canonical_observations_count', 'data_quality', n >= 50000, n FROM ev
  UNION ALL SELECT 'labeled_observations_count', 'data_quality', n >= 10000, n FROM lc
  UNION ALL SELECT 'sequence_counts_sufficiency', 'data_quality', total >= 10000 AND tr >= 7000 AND va >= 1000 AND te >= 1000, total FROM n
  UNION ALL SELECT 'zero_nan_values', 'data_quality', nans = 0, nans FROM ni
  UNION ALL SELECT 'zero_inf_values', 'data_quality', infs = 0, infs FROM ni
  UNION ALL SELECT 'required_classes_present', 'data_quality', n = 3, n FROM l
  UNION ALL SELECT 'class_balance_minimum', 'data_quality', n = 3 AND least >= 0.05, round(least, 9) FROM l
  UNION ALL SELECT 'price_diversity', 'data_quality', mids >= 25, mids FROM s
  UNION ALL SELECT 'directional_transitions', 'data_quality', t >= 100, t FROM tr
  UNION ALL SELECT 'staleness_threshold', 'data_quality', stale <= 0.2, round(stale, 9) FROM s
  UNION ALL SELECT 'feature_variance_audit', 'data_quality', k <= 3, k FROM cf
),
r AS (SELECT name, category, CASE WHEN ok THEN 'PASS' WHEN name = 'feature_variance_audit' THEN 'WARNING' ELSE 'FAIL' END AS status, observed FROM c),
verdict AS (SELECT bool_and(category <> 'pipeline_integrity' OR status = 'PASS') AS pipeline_valid, bool_and(category <> 'data_quality' OR status <> 'FAIL') AS data_quality_pass FROM r)
SELECT r.*, verdict.*, pipeline_valid AND data_quality_pass AS training_ready FROM r, verdict""",
    ),
)
def quality_gate(spark, sf_dir):
    from ..operators.quality import gate

    g, lab = grid(spark, sf_dir), label.clean(labeled(spark, sf_dir))
    return gate(g, lab, sequences_of(spark, sf_dir), events(spark, sf_dir))


@query(
    "gate_null_cells",
    with_(
        CELLS_SQL,
        ", st AS (SELECT split, step, "
        + " + ".join(f"({f} IS NULL)::INT" for f in FEATURES)
        + """ AS empty FROM wx0, range(0, 10) t(step) WHERE i + 9 - step BETWEEN 10 AND c)
SELECT split, step::INT AS step, 11 * count(*) AS cells, sum(empty)::BIGINT AS nulls, CASE WHEN step < 5 OR sum(empty) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM st GROUP BY split, step""",
    ),
)
def gate_null_cells(spark, sf_dir):
    from ..operators.quality import null_cells

    return null_cells(sequences_of(spark, sf_dir))


@query(
    "gate_null_features",
    with_(
        CELLS_SQL,
        ", st AS (SELECT split, step, "
        + ", ".join(FEATURES)
        + """ FROM wx0, range(0, 10) t(step) WHERE i + 9 - step BETWEEN 10 AND c)
SELECT split, step::INT AS step, f.feature, count(*) AS cells, count_if(f.empty) AS nulls FROM (SELECT split, step, unnest(["""
        + ", ".join(f"{{'feature': '{f}', 'empty': {f} IS NULL}}" for f in FEATURES)
        + "]) AS f FROM st) GROUP BY ALL",
    ),
)
def gate_null_features(spark, sf_dir):
    from ..operators.quality import null_features

    return null_features(sequences_of(spark, sf_dir))


_HELD = {"spread_positive_pct": "spread > 0", "bid_mid_ask_pct": "mid_price BETWEEN bid AND ask", "bid_micro_ask_pct": "microprice BETWEEN bid AND ask", "depth_imbalance_valid_pct": "depth_imbalance BETWEEN -1 AND 1"}


@query(
    "gate_microstructure",
    with_(
        FEATURES_SQL,
        "SELECT market_id, asset_id, count(*) AS rows, count(DISTINCT mid_price) AS unique_mid_prices, "
        + ", ".join(f"round(avg(coalesce({c}, false)::INT) * 100.0, 6) AS {n}" for n, c in _HELD.items())
        + ", bool_and("
        + " AND ".join(f"coalesce({c}, false)" for c in _HELD.values())
        + ") AS passed FROM feat GROUP BY 1, 2",
    ),
)
def gate_microstructure(spark, sf_dir):
    """Bounds that hold in every sound book, a row a stream."""
    from ..operators.quality import microstructure

    return microstructure(featured(spark, sf_dir), STREAM).withColumns({n: F.round(n, 6) for n in _HELD})


@query(
    "gate_purge_gaps",
    with_(
        SEQUENCE_SQL,
        f""", pg AS (SELECT max(endpoint_timestamp_ms) FILTER (split = 'train') AS t, min(start_timestamp_ms) FILTER (split = 'validation') AS v0, max(endpoint_timestamp_ms) FILTER (split = 'validation') AS v, min(start_timestamp_ms) FILTER (split = 'test') AS e0 FROM sq)
SELECT 'train' AS after, 'validation' AS before, v0 - t AS gap_ms, v0 - t >= {PURGE} AS passed FROM pg UNION ALL SELECT 'validation', 'test', e0 - v, e0 - v >= {PURGE} FROM pg""",
    ),
)
def gate_purge_gaps(spark, sf_dir):
    from ..operators.quality import purge_gaps

    return purge_gaps(sequences_of(spark, sf_dir), PURGE)


@query(
    "gate_market_classes",
    with_(LABEL_SQL, "SELECT market_id, count(*) AS rows, round(avg((label = 'DOWN')::INT), 9) AS down, round(avg((label = 'FLAT')::INT), 9) AS flat, round(avg((label = 'UP')::INT), 9) AS up FROM labeled GROUP BY 1"),
)
def gate_market_classes(spark, sf_dir):
    """The class mix of every market."""
    share = lambda v: F.round(F.avg((F.col("label") == v).cast("int")), 9)
    return labeled(spark, sf_dir).groupBy("market_id").agg(F.count(F.lit(1)).alias("rows"), share("DOWN").alias("down"), share("FLAT").alias("flat"), share("UP").alias("up"))


@query(
    "purge_requirement",
    with_(LABEL_SQL, f"SELECT market_id, max(target_timestamp - grid_timestamp_ms) AS widest_label_ms, {PURGE}::BIGINT AS purge_ms, max(target_timestamp - grid_timestamp_ms) <= {PURGE} AS covered FROM labeled GROUP BY 1"),
)
def purge_requirement(spark, sf_dir):
    """Whether the purge covers how far the labels of each market look ahead."""
    widest = F.max(F.col("target.timestamp_ms") - F.col("grid_timestamp_ms"))
    return labeled(spark, sf_dir).groupBy("market_id").agg(widest.alias("widest_label_ms"), F.lit(PURGE).cast("long").alias("purge_ms"), (widest <= PURGE).alias("covered"))
