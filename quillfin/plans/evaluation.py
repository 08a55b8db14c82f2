"""Queries on predictions: metrics, calibration, regimes, correlations, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import argmax, ratio, softmax
from ..model import FEATURES
from ..operators import metrics, split, stats
from .base import FEATURES_SQL, LABEL_SQL, featured, labeled, query, table, with_

PREDICT_SQL = (
    LABEL_SQL
    + """,
pr0 AS (
  SELECT *, CASE label WHEN 'DOWN' THEN 0 WHEN 'FLAT' THEN 1 ELSE 2 END AS y, (1 + source_sequence_id % 7)::DOUBLE / (3 + source_sequence_id % 7 + source_sequence_id % 5 + source_sequence_id % 11) AS p0,
         (1 + source_sequence_id % 5)::DOUBLE / (3 + source_sequence_id % 7 + source_sequence_id % 5 + source_sequence_id % 11) AS p1,
         (1 + source_sequence_id % 11)::DOUBLE / (3 + source_sequence_id % 7 + source_sequence_id % 5 + source_sequence_id % 11) AS p2
  FROM labeled
),
pred AS (SELECT *, greatest(p0, p1, p2) AS confidence, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM pr0)"""
)


def probs():
    return [F.col("p0"), F.col("p1"), F.col("p2")]


def predictions(df: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model: probabilities by arithmetic on the sequence id."""
    s = F.col("source_sequence_id")
    total = 3 + s % 7 + s % 5 + s % 11
    out = df.withColumns({f"p{k}": (1 + s % m).cast("double") / total for k, m in enumerate((7, 5, 11))})
    out = out.withColumn("y", F.when(F.col("label") == "DOWN", 0).when(F.col("label") == "FLAT", 1).otherwise(2))
    return out.withColumns({"confidence": F.greatest(*probs()), "prediction": argmax(probs())})


def predicted(spark, sf_dir):
    return predictions(labeled(spark, sf_dir))


CM_SQL = (
    PREDICT_SQL
    + """,
cm AS (SELECT k.y, count_if(prediction = 0) AS pred_0, count_if(prediction = 1) AS pred_1, count_if(prediction = 2) AS pred_2 FROM (VALUES (0), (1), (2)) k(y) LEFT JOIN pred ON pred.y = k.y GROUP BY k.y),
tt AS (SELECT sum(pred_0) AS t0, sum(pred_1) AS t1, sum(pred_2) AS t2 FROM cm),
rp0 AS (SELECT y, CASE y WHEN 0 THEN pred_0 WHEN 1 THEN pred_1 ELSE pred_2 END AS hits, CASE y WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS said, pred_0 + pred_1 + pred_2 AS support FROM cm, tt),
rp1 AS (SELECT *, coalesce(hits::DOUBLE / nullif(said, 0), 0) AS p, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS r FROM rp0),
rp AS (SELECT y, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, support, hits FROM rp1)"""
)


@query("confusion", with_(CM_SQL, "SELECT y, pred_0::BIGINT AS pred_0, pred_1::BIGINT AS pred_1, pred_2::BIGINT AS pred_2 FROM cm"))
def confusion(spark, sf_dir):
    return metrics.confusion(predicted(spark, sf_dir))


@query("class_report", with_(CM_SQL, "SELECT y, precision, recall, f1, support::BIGINT AS support FROM rp"))
def class_report(spark, sf_dir):
    return metrics.class_report(metrics.confusion(predicted(spark, sf_dir))).drop("hits")


@query(
    "balanced_acc_macro_f1",
    with_(CM_SQL, "SELECT round(sum(hits)::DOUBLE / sum(support), 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, sum(support)::BIGINT AS rows FROM rp"),
)
def balanced_acc_macro_f1(spark, sf_dir):
    out = metrics.summary(metrics.class_report(metrics.confusion(predicted(spark, sf_dir))))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")})


@query("inversions", with_(CM_SQL, "SELECT (sum(CASE WHEN y = 0 THEN pred_2 WHEN y = 2 THEN pred_0 ELSE 0 END))::BIGINT AS inversions, round(sum(CASE WHEN y = 0 THEN pred_2 WHEN y = 2 THEN pred_0 ELSE 0 END)::DOUBLE / sum(CASE WHEN y <> 1 THEN pred_0 + pred_1 + pred_2 END), 9) AS rate FROM cm"))
def inversions(spark, sf_dir):
    """Predictions opposite to a directional truth."""
    d = predicted(spark, sf_dir).where("y <> 1")
    n = F.count_if(((F.col("y") == 0) & (F.col("prediction") == 2)) | ((F.col("y") == 2) & (F.col("prediction") == 0)))
    return d.agg(n.alias("inversions"), F.round(ratio(n, F.count(F.lit(1))), 9).alias("rate"))


@query("quality_labels_report", "SELECT count(*) AS rows, count_if(quality = 1 AND toxic = 0) AS agree, round(avg((quality = 1 - toxic)::INT), 9) AS accuracy FROM labels")
def quality_labels_report(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("agree"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")), 9).alias("accuracy"))


@query(
    "nll_brier",
    with_(
        PREDICT_SQL,
        "SELECT round(-avg(ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15))), 8) AS nll, round(avg(pow(p0 - (y = 0)::INT, 2) + pow(p1 - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2)), 8) AS brier, count(*) AS rows FROM pred",
    ),
)
def nll_brier(spark, sf_dir):
    y = F.col("y")
    return predicted(spark, sf_dir).agg(F.round(metrics.nll(y, probs()), 8).alias("nll"), F.round(metrics.brier(y, probs()), 8).alias("brier"), F.count(F.lit(1)).alias("rows"))


ECE_SQL = (
    PREDICT_SQL
    + """,
eb AS (SELECT k::INT AS bin, k * (1.0::DOUBLE / 10) AS lo, CASE WHEN k = 9 THEN 1.1 ELSE (k + 1) * (1.0::DOUBLE / 10) END AS hi FROM range(10) t(k)),
bins AS (SELECT bin, lo, count(confidence) AS n, coalesce(avg((prediction = y)::INT), 0) AS accuracy, coalesce(avg(confidence), 0) AS confidence FROM eb LEFT JOIN pred ON confidence >= lo AND confidence < hi GROUP BY bin, lo)"""
)


@query("ece_bins", with_(ECE_SQL, "SELECT bin, lo, n, round(accuracy, 9) AS accuracy, round(confidence, 9) AS confidence FROM bins"))
def ece_bins(spark, sf_dir):
    out = metrics.reliability(predicted(spark, sf_dir), "confidence", F.col("prediction") == F.col("y"))
    return out.select("bin", "lo", "n", F.round("accuracy", 9).alias("accuracy"), F.round("confidence", 9).alias("confidence"))


@query("ece", with_(ECE_SQL, "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece, sum(n)::BIGINT AS rows FROM bins"))
def ece(spark, sf_dir):
    return metrics.ece(metrics.reliability(predicted(spark, sf_dir), "confidence", F.col("prediction") == F.col("y"))).withColumn("ece", F.round("ece", 9))


@query(
    "coverage_curve",
    with_(
        PREDICT_SQL,
        "SELECT t.threshold::DOUBLE AS threshold, count_if(confidence >= t.threshold::DOUBLE) AS covered, round(avg((confidence >= t.threshold::DOUBLE)::INT), 9) AS coverage, round(avg(CASE WHEN confidence >= t.threshold::DOUBLE THEN (prediction = y)::INT END), 9) AS accuracy FROM pred, (VALUES (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) t(threshold) GROUP BY t.threshold",
    ),
)
def coverage_curve(spark, sf_dir):
    out = metrics.coverage(predicted(spark, sf_dir), "confidence", F.col("prediction") == F.col("y"), [0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    return out.withColumns({"coverage": F.round("coverage", 9), "accuracy": F.round("accuracy", 9)})


@query(
    "softmax_temperature",
    with_(
        PREDICT_SQL,
        """, z AS (SELECT market_id, asset_id, grid_timestamp_ms, exp((ln(p0) - ln(confidence)) / 0.8) AS a, exp((ln(p1) - ln(confidence)) / 0.8) AS b, exp((ln(p2) - ln(confidence)) / 0.8) AS c FROM pred)
SELECT market_id, asset_id, grid_timestamp_ms, round(a / (a + b + c), 9) AS q0, round(b / (a + b + c), 9) AS q1, round(c / (a + b + c), 9) AS q2 FROM z""",
    ),
)
def softmax_temperature(spark, sf_dir):
    q = softmax([F.log(p) for p in probs()], 0.8)
    return predicted(spark, sf_dir).select("market_id", "asset_id", "grid_timestamp_ms", *[F.round(x, 9).alias(f"q{k}") for k, x in enumerate(q)])


_TEMPERATURES = [0.5, 0.75, 1.0, 1.5, 2.0, 4.0]


@query(
    "temperature_grid",
    with_(
        PREDICT_SQL,
        """, z AS (SELECT t::DOUBLE AS temperature, y, ln(p0) / t::DOUBLE AS a, ln(p1) / t::DOUBLE AS b, ln(p2) / t::DOUBLE AS c FROM pred, (VALUES (0.5), (0.75), (1.0), (1.5), (2.0), (4.0)) v(t))
SELECT temperature, round(avg(ln(exp(a) + exp(b) + exp(c)) - CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END), 8) AS nll FROM z GROUP BY temperature""",
    ),
)
def temperature_grid(spark, sf_dir):
    df = predicted(spark, sf_dir).withColumns({f"z{k}": F.log(p) for k, p in enumerate(probs())})
    return metrics.temperature_grid(df, "y", ["z0", "z1", "z2"], _TEMPERATURES).withColumn("nll", F.round("nll", 8))


@query(
    "window_diagnostics",
    with_(
        PREDICT_SQL,
        """, di AS (SELECT grid_timestamp_ms, row_number() OVER (ORDER BY grid_timestamp_ms) - 1 AS k FROM (SELECT DISTINCT grid_timestamp_ms FROM pred)),
wd AS (SELECT * FROM (VALUES ('early', 0, 199), ('middle', 250, 449), ('late', 500, 649)) t(win, a, b)),
x AS (SELECT win, y, prediction, confidence FROM pred JOIN di USING (grid_timestamp_ms) JOIN wd ON k BETWEEN a AND b)
SELECT win AS "window", count(*) AS rows, greatest(count(*) // 10, 1) AS n_eff, count_if(y = 0) AS down, count_if(y = 1) AS flat, count_if(y = 2) AS up,
  round(greatest(count_if(y = 0), count_if(y = 1), count_if(y = 2))::DOUBLE / count(*), 9) AS majority, round(avg((y = prediction)::INT), 9) AS accuracy,
  round(sqrt(avg((y = prediction)::INT) * (1 - avg((y = prediction)::INT)) / count(*)), 9) AS accuracy_se, round(avg(confidence), 9) AS mean_confidence, round(median(confidence), 9) AS median_confidence
FROM x GROUP BY win""",
    ),
)
def window_diagnostics(spark, sf_dir):
    df = split.named_windows(predicted(spark, sf_dir), "grid_timestamp_ms", [("early", 0, 199), ("middle", 250, 449), ("late", 500, 649)])
    n, acc = F.count(F.lit(1)), F.avg((F.col("y") == F.col("prediction")).cast("int"))
    by = [F.count_if(F.col("y") == k) for k in range(3)]
    return df.groupBy("window").agg(
        n.alias("rows"), F.greatest(F.floor(n / 10).cast("long"), F.lit(1)).alias("n_eff"), by[0].alias("down"), by[1].alias("flat"), by[2].alias("up"),
        F.round(F.greatest(*by) / n, 9).alias("majority"), F.round(acc, 9).alias("accuracy"), F.round(F.sqrt(acc * (1 - acc) / n), 9).alias("accuracy_se"),
        F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.median("confidence"), 9).alias("median_confidence"),
    )


@query("majority_baseline", with_(PREDICT_SQL, "SELECT y AS majority_class, n AS hits, round(n::DOUBLE / (SELECT count(*) FROM pred), 9) AS accuracy FROM (SELECT y, count(*) AS n FROM pred GROUP BY y) ORDER BY n DESC, y LIMIT 1"))
def majority_baseline(spark, sf_dir):
    per = predicted(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("m"), F.sum("n").alias("t")).select((-F.col("m.y")).alias("majority_class"), F.col("m.n").alias("hits"), F.round(ratio(F.col("m.n"), F.col("t")), 9).alias("accuracy"))


@query("label_counts", with_(LABEL_SQL, "SELECT label, count(*) AS rows, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM labeled GROUP BY label"))
def label_counts(spark, sf_dir):
    per = labeled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    total = per.agg(F.sum("rows").alias("t"))
    return per.join(F.broadcast(total)).select("label", "rows", F.round(F.col("rows") / F.col("t"), 9).alias("share"))  # one row


@query("label_moves", with_(LABEL_SQL, "SELECT label, count(*) AS rows, round(avg(delta), 9) AS mean, round(min(delta), 9) AS min, round(max(delta), 9) AS max FROM labeled GROUP BY label"))
def label_moves(spark, sf_dir):
    return labeled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("delta"), 9).alias("mean"), F.round(F.min("delta"), 9).alias("min"), F.round(F.max("delta"), 9).alias("max"))


@query(
    "multi_run_stats",
    with_(PREDICT_SQL, """, r AS (SELECT market_id AS run, asset_id AS model, avg((y = prediction)::INT) AS acc FROM pred GROUP BY ALL)
SELECT model, count(*) AS runs, round(avg(acc), 9) AS mean, round(stddev_pop(acc), 9) AS std, round(min(acc), 9) AS min, round(max(acc), 9) AS max FROM r GROUP BY model"""),
)
def multi_run_stats(spark, sf_dir):
    r = predicted(spark, sf_dir).groupBy(F.col("market_id").alias("run"), F.col("asset_id").alias("model")).agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("acc"))
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), *[F.round(f("acc"), 9).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


@query(
    "median_regimes",
    with_(
        PREDICT_SQL,
        """, th AS (SELECT quantile_cont(ask - bid, 0.5) AS s, quantile_cont(confidence, 0.5) AS c FROM pred)
SELECT CASE WHEN ask - bid <= s THEN 'TIGHT' ELSE 'WIDE' END AS spread_regime, CASE WHEN confidence >= 0.55 THEN 'HIGH' ELSE 'LOW' END AS confidence_regime, count(*) AS rows, round(avg((y = prediction)::INT), 9) AS accuracy FROM pred, th GROUP BY ALL""",
    ),
)
def median_regimes(spark, sf_dir):
    df = predicted(spark, sf_dir).withColumn("s", F.col("ask") - F.col("bid"))
    th = df.agg(F.percentile("s", 0.5).alias("cut"))
    out = df.join(F.broadcast(th))  # one row
    by = [F.when(F.col("s") <= F.col("cut"), "TIGHT").otherwise("WIDE").alias("spread_regime"), F.when(F.col("confidence") >= 0.55, "HIGH").otherwise("LOW").alias("confidence_regime")]
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col("y") == F.col("prediction")).cast("int")), 9).alias("accuracy"))


_CORR = ["mid_price", "spread", "microprice", "depth_imbalance", "mid_return_1s", "bid_change_1s"]


@query(
    "corr_pairs",
    with_(FEATURES_SQL, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS correlation, abs(corr({a}, {b})) >= 0.95 AS redundant FROM feat" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])),
)
def corr_pairs(spark, sf_dir):
    out = stats.correlations(featured(spark, sf_dir), _CORR)
    return out.select("a", "b", F.round("correlation", 7).alias("correlation"), (F.abs("correlation") >= 0.95).alias("redundant"))


@query(
    "ablation_groups",
    with_(
        FEATURES_SQL,
        "SELECT 'price' AS grp, count(mid_price) + count(microprice) AS cells FROM feat UNION ALL SELECT 'returns', count(mid_return_1s) + count(mid_return_3s) + count(mid_return_5s) FROM feat UNION ALL SELECT 'liquidity', count(spread) + count(spread_bps) + count(depth_imbalance) FROM feat",
    ),
)
def ablation_groups(spark, sf_dir):
    """Feature groups as projections; cells that are there."""
    groups = {"price": ["mid_price", "microprice"], "returns": ["mid_return_1s", "mid_return_3s", "mid_return_5s"], "liquidity": ["spread", "spread_bps", "depth_imbalance"]}
    one = featured(spark, sf_dir).agg(*[F.count(c).alias(c) for cs in groups.values() for c in cs])
    items = [F.struct(F.lit(g).alias("grp"), sum([F.col(c) for c in cs[1:]], F.col(cs[0])).alias("cells")) for g, cs in groups.items()]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


@query(
    "feature_stats",
    with_(
        FEATURES_SQL,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS present, count(*) - count({c}) AS missing, CAST(count_if(isnan({c})) AS BIGINT) AS nan, CAST(count_if(isinf({c})) AS BIGINT) AS infinite, count(DISTINCT round({c}, 8)) AS distinct_values, round(avg({c}), 8) AS mean, "
            f"round(stddev_samp({c}), 8) AS std, round(min({c}), 9) AS min, round(max({c}), 9) AS max, coalesce(stddev_samp({c}) < 1e-12, true) AS constant, coalesce(stddev_samp({c}) < 1e-6, true) AS near_constant FROM feat"
            for c in FEATURES
        ),
    ),
)
def feature_stats(spark, sf_dir):
    """All eleven features: what is there, missing, not a number or infinite, and how much varies."""
    df = featured(spark, sf_dir).select(*FEATURES)
    long = df.unpivot([], FEATURES, "feature", "v")
    v, spread = F.col("v"), F.stddev_samp("v")
    return long.groupBy("feature").agg(
        F.count(v).alias("present"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.count_distinct(F.round(v, 8)).alias("distinct_values"), F.round(F.avg(v), 8).alias("mean"), F.round(spread, 8).alias("std"), F.round(F.min(v), 9).alias("min"), F.round(F.max(v), 9).alias("max"),
        F.coalesce(spread < 1e-12, F.lit(True)).alias("constant"), F.coalesce(spread < 1e-6, F.lit(True)).alias("near_constant"),
    )


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    return stats.block_bootstrap(labeled(spark, sf_dir), "delta", ["grid_timestamp_ms", "market_id", "asset_id"])


@query("temperature_fit")
def temperature_fit(spark, sf_dir):
    df = predicted(spark, sf_dir).select("y", *[F.log(p).alias(f"z{k}") for k, p in enumerate(probs())])
    t = metrics.fit_temperature(df, "y", ["z0", "z1", "z2"], high=1000.0, tolerance=1e-3)
    return spark.createDataFrame([(t,)], "temperature double")


@query("embedding_scale", "SELECT label, count(*) AS rows, round(avg(list_sum(embedding::DOUBLE[])), 6) AS mean_sum, round(max(list_max(embedding::DOUBLE[])), 6) AS top FROM embeddings GROUP BY label")
def embedding_scale(spark, sf_dir):
    """Array arithmetic without unnesting."""
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)), 6).alias("mean_sum"), F.round(F.max(F.array_max("x")), 6).alias("top"))


