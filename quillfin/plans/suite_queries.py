"""Queries on validator suites, market-snapped splits and least squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import STREAM
from ..operators import rules, split, stats
from .base import FEATURES_SQL, QUOTES_SQL, events, featured, query, table, with_

_MINUTES = 1_200_000
#: Quotes as candles of sessions, some of them broken in each way.
_CANDLES = """, k AS (SELECT market_id AS session, sequence_id, timestamp_ms - CASE WHEN sequence_id % 43 = 0 THEN 3600000 ELSE 0 END AS collected_at, sequence_id - CASE WHEN sequence_id % 29 = 0 THEN sequence_id % 7 ELSE 0 END AS record_id,
  CASE WHEN sequence_id % 31 = 0 THEN NULL ELSE asset_id END AS symbol, timestamp_ms // 60000 * 60000 AS source_timestamp, CASE WHEN sequence_id % 37 = 0 THEN -bid ELSE bid END AS open,
  CASE WHEN sequence_id % 41 = 0 THEN bid / 2 ELSE ask END AS high, bid AS low, bid AS close, CASE WHEN sequence_id % 47 = 0 THEN -1.0::DOUBLE ELSE bid_size END AS volume FROM q),
k1 AS (SELECT *, symbol IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND volume IS NOT NULL AS there, row_number() OVER (PARTITION BY session, record_id ORDER BY sequence_id) > 1 AS again,
  collected_at < lag(collected_at) OVER s AS back, source_timestamp < lag(source_timestamp) OVER s AS src, collected_at - lag(collected_at) OVER (PARTITION BY session ORDER BY collected_at, sequence_id) AS pause
  FROM k WINDOW s AS (PARTITION BY session ORDER BY sequence_id)),
k2 AS (SELECT session, count_if(NOT there) AS required_fields, count_if(there AND least(open, high, low, close) <= 0) AS positive_prices, count_if(there AND (high < low OR high < open OR high < close)) AS high_low_validity,
  count_if(there AND volume < 0) AS non_negative_volume, count_if(again) AS duplicate_records, count_if(back) AS timestamp_ordering, count_if(pause = 0) AS duplicate_timestamps, count_if(pause > 3600000) AS missing_intervals,
  count_if(src) AS candle_source_timestamps FROM k1 GROUP BY 1),
ch AS (UNPIVOT k2 ON * EXCLUDE (session) INTO NAME "check" VALUE observed)"""


def _candles(spark, sf_dir):
    k, c = F.col("sequence_id"), F.col
    every = lambda n, then, other: F.when(k % n == 0, then).otherwise(other)
    return events(spark, sf_dir).select(
        c("market_id").alias("session"), k, (c("timestamp_ms") - every(43, 3_600_000, 0)).alias("collected_at"), (k - every(29, k % 7, 0)).alias("record_id"), F.lit("feed").alias("source"),
        every(31, None, c("asset_id")).alias("symbol"), (F.floor(c("timestamp_ms") / 60_000) * 60_000).alias("source_timestamp"), every(37, -c("bid"), c("bid")).alias("open"),
        every(41, c("bid") / 2, c("ask")).alias("high"), c("bid").alias("low"), c("bid").alias("close"), every(47, -1.0, c("bid_size")).alias("volume"),
    )


def _candle_checks(spark, sf_dir):
    return rules.validated(_candles(spark, sf_dir), ["session"], rules.candle_rules("sequence_id", "collected_at", ["session"], _MINUTES))


@query("session_checks", with_(QUOTES_SQL, _CANDLES + """ SELECT session, "check", observed, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ch"""))
def session_checks(spark, sf_dir):
    """The nine checks on each session's candles."""
    return _candle_checks(spark, sf_dir)


@query("session_verdicts", with_(QUOTES_SQL, _CANDLES + " SELECT session, count_if(observed > 0) AS failed, CAST(0 AS BIGINT) AS warned, CASE WHEN count_if(observed > 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ch GROUP BY 1"))
def session_verdicts(spark, sf_dir):
    return rules.verdict(_candle_checks(spark, sf_dir), ["session"])


@query(
    "depth_checks",
    with_(
        QUOTES_SQL,
        """, d AS (SELECT market_id, bid, ask, bid_size, ask_size, sequence_id, timestamp_ms - CASE WHEN sequence_id % 23 = 0 THEN 7200000 ELSE 0 END AS id FROM q),
e AS (SELECT *, id <= coalesce(lag(id) OVER (PARTITION BY market_id ORDER BY sequence_id), -1) AS back FROM d),
f AS (SELECT market_id, count_if(CASE WHEN sequence_id % 17 = 0 THEN ask + 0.5 ELSE bid END > ask) AS l2_uncrossed_books, count_if(back) AS l2_monotonic_sequence, count_if(bid - 0.05 <= 0 OR (sequence_id % 19 = 0)) AS l2_valid_levels FROM e GROUP BY 1),
g AS (UNPIVOT f ON * EXCLUDE (market_id) INTO NAME "check" VALUE observed)
SELECT market_id, "check", observed, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""",
    ),
)
def depth_checks(spark, sf_dir):
    """Depth of two levels a side made from each quote, and the checks on it."""
    k, c = F.col("sequence_id"), F.col
    level = lambda p, s: F.struct(p.cast("double").alias("price"), s.cast("double").alias("size"))
    best = F.when(k % 17 == 0, c("ask") + 0.5).otherwise(c("bid"))
    d = events(spark, sf_dir).select(
        "market_id", k, (c("timestamp_ms") - F.when(k % 23 == 0, 7_200_000).otherwise(0)).alias("last_update_id"),
        F.array(level(c("bid") - 0.05, c("bid_size")), level(best, c("bid_size"))).alias("bids"), F.array(level(c("ask"), F.when(k % 19 == 0, -1.0).otherwise(c("ask_size"))), level(c("ask") + 0.05, c("ask_size"))).alias("asks"),
    )
    return rules.validated(d, ["market_id"], rules.depth_rules("sequence_id", ["market_id"]))


_SNAPS = """, s AS (SELECT market_id, asset_id, sequence_id, bid AS best_bid, CASE WHEN sequence_id % 53 = 0 THEN bid - 0.01 ELSE ask END AS best_ask, CASE WHEN sequence_id % 59 = 0 THEN NULL ELSE (bid + ask) / 2.0 END AS mid_price, bid_size AS bid_depth, ask_size AS ask_depth FROM q),
s1 AS (SELECT *, best_ask - best_bid AS spread, lag(mid_price) OVER (PARTITION BY market_id, asset_id ORDER BY sequence_id) AS p FROM s)"""


def _snapshots(spark, sf_dir):
    k, c = F.col("sequence_id"), F.col
    s = events(spark, sf_dir).select(
        *STREAM, k, c("bid").alias("best_bid"), F.when(k % 53 == 0, c("bid") - 0.01).otherwise(c("ask")).alias("best_ask"), F.when(k % 59 == 0, None).otherwise((c("bid") + c("ask")) / 2.0).alias("mid_price"),
        c("bid_size").alias("bid_depth"), c("ask_size").alias("ask_depth"),
    )
    return s.withColumn("spread", c("best_ask") - c("best_bid"))


@query(
    "snapshot_checks",
    with_(
        QUOTES_SQL,
        _SNAPS
        + """, a AS (SELECT market_id, asset_id, count_if(best_bid IS NULL) AS missing_best_bid, count_if(best_ask IS NULL) AS missing_best_ask, count_if(mid_price IS NULL) AS missing_mid_price, count_if(spread IS NULL) AS missing_spread,
  count_if(bid_depth IS NULL) AS missing_bid_depth, count_if(ask_depth IS NULL) AS missing_ask_depth, count_if(mid_price <= 0) AS mid_price_positive, count_if(best_bid > best_ask) AS bid_over_ask, count_if(spread < 0) AS negative_spread,
  count_if(mid_price <> p) AS price_movement FROM s1 GROUP BY ALL), u AS (UNPIVOT a ON * EXCLUDE (market_id, asset_id) INTO NAME "check" VALUE observed)
SELECT market_id, asset_id, "check", observed, CASE WHEN "check" = 'price_movement' THEN CASE WHEN observed > 0 THEN 'PASS' ELSE 'WARNING' END WHEN observed = 0 THEN 'PASS' WHEN starts_with("check", 'missing') THEN 'WARNING' ELSE 'FAIL' END AS status FROM u""",
    ),
)
def snapshot_checks(spark, sf_dir):
    """The first generation's checks on each stream."""
    return rules.validated(_snapshots(spark, sf_dir), STREAM, rules.snapshot_rules("sequence_id", STREAM))


@query(
    "snapshot_movement",
    with_(
        QUOTES_SQL,
        _SNAPS
        + """ SELECT market_id, asset_id, count(*) AS rows, count(DISTINCT mid_price) AS distinct_prices, count_if(mid_price <> p) AS changes, round(count_if(mid_price <> p)::DOUBLE / count(*), 9) AS change_ratio,
  round(avg(mid_price / nullif(p, 0) - 1), 7) AS mean_return, round(stddev_samp(mid_price / nullif(p, 0) - 1), 7) AS std_return FROM s1 GROUP BY ALL""",
    ),
)
def snapshot_movement(spark, sf_dir):
    out = rules.movement(_snapshots(spark, sf_dir), STREAM, "sequence_id")
    return out.withColumns({"change_ratio": F.round("change_ratio", 9), "mean_return": F.round("mean_return", 7), "std_return": F.round("std_return", 7)})


@query(
    "split_snapped",
    """WITH r AS (SELECT o_orderkey, 'M' || (extract('month' FROM o_orderdate) + 12 * extract('year' FROM o_orderdate)) AS market_id, epoch_us(o_orderdate::TIMESTAMP) // 1000 + 864000000 * (extract('month' FROM o_orderdate) + 12 * extract('year' FROM o_orderdate)) AS t FROM orders),
a AS (SELECT market_id, count(*) AS rows, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1),
b AS (SELECT lo, (sum(rows) OVER w - rows)::DOUBLE / sum(rows) OVER () AS s, lo - max(hi) OVER (ORDER BY lo, market_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM a WINDOW w AS (ORDER BY lo, market_id)),
c AS (SELECT x.lo AS one, y.lo AS two FROM b x JOIN b y ON x.s < y.s WHERE x.gap >= 432000000 AND y.gap >= 432000000
  ORDER BY round(abs(x.s - 0.7::DOUBLE) + abs(y.s - x.s - 0.15::DOUBLE) + abs(1 - y.s - 0.15::DOUBLE), 12), 1, 2 LIMIT 1)
SELECT o_orderkey, market_id, CASE WHEN t < one THEN 'train' WHEN t < two THEN 'validation' ELSE 'test' END AS split FROM r, c""",
)
def split_snapped(spark, sf_dir):
    """Every order with its part; months stand in for markets, moved ten days apart each."""
    month = F.month("o_orderdate") + 12 * F.year("o_orderdate")
    at = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long") + F.lit(864_000_000) * month.cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("M"), month.cast("string")).alias("market_id"), at.alias("t"))
    return split.snapped_split(rows, 432_000_000, "t").select("o_orderkey", "market_id", "split")


@query(
    "ols_ablation",
    with_(
        FEATURES_SQL,
        """, ols_w AS (SELECT min(grid_timestamp_ms) + (max(grid_timestamp_ms) - min(grid_timestamp_ms)) // 2 AS mid_ms FROM feat),
ols_v AS (SELECT grid_timestamp_ms <= mid_ms AS tr, mid_return_1s AS x, depth_imbalance AS z, CASE label WHEN 'UP' THEN 1.0::DOUBLE WHEN 'DOWN' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM feat, ols_w WHERE mid_return_1s IS NOT NULL AND depth_imbalance IS NOT NULL),
ols_m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(z) AS sz, corr(x, z) AS r, covar_pop(x, y) / stddev_pop(x) AS cx, covar_pop(z, y) / stddev_pop(z) AS cz FROM ols_v WHERE tr),
ols_t AS (SELECT 'returns' AS model, cx AS bx, 0.0::DOUBLE AS bz, 1.0::DOUBLE AS condition FROM ols_m UNION ALL SELECT 'returns_depth', (cx - r * cz) / (1 - r * r), (cz - r * cx) / (1 - r * r), (1 + abs(r)) / (1 - abs(r)) FROM ols_m),
ols_f AS (SELECT model, tr, 1 - sum((y - my - bx * (x - mx) / sx - bz * (z - mz) / sz) ** 2) / (count(*) * var_pop(y)) AS r2 FROM ols_v, ols_m, ols_t GROUP BY ALL),
ols_o AS (SELECT model, 'intercept' AS term, my AS beta, condition FROM ols_t, ols_m UNION ALL SELECT model, 'mid_return_1s', bx, condition FROM ols_t UNION ALL SELECT model, 'depth_imbalance', bz, condition FROM ols_t WHERE model <> 'returns')
SELECT model, term, round(beta, 7) AS beta, round(a.r2, 7) AS r2_train, round(b.r2, 7) AS r2_validation, round(condition, 7) AS condition FROM ols_o JOIN ols_f a USING (model) JOIN ols_f b USING (model) WHERE a.tr AND NOT b.tr""",
    ),
)
def ols_ablation(spark, sf_dir):
    """What depth adds to returns in explaining the direction: fitted on the first half of the time, judged on the second."""
    f = featured(spark, sf_dir).select("grid_timestamp_ms", "mid_return_1s", "depth_imbalance", "label")
    ends = f.agg(F.min("grid_timestamp_ms").alias("_lo"), F.max("grid_timestamp_ms").alias("_hi"))
    half = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2)
    part = F.when(F.col("grid_timestamp_ms") <= half, "train").otherwise("validation")
    y = F.when(F.col("label") == "UP", 1.0).when(F.col("label") == "DOWN", -1.0).otherwise(0.0)
    rows = f.join(F.broadcast(ends)).select("mid_return_1s", "depth_imbalance", y.alias("y"), part.alias("part"))  # one row
    models = [("returns", ["mid_return_1s"]), ("returns_depth", ["mid_return_1s", "depth_imbalance"])]
    one, two = (stats.least_squares(rows, "y", xs, "part").select(F.lit(n).alias("model"), "term", *[F.round(c, 7).alias(c) for c in ("beta", "r2_train", "r2_validation", "condition")]) for n, xs in models)
    return one.union(two)
