"""Queries on grids, as-of joins, labels and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quotes import mid, microprice, ratio, spread
from ..model import FEATURES, HOURS
from ..operators import asof, features, label
from .base import FEATURES_SQL, GRID_SQL, LABEL_SQL, QUOTES_SQL, events, featured, features_sql, grid, labeled, query, table, with_

_GRID_COLUMNS = "grid_timestamp_ms, source_timestamp_ms, source_sequence_id, market_id, asset_id, bid, ask, bid_size, ask_size, event_age_ms, is_stale"


@query("asof_grid", with_(GRID_SQL, f"SELECT {_GRID_COLUMNS} FROM grid"))
def asof_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@query(
    "asof_tolerance",
    with_(
        QUOTES_SQL,
        f"""SELECT a.sequence_id, a.market_id, a.timestamp_ms, a.bid AS up_bid, a.ask AS up_ask,
       CASE WHEN a.timestamp_ms - d.timestamp_ms <= {HOURS.stale} THEN d.sequence_id END AS down_sequence_id,
       CASE WHEN a.timestamp_ms - d.timestamp_ms <= {HOURS.stale} THEN d.bid END AS down_bid,
       CASE WHEN a.timestamp_ms - d.timestamp_ms <= {HOURS.stale} THEN d.ask END AS down_ask
FROM (SELECT * FROM q WHERE asset_id = 'UP') a
ASOF LEFT JOIN (SELECT * FROM q WHERE asset_id = 'DOWN' QUALIFY row_number() OVER (PARTITION BY market_id, timestamp_ms ORDER BY sequence_id DESC) = 1) d
  ON a.market_id = d.market_id AND a.timestamp_ms >= d.timestamp_ms""",
    ),
)
def asof_tolerance(spark, sf_dir):
    q = events(spark, sf_dir)
    up = q.where("asset_id = 'UP'").select("sequence_id", "market_id", "timestamp_ms", F.col("bid").alias("up_bid"), F.col("ask").alias("up_ask"))
    out = asof.asof_backward(up, q.where("asset_id = 'DOWN'"), ["market_id"], "timestamp_ms", "timestamp_ms", "sequence_id", ["bid", "ask"], tolerance=HOURS.stale)
    return out.select("sequence_id", "market_id", "timestamp_ms", "up_bid", "up_ask", F.col("match.sequence_id").alias("down_sequence_id"), F.col("match.bid").alias("down_bid"), F.col("match.ask").alias("down_ask"))


_DAY = 86_400_000
CANDLE_SQL = (
    QUOTES_SQL
    + f""",
candle AS (
  SELECT market_id, timestamp_ms // {_DAY} * {_DAY} AS open_time_ms, (timestamp_ms // {_DAY} + 1) * {_DAY} - 1 AS close_time_ms,
         arg_min((bid + ask) / 2.0, (timestamp_ms, sequence_id)) AS open, max((bid + ask) / 2.0) AS high, min((bid + ask) / 2.0) AS low,
         arg_max((bid + ask) / 2.0, (timestamp_ms, sequence_id)) AS close, count(*) AS trades
  FROM q GROUP BY ALL
)"""
)


def candles(q, step: int = _DAY):
    """Open, high, low, close of the mid by market and ``step`` ms."""
    at = F.struct("timestamp_ms", "sequence_id")
    start = (F.floor(F.col("timestamp_ms") / step) * step).cast("long")
    out = q.withColumn("m", mid()).groupBy("market_id", start.alias("open_time_ms"))
    return out.agg(F.min_by("m", at).alias("open"), F.max("m").alias("high"), F.min("m").alias("low"), F.max_by("m", at).alias("close"), F.count(F.lit(1)).alias("trades")).withColumn(
        "close_time_ms", F.col("open_time_ms") + step - 1
    )


@query("candles_daily", with_(CANDLE_SQL, "SELECT * FROM candle"))
def candles_daily(spark, sf_dir):
    return candles(events(spark, sf_dir))


@query(
    "asof_closed_candle",
    with_(
        CANDLE_SQL,
        """SELECT a.sequence_id, a.market_id, c.open_time_ms, c.close AS candle_close
FROM q a ASOF LEFT JOIN candle c ON a.market_id = c.market_id AND a.timestamp_ms >= c.close_time_ms""",
    ),
)
def asof_closed_candle(spark, sf_dir):
    """The last candle that had closed; candles are daily, so days match by equality after a carry."""
    q = events(spark, sf_dir)
    c = candles(q).withColumn("o", F.col("open_time_ms"))
    out = asof.asof_backward(q.select("sequence_id", "market_id", "timestamp_ms"), c, ["market_id"], "timestamp_ms", "close_time_ms", "o", ["open_time_ms", "close"])
    return out.select("sequence_id", "market_id", F.col("match.open_time_ms").alias("open_time_ms"), F.col("match.close").alias("candle_close"))


@query(
    "asof_forward_candle",
    with_(
        CANDLE_SQL,
        f"""SELECT a.sequence_id, a.market_id, c.open_time_ms AS next_open_time_ms, c.open AS next_open
FROM (SELECT *, timestamp_ms + {HOURS.low} AS t FROM q) a ASOF LEFT JOIN candle c ON a.market_id = c.market_id AND a.t <= c.open_time_ms""",
    ),
)
def asof_forward_candle(spark, sf_dir):
    q = events(spark, sf_dir)
    c = candles(q).select("market_id", F.col("open_time_ms").alias("timestamp_ms"), F.col("open_time_ms").alias("sequence_id"), "open")
    out = asof.forward_match(q.select("sequence_id", "market_id", "timestamp_ms"), c, "timestamp_ms", HOURS.low, None, ["open"], keys=["market_id"])
    return out.select("sequence_id", "market_id", F.col("target.timestamp_ms").alias("next_open_time_ms"), F.col("target.open").alias("next_open"))


@query(
    "interval_counts",
    with_(
        GRID_SQL,
        f"""SELECT g.market_id, g.asset_id, g.grid_timestamp_ms, count(q.sequence_id) AS source_events_in_interval
FROM grid g LEFT JOIN q ON g.market_id = q.market_id AND g.asset_id = q.asset_id AND q.timestamp_ms > g.grid_timestamp_ms - {HOURS.step} AND q.timestamp_ms <= g.grid_timestamp_ms
GROUP BY ALL""",
    ),
)
def interval_counts(spark, sf_dir):
    q = events(spark, sf_dir)
    return asof.interval_counts(asof.asof_grid(q, HOURS).select("market_id", "asset_id", "grid_timestamp_ms"), q, HOURS.step)


@query("label_physical", with_(LABEL_SQL, f"SELECT {_GRID_COLUMNS}, label FROM labeled"))
def label_physical(spark, sf_dir):
    return label.clean(labeled(spark, sf_dir))


@query(
    "label_audit",
    with_(
        LABEL_SQL,
        """SELECT grid_timestamp_ms AS current_timestamp, target_timestamp, target_timestamp - grid_timestamp_ms AS physical_horizon_ms, current_mid, target_mid,
       delta, threshold, label, market_id, asset_id, source_sequence_id AS current_sequence_id, target_sequence_id FROM labeled""",
    ),
)
def label_audit(spark, sf_dir):
    return label.audit(labeled(spark, sf_dir))


@query(
    "label_grid_pool",
    with_(
        GRID_SQL,
        f""", f AS (SELECT *, grid_timestamp_ms + {HOURS.low} AS from_ms FROM grid WHERE NOT is_stale),
m AS (
  SELECT f.market_id, f.asset_id, f.grid_timestamp_ms, v.grid_timestamp_ms AS target_timestamp, (f.bid + f.ask) / 2.0 AS c, (v.bid + v.ask) / 2.0 AS t, greatest((f.ask - f.bid) * 0.5, {HOURS.least_move}) AS h
  FROM f ASOF JOIN f v ON f.market_id = v.market_id AND f.asset_id = v.asset_id AND f.from_ms <= v.grid_timestamp_ms
  WHERE v.grid_timestamp_ms <= f.grid_timestamp_ms + {HOURS.high}
)
SELECT market_id, asset_id, grid_timestamp_ms, target_timestamp, CASE WHEN t - c > h THEN 'UP' WHEN t - c < -h THEN 'DOWN' ELSE 'FLAT' END AS label FROM m""",
    ),
)
def label_grid_pool(spark, sf_dir):
    out = label.physical_horizon(grid(spark, sf_dir), None, HOURS)
    return out.select("market_id", "asset_id", "grid_timestamp_ms", F.col("target.timestamp_ms").alias("target_timestamp"), "label")


@query(
    "label_row_shift",
    with_(
        QUOTES_SQL,
        """, s AS (SELECT *, (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS m FROM q),
l AS (SELECT *, lead(m, 5) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id) AS f FROM s)
SELECT market_id, asset_id, sequence_id, m AS now_value, f AS future_value, CASE WHEN f - m > 0 THEN 'UP' WHEN f - m < 0 THEN 'DOWN' ELSE 'FLAT' END AS label
FROM l WHERE f IS NOT NULL""",
    ),
)
def label_row_shift(spark, sf_dir):
    out = label.row_shift(events(spark, sf_dir), microprice(), 5, ["timestamp_ms", "sequence_id"], ["market_id", "asset_id"])
    return out.select("market_id", "asset_id", "sequence_id", "now_value", "future_value", "label")


@query(
    "label_candle",
    with_(
        CANDLE_SQL,
        f"""SELECT c.market_id, c.open_time_ms, c.close, n.close AS target_close, CASE WHEN n.close > c.close THEN 1 WHEN n.close IS NOT NULL THEN 0 END AS target_up
FROM candle c LEFT JOIN candle n ON c.market_id = n.market_id AND n.open_time_ms = c.open_time_ms + {5 * _DAY}""",
    ),
)
def label_candle(spark, sf_dir):
    """The candle exactly five steps on, as an equality join."""
    c = candles(events(spark, sf_dir)).select("market_id", "open_time_ms", "close")
    n = c.select("market_id", (F.col("open_time_ms") - 5 * _DAY).alias("open_time_ms"), F.col("close").alias("target_close"))
    return c.join(n, ["market_id", "open_time_ms"], "left").withColumn("target_up", F.when(F.col("target_close") > F.col("close"), 1).when(F.col("target_close").isNotNull(), 0))


@query(
    "label_resolution",
    with_(
        CANDLE_SQL,
        """, w AS (SELECT *, market_id || ':' || (open_time_ms // (5 * 86400000)) AS win FROM candle)
SELECT win, arg_min(open, open_time_ms) AS first_open, arg_max(close, open_time_ms) AS last_close, count(*) AS candles,
       CASE WHEN arg_max(close, open_time_ms) >= arg_min(open, open_time_ms) THEN 'UP' ELSE 'DOWN' END AS label FROM w GROUP BY win""",
    ),
)
def label_resolution(spark, sf_dir):
    c = candles(events(spark, sf_dir)).withColumn("win", F.concat("market_id", F.lit(":"), F.floor(F.col("open_time_ms") / (5 * _DAY)).cast("string")))
    return label.resolution(c, "win", "open_time_ms")


_FEAT = ", ".join(c if not c.startswith("mid_volatility") else f"round({c}, 9) AS {c}" for c in FEATURES)


@query("feat_causal_11", with_(FEATURES_SQL, f"SELECT market_id, asset_id, grid_timestamp_ms, {_FEAT}, label FROM feat"))
def feat_causal_11(spark, sf_dir):
    out = featured(spark, sf_dir).withColumn("mid_volatility_5s", F.round("mid_volatility_5s", 9))
    return out.select("market_id", "asset_id", "grid_timestamp_ms", *FEATURES, "label")


@query(
    "feat_grid_summary",
    with_(
        GRID_SQL + "," + features_sql("grid"),
        """SELECT market_id, asset_id, count(*) AS rows, count(mid_return_1s) AS returns, count(mid_volatility_5s) AS volatilities,
       round(avg(mid_price), 9) AS avg_mid, round(avg(spread_bps), 6) AS avg_spread_bps, round(avg(mid_volatility_5s), 9) AS avg_volatility FROM feat GROUP BY ALL""",
    ),
)
def feat_grid_summary(spark, sf_dir):
    """Eleven features on the regular grid, summed up per stream."""
    f = features.causal(grid(spark, sf_dir))
    return f.groupBy("market_id", "asset_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("mid_return_1s").alias("returns"), F.count("mid_volatility_5s").alias("volatilities"),
        F.round(F.avg("mid_price"), 9).alias("avg_mid"), F.round(F.avg("spread_bps"), 6).alias("avg_spread_bps"), F.round(F.avg("mid_volatility_5s"), 9).alias("avg_volatility"),
    )


_O = "OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id)"


def _rows(n):
    return f"OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


FIRST_SQL = with_(
    QUOTES_SQL,
    f""", s AS (SELECT market_id, asset_id, timestamp_ms, sequence_id, (bid + ask) / 2.0 AS mid_price, ask - bid AS spread, bid_size AS bid_depth, ask_size AS ask_depth,
  (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS microprice FROM q),
r AS (SELECT *, mid_price / lag(mid_price, 1) {_O} - 1 AS return_1, mid_price / lag(mid_price, 5) {_O} - 1 AS return_5, mid_price / lag(mid_price, 10) {_O} - 1 AS return_10 FROM s)
SELECT market_id, asset_id, sequence_id, return_1, return_5, return_10, spread / mid_price * 10000 AS spread_bps,
  (bid_depth - ask_depth) / (bid_depth + ask_depth) AS depth_imbalance, (microprice - mid_price) / mid_price AS microprice_deviation,
  bid_depth - lag(bid_depth) {_O} AS bid_depth_change, ask_depth - lag(ask_depth) {_O} AS ask_depth_change,
  round(CASE WHEN count(return_1) {_rows(10)} = 10 THEN stddev_samp(return_1) {_rows(10)} END, 7) AS volatility_10,
  round(CASE WHEN count(return_1) {_rows(50)} = 50 THEN stddev_samp(return_1) {_rows(50)} END, 7) AS volatility_50,
  mid_price - lag(mid_price, 10) {_O} AS momentum_10
FROM r""",
)


def first_generation(spark, sf_dir):
    q = events(spark, sf_dir)
    snap = q.select("market_id", "asset_id", "timestamp_ms", "sequence_id", mid().alias("mid_price"), spread().alias("spread"), F.col("bid_size").alias("bid_depth"), F.col("ask_size").alias("ask_depth"), microprice().alias("microprice"))
    return features.first_generation(snap, ["timestamp_ms", "sequence_id"], ["market_id", "asset_id"])


@query("feat_gen1_17", FIRST_SQL)
def feat_gen1_17(spark, sf_dir):
    out = first_generation(spark, sf_dir).withColumns({c: F.round(c, 7) for c in ("volatility_10", "volatility_50")})
    names = ["return_1", "return_5", "return_10", "spread_bps", "depth_imbalance", "microprice_deviation", "bid_depth_change", "ask_depth_change", "volatility_10", "volatility_50", "momentum_10"]
    return out.select("market_id", "asset_id", "sequence_id", *names)


@query(
    "feat_time_range_vol",
    with_(
        QUOTES_SQL,
        f""", r AS (SELECT *, (bid + ask) / 2.0 / lag((bid + ask) / 2.0) {_O} - 1 AS r FROM q)
SELECT market_id, asset_id, sequence_id, count(r) OVER w AS returns,
       round(CASE WHEN count(r) OVER w >= 3 THEN stddev_samp(r) OVER w END, 7) AS volatility
FROM r WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY timestamp_ms RANGE BETWEEN {12 * HOURS.step - 1} PRECEDING AND CURRENT ROW)""",
    ),
)
def feat_time_range_vol(spark, sf_dir):
    q = events(spark, sf_dir)
    keys = ["market_id", "asset_id"]
    w = Window.partitionBy(*keys).orderBy("timestamp_ms", "sequence_id")
    r = q.select(*keys, "sequence_id", "timestamp_ms", (ratio(mid(), F.lag(mid()).over(w)) - 1).alias("r"))
    out = features.time_range_volatility(r, F.col("r"), "timestamp_ms", 12 * HOURS.step, keys)
    return out.select(*keys, "sequence_id", F.col("values").alias("returns"), F.round("volatility", 7).alias("volatility"))


_G = "OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms)"


@query(
    "feat_ofi",
    with_(
        LABEL_SQL,
        f""", p AS (SELECT *, lag(bid) {_G} AS b0, lag(ask) {_G} AS a0, lag(bid_size) {_G} AS qb0, lag(ask_size) {_G} AS qa0, grid_timestamp_ms - lag(grid_timestamp_ms) {_G} AS dt FROM labeled),
o AS (SELECT *, CASE WHEN dt = {HOURS.step} THEN
   (CASE WHEN bid > b0 THEN bid_size WHEN bid = b0 THEN bid_size - qb0 ELSE -qb0 END) + (CASE WHEN ask < a0 THEN -ask_size WHEN ask = a0 THEN -(ask_size - qa0) ELSE qa0 END) END AS quote_ofi_raw FROM p)
SELECT market_id, asset_id, grid_timestamp_ms, quote_ofi_raw, quote_ofi_raw / (0.5::DOUBLE * (bid_size + ask_size + qb0 + qa0) + 1e-6) AS quote_ofi_norm FROM o""",
    ),
)
def feat_ofi(spark, sf_dir):
    return features.order_flow(label.clean(labeled(spark, sf_dir)), HOURS.step).select("market_id", "asset_id", "grid_timestamp_ms", "quote_ofi_raw", "quote_ofi_norm")


REGIME_SQL = (
    QUOTES_SQL
    + f""",
r0 AS (SELECT *, (bid + ask) / 2.0 AS m FROM q),
r1 AS (SELECT *, m / lag(m) {_O} - 1 AS r, m / lag(m, 50) {_O} - 1 AS regime_trend, row_number() OVER (ORDER BY timestamp_ms, sequence_id) AS n FROM r0),
r2 AS (SELECT *, round(CASE WHEN count(r) {_rows(50)} = 50 THEN stddev_samp(r) {_rows(50)} END, 9) AS regime_volatility FROM r1),
th AS (SELECT quantile_cont(regime_volatility, 0.5) AS vm, quantile_cont(abs(regime_trend), 0.5) AS tb FROM r2 WHERE timestamp_ms < (SELECT min(timestamp_ms) + 7 * (max(timestamp_ms) - min(timestamp_ms)) // 10 FROM q)),
reg AS (
  SELECT r2.*, CASE WHEN regime_volatility IS NULL OR regime_trend IS NULL THEN 'INSUFFICIENT_HISTORY'
    WHEN regime_trend > tb AND regime_volatility > vm THEN 'TREND_UP_HIGH_VOL' WHEN regime_trend < -tb AND regime_volatility > vm THEN 'TREND_DOWN_HIGH_VOL'
    WHEN regime_trend > tb THEN 'TREND_UP_LOW_VOL' WHEN regime_trend < -tb THEN 'TREND_DOWN_LOW_VOL'
    WHEN regime_volatility > vm THEN 'RANGE_HIGH_VOL' ELSE 'RANGE_LOW_VOL' END AS regime
  FROM r2 CROSS JOIN th
)"""
)


def regimed(spark, sf_dir):
    """Regimes whose thresholds are medians over the first 70 % of time (training) only."""
    q = events(spark, sf_dir).withColumn("mid_price", mid())
    keys = ["market_id", "asset_id"]
    f = features.regime_features(q, ["timestamp_ms", "sequence_id"], keys).withColumn("regime_volatility", F.round("regime_volatility", 9))
    lo, hi = q.agg(F.min("timestamp_ms"), F.max("timestamp_ms")).first()
    if lo is None:
        return f.withColumn("regime", F.lit(None).cast("string"))
    train = f.where(F.col("timestamp_ms") < lo + 7 * (hi - lo) // 10)
    th = train.agg(F.percentile("regime_volatility", 0.5).alias("vm"), F.percentile(F.abs("regime_trend"), 0.5).alias("tb"))
    return f.join(F.broadcast(th)).withColumn("regime", features.regimes(f, F.col("vm"), F.col("tb"))).drop("vm", "tb")  # th is one row


@query("regime_buckets", with_(REGIME_SQL, "SELECT market_id, asset_id, sequence_id, regime FROM reg"))
def regime_buckets(spark, sf_dir):
    return regimed(spark, sf_dir).select("market_id", "asset_id", "sequence_id", "regime")


@query(
    "regime_returns",
    with_(
        REGIME_SQL,
        f""", fr AS (SELECT regime, lead(m, 50) {_O} / m - 1 AS future_return FROM reg)
SELECT regime, count(*) AS rows, count(future_return) AS returns, round(avg(future_return), 8) AS mean_return, round(median(future_return), 8) AS median_return, round(stddev_samp(future_return), 8) AS std_return
FROM fr GROUP BY regime""",
    ),
)
def regime_returns(spark, sf_dir):
    w = Window.partitionBy("market_id", "asset_id").orderBy("timestamp_ms", "sequence_id")
    r = regimed(spark, sf_dir).withColumn("future_return", ratio(F.lead("mid_price", 50).over(w), F.col("mid_price")) - 1)
    x = F.col("future_return")
    return r.groupBy("regime").agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("returns"), F.round(F.avg(x), 8).alias("mean_return"), F.round(F.median(x), 8).alias("median_return"), F.round(F.stddev_samp(x), 8).alias("std_return"))


@query(
    "pair_pivot",
    with_(
        GRID_SQL,
        """SELECT grid_timestamp_ms, market_id || '' AS market_id, max(CASE WHEN asset_id = 'UP' THEN bid END) AS up_bid, max(CASE WHEN asset_id = 'UP' THEN ask END) AS up_ask,
       max(CASE WHEN asset_id = 'DOWN' THEN bid END) AS down_bid, max(CASE WHEN asset_id = 'DOWN' THEN ask END) AS down_ask
FROM grid GROUP BY ALL HAVING count_if(asset_id = 'UP') > 0 AND count_if(asset_id = 'DOWN') > 0""",
    ),
)
def pair_pivot(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("at", F.struct("market_id", "grid_timestamp_ms"))
    return features.pair_pivot(g, "at", "asset_id", ["bid", "ask"]).select("at.grid_timestamp_ms", "at.market_id", "up_bid", "up_ask", "down_bid", "down_ask")


@query(
    "pair_asof",
    with_(
        QUOTES_SQL,
        f""", p AS (
  SELECT a.market_id, a.sequence_id, (a.bid + a.ask) / 2.0 AS up_mid, (d.bid + d.ask) / 2.0 AS down_mid, a.timestamp_ms - d.timestamp_ms AS age
  FROM (SELECT * FROM q WHERE asset_id = 'UP') a ASOF JOIN (SELECT * FROM q WHERE asset_id = 'DOWN' QUALIFY row_number() OVER (PARTITION BY market_id, timestamp_ms ORDER BY sequence_id DESC) = 1) d
  ON a.market_id = d.market_id AND a.timestamp_ms >= d.timestamp_ms)
SELECT market_id, count(*) AS pairs, count_if(age > {HOURS.stale}) AS stale_pairs, round(avg(up_mid + down_mid), 9) AS avg_sum, max(age) AS max_age FROM p GROUP BY ALL""",
    ),
)
def pair_asof(spark, sf_dir):
    q = events(spark, sf_dir)
    up = q.where("asset_id = 'UP'").select("market_id", "sequence_id", "timestamp_ms", mid().alias("up_mid"))
    down = q.where("asset_id = 'DOWN'").withColumn("down_mid", mid())
    p = asof.asof_backward(up, down, ["market_id"], "timestamp_ms", "timestamp_ms", "sequence_id", ["down_mid"]).where("match IS NOT NULL")
    age = F.col("timestamp_ms") - F.col("match.timestamp_ms")
    return p.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(age > HOURS.stale).alias("stale_pairs"), F.round(F.avg(F.col("up_mid") + F.col("match.down_mid")), 9).alias("avg_sum"), F.max(age).alias("max_age")
    )


@query("unique_target", with_(LABEL_SQL, "SELECT market_id, asset_id, target_sequence_id, max(grid_timestamp_ms) AS grid_timestamp_ms, arg_max(label, grid_timestamp_ms) AS label FROM labeled GROUP BY ALL"))
def unique_target(spark, sf_dir):
    """The last row of each target."""
    out = labeled(spark, sf_dir).groupBy("market_id", "asset_id", F.col("target.sequence_id").alias("target_sequence_id"))
    return out.agg(F.max("grid_timestamp_ms").alias("grid_timestamp_ms"), F.max_by("label", "grid_timestamp_ms").alias("label"))


@query(
    "combined_features",
    with_(
        FEATURES_SQL,
        """SELECT a.market_id, a.grid_timestamp_ms, a.mid_price AS mid_price_up, d.mid_price AS mid_price_down, a.spread AS spread_up, d.spread AS spread_down, a.label AS label_up, d.label AS label_down
FROM feat a JOIN feat d ON a.market_id = d.market_id AND a.grid_timestamp_ms = d.grid_timestamp_ms WHERE a.asset_id = 'UP' AND d.asset_id = 'DOWN'""",
    ),
)
def combined_features(spark, sf_dir):
    """Inner join of two feature sets on time, with suffixes."""
    f = featured(spark, sf_dir).select("market_id", "asset_id", "grid_timestamp_ms", "mid_price", "spread", "label")
    side = lambda s, x: f.where(F.col("asset_id") == s).select("market_id", "grid_timestamp_ms", *[F.col(c).alias(f"{c}_{x}") for c in ("mid_price", "spread", "label")])
    return side("UP", "up").join(side("DOWN", "down"), ["market_id", "grid_timestamp_ms"])


@query("file_scan_pruned", "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def file_scan_pruned(spark, sf_dir):
    """Column-pruned scan with a pushed-down filter."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
