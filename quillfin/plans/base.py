"""The shared chain quotes -> grid -> labels -> features, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import HOURS
from ..operators import asof, features, label
from ..sources import quotes
from ..sources.quotes import QUOTES_SQL

QUERIES: dict = {}
ORACLES: dict = {}

GRID_SQL = (
    QUOTES_SQL
    + f""",
u AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, timestamp_ms ORDER BY sequence_id DESC) = 1),
b AS (SELECT market_id, asset_id, (min(timestamp_ms) + {HOURS.step - 1}) // {HOURS.step} * {HOURS.step} AS lo, max(timestamp_ms) // {HOURS.step} * {HOURS.step} AS hi FROM q GROUP BY ALL),
g AS (SELECT market_id, asset_id, unnest(generate_series(lo, hi, {HOURS.step})) AS grid_timestamp_ms FROM b WHERE lo <= hi),
grid AS (
  SELECT g.grid_timestamp_ms, u.timestamp_ms AS source_timestamp_ms, u.sequence_id AS source_sequence_id, g.market_id, g.asset_id,
         u.bid, u.ask, u.bid_size, u.ask_size, g.grid_timestamp_ms - u.timestamp_ms AS event_age_ms,
         g.grid_timestamp_ms - u.timestamp_ms > {HOURS.stale} AS is_stale
  FROM g ASOF JOIN u ON g.market_id = u.market_id AND g.asset_id = u.asset_id AND g.grid_timestamp_ms >= u.timestamp_ms
)"""
)

LABEL_SQL = (
    GRID_SQL
    + f""",
f AS (SELECT *, grid_timestamp_ms + {HOURS.low} AS from_ms FROM grid WHERE NOT is_stale),
v AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, timestamp_ms ORDER BY sequence_id) = 1),
m AS (
  SELECT f.*, v.timestamp_ms AS target_timestamp, v.sequence_id AS target_sequence_id,
         (f.bid + f.ask) / 2.0 AS current_mid, (v.bid + v.ask) / 2.0 AS target_mid, greatest((f.ask - f.bid) * 0.5, {HOURS.least_move}) AS threshold
  FROM f ASOF JOIN v ON f.market_id = v.market_id AND f.asset_id = v.asset_id AND f.from_ms <= v.timestamp_ms
  WHERE v.timestamp_ms <= f.grid_timestamp_ms + {HOURS.high}
),
labeled AS (
  SELECT *, target_mid - current_mid AS delta,
         CASE WHEN target_mid - current_mid > threshold THEN 'UP' WHEN target_mid - current_mid < -threshold THEN 'DOWN' ELSE 'FLAT' END AS label FROM m
)"""
)

_W = "OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms)"
_R5 = "OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def features_sql(source: str) -> str:
    """CTEs feat0 .. feat over ``source``."""
    return f"""
feat0 AS (
  SELECT *, (bid + ask) / 2.0 AS mid_price, ask - bid AS spread, (ask - bid) / ((bid + ask) / 2.0) * 10000.0 AS spread_bps,
         (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS microprice, (bid_size - ask_size) / (bid_size + ask_size) AS depth_imbalance
  FROM {source}
),
feat1 AS (
  SELECT *, (mid_price - lag(mid_price, 1) {_W}) / nullif(lag(mid_price, 1) {_W}, 0) AS mid_return_1s,
         (mid_price - lag(mid_price, 3) {_W}) / nullif(lag(mid_price, 3) {_W}, 0) AS mid_return_3s,
         (mid_price - lag(mid_price, 5) {_W}) / nullif(lag(mid_price, 5) {_W}, 0) AS mid_return_5s,
         bid - lag(bid) {_W} AS bid_change_1s, ask - lag(ask) {_W} AS ask_change_1s
  FROM feat0
),
feat AS (
  SELECT *, CASE WHEN count(mid_return_1s) {_R5} = 5 THEN stddev_samp(mid_return_1s) {_R5} END AS mid_volatility_5s FROM feat1
)"""


FEATURES_SQL = LABEL_SQL + "," + features_sql("labeled")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.load(spark, sf_dir)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_grid(events(spark, sf_dir), HOURS)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = events(spark, sf_dir)
    return label.physical_horizon(asof.asof_grid(q, HOURS), q, HOURS)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.causal(label.clean(labeled(spark, sf_dir)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_counts(sql: str) -> str:
    """``sql`` with every aggregate count_if(...) as a 64-bit number, as Spark counts."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        over = sql[end:].lstrip().upper().startswith("OVER")
        body = "count_if(" + plain_counts(sql[k + len("count_if(") : end])
        out += [sql[at:k], body if over else f"CAST({body} AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = plain_counts(sql)
        return f

    return add


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
