"""Queries on input checks, quotability, ladders, sessions and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import STREAM
from ..operators import guards
from ..sources import files
from .base import GRID_SQL, LABEL_SQL, QUOTES_SQL, events, grid, labeled, query, table, with_


@query(
    "input_violations",
    with_(
        QUOTES_SQL,
        """SELECT count(*) AS rows, count(*) FILTER (market_id IS NULL OR asset_id IS NULL OR timestamp_ms IS NULL OR sequence_id IS NULL OR bid IS NULL OR ask IS NULL OR bid_size IS NULL OR ask_size IS NULL) AS missing,
  count(*) FILTER (back) AS not_monotonic, count(*) FILTER (bid >= ask) AS crossed, count(*) FILTER (bid_size <= 0 OR ask_size <= 0) AS no_depth
FROM (SELECT *, timestamp_ms < lag(timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY sequence_id) AS back FROM q)""",
    ),
)
def input_violations(spark, sf_dir):
    return guards.input_violations(events(spark, sf_dir))


@query("no_future_grid", with_(GRID_SQL, "SELECT market_id, asset_id, grid_timestamp_ms, event_age_ms FROM grid"))
def no_future_grid(spark, sf_dir):
    """The grid behind the assertion that no source lies after its grid time."""
    return guards.no_future(grid(spark, sf_dir)).select(*STREAM, "grid_timestamp_ms", "event_age_ms")


@query(
    "quotability_reasons",
    with_(
        QUOTES_SQL,
        """, b AS (SELECT sequence_id, CASE WHEN sequence_id % 7 = 0 THEN NULL WHEN sequence_id % 11 = 0 THEN ask ELSE bid END AS bid, CASE WHEN sequence_id % 13 = 0 THEN 0.0::DOUBLE ELSE ask END AS ask,
  CASE WHEN sequence_id % 17 = 0 THEN 0 ELSE timestamp_ms END AS up, timestamp_ms - CASE WHEN sequence_id % 19 = 0 THEN 1 ELSE 0 END AS seen FROM q)
SELECT sequence_id, concat_ws(',', CASE WHEN bid IS NULL OR bid <= 0 THEN 'MISSING_OR_NONPOSITIVE_BID' END, CASE WHEN ask IS NULL OR ask <= 0 THEN 'MISSING_OR_NONPOSITIVE_ASK' END,
  CASE WHEN bid >= ask THEN 'CROSSED_OR_LOCKED_QUOTES' END, CASE WHEN up IS NULL OR up <= 0 THEN 'INVALID_OR_MISSING_TIMESTAMP' END, CASE WHEN up > 0 AND seen < up THEN 'GRID_EARLIER_THAN_BOOK_UPDATE' END) AS reasons FROM b""",
    ),
)
def quotability_reasons(spark, sf_dir):
    """Books broken in every way, and all reasons against each."""
    k = F.col("sequence_id")
    b = events(spark, sf_dir).select(
        k, F.when(k % 7 == 0, None).when(k % 11 == 0, F.col("ask")).otherwise(F.col("bid")).alias("bid"), F.when(k % 13 == 0, 0.0).otherwise(F.col("ask")).alias("ask"),
        F.when(k % 17 == 0, 0).otherwise(F.col("timestamp_ms")).alias("up"), (F.col("timestamp_ms") - F.when(k % 19 == 0, 1).otherwise(0)).alias("at"),
    )
    return b.select("sequence_id", F.concat_ws(",", guards.quotability(F.col("bid"), F.col("ask"), F.col("up"), F.col("at"))).alias("reasons"))


_RUNG = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY timestamp_ms, sequence_id) = 1"


@query(
    "dedup_ladder",
    with_(
        QUOTES_SQL,
        f""", a AS (SELECT *, sequence_id // 2 AS record FROM q), r1 AS (SELECT * FROM a {_RUNG.format("record")}), r2 AS (SELECT * FROM r1 {_RUNG.format("market_id, asset_id, timestamp_ms // 60000")})
SELECT sequence_id, market_id, asset_id FROM r2 {_RUNG.format("market_id, bid, ask, timestamp_ms // 3600000")}""",
    ),
)
def dedup_ladder(spark, sf_dir):
    """First by record, then by stream and minute, then by prices and hour."""
    q = events(spark, sf_dir).withColumns({"record": F.floor(F.col("sequence_id") / 2), "minute": F.floor(F.col("timestamp_ms") / 60_000), "hour": F.floor(F.col("timestamp_ms") / 3_600_000)})
    return guards.dedup_ladder(q, [["record"], ["market_id", "asset_id", "minute"], ["market_id", "bid", "ask", "hour"]], ["timestamp_ms", "sequence_id"]).select("sequence_id", *STREAM)


_DESCRIBED = ["bid", "ask", "bid_size", "ask_size"]


@query(
    "describe_quotes",
    with_(
        QUOTES_SQL,
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS least, max({c}) AS most, count(*) - count({c}) AS nulls FROM q" for c in _DESCRIBED),
    ),
)
def describe_quotes(spark, sf_dir):
    return guards.described(events(spark, sf_dir), _DESCRIBED).withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query("head_and_tail", with_(QUOTES_SQL, ", h AS (SELECT 'head' AS part, * FROM q ORDER BY timestamp_ms, sequence_id LIMIT 5), t AS (SELECT 'tail' AS part, * FROM q ORDER BY timestamp_ms DESC, sequence_id DESC LIMIT 5) SELECT part, sequence_id, timestamp_ms FROM h UNION ALL SELECT part, sequence_id, timestamp_ms FROM t"))
def head_and_tail(spark, sf_dir):
    """Previews: the first and the last five quotes (the limit is the feature)."""
    q = events(spark, sf_dir).select("sequence_id", "timestamp_ms")
    head = q.orderBy("timestamp_ms", "sequence_id").limit(5).select(F.lit("head").alias("part"), "*")
    return head.union(q.orderBy(F.desc("timestamp_ms"), F.desc("sequence_id")).limit(5).select(F.lit("tail").alias("part"), "*"))


@query(
    "map_lookup",
    with_(
        QUOTES_SQL,
        """, d AS (SELECT timestamp_ms // 86400000 * 86400 AS epoch, count(*) AS n FROM q GROUP BY ALL), f AS (SELECT sequence_id, 'feed-updown-' || (timestamp_ms // 86400000 * 86400) || '.jsonl' AS file FROM q)
SELECT sequence_id, CASE WHEN n % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS label FROM f LEFT JOIN d ON contains(file, '-' || epoch || '.')""",
    ),
)
def map_lookup(spark, sf_dir):
    """Labels by the epoch in a file's name: taken out of the name, so the join is by equality."""
    q = events(spark, sf_dir)
    epoch = F.floor(F.col("timestamp_ms") / 86_400_000) * 86_400
    labels = q.groupBy(epoch.alias("epoch")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "UP").otherwise("DOWN").alias("label"))
    named = q.select("sequence_id", F.concat(F.lit("feed-updown-"), epoch.cast("string"), F.lit(".jsonl")).alias("file"))
    return named.withColumn("epoch", F.regexp_extract("file", r"-(\d+)\.", 1).cast("long")).join(labels, "epoch", "left").select("sequence_id", "label")


@query("file_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("orders", "events", "nation")))
def file_row_counts(spark, sf_dir):
    """Counts from Parquet footers."""
    return spark.createDataFrame([(t, files.footer_rows(spark, f"{sf_dir}/{t}.parquet")) for t in ("orders", "events", "nation")], "name string, rows long")


@query(
    "file_screen",
    with_(
        QUOTES_SQL,
        """, f AS (SELECT *, market_id || '/' || (timestamp_ms // 604800000) AS file FROM q), p AS (SELECT file, count(timestamp_ms) AS rows, count(*) FILTER (bid IS NOT NULL AND ask IS NOT NULL) AS two_sided, max(timestamp_ms) - min(timestamp_ms) AS duration_ms FROM f GROUP BY ALL)
SELECT *, CASE WHEN contains(file, 'click') THEN 'EXCLUDED' WHEN rows = 0 THEN 'EMPTY' WHEN coalesce(duration_ms, 0) < 500000000 THEN 'TOO_SHORT' WHEN two_sided = 0 THEN 'NO_TWO_SIDED_QUOTES' END AS left_out FROM p""",
    ),
)
def file_screen(spark, sf_dir):
    """The screen over files, here a market's weeks."""
    q = events(spark, sf_dir).withColumn("file", F.concat_ws("/", "market_id", F.floor(F.col("timestamp_ms") / 604_800_000).cast("string")))
    return files.screened(q, ["click"], 500_000_000)


@query(
    "pending_settlement",
    with_(
        QUOTES_SQL,
        """, o AS (SELECT sequence_id AS position_id, market_id, asset_id, timestamp_ms AS opened_ms, CASE WHEN sequence_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, timestamp_ms + 3600000 AS due FROM q),
v AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, timestamp_ms ORDER BY sequence_id) = 1),
m AS (SELECT o.*, v.timestamp_ms AS t, v.bid, v.ask FROM o ASOF LEFT JOIN v ON o.market_id = v.market_id AND o.asset_id = v.asset_id AND o.due <= v.timestamp_ms)
SELECT position_id, CASE WHEN t <= due + 14400000 THEN CASE WHEN side = 'BUY' THEN bid ELSE ask END END AS exit_price, CASE WHEN t <= due + 14400000 THEN t END AS settled_ms,
  CASE WHEN t <= due + 14400000 THEN 'SETTLED' ELSE 'FORCED_INCOMPLETE' END AS outcome FROM m""",
    ),
)
def pending_settlement(spark, sf_dir):
    """A position on every quote, due an hour later, four hours of patience."""
    q = events(spark, sf_dir)
    side = F.when(F.col("sequence_id") % 2 == 0, "BUY").otherwise("SELL")
    o = q.select(F.col("sequence_id").alias("position_id"), *STREAM, F.col("timestamp_ms").alias("opened_ms"), side.alias("side"))
    return guards.settled(o, q, 3_600_000, 14_400_000).select("position_id", "exit_price", "settled_ms", "outcome")


_DAY_MS = 86_400_000
#: Cells and trades of a market's day; a trade follows the deeper side and pays the spread.
_STOPS_SQL = """, hc AS (SELECT market_id || '-' || (grid_timestamp_ms // 86400000) AS session_id, count(*) FILTER (NOT is_stale) AS observations, avg(CASE WHEN is_stale THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS missing, coalesce(avg(event_age_ms) FILTER (NOT is_stale), 0) / 3600 AS age FROM grid GROUP BY 1),
ht AS (SELECT market_id || '-' || (grid_timestamp_ms // 86400000) AS session_id, grid_timestamp_ms, asset_id, bid_size > ask_size AS up, round(CASE WHEN bid_size > ask_size THEN delta ELSE -delta END - (ask - bid), 9) AS pnl FROM labeled),
h1 AS (SELECT *, sum(pnl) OVER w AS cum, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER w AS run FROM ht WINDOW w AS (PARTITION BY session_id ORDER BY grid_timestamp_ms, asset_id ROWS UNBOUNDED PRECEDING)),
h2 AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY session_id ORDER BY grid_timestamp_ms, asset_id ROWS UNBOUNDED PRECEDING)) - cum AS fall FROM h1),
h3 AS (SELECT session_id, max(losses) AS losses FROM (SELECT session_id, run, count(*) FILTER (pnl < 0) AS losses FROM h1 GROUP BY ALL) GROUP BY 1),
h4 AS (SELECT session_id, max(fall) AS drawdown, abs(avg(CASE WHEN up THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 0.5) AS asymmetry FROM h2 GROUP BY 1),
h5 AS (SELECT session_id, observations, missing, age, coalesce(losses, 0) AS losses, coalesce(drawdown, 0) AS drawdown, coalesce(asymmetry, 0) AS asymmetry FROM hc LEFT JOIN h3 USING (session_id) LEFT JOIN h4 USING (session_id)),
h6 AS (SELECT *, CASE WHEN missing > 0.25 THEN 'MISSING_QUOTE_RATE' WHEN observations >= 10 AND age > 2000 THEN 'QUOTE_AGE' WHEN losses >= 8 THEN 'CONSECUTIVE_LOSSES' WHEN drawdown >= 2.5 THEN 'DRAWDOWN' WHEN asymmetry > 0.40 THEN 'DIRECTIONAL_ASYMMETRY' END AS stop FROM h5),
st AS (SELECT *, CASE WHEN observations < 5 THEN 'FAILED' WHEN stop IS NOT NULL THEN 'ABORTED_HARD_STOP' WHEN missing > 0.1 THEN 'DEGRADED' ELSE 'COMPLETE' END AS status FROM h6)"""


def _day(time):
    return F.concat_ws("-", "market_id", F.floor(F.col(time) / _DAY_MS).cast("string"))


def _session_states(spark, sf_dir):
    """Sessions (a market's days) with their sums, first hard stop and status."""
    c = F.col
    cells = grid(spark, sf_dir).select(_day("grid_timestamp_ms").alias("session_id"), "event_age_ms", "is_stale")
    up = c("bid_size") > c("ask_size")
    pnl = F.round(F.when(up, c("delta")).otherwise(-c("delta")) - (c("ask") - c("bid")), 9)
    trades = labeled(spark, sf_dir).select(_day("grid_timestamp_ms").alias("session_id"), "grid_timestamp_ms", "asset_id", F.when(up, "UP").otherwise("DOWN").alias("side"), pnl.alias("pnl"))
    sums = guards.session_sums(cells, trades, ["session_id"], ["grid_timestamp_ms", "asset_id"])
    # the driver's events are 3600 times as far apart as live ones
    stop = guards.hard_stop(c("missing_rate"), c("mean_age") / 3600, c("losses"), c("drawdown"), c("asymmetry"), c("observations"))
    out = sums.withColumn("stop", stop)
    return out.withColumn("status", guards.session_status(c("stop"), c("observations") < 5, c("missing_rate") > 0.1))


@query(
    "session_clusters",
    with_(
        LABEL_SQL,
        _STOPS_SQL
        + """, sg AS (SELECT sequence_id AS signal_id, market_id || '-' || (timestamp_ms // 86400000) AS session_id, timestamp_ms // 3600000 AS burst_id FROM q)
SELECT sg.session_id, signal_id, burst_id, CAST(dense_rank() OVER (ORDER BY sg.session_id, burst_id) - 1 AS BIGINT) AS cluster FROM sg JOIN st USING (session_id) WHERE status = 'COMPLETE'""",
    ),
)
def session_clusters(spark, sf_dir):
    """Bursts of sessions that ended complete, numbered across sessions without a global sort of signals."""
    s = events(spark, sf_dir).select(F.col("sequence_id").alias("signal_id"), _day("timestamp_ms").alias("session_id"), F.floor(F.col("timestamp_ms") / 3_600_000).alias("burst_id"))
    return guards.sessions(s, _session_states(spark, sf_dir).select("session_id", "status"))


@query("hard_stops", with_(LABEL_SQL, _STOPS_SQL + " SELECT session_id, observations, round(missing, 9) AS missing_rate, losses, round(drawdown, 6) AS drawdown, round(asymmetry, 9) AS asymmetry, stop, status FROM st"))
def hard_stops(spark, sf_dir):
    """The sums of each session and what they lead to."""
    out = _session_states(spark, sf_dir)
    return out.select("session_id", "observations", F.round("missing_rate", 9).alias("missing_rate"), "losses", F.round("drawdown", 6).alias("drawdown"), F.round("asymmetry", 9).alias("asymmetry"), "stop", "status")


@query(
    "nation_last_by_region",
    "SELECT n_regionkey, n_nationkey, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC, n_nationkey DESC) <= 3",
)
def nation_last_by_region(spark, sf_dir):
    """Tails of groups: the last three names of each region."""
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("n_name"), F.desc("n_nationkey"))
    return table(spark, sf_dir, "nation").withColumn("k", F.row_number().over(w)).where("k <= 3").select("n_regionkey", "n_nationkey", "n_name")
