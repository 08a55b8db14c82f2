"""Queries on validation, deduplication, gaps and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quotes import mid, ratio
from ..model import HOURS, STREAM
from ..operators import dedup, stats
from ..operators.quality import checks
from .base import GRID_SQL, LABEL_SQL, QUOTES_SQL, events, grid, labeled, query, table, with_

RAW_SQL = (
    QUOTES_SQL
    + """,
raw AS (
  SELECT sequence_id, CASE WHEN sequence_id % 97 = 0 THEN NULL WHEN sequence_id % 97 = 1 THEN 'soon' WHEN sequence_id % 97 = 2 THEN '12' ELSE timestamp_ms::VARCHAR END AS timestamp,
    CASE WHEN sequence_id % 97 = 3 THEN ' ' ELSE market_id END AS market_id, CASE WHEN sequence_id % 97 = 4 THEN '' ELSE asset_id END AS asset_id,
    CASE WHEN sequence_id % 97 = 5 THEN NULL WHEN sequence_id % 97 = 6 THEN 'x' WHEN sequence_id % 97 = 7 THEN '-0.5' WHEN sequence_id % 97 = 8 THEN '0.99' ELSE bid::VARCHAR END AS bid,
    CASE WHEN sequence_id % 97 = 8 THEN '0.98' WHEN sequence_id % 97 = 9 THEN '1.25' WHEN sequence_id % 97 = 10 THEN 'NaN' ELSE ask::VARCHAR END AS ask,
    CASE WHEN sequence_id % 97 = 11 THEN NULL WHEN sequence_id % 97 = 12 THEN 'many' WHEN sequence_id % 97 = 13 THEN '0' ELSE bid_size::VARCHAR END AS bid_size, ask_size::VARCHAR AS ask_size
  FROM q
),
rej AS (
  SELECT *, CASE WHEN timestamp IS NULL OR timestamp = '' THEN 'MISSING_TIMESTAMP' WHEN try_cast(timestamp AS BIGINT) IS NULL THEN 'INVALID_TIMESTAMP' WHEN try_cast(timestamp AS BIGINT) NOT BETWEEN 1577836800000 AND 2051222400000 THEN 'OUT_OF_BOUNDS_TIMESTAMP'
    WHEN market_id IS NULL OR trim(market_id) = '' THEN 'MISSING_MARKET_ID' WHEN asset_id IS NULL OR trim(asset_id) = '' THEN 'MISSING_ASSET_ID' WHEN bid IS NULL OR ask IS NULL THEN 'MISSING_PRICE'
    WHEN try_cast(bid AS DOUBLE) IS NULL OR try_cast(ask AS DOUBLE) IS NULL OR isnan(try_cast(bid AS DOUBLE)) OR isnan(try_cast(ask AS DOUBLE)) OR isinf(try_cast(bid AS DOUBLE)) OR isinf(try_cast(ask AS DOUBLE)) THEN 'INVALID_PRICE'
    WHEN try_cast(bid AS DOUBLE) <= 0 OR try_cast(ask AS DOUBLE) <= 0 OR try_cast(bid AS DOUBLE) >= 1 OR try_cast(ask AS DOUBLE) >= 1 THEN 'IMPOSSIBLE_PRICE' WHEN try_cast(bid AS DOUBLE) >= try_cast(ask AS DOUBLE) THEN 'CROSSED_BOOK'
    WHEN bid_size IS NULL OR ask_size IS NULL THEN 'MISSING_SIZE' WHEN try_cast(bid_size AS DOUBLE) IS NULL OR try_cast(ask_size AS DOUBLE) IS NULL THEN 'INVALID_SIZE'
    WHEN try_cast(bid_size AS DOUBLE) <= 0 OR try_cast(ask_size AS DOUBLE) <= 0 THEN 'NON_POSITIVE_DEPTH' END AS reject_reason FROM raw
)"""
)


def raw_quotes(spark, sf_dir):
    """Quotes as strings, some of them broken in every way the validator knows."""
    k = F.col("sequence_id") % 97
    s = lambda c: F.col(c).cast("string")
    return events(spark, sf_dir).select(
        "sequence_id",
        F.when(k == 0, None).when(k == 1, "soon").when(k == 2, "12").otherwise(s("timestamp_ms")).alias("timestamp"),
        F.when(k == 3, " ").otherwise(F.col("market_id")).alias("market_id"),
        F.when(k == 4, "").otherwise(F.col("asset_id")).alias("asset_id"),
        F.when(k == 5, None).when(k == 6, "x").when(k == 7, "-0.5").when(k == 8, "0.99").otherwise(s("bid")).alias("bid"),
        F.when(k == 8, "0.98").when(k == 9, "1.25").when(k == 10, "NaN").otherwise(s("ask")).alias("ask"),
        F.when(k == 11, None).when(k == 12, "many").when(k == 13, "0").otherwise(s("bid_size")).alias("bid_size"),
        s("ask_size").alias("ask_size"),
    )


@query("reject_reasons", with_(RAW_SQL, "SELECT sequence_id, reject_reason FROM rej"))
def reject_reasons(spark, sf_dir):
    return raw_quotes(spark, sf_dir).select("sequence_id", dedup.reject_reason().alias("reject_reason"))


@query("reject_counts", with_(RAW_SQL, "SELECT coalesce(reject_reason, 'VALID') AS reason, count(*) AS rows FROM rej GROUP BY 1"))
def reject_counts(spark, sf_dir):
    return raw_quotes(spark, sf_dir).groupBy(F.coalesce(dedup.reject_reason(), F.lit("VALID")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


DUP_SQL = (
    QUOTES_SQL
    + """,
dup AS (SELECT sequence_id AS line, sequence_id // 2 AS seq, market_id, asset_id, timestamp_ms // 86400000 AS day, CASE WHEN sequence_id % 3 = 0 THEN 0.5::DOUBLE ELSE bid END AS bid, ask FROM q
        UNION ALL SELECT sequence_id + 1000000, sequence_id // 2, market_id, asset_id, timestamp_ms // 86400000, CASE WHEN sequence_id % 3 = 0 THEN 0.5::DOUBLE ELSE bid END, CASE WHEN sequence_id % 5 = 0 THEN ask + 0.01::DOUBLE ELSE ask END FROM q WHERE sequence_id % 4 = 0),
dk AS (SELECT *, row_number() OVER w AS arrival, round(bid, 8) AS rb, round(ask, 8) AS ra, first_value(round(bid, 8)) OVER w AS fb, first_value(round(ask, 8)) OVER w AS fa FROM dup WINDOW w AS (PARTITION BY market_id, asset_id, day, seq ORDER BY line))"""
)


def duplicated(spark, sf_dir):
    q = events(spark, sf_dir)
    day = F.floor(F.col("timestamp_ms") / 86_400_000).cast("long").alias("day")
    bid = F.when(F.col("sequence_id") % 3 == 0, 0.5).otherwise(F.col("bid")).alias("bid")
    seq = F.floor(F.col("sequence_id") / 2).cast("long").alias("seq")
    one = q.select(F.col("sequence_id").alias("line"), seq, *STREAM, day, bid, "ask")
    two = q.where("sequence_id % 4 = 0").select((F.col("sequence_id") + 1_000_000).alias("line"), seq, *STREAM, day, bid, F.when(F.col("sequence_id") % 5 == 0, F.col("ask") + 0.01).otherwise(F.col("ask")).alias("ask"))
    return one.unionByName(two)


@query("dedup_first_conflict", with_(DUP_SQL, "SELECT line, seq, arrival, CASE WHEN arrival = 1 THEN 'kept' WHEN rb = fb AND ra = fa THEN 'identical' ELSE 'conflicting' END AS kind FROM dk"))
def dedup_first_conflict(spark, sf_dir):
    return dedup.first_arrival(duplicated(spark, sf_dir), [*STREAM, "day", "seq"], ["line"], ["bid", "ask"]).select("line", "seq", "arrival", "kind")


@query("dedup_last", with_(DUP_SQL, "SELECT market_id, asset_id, day, max(line) AS line, arg_max(bid, line) AS bid, arg_max(ask, line) AS ask FROM dup GROUP BY ALL"))
def dedup_last(spark, sf_dir):
    return dedup.keep_last(duplicated(spark, sf_dir).drop("seq"), [*STREAM, "day"], ["line"]).select(*STREAM, "day", "line", "bid", "ask")


@query(
    "stream_summary",
    with_(
        QUOTES_SQL,
        """SELECT market_id, asset_id, count(*) AS rows, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, max(timestamp_ms) - min(timestamp_ms) AS span_ms, count(*) - count(DISTINCT timestamp_ms) AS duplicate_times,
  round(avg((bid < ask)::INT), 9) AS ordered_share, count(DISTINCT sequence_id) AS ids, round(count(*) / ((max(timestamp_ms) - min(timestamp_ms)) / 1000.0), 9) AS events_per_second,
  min((bid + ask) / 2.0) AS min_mid, max((bid + ask) / 2.0) AS max_mid, round(avg((bid + ask) / 2.0), 9) AS mean_mid FROM q GROUP BY ALL""",
    ),
)
def stream_summary(spark, sf_dir):
    n, span = F.count(F.lit(1)), F.max("timestamp_ms") - F.min("timestamp_ms")
    return events(spark, sf_dir).groupBy(*STREAM).agg(
        n.alias("rows"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), span.alias("span_ms"), (n - F.count_distinct("timestamp_ms")).alias("duplicate_times"),
        F.round(F.avg((F.col("bid") < F.col("ask")).cast("int")), 9).alias("ordered_share"), F.count_distinct("sequence_id").alias("ids"), F.round(ratio(n, span / 1000.0), 9).alias("events_per_second"),
        F.min(mid()).alias("min_mid"), F.max(mid()).alias("max_mid"), F.round(F.avg(mid()), 9).alias("mean_mid"),
    )


@query(
    "resample_report",
    with_(
        GRID_SQL,
        """, r AS (SELECT *, count(*) OVER (PARTITION BY market_id, asset_id, grid_timestamp_ms) AS d FROM grid)
SELECT market_id, asset_id, count(*) AS rows, min(grid_timestamp_ms) AS first_grid, max(grid_timestamp_ms) AS last_grid, min(source_timestamp_ms) AS first_source, max(source_timestamp_ms) AS last_source, round(avg(event_age_ms), 6) AS mean_age, max(event_age_ms) AS max_age,
  count_if(is_stale) AS stale, round(100.0 * count_if(is_stale) / count(*), 9) AS stale_pct, count_if(event_age_ms < 0) AS violations, count_if(d > 1) AS duplicate_keys FROM r GROUP BY ALL""",
    ),
)
def resample_report(spark, sf_dir):
    g = grid(spark, sf_dir)
    per = g.groupBy(*STREAM, "grid_timestamp_ms").agg(F.count(F.lit(1)).alias("d"), *[F.first(c).alias(c) for c in ("source_timestamp_ms", "event_age_ms", "is_stale")])
    n = F.sum("d")
    stale = F.sum(F.when(F.col("is_stale"), F.col("d")).otherwise(0))
    return per.groupBy(*STREAM).agg(
        n.alias("rows"), F.min("grid_timestamp_ms").alias("first_grid"), F.max("grid_timestamp_ms").alias("last_grid"), F.min("source_timestamp_ms").alias("first_source"), F.max("source_timestamp_ms").alias("last_source"),
        F.round(F.avg("event_age_ms"), 6).alias("mean_age"), F.max("event_age_ms").alias("max_age"), stale.alias("stale"), F.round(100.0 * stale / n, 9).alias("stale_pct"),
        F.count_if(F.col("event_age_ms") < 0).alias("violations"), F.sum(F.when(F.col("d") > 1, F.col("d")).otherwise(0)).alias("duplicate_keys"),
    )


_BIN = HOURS.step // 2


@query("horizon_histogram", with_(LABEL_SQL, f"SELECT (target_timestamp - grid_timestamp_ms) // {_BIN} * {_BIN} AS bucket_ms, count(*) AS rows FROM labeled GROUP BY 1"))
def horizon_histogram(spark, sf_dir):
    h = F.col("target.timestamp_ms") - F.col("grid_timestamp_ms")
    return labeled(spark, sf_dir).groupBy((F.floor(h / _BIN) * _BIN).cast("long").alias("bucket_ms")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "label_report",
    with_(LABEL_SQL, "SELECT count(*) AS rows, min(h) AS min_ms, max(h) AS max_ms, round(avg(h), 6) AS mean_ms, median(h) AS median_ms, round(quantile_cont(h, 0.95), 6) AS p95_ms, count_if(label = 'UP') AS up, count_if(label = 'DOWN') AS down, count_if(label = 'FLAT') AS flat FROM (SELECT *, target_timestamp - grid_timestamp_ms AS h FROM labeled)"),
)
def label_report(spark, sf_dir):
    h = F.col("target.timestamp_ms") - F.col("grid_timestamp_ms")
    return labeled(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.min(h).alias("min_ms"), F.max(h).alias("max_ms"), F.round(F.avg(h), 6).alias("mean_ms"), F.median(h).alias("median_ms"), F.round(F.percentile(h, 0.95), 6).alias("p95_ms"),
        *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("UP", "DOWN", "FLAT")],
    )


@query(
    "gap_stats",
    with_(
        QUOTES_SQL,
        """, g AS (SELECT market_id, asset_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id) AS gap FROM q)
SELECT market_id, asset_id, count(*) AS gaps, median(gap) AS median_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap, max(gap) AS max_gap, count_if(gap >= 3600000) AS at_least_0, count_if(gap >= 7200000) AS at_least_1, count_if(gap >= 21600000) AS at_least_2 FROM g WHERE gap IS NOT NULL GROUP BY ALL""",
    ),
)
def gap_stats(spark, sf_dir):
    return dedup.gap_stats(events(spark, sf_dir), "timestamp_ms", ["sequence_id"], STREAM, [3_600_000, 7_200_000, 21_600_000]).withColumn("p95_gap", F.round("p95_gap", 6))


@query(
    "stale_runs",
    with_(
        GRID_SQL,
        """, c AS (SELECT *, coalesce(bid = lag(bid) OVER w AND ask = lag(ask) OVER w, false) AS same FROM grid WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms)),
r AS (SELECT market_id, asset_id, sum((NOT same)::INT) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms ROWS UNBOUNDED PRECEDING) AS run FROM c),
l AS (SELECT market_id, asset_id, run, count(*) AS length FROM r GROUP BY ALL)
SELECT market_id, asset_id, count(*) AS runs, max(length) AS longest, count_if(length >= 3) AS at_least_3, count_if(length >= 5) AS at_least_5 FROM l GROUP BY ALL""",
    ),
)
def stale_runs(spark, sf_dir):
    w = Window.partitionBy(*STREAM).orderBy("grid_timestamp_ms")
    same = F.coalesce((F.col("bid") == F.lag("bid").over(w)) & (F.col("ask") == F.lag("ask").over(w)), F.lit(False))
    r = stats.runs(grid(spark, sf_dir), same, ["grid_timestamp_ms"], STREAM)
    return r.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.count_if(F.col("length") >= 3).alias("at_least_3"), F.count_if(F.col("length") >= 5).alias("at_least_5"))


@query(
    "transitions",
    with_(LABEL_SQL, """, p AS (SELECT market_id, asset_id, label, lag(label) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) AS b FROM labeled)
SELECT b AS before, label AS after, count(*) AS rows FROM p WHERE b <> label GROUP BY ALL"""),
)
def transitions(spark, sf_dir):
    w = Window.partitionBy(*STREAM).orderBy("grid_timestamp_ms")
    d = labeled(spark, sf_dir).select(F.lag("label").over(w).alias("before"), F.col("label").alias("after"))
    return d.where("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "missing_seconds",
    with_(
        LABEL_SQL,
        f""", n AS (SELECT market_id, asset_id, min(grid_timestamp_ms) AS lo, max(grid_timestamp_ms) AS hi FROM labeled GROUP BY ALL),
e AS (SELECT market_id, asset_id, unnest(generate_series(lo, hi, {HOURS.step})) AS grid_timestamp_ms FROM n)
SELECT market_id, asset_id, grid_timestamp_ms FROM e ANTI JOIN labeled USING (market_id, asset_id, grid_timestamp_ms)""",
    ),
)
def missing_seconds(spark, sf_dir):
    return dedup.missing_times(labeled(spark, sf_dir), "grid_timestamp_ms", HOURS.step, STREAM)


@query(
    "ts_quality",
    """WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS t FROM events), o AS (SELECT *, lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS b, lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS p FROM e)
SELECT event_type, count(*) AS rows, count_if(t - p = 0) AS duplicates, min(t) AS first, max(t) AS last, count_if(t < b) AS out_of_order, count_if(t - p > 1.5 * 1200000) AS gaps, max(t - p) AS max_gap FROM o GROUP BY 1""",
)
def ts_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t"))
    return dedup.timestamp_quality(e, "t", "event_id", ["event_type"], 1_200_000)


@query(
    "validator_checks",
    """WITH a AS (SELECT count(*) AS n, count_if(o_totalprice IS NULL OR o_orderdate IS NULL) AS miss, count(*) - count(DISTINCT o_orderkey) AS dup, count_if(o_totalprice <= 0) AS bad, count_if(isnan(o_totalprice) OR isinf(o_totalprice)) AS odd FROM orders)
SELECT 'missing_values' AS name, 'quality' AS category, CASE WHEN miss = 0 THEN 'PASS' ELSE 'FAIL' END AS status, miss::DOUBLE AS observed FROM a UNION ALL SELECT 'duplicate_records', 'quality', CASE WHEN dup = 0 THEN 'PASS' ELSE 'FAIL' END, dup FROM a
UNION ALL SELECT 'positive_values', 'quality', CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END, bad FROM a UNION ALL SELECT 'finite_values', 'quality', CASE WHEN odd = 0 THEN 'PASS' ELSE 'FAIL' END, odd FROM a UNION ALL SELECT 'row_count', 'quality', CASE WHEN n >= 1 THEN 'PASS' ELSE 'FAIL' END, n FROM a""",
)
def validator_checks(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), F.col
    x = c("o_totalprice")
    one = o.agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull() | c("o_orderdate").isNull()).alias("miss"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("dup"), F.count_if(x <= 0).alias("bad"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("odd"))
    specs = [(n, "quality", c(k) == 0, c(k)) for n, k in (("missing_values", "miss"), ("duplicate_records", "dup"), ("positive_values", "bad"), ("finite_values", "odd"))]
    return checks(one, [*specs, ("row_count", "quality", c("n") >= 1, c("n"))])


@query("constant_features", "SELECT 'l_linestatus' AS feature, count(DISTINCT l_linestatus) AS distinct_values, round((SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linestatus))::DOUBLE / count(*), 9) AS top_share FROM lineitem")
def constant_features(spark, sf_dir):
    return dedup.top_share(table(spark, sf_dir, "lineitem"), "l_linestatus").select(F.lit("l_linestatus").alias("feature"), "distinct_values", F.round("top_share", 9).alias("top_share"))


@query("market_level_agg", with_(LABEL_SQL, "SELECT market_id, label, count(*) AS rows, round(avg(current_mid), 9) AS mean_mid, round(avg(ask - bid), 9) AS mean_spread, round(avg(event_age_ms), 4) AS mean_age FROM labeled GROUP BY ALL"))
def market_level_agg(spark, sf_dir):
    return labeled(spark, sf_dir).groupBy("market_id", "label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("current_mid"), 9).alias("mean_mid"), F.round(F.avg(F.col("ask") - F.col("bid")), 9).alias("mean_spread"), F.round(F.avg("event_age_ms"), 4).alias("mean_age"))


def _scores(q):
    w = Window.partitionBy(*STREAM).orderBy("timestamp_ms", "sequence_id")
    d = q.withColumns({"m": mid(), "s": F.col("ask") - F.col("bid")})
    d = d.withColumns({"pm": F.lag("m").over(w), "ps": F.lag("s").over(w)})
    a = d.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("bid", "ask").alias("u"), F.count_if(F.col("m") != F.col("pm")).alias("p"), F.count_if(F.col("s") != F.col("ps")).alias("c"))
    return a.select(*STREAM, "samples", dedup.quality_score(F.col("samples"), F.col("u"), F.col("p"), F.col("c")).alias("score"))


@query(
    "quality_score",
    with_(
        QUOTES_SQL,
        """, c AS (SELECT *, (bid + ask) / 2.0 AS m, ask - bid AS s, lag((bid + ask) / 2.0) OVER w AS pm, lag(ask - bid) OVER w AS ps FROM q WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id)),
a AS (SELECT market_id, asset_id, count(*) AS n, count(DISTINCT (bid, ask)) AS u, coalesce(count_if(m <> pm), 0) AS p, coalesce(count_if(s <> ps), 0) AS s FROM c GROUP BY ALL)
SELECT market_id, asset_id, n AS samples, round(least(n / 30, 1.0) * 40 + least(u / 5, 1.0) * 30 + least(p / 3, 1.0) * 20 + least(s / 3, 1.0) * 10, 2) AS score FROM a""",
    ),
)
def quality_score(spark, sf_dir):
    """Scores of each stream over all its events."""
    return _scores(events(spark, sf_dir))


@query("topk_moves", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 10")
def topk_moves(spark, sf_dir):
    """The ten largest rows of each flag (a top-k report)."""
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k", "l_partkey")


@query("append_once", "SELECT count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)) AS records FROM orders WHERE (o_custkey, o_orderstatus, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderstatus, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0)")
def append_once(spark, sf_dir):
    """Idempotent append: records whose content was not stored before."""
    o = table(spark, sf_dir, "orders")
    rec = lambda d: d.select("o_custkey", "o_orderstatus", "o_orderpriority").transform(lambda x: x.withColumn("record_id", dedup.record_id(x)))
    return dedup.append_once(rec(o.where("o_orderkey % 2 = 1")), rec(o.where("o_orderkey % 2 = 0"))).agg(F.count(F.lit(1)).alias("records"))


@query("merge_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def merge_keep_last(spark, sf_dir):
    """Merge of two loads, the later one winning."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.keep_last(o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 2 = 1")), ["o_custkey"], ["o_orderkey"])


@query("fingerprint")
def fingerprint(spark, sf_dir):
    return dedup.fingerprint(table(spark, sf_dir, "orders"))


@query("unmapped_rows", "SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def unmapped_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("mapped_rows", "SELECT count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def mapped_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("time_containment", "SELECT s.event_id AS session_event, count(e.event_id) AS inside FROM (SELECT * FROM events WHERE event_type = 'signup') s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 6 HOUR GROUP BY 1")
def time_containment(spark, sf_dir):
    """Events of a user in [t, t + 6 h) of each of its sign-ups; an equality join on the user first."""
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("ts").alias("t0"), F.col("event_id").alias("session_event"))
    hit = s.join(e, (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t0") + F.expr("INTERVAL 6 HOURS")))
    return hit.groupBy("session_event").agg(F.count(F.lit(1)).alias("inside"))


@query(
    "file_audit",
    "SELECT event_type, count(*) AS lines, count(DISTINCT user_id) AS ids, count_if(json_extract(props, '$.k') IS NULL) AS malformed, max(length(props)) AS longest FROM events GROUP BY 1",
)
def file_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("user_id").alias("ids"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("malformed"), F.max(F.length("props")).alias("longest"))


@query("conversation_last", "SELECT conv_id, max(turn) AS turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def conversation_last(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.max_by("role", "turn").alias("last_role"))


@query("text_market_filter", "SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%steel%') AND p_size >= 10")
def text_market_filter(spark, sf_dir):
    low = lambda c: F.lower(c).contains("steel")
    return table(spark, sf_dir, "part").where((low("p_name") | low("p_type")) & (F.col("p_size") >= 10)).select("p_partkey")


@query(
    "dedup_first_complete_key",
    with_(
        QUOTES_SQL,
        """, k AS (SELECT market_id, asset_id, CASE WHEN sequence_id % 7 = 0 THEN NULL ELSE sequence_id // 2 END AS record_id, timestamp_ms // 3600000 AS hour, sequence_id FROM q)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, hour ORDER BY sequence_id) = 1""",
    ),
)
def dedup_first_complete_key(spark, sf_dir):
    """Record ids have gaps here, so the rows are told apart by stream and hour instead."""
    k = F.col("sequence_id")
    rows = events(spark, sf_dir).select("market_id", "asset_id", F.when(k % 7 == 0, None).otherwise(F.floor(k / 2)).alias("record_id"), F.floor(F.col("timestamp_ms") / 3_600_000).alias("hour"), "sequence_id")
    return dedup.by_first_complete_key(rows, [["record_id"], ["market_id", "asset_id", "hour"]], ["sequence_id"])
