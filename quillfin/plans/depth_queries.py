"""Depth rows, first-generation snapshots and the audit of raw files laid out from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import STREAM
from ..operators import depth
from ..sources import audit
from .base import QUOTES_SQL, events, query, with_

_DAY = 86_400_000


def books(spark, sf_dir):
    """A book a stream and day in the feed's form: levels as text, in no order, some of size 0."""
    day = F.floor(F.col("timestamp_ms") / _DAY).cast("long").alias("day")
    q = events(spark, sf_dir).select(*STREAM, day, "timestamp_ms", "sequence_id", F.inline(F.array(F.struct(F.lit(True).alias("is_bid"), F.col("bid").alias("p"), F.col("bid_size").alias("s")), F.struct(F.lit(False).alias("is_bid"), F.col("ask").alias("p"), F.col("ask_size").alias("s")))))
    size = F.when(F.count(F.lit(1)) % 4 == 0, F.lit(0.0)).otherwise(F.max("s"))
    per = q.groupBy(*STREAM, "day", "is_bid", "p").agg(size.alias("s"), F.max("timestamp_ms").alias("t"), F.max("sequence_id").alias("n"))
    level = F.struct(F.col("p").cast("string").alias("price"), F.col("s").cast("string").alias("size"))
    # a price is one of a hundred cents, so a side has as many levels at most
    sides = [F.collect_list(F.when(F.col("is_bid") == is_bid, level)).alias(name) for is_bid, name in ((True, "bids"), (False, "asks"))]
    return per.groupBy(*STREAM, "day").agg(F.max("t").alias("timestamp_ms"), F.max("n").alias("last_update_id"), *sides)


BOOKS_SQL = (
    QUOTES_SQL
    + f""",
k AS (SELECT market_id, asset_id, timestamp_ms // {_DAY} AS day, max(timestamp_ms) AS t, max(sequence_id) AS n FROM q GROUP BY ALL),
bl AS (SELECT market_id, asset_id, day, list([p, s] ORDER BY p DESC) AS bids FROM (
  SELECT market_id, asset_id, timestamp_ms // {_DAY} AS day, bid AS p, max(bid_size) AS s FROM q GROUP BY ALL HAVING count(*) % 4 <> 0) GROUP BY ALL),
al AS (SELECT market_id, asset_id, day, list([p, s] ORDER BY p) AS asks FROM (
  SELECT market_id, asset_id, timestamp_ms // {_DAY} AS day, ask AS p, max(ask_size) AS s FROM q GROUP BY ALL HAVING count(*) % 4 <> 0) GROUP BY ALL),
bk AS (SELECT market_id, asset_id, t, n, coalesce(bids, []) AS bids, coalesce(asks, []) AS asks FROM k LEFT JOIN bl USING (market_id, asset_id, day) LEFT JOIN al USING (market_id, asset_id, day)),
dp AS (SELECT *, bids[1][1] AS bid, asks[1][1] AS ask, coalesce(bids[1][2], 0) AS bs, coalesce(asks[1][2], 0) AS sz,
  coalesce(list_sum([x[2] for x in bids]), 0) AS bd, coalesce(list_sum([x[2] for x in asks]), 0) AS ad, coalesce(list_sum([x[2] for x in bids[1:5]]), 0) AS b5, coalesce(list_sum([x[2] for x in asks[1:5]]), 0) AS a5 FROM bk)"""
)


@query(
    "depth_rows",
    with_(
        BOOKS_SQL,
        """SELECT market_id || '/' || asset_id AS symbol, n AS last_update_id, bid AS best_bid, ask AS best_ask, round((bid + ask) / 2.0, 9) AS mid_price, round(ask - bid, 9) AS spread,
  round((ask - bid) / ((bid + ask) / 2.0) * 10000.0, 6) AS spread_bps, round(coalesce((b5 - a5) / nullif(b5 + a5, 0), 0), 9) AS order_book_imbalance_5, round((b5 * ask + a5 * bid) / nullif(b5 + a5, 0), 9) AS microprice_5,
  bd AS bid_depth_total, ad AS ask_depth_total, len(bids[1:10]) AS bid_levels, len(asks[1:10]) AS ask_levels, t AS received_ms FROM dp""",
    ),
)
def depth_rows(spark, sf_dir):
    """A depth row a book; the sides' JSON is given as its number of levels."""
    b = books(spark, sf_dir)
    s = b.select(F.concat_ws("/", *STREAM).alias("symbol"), "last_update_id", "bids", "asks", F.lit(None).cast("string").alias("exchange_timestamp"), F.timestamp_millis("timestamp_ms").alias("received_at"))
    d = depth.depth_rows(s)
    levels = [F.json_array_length(f"top_{x}s_json").cast("long").alias(f"{x}_levels") for x in ("bid", "ask")]
    rounded = [F.round(c, 6 if c == "spread_bps" else 9).alias(c) for c in ("mid_price", "spread", "spread_bps", "order_book_imbalance_5", "microprice_5")]
    return d.select("symbol", "last_update_id", "best_bid", "best_ask", *rounded, "bid_depth_total", "ask_depth_total", *levels, F.unix_millis("received_at").alias("received_ms"))


@query(
    "book_snapshots",
    with_(
        BOOKS_SQL,
        """SELECT t AS "timestamp", market_id, asset_id, bid AS best_bid, ask AS best_ask, bs AS best_bid_size, sz AS best_ask_size, round((bid + ask) / 2.0, 9) AS mid_price, round(ask - bid, 9) AS spread,
  bd AS bid_depth, ad AS ask_depth, round((bd - ad) / nullif(bd + ad, 0), 9) AS imbalance, round((ask * bs + bid * sz) / nullif(bs + sz, 0), 9) AS microprice FROM dp""",
    ),
)
def book_snapshots(spark, sf_dir):
    """The first generation's snapshot of each book."""
    s = depth.snapshot_rows(books(spark, sf_dir).withColumnRenamed("timestamp_ms", "timestamp"))
    return s.withColumns({c: F.round(c, 9) for c in ("mid_price", "spread", "imbalance", "microprice")})


@query(
    "raw_file_audit",
    with_(
        QUOTES_SQL,
        f""", n AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ms, sequence_id) AS n FROM q),
r AS (SELECT strftime(epoch_ms(timestamp_ms), '%Y-%m-%d') || '/' || market_id || '.jsonl' AS source_file, market_id AS slug, timestamp_ms // {_DAY} AS day, n, n % 97 <> 0 AS sound, timestamp_ms, asset_id FROM n),
g AS (SELECT source_file, max(timestamp_ms - p) AS gap FROM (SELECT *, lag(timestamp_ms) OVER (PARTITION BY source_file ORDER BY n) AS p FROM r WHERE sound) GROUP BY 1),
f AS (SELECT source_file, slug, day, count(*) AS lines, count_if(NOT sound) AS malformed, count_if(sound) AS quotes, min(timestamp_ms) FILTER (sound) AS first_ms, max(timestamp_ms) FILTER (sound) AS last_ms,
  count(DISTINCT asset_id) FILTER (sound) AS assets, coalesce(bool_or(asset_id = 'UP' AND day % 3 <> 0) FILTER (sound), false) AS up_represented, coalesce(bool_or(asset_id = 'DOWN' AND day % 3 <> 0) FILTER (sound), false) AS down_represented FROM r GROUP BY ALL),
c AS (SELECT *, coalesce(last_ms - first_ms, 0) AS duration_ms FROM f),
k AS (SELECT *, CASE WHEN quotes = 0 THEN 'DEGENERATE_EMPTY' WHEN NOT (up_represented AND down_represented) THEN 'ONE_SIDED_OR_INCOMPLETE' WHEN duration_ms >= 72000000 THEN 'COMPLETE' WHEN duration_ms >= 18000000 THEN 'TRUNCATED' ELSE 'MINIMAL_TRUNCATED' END AS classification FROM c)
SELECT source_file, slug, count(*) OVER (PARTITION BY slug) AS files_of_slug, lines, malformed, quotes, assets, up_represented, down_represented, first_ms, last_ms, duration_ms, coalesce(gap, 0) AS max_gap_ms, classification,
  classification IN ('COMPLETE', 'TRUNCATED') AS usable FROM k LEFT JOIN g USING (source_file)""",
    ),
)
def raw_file_audit(spark, sf_dir):
    """A file a market and day; every 97th line of a market is cut, every third day lacks its tokens."""
    from .replay_queries import raw_records

    ms = F.col("timestamp_ms")
    file = lambda market: F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit("/"), market, F.lit(".jsonl")).alias("source_file")
    whole = F.concat(F.lit('{"event":'), "event", F.lit("}"))
    lines = raw_records(spark, sf_dir).select(file("source_file"), "source_line", F.when(F.col("source_line") % 97 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    tokens = events(spark, sf_dir).where(F.floor(ms / _DAY) % 3 != 0).select(file("market_id")).distinct().select("source_file", F.lit("UP").alias("up_token"), F.lit("DOWN").alias("down_token"))
    return audit.audit(lines, tokens, 72_000_000, 18_000_000).drop("event_types", "markets")
