"""Queries on raw events, book replay, event-driven fills, streams and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quotes import book_imbalance, mid
from ..model import FEATURES, HOURS, STREAM
from ..operators import execution, label, learn, split
from ..operators.running import SPAN, numbered
from ..sources import jsonl
from .base import GRID_SQL, LABEL_SQL, QUOTES_SQL, events, featured, grid, labeled, query, table, with_


def raw_records(spark, sf_dir):
    """The quotes as raw feed records: a snapshot every 50 events of a market, else changes."""
    q = numbered(events(spark, sf_dir), ["market_id"], ["timestamp_ms", "sequence_id"], F.floor(F.col("timestamp_ms") / SPAN), "_line")
    level = lambda p, s: F.struct(F.col(p).cast("string").alias("price"), F.col(s).cast("string").alias("size"))
    ts = F.col("timestamp_ms").cast("string").alias("timestamp")
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), F.col("market_id").alias("market"), "asset_id", ts, F.array(level("bid", "bid_size")).alias("bids"), F.array(level("ask", "ask_size")).alias("asks")))
    change = lambda p, s, side: F.struct("asset_id", F.col(p).cast("string").alias("price"), F.when(F.col("sequence_id") % 7 == 0, "0").otherwise(F.col(s).cast("string")).alias("size"), F.lit(side).alias("side"))
    delta = F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.col("market_id").alias("market"), ts, F.array(change("bid", "bid_size", "BUY"), change("ask", "ask_size", "SELL")).alias("price_changes")))
    n = F.col("_line")
    return q.select(
        F.col("market_id").alias("source_file"), n.alias("source_line"), F.lit(None).cast("string").alias("outer_asset_id"), F.lit(None).cast("string").alias("problem"),
        F.lit(0).cast("long").alias("source_record_idx"), F.when((n - 1) % 50 < 2, book).otherwise(delta).alias("event"), "timestamp_ms",
    )


@query("l2_replay")
def l2_replay(spark, sf_dir):
    """Book replay of raw records into canonical quotes (a fold a file)."""
    return jsonl.canonical(jsonl.normalize(raw_records(spark, sf_dir)))


@query("l2_rejections")
def l2_rejections(spark, sf_dir):
    return jsonl.normalize(raw_records(spark, sf_dir)).groupBy(F.coalesce("reject_reason", F.lit("VALID")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "topk_levels",
    with_(
        QUOTES_SQL,
        """, d AS (SELECT market_id, timestamp_ms // 86400000 AS day, bid, max(bid_size) AS bs FROM q GROUP BY ALL), e AS (SELECT market_id, timestamp_ms // 86400000 AS day, ask, max(ask_size) AS s FROM q GROUP BY ALL),
b AS (SELECT market_id, day, sum(bs) AS bv, max(bid) AS best_bid FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY market_id, day ORDER BY bid DESC) <= 5) GROUP BY ALL),
a AS (SELECT market_id, day, sum(s) AS av, min(ask) AS best_ask FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY market_id, day ORDER BY ask) <= 5) GROUP BY ALL)
SELECT market_id, day, best_bid, best_ask, round((bv - av) / (bv + av), 9) AS imbalance FROM b JOIN a USING (market_id, day)""",
    ),
)
def topk_levels(spark, sf_dir):
    """A book a market and day; imbalance of the five best levels of each side."""
    q = events(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp_ms") / 86_400_000).cast("long"))
    side = lambda p, s, name: q.groupBy("market_id", "day", F.col(p).alias("price")).agg(F.max(s).alias("size")).groupBy("market_id", "day").agg(F.collect_list(F.struct("price", "size")).alias(name))
    b = side("bid", "bid_size", "bids").join(side("ask", "ask_size", "asks"), ["market_id", "day"])
    return b.select("market_id", "day", F.array_max("bids.price").alias("best_bid"), F.array_min("asks.price").alias("best_ask"), F.round(book_imbalance(F.col("bids"), F.col("asks")), 9).alias("imbalance"))


@query(
    "frame_kinds",
    """WITH f AS (SELECT CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'PONG' WHEN 2 THEN ' ' WHEN 3 THEN 'INVALID OPERATION' WHEN 4 THEN '{broken' ELSE 'ping' END AS t, event_id % 6 AS k FROM events)
SELECT CASE k WHEN 0 THEN 'JSON' WHEN 1 THEN 'CONTROL' WHEN 2 THEN 'EMPTY' WHEN 3 THEN 'PROTOCOL_ERROR' WHEN 4 THEN 'MALFORMED' ELSE 'CONTROL' END AS kind, count(*) AS frames FROM f GROUP BY 1""",
)
def frame_kinds(spark, sf_dir):
    k = F.col("event_id") % 6
    t = F.when(k == 0, F.col("props")).when(k == 1, "PONG").when(k == 2, " ").when(k == 3, "INVALID OPERATION").when(k == 4, "{broken").otherwise("ping")
    return table(spark, sf_dir, "events").select(jsonl.frame_kind(t).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("frames"))


@query(
    "slot_rollover",
    with_(
        QUOTES_SQL,
        """, s AS (SELECT *, timestamp_ms // 300000 * 300000 AS slot FROM q)
SELECT slot, count(*) AS events, count_if(slot + 300000 - timestamp_ms <= 5000) AS in_blackout, count(DISTINCT market_id || asset_id) AS streams FROM s GROUP BY slot""",
    ),
)
def slot_rollover(spark, sf_dir):
    """Five-minute slots; no entries in a slot's last five seconds."""
    slot = (F.floor(F.col("timestamp_ms") / 300_000) * 300_000).cast("long")
    s = events(spark, sf_dir).withColumn("slot", slot)
    return s.groupBy("slot").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("slot") + 300_000 - F.col("timestamp_ms") <= 5000).alias("in_blackout"), F.count_distinct(F.concat("market_id", "asset_id")).alias("streams"))


@query(
    "sequence_gaps",
    with_(
        QUOTES_SQL,
        """, g AS (SELECT *, sequence_id - lag(sequence_id) OVER (PARTITION BY market_id ORDER BY sequence_id) AS step FROM q)
SELECT market_id, count(*) AS updates, count_if(step > 1) AS gaps, max(step) AS widest FROM g GROUP BY 1""",
    ),
)
def sequence_gaps(spark, sf_dir):
    """Missing update ids; a live book would ask for a new snapshot there."""
    w = Window.partitionBy("market_id").orderBy("sequence_id")
    g = events(spark, sf_dir).withColumn("step", F.col("sequence_id") - F.lag("sequence_id").over(w))
    return g.groupBy("market_id").agg(F.count(F.lit(1)).alias("updates"), F.count_if(F.col("step") > 1).alias("gaps"), F.max("step").alias("widest"))


_T, _X = 6 * HOURS.step, 5 * HOURS.step
_FILL = "CASE WHEN side = 'BUY' THEN e.ask <= lim OR e.bid < lim ELSE e.bid >= lim OR e.ask > lim END"
EVENT_SIM_SQL = (
    QUOTES_SQL
    + f""",
od AS (SELECT *, CASE WHEN sequence_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN sequence_id % 2 = 0 THEN bid ELSE ask END AS lim FROM q),
fi AS (SELECT o.sequence_id, min((e.timestamp_ms, e.sequence_id)) AS f FROM od o JOIN q e ON o.market_id = e.market_id AND o.asset_id = e.asset_id AND e.timestamp_ms > o.timestamp_ms AND e.timestamp_ms <= o.timestamp_ms + {_T} WHERE {_FILL} GROUP BY 1),
fx AS (SELECT o.*, f[1] AS fill_ms FROM od o LEFT JOIN fi USING (sequence_id)),
v AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, timestamp_ms ORDER BY sequence_id) = 1),
xx AS (SELECT fx.sequence_id, side, lim, fill_ms, x.bid AS xb, x.ask AS xa FROM (SELECT *, fill_ms + {_X} AS due FROM fx WHERE fill_ms IS NOT NULL) fx ASOF LEFT JOIN v x ON fx.market_id = x.market_id AND fx.asset_id = x.asset_id AND fx.due <= x.timestamp_ms)"""
)


def _event_sim(q, orders):
    """Event-driven passive orders: the first later quote in time that fills, then the first
    quote after the holding time."""
    from ..operators.asof import forward_match

    even = F.col("sequence_id") % 2 == 0
    o = orders.withColumns({"side": F.when(even, "BUY").otherwise("SELL"), "limit_price": F.when(even, F.col("bid")).otherwise(F.col("ask"))})
    o = o.select("sequence_id", *STREAM, "timestamp_ms", "side", "limit_price")
    fills = execution.first_fills(o.withColumnRenamed("sequence_id", "order_id"), q, _T, STREAM).withColumnRenamed("order_id", "sequence_id")
    out = forward_match(o.join(fills, "sequence_id"), q, "fill_timestamp_ms", _X, None, ["bid", "ask"], keys=STREAM)
    exit_price = F.when(F.col("side") == "BUY", F.col("target.bid")).otherwise(F.col("target.ask"))
    every = o.join(out.select("sequence_id", "fill_timestamp_ms", exit_price.alias("exit_price")), "sequence_id", "left")
    status = F.when(F.col("fill_timestamp_ms").isNull(), "CANCELLED_UNFILLED").when(F.col("exit_price").isNull(), "INCOMPLETE_MISSING_EXIT").otherwise("COMPLETED")
    return every.select("sequence_id", "side", "limit_price", "fill_timestamp_ms", "exit_price", status.alias("outcome"))


@query(
    "maker_event_sim",
    with_(
        EVENT_SIM_SQL,
        """SELECT o.sequence_id, o.side, o.lim AS limit_price, o.fill_ms AS fill_timestamp_ms, CASE WHEN o.side = 'BUY' THEN xb ELSE xa END AS exit_price,
  CASE WHEN o.fill_ms IS NULL THEN 'CANCELLED_UNFILLED' WHEN xb IS NULL THEN 'INCOMPLETE_MISSING_EXIT' ELSE 'COMPLETED' END AS outcome FROM fx o LEFT JOIN xx USING (sequence_id)""",
    ),
)
def maker_event_sim(spark, sf_dir):
    """A passive order on every quote."""
    q = events(spark, sf_dir)
    return _event_sim(q, q)


_ON = "OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms)"


@query(
    "feat_online",
    with_(
        GRID_SQL,
        f""", m AS (SELECT *, (bid + ask) / 2.0 AS mid FROM grid), o AS (SELECT *, """
        + ", ".join(f"(mid - coalesce(lag(mid, {k}) {_ON}, mid)) / greatest(coalesce(lag(mid, {k}) {_ON}, mid), 1e-6) AS r{k}" for k in (1, 3, 5))
        + f", row_number() {_ON} AS n FROM m) SELECT market_id, asset_id, grid_timestamp_ms, round(r1, 9) AS r1, round(r3, 9) AS r3, round(r5, 9) AS r5, n >= 10 AS warm FROM o",
    ),
)
def feat_online(spark, sf_dir):
    """The live engine's features: a missing lag is the row itself, denominators at least 1e-6."""
    w = Window.partitionBy(*STREAM).orderBy("grid_timestamp_ms")
    g = grid(spark, sf_dir).withColumn("mid", mid())
    r = {}
    for k in (1, 3, 5):
        before = F.coalesce(F.lag("mid", k).over(w), F.col("mid"))
        r[f"r{k}"] = F.round((F.col("mid") - before) / F.greatest(before, F.lit(1e-6)), 9)
    return g.withColumns(r).select(*STREAM, "grid_timestamp_ms", "r1", "r3", "r5", (F.row_number().over(w) >= 10).alias("warm"))


def _shared(spark, name):
    """A fresh folder in the shared one (a local one only where none is set, as in tests)."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='quillfin-')).rstrip('/')}/quillfin/{name}-{uuid.uuid4().hex}"


def _ran(stream, path):
    """Run a stream over all its input; its rows."""
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")


_END = "~end"


def _stored(rows, path, time="timestamp_ms"):
    """``rows`` as a stream from stored files, with a row of market ~end long after them
    that moves the watermark past all others."""
    late = rows.groupBy().agg(F.max(time).alias("_t"))
    end = late.where(F.col("_t").isNotNull()).select(*[(F.col("_t") + 1_000 * 86_400_000 if c == time else F.lit(_END) if c == "market_id" else F.lit("") if c == "asset_id" else F.lit(0)).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(end).write.parquet(path)
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).parquet(path).withColumn("at", F.timestamp_millis(time))


@query("stream_grid_parity", with_(GRID_SQL, "SELECT *, false AS degraded FROM grid"))
def stream_grid_parity(spark, sf_dir):
    """The grid of the streaming operator over all events, replayed to the end."""
    from ..streaming.grid import grid_stream

    path = _shared(spark, "grid")
    return _ran(grid_stream(_stored(events(spark, sf_dir), f"{path}/in"), HOURS, "0 seconds"), path).where(F.col("market_id") != _END)


@query(
    "settlement_stream",
    with_(
        QUOTES_SQL,
        """, o AS (SELECT sequence_id AS position_id, market_id, asset_id, CASE WHEN sequence_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, timestamp_ms + 3600000 AS due FROM q),
v AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, timestamp_ms ORDER BY sequence_id) = 1),
m AS (SELECT o.*, v.timestamp_ms AS t, v.bid, v.ask FROM o ASOF LEFT JOIN v ON o.market_id = v.market_id AND o.asset_id = v.asset_id AND o.due <= v.timestamp_ms)
SELECT position_id, CASE WHEN t <= due + 14400000 THEN CASE WHEN side = 'BUY' THEN bid ELSE ask END END AS exit_price, CASE WHEN t <= due + 14400000 THEN t END AS settled_ms,
  CASE WHEN t <= due + 14400000 THEN 'SETTLED' ELSE 'FORCED_INCOMPLETE' END AS outcome FROM m""",
    ),
)
def settlement_stream(spark, sf_dir):
    """Positions on every quote settled by a join of two streams with watermarks."""
    from ..streaming.live import settle_stream

    path = _shared(spark, "settle")
    q = events(spark, sf_dir)
    side = F.when(F.col("sequence_id") % 2 == 0, "BUY").otherwise("SELL")
    o = q.select(F.col("sequence_id").alias("position_id"), *STREAM, side.alias("side"), F.col("timestamp_ms").alias("opened_ms"))
    opened = _stored(o, f"{path}/positions", "opened_ms").withColumnRenamed("at", "opened_at").withColumn("position_id", F.when(F.col("market_id") != _END, F.col("position_id")))
    out = settle_stream(opened, _stored(q, f"{path}/quotes"), 3_600_000, 14_400_000, "0 seconds")
    return _ran(out, path).where(F.col("position_id").isNotNull())


def live_events(q, slot_ms):
    """Quotes as a live feed: a snapshot at every seventh quote of a market's token, a lost
    frame at every 61st, changes otherwise, of which some report the exchange's best prices."""
    k = F.col("sequence_id")
    kind = F.when(k % 7 == 0, "book").when(k % 61 == 0, "overflow").otherwise("price_change")
    buy = k % 2 == 0
    price = F.when(buy, F.col("bid")).otherwise(F.col("ask"))
    return q.select(
        *STREAM, "timestamp_ms", k, kind.alias("kind"), F.array("bid", F.col("bid") - 0.01).alias("bid_prices"), F.array("bid_size", F.lit(5.0)).alias("bid_sizes"),
        F.array("ask", F.col("ask") + 0.01).alias("ask_prices"), F.array("ask_size", F.lit(0.0)).alias("ask_sizes"), F.when(buy, "BUY").otherwise("SELL").alias("side"),
        price.alias("price"), F.when(k % 5 == 0, 0.0).otherwise(F.col("bid_size")).alias("size"),
        F.when(k % 3 == 0, F.col("bid")).alias("best_bid"), F.when(k % 4 == 0, F.col("ask")).alias("best_ask"),
    )


_SLOT = 7 * 86_400_000


@query("live_book")
def live_book(spark, sf_dir):
    """Books of weekly slots over all events as a feed, with what the watchdog says."""
    from ..streaming import live

    path = _shared(spark, "book")
    feed = live_events(events(spark, sf_dir), _SLOT)
    feed.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(feed.schema).parquet(f"{path}/in").withColumn("at", F.timestamp_millis("timestamp_ms"))
    return _ran(live.live_book(stream, _SLOT, 3 * 86_400_000, 86_400_000, 3_600_000, "0 seconds"), path)


@query("baseline_models")
def baseline_models(spark, sf_dir):
    d = split.simple_cut(featured(spark, sf_dir), "grid_timestamp_ms", split.TIES)
    d = d.withColumn("y", F.when(F.col("label") == "DOWN", 0).when(F.col("label") == "FLAT", 1).otherwise(2))
    return learn.fit_and_score(d.where("split = 'train'"), d.where("split = 'validation'"), FEATURES)


@query("label_event_pool_counts", with_(LABEL_SQL, "SELECT 'events' AS pool, count(*) AS labels FROM labeled"))
def label_event_pool_counts(spark, sf_dir):
    return label.clean(labeled(spark, sf_dir)).agg(F.count(F.lit(1)).alias("labels")).select(F.lit("events").alias("pool"), "labels")
