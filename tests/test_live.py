"""Live books, the lossless grid and settlement on streams against plain code and batch."""

from collections import defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillfin.model import LIVE
from quillfin.operators import guards
from quillfin.plans.base import events
from quillfin.plans.replay_queries import _SLOT, live_events
from quillfin.sources.book import LiveBook, Side
from quillfin.streaming import live
from quillfin.streaming.grid import OUT, grid_stream


class PlainBook:
    """The same rules on dictionaries, every best price searched for."""

    def __init__(self):
        self.l, self.told, self.ready, self.degraded = ({}, {}), [None, None], False, False

    def own(self, k):
        return (max, min)[k](self.l[k]) if self.l[k] else None

    def apply(self, r):
        if r["kind"] == "book":
            for k, n in enumerate(("bid", "ask")):
                self.l[k].clear()
                self.l[k].update({p: s for p, s in zip(r[f"{n}_prices"], r[f"{n}_sizes"]) if s > 0})
                self.told[k] = self.own(k)
            self.ready, self.degraded = True, False
        elif r["kind"] == "overflow":
            self.degraded = True
        else:
            k = 0 if r["side"] == "BUY" else 1
            if r["size"] <= 0:
                self.l[k].pop(r["price"], None)
            else:
                self.l[k][r["price"]] = r["size"]
            for k, v in enumerate((r["best_bid"], r["best_ask"])):
                if v is None:
                    self.told[k] = self.own(k)
                else:
                    self.told[k] = v
                    for p in [p for p in self.l[k] if (p > v + 1e-9 if k == 0 else p < v - 1e-9)]:
                        del self.l[k][p]
            b, a = (self.told[k] if self.told[k] else self.own(k) for k in (0, 1))
            if b is not None and a is not None and b < a:
                for p in [p for p in self.l[0] if p >= a - 1e-9]:
                    del self.l[0][p]
                for p in [p for p in self.l[1] if p <= b + 1e-9]:
                    del self.l[1][p]
        best = []
        for k, f in ((0, max), (1, min)):
            seen = [v for v in (self.own(k), self.told[k]) if v is not None]
            best.append(f(seen) if seen else None)
        return (*best, *(0.0 if p is None else self.l[k].get(p, 100.0) for k, p in enumerate(best)), self.ready, self.degraded)


def run(stream, path):
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def expected(feed):
    books, out = defaultdict(PlainBook), []
    for r in sorted(feed, key=lambda r: (r["timestamp_ms"], r["sequence_id"])):
        key = (r["market_id"], r["asset_id"], r["timestamp_ms"] // _SLOT * _SLOT)
        out.append((*key, r["kind"], r["timestamp_ms"], r["sequence_id"], *books[key].apply(r)))
    return sorted(out)


def test_live_book_goes_on_after_a_restart(spark, tmp_path):
    feed = live_events(events(spark, SF), _SLOT).coalesce(1)
    rows = [r.asDict() for r in feed.collect()]
    cuts = sorted(r["timestamp_ms"] for r in rows)
    cut = cuts[len(cuts) // 2]
    path = str(tmp_path / "in")
    for part in (F.col("timestamp_ms") < cut, F.col("timestamp_ms") >= cut):
        # each run starts from the checkpoint of the one before, in the middle of a slot
        feed.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.schema(feed.schema).parquet(path).withColumn("at", F.timestamp_millis("timestamp_ms"))
        got = run(live.live_book(stream, _SLOT, 3 * 86_400_000, 86_400_000, 3_600_000, "0 seconds"), tmp_path / "out")
    got = got.collect()
    applied = sorted(tuple(r)[:12] for r in got if r.kind != "WATCHDOG")
    assert applied == expected(rows)
    # a warning for each slot and token that has events three days in and no snapshot by then
    late = defaultdict(lambda: [False, False])
    end = cuts[-1]
    for r in rows:
        slot = r["timestamp_ms"] // _SLOT * _SLOT
        early = r["timestamp_ms"] <= slot + 3 * 86_400_000
        late[r["market_id"], r["asset_id"], slot][0] |= early
        late[r["market_id"], r["asset_id"], slot][1] |= early and r["kind"] == "book"
    sure = {k for k, (seen, ready) in late.items() if seen and not ready and k[2] + 3 * 86_400_000 < end}
    warned = {(r.market_id, r.asset_id, r.slot) for r in got if r.kind == "WATCHDOG"}
    assert warned <= {k for k, (_, ready) in late.items() if not ready} and all(not r.initialized for r in got if r.kind == "WATCHDOG")
    assert sure or not warned


def test_watchdog_and_rollover(spark, tmp_path):
    book = lambda t, s, m="m": (m, "UP", t, s, "book", [0.41, 0.4], [3.0, 1.0], [0.47], [2.0], None, None, None, None, None)
    change = lambda t, s, side, p, z, bb=None, ba=None: ("m", "UP", t, s, "price_change", [], [], [], [], side, p, z, bb, ba)
    schema = "market_id string, asset_id string, timestamp_ms long, sequence_id long, kind string, bid_prices array<double>, bid_sizes array<double>, ask_prices array<double>, ask_sizes array<double>, side string, price double, size double, best_bid double, best_ask double"
    batches = [
        [book(1_000, 1), change(2_000, 2, "BUY", 0.43, 4.0), change(3_000, 3, "SELL", 0.44, 9.0, 0.42, 0.44)],
        [change(304_000, 4, "BUY", 0.3, 1.0)],  # next slot, no snapshot yet
        [change(306_500, 5, "SELL", 0.5, 1.0), ("o", "UP", 330_000, 9, "x", [], [], [], [], None, None, None, None, None)],
        [book(331_000, 6), ("m", "UP", 332_000, 7, "overflow", [], [], [], [], None, None, None, None, None)],
        [book(333_000, 8)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("timestamp_ms"))
        got = run(live.live_book(stream, delay="0 seconds"), tmp_path / "out")
    assert [(r.kind, r.timestamp_ms) for r in got.where("market_id = 'o'").collect()] == [("WATCHDOG", 305_000)]
    rows = sorted(got.where("market_id = 'm'").collect(), key=lambda r: (r.timestamp_ms, r.sequence_id or 0))
    seen = [(r.slot, r.kind, r.timestamp_ms, r.bid, r.ask, r.bid_size, r.ask_size, r.initialized, r.degraded) for r in rows]
    assert seen == [
        (0, "book", 1_000, 0.41, 0.47, 3.0, 2.0, True, False),
        (0, "price_change", 2_000, 0.43, 0.47, 4.0, 2.0, True, False),
        # the exchange's best bid 0.42 prunes 0.43 and shows although no level holds it
        (0, "price_change", 3_000, 0.42, 0.44, 100.0, 9.0, True, False),
        (300_000, "price_change", 304_000, 0.3, None, 1.0, 0.0, False, False),
        (300_000, "WATCHDOG", 305_000, None, None, 0.0, 0.0, False, False),
        (300_000, "price_change", 306_500, 0.3, 0.5, 1.0, 1.0, False, False),
        (300_000, "book", 331_000, 0.41, 0.47, 3.0, 2.0, True, False),
        (300_000, "overflow", 332_000, 0.41, 0.47, 3.0, 2.0, True, True),
        (300_000, "book", 333_000, 0.41, 0.47, 3.0, 2.0, True, False),
    ]
    assert [r.blackout for r in rows] == [False] * 9


def test_sides_and_crossed_levels():
    side = Side(True, {0.5: 1.0, 0.4: 2.0, 0.3: 0.0})
    assert side.best() == 0.5 and 0.3 not in side.levels
    side.put(0.5, 0)
    side.put(0.45, 1)
    assert side.best() == 0.45
    side.cut(0.42, 1e-9)
    assert side.levels == {0.4: 2.0} and side.best() == 0.4
    book = LiveBook({0.6: 1.0, 0.5: 1.0}, {0.55: 1.0, 0.7: 1.0})
    book.change("BUY", 0.1, 1.0, 0.52, None)  # reported best bid below the crossed ask
    assert set(book.sides[0].levels) == {0.5, 0.1} and book.top()[:2] == (0.52, 0.55)
    book.change("BUY", 0.2, None, -1.0, None)  # neither a size nor a usable report
    assert book.top()[0] == 0.52


def test_grid_loses_nothing_and_says_degraded(spark, tmp_path):
    schema = "market_id string, asset_id string, timestamp_ms long, sequence_id long, bid double, ask double, bid_size double, ask_size double, mark string"
    many = [("a", "UP", 10_000 + k % 997, k, k / 1e6, 0.5, 1.0, 1.0, None) for k in range(3000)]
    marks = [("a", "UP", 11_500, 1, None, None, None, None, "OVERFLOW"), ("a", "UP", 13_200, 2, None, None, None, None, "SNAPSHOT")]
    end = [("a", "UP", 15_000, 9_000, 0.3, 0.5, 1.0, 1.0, None), ("b", "UP", 60_000, 1, 0.3, 0.5, 1.0, 1.0, None)]
    spark.createDataFrame(many + marks + end, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("timestamp_ms"))
    got = run(grid_stream(stream, LIVE, "0 seconds"), tmp_path / "out").where("market_id = 'a'").orderBy("grid_timestamp_ms").collect()
    last = max((t, s) for _, _, t, s, *_ in many)
    first = max((t, s) for _, _, t, s, *_ in many if t <= 10_000)
    assert [(r.grid_timestamp_ms, r.source_timestamp_ms, r.source_sequence_id, r.degraded) for r in got] == [
        (10_000, *first, False), (11_000, *last, False), (12_000, *last, True), (13_000, *last, True), (14_000, *last, False), (15_000, 15_000, 9_000, False),
    ]
    assert got[0].asDict().keys() == set(OUT.names)


@pytest.mark.parametrize("batches", [1, 3])
def test_settlement_equals_batch(spark, tmp_path, batches):
    q = events(spark, SF).where("market_id = 'click'")
    o = q.select(F.col("sequence_id").alias("position_id"), "market_id", "asset_id", F.when(F.col("sequence_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("timestamp_ms").alias("opened_ms"))
    want = guards.settled(o, q, 3_600_000, 86_400_000).select("position_id", "exit_price", "settled_ms", "outcome").collect()
    times = sorted(r.timestamp_ms for r in q.select("timestamp_ms").collect())
    bounds = [times[len(times) * k // batches] for k in range(batches)] + [times[-1] + 1]
    end = times[-1] + 10**10
    q = q.unionByName(q.limit(1).withColumns({"timestamp_ms": F.lit(end), "asset_id": F.lit("end")}))
    o = o.unionByName(o.limit(1).withColumns({"opened_ms": F.lit(end), "position_id": F.lit(-1).cast("long")}))
    bounds[-1] = end + 1
    for lo, hi in zip(bounds, bounds[1:]):
        q.where(F.col("timestamp_ms").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
        o.where(F.col("opened_ms").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        opened = spark.readStream.schema(o.schema).parquet(str(tmp_path / "o")).withColumn("opened_at", F.timestamp_millis("opened_ms"))
        quotes = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")).withColumn("at", F.timestamp_millis("timestamp_ms"))
        got = run(live.settle_stream(opened, quotes, 3_600_000, 86_400_000, "0 seconds"), tmp_path / "out")
    assert sorted(got.where("position_id >= 0").collect()) == sorted(want) and len(want) > 50


def test_settlement_pairs_no_position_with_all_its_quotes(spark, tmp_path):
    """30,000 quotes that each of 30,000 positions could take: 9e8 pairs, which no join ends in time."""
    n = 30_000
    q = spark.range(n).select(F.lit("m").alias("market_id"), F.lit("a").alias("asset_id"), (10_000 + F.col("id") % 4000).alias("timestamp_ms"), F.col("id").alias("sequence_id"), (F.col("id") / 1e6).alias("bid"), F.lit(0.5).alias("ask"))
    o = spark.range(n).select(F.col("id").alias("position_id"), F.lit("m").alias("market_id"), F.lit("a").alias("asset_id"), F.lit("BUY").alias("side"), (3_000 + F.col("id") % 8000).alias("opened_ms"))
    q.unionByName(q.limit(1).withColumns({"timestamp_ms": F.lit(10**6).cast("long"), "market_id": F.lit("end")})).write.parquet(str(tmp_path / "q"))
    o.unionByName(o.limit(1).withColumns({"opened_ms": F.lit(10**6).cast("long"), "market_id": F.lit(None).cast("string"), "position_id": F.lit(None).cast("long")})).write.parquet(str(tmp_path / "o"))
    opened = spark.readStream.schema(o.schema).parquet(str(tmp_path / "o")).withColumn("opened_at", F.timestamp_millis("opened_ms"))
    quotes = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")).withColumn("at", F.timestamp_millis("timestamp_ms"))
    stream = live.settle_stream(opened, quotes, 5_000, 2_000, "0 seconds")
    running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    ended = running.awaitTermination(120)
    running.stop()
    assert ended
    got = {r.position_id: (r.exit_price, r.settled_ms, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for k in range(0, n, 97):
        due = 8_000 + k % 8000
        t = max(due, 10_000)  # a quote every millisecond from 10,000 to 13,999; due 8,000 still reaches the first
        want = ((t - 10_000) / 1e6, t, "SETTLED") if t < 14_000 and t <= due + 2_000 else (None, None, "FORCED_INCOMPLETE")
        assert got[k] == want, k
    assert len(got) == n
