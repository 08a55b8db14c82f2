"""Live books on a stream: state a slot and token, with rollover, watchdog and recovery.

The state of a book is a map of levels on each side and one row of flags, so a restart goes on
from the checkpoint in the middle of a slot. A slot's tokens are keys of their own: a rollover
starts empty books without touching the old ones, which a timer deletes once their slot is past.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.book import LiveBook

OUT = (
    "market_id string, asset_id string, slot long, kind string, timestamp_ms long, sequence_id long, bid double, ask double, bid_size double, ask_size double, "
    "initialized boolean, degraded boolean"
)
_OUT = [c.strip().split(" ")[0] for c in OUT.split(",")]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an event of a live book holds besides market_id, asset_id and ``at`` (its receipt).
EVENT = ["timestamp_ms", "sequence_id", "kind", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes", "side", "price", "size", "best_bid", "best_ask"]


def with_rocks(spark: SparkSession) -> None:
    """Maps and timers need a state store that holds several columns; an own choice stays."""
    now = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "HDFSBacked" in now or not now:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _value(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


class _Book(StatefulProcessor):
    def __init__(self, slot_ms: int, watchdog_ms: int, keep_ms: int):
        self.slot_ms, self.watchdog_ms, self.keep_ms = slot_ms, watchdog_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "bids boolean, price double", "size double")
        self.flags = handle.getValueState("flags", "told_bid double, told_ask double, initialized boolean, degraded boolean")

    def _load(self) -> LiveBook:
        told_bid, told_ask, initialized, degraded = self.flags.get() if self.flags.exists() else (None, None, False, False)
        held: tuple[dict, dict] = ({}, {})
        if self.levels.exists():
            for (bids, price), (size,) in self.levels.iterator():
                held[0 if bids else 1][price] = size
        return LiveBook(*held, (_value(told_bid), _value(told_ask)), initialized, degraded)

    def handleInputRows(self, key, rows, timerValues):
        new = not self.flags.exists()
        book = self._load()
        before = [dict(s.levels) for s in book.sides]
        slot, out = int(key[2]), []
        every = pd.concat(list(rows)).sort_values(["timestamp_ms", "sequence_id"], kind="stable")
        for r in every[EVENT].itertuples(index=False):
            if r.kind == "book":
                book.snapshot(zip(r.bid_prices, r.bid_sizes), zip(r.ask_prices, r.ask_sizes))
            elif r.kind == "price_change":
                book.change(r.side, *map(_value, (r.price, r.size, r.best_bid, r.best_ask)))
            elif r.kind == "overflow":
                book.degraded = True
            else:
                continue
            out.append((*key, r.kind, r.timestamp_ms, r.sequence_id, *book.top(), book.initialized, book.degraded))
        for bids, side, old in zip((True, False), book.sides, before):
            for price in old.keys() - side.levels.keys():
                self.levels.removeKey((bids, price))
            for price, size in side.levels.items():
                if old.get(price) != size:
                    self.levels.updateValue((bids, price), (size,))
        self.flags.update((*book.told, book.initialized, book.degraded))
        if new:
            self.handle.registerTimer(slot + self.watchdog_ms)
            self.handle.registerTimer(slot + self.slot_ms + self.keep_ms)
        yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        slot, at, out = int(key[2]), expiredTimerInfo.getExpiryTimeInMs(), []
        if at >= slot + self.slot_ms + self.keep_ms:
            self.levels.clear()
            self.flags.clear()
        elif self.flags.exists() and not self.flags.get()[2]:
            out.append((*key, "WATCHDOG", at, None, None, None, 0.0, 0.0, False, bool(self.flags.get()[3])))
        yield pd.DataFrame(out, columns=_OUT).astype({"timestamp_ms": "Int64", "sequence_id": "Int64", "bid": "float64", "ask": "float64"})

    def close(self) -> None:
        pass


def live_book(events: DataFrame, slot_ms: int = 300_000, watchdog_ms: int = 5000, keep_ms: int = 5000, blackout_ms: int = 5000, delay: str = "10 seconds") -> DataFrame:
    """A row for each event applied to a token's book: its best prices and sizes after it.

    events: streaming, with market_id, asset_id, ``at`` (timestamp) and the columns EVENT. ``kind``
    says what one is: ``book`` (a snapshot; prices and sizes as arrays), ``price_change`` (side,
    price, size, and the best prices the exchange reports, or null) or ``overflow`` (frames
    were lost: the book is ``degraded`` until the next snapshot); others are passed over.
    Events apply in order of time and sequence within a micro-batch, batches as they arrive.

    Books start empty in each slot of ``slot_ms``. One that has events but no snapshot when the
    watermark is ``watchdog_ms`` into its slot gives a row of kind WATCHDOG: its feed has to be
    opened anew. State goes ``keep_ms`` after the slot's end. ``blackout``: no entries in the
    last ``blackout_ms`` of a slot.
    """
    with_rocks(events.sparkSession)
    slot = (F.floor(F.unix_millis("at") / slot_ms) * slot_ms).cast("long")
    marked = events.withWatermark("at", delay).withColumn("slot", slot)
    rows = marked.groupBy("market_id", "asset_id", "slot").transformWithStateInPandas(_Book(slot_ms, watchdog_ms, keep_ms), OUT, "Append", "EventTime")
    return rows.withColumn("blackout", F.col("slot") + slot_ms - F.col("timestamp_ms") <= blackout_ms)


_ASKED = ["is_quote", "micros", "ts", "seq", "bid", "ask", "position_id", "side"]
_SETTLED = "position_id string, exit_price double, settled_ms long, outcome string"
#: Stands for a missing number where state and pandas have only plain longs; it sorts first, as null does.
_NONE = -(2**63)


class _Settle(StatefulProcessor):
    """Quotes and due positions of a span of ``width``, and the quotes of the span after it.

    A position waits no longer than a span, so its quotes are the last ones of its own span from
    its due time on and the first ones of the next up to its end: the least quote of either
    is a running minimum, and no position is paired with the quotes it might take.
    """

    def __init__(self, wait: int, width: int):
        self.wait, self.width = wait, width

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")  # a batch's rows as an Arrow stream

    def handleInputRows(self, key, rows, timerValues):
        if not self.held.exists():
            self.handle.registerTimer(-(-(int(key[2]) + 2) * self.width // 1000))
        for f in rows:
            batch, sink = pa.RecordBatch.from_pandas(f[_ASKED], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            self.held.appendValue((sink.getvalue().to_pybytes(),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        f = pd.concat([pa.ipc.open_stream(bytes(x[0])).read_pandas() for x in self.held.get()])
        self.held.clear()
        p = f[~f["is_quote"]].drop_duplicates(["micros", "position_id", "side"])
        q = f[f["is_quote"]].sort_values(["ts", "seq", "bid", "ask"], na_position="first")
        n, end, due = len(q), (int(key[2]) + 1) * self.width, p["micros"].to_numpy()
        rank = np.argsort(q["micros"].to_numpy(), kind="stable")  # places among the quotes by time of receipt
        at = q["micros"].to_numpy()[rank]
        cut = np.searchsorted(at, end)
        own = np.append(np.minimum.accumulate(rank[:cut][::-1])[::-1], n)
        following = np.append(n, np.minimum.accumulate(rank[cut:]))
        best = np.minimum(own[np.searchsorted(at[:cut], due)], following[np.searchsorted(at[cut:], due + self.wait, "right")])
        took = q[["ts", "bid", "ask"]].reset_index(drop=True).astype({"ts": "Int64"}).reindex(best)
        price = np.where(p["side"] == "BUY", took["bid"], took["ask"])
        outcome = np.where(best < n, "SETTLED", "FORCED_INCOMPLETE")
        yield pd.DataFrame({"position_id": p["position_id"].to_numpy(), "exit_price": price, "settled_ms": took["ts"].array, "outcome": outcome})

    def close(self) -> None:
        pass


def settle_stream(positions: DataFrame, quotes: DataFrame, hold_ms: int = 5000, wait_ms: int = 2000, delay: str = "10 seconds") -> DataFrame:
    """Open positions settled by the first quote in time, as streams (append mode).

    positions: position_id, market_id, asset_id, side, ``opened_at``; quotes: market_id,
    asset_id, timestamp_ms, sequence_id, bid, ask, ``at``. A position waits for the first quote from
    ``hold_ms`` to ``hold_ms + wait_ms`` after it was opened; when the watermark shows that
    none will come, it leaves as FORCED_INCOMPLETE. State is held a stream and span of ``wait_ms``
    and ends with the next span, so a row meets the rows of two spans at most, a quote in two
    of them: work grows with the rows, not with the quotes a position could take.
    Columns as of the batch operator: position_id, exit_price, settled_ms, outcome.
    """
    with_rocks(positions.sparkSession)
    wait = wait_ms * 1000
    width, kind = max(wait, 1), positions.schema["position_id"].dataType
    span = lambda t: ((t - F.pmod(t, F.lit(width))) / width).cast("long")
    no_number, no_text, no_price = F.lit(_NONE), F.lit(None).cast("string"), F.lit(None).cast("double")
    known = lambda c: F.coalesce(F.col(c), no_number).alias
    p = positions.select("market_id", "asset_id", F.col("opened_at").alias("at"), F.col("position_id").cast("string").alias("position_id"), "side").where("at IS NOT NULL").withWatermark("at", delay)
    due = F.unix_micros("at") + hold_ms * 1000
    p = p.select("market_id", "asset_id", span(due).alias("span"), "at", F.lit(False).alias("is_quote"), due.alias("micros"), no_number.alias("ts"), no_number.alias("seq"), no_price.alias("bid"), no_price.alias("ask"), "position_id", "side")
    q = quotes.where("market_id IS NOT NULL AND asset_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    t = F.unix_micros("at")
    spans = F.array_distinct(F.array(span(t - wait), span(t)))
    q = q.select("market_id", "asset_id", F.explode(spans).alias("span"), "at", F.lit(True).alias("is_quote"), t.alias("micros"), known("timestamp_ms")("ts"), known("sequence_id")("seq"), "bid", "ask", no_text.alias("position_id"), no_text.alias("side"))
    met = p.unionByName(q).groupBy("market_id", "asset_id", "span").transformWithStateInPandas(_Settle(wait, width), _SETTLED, "Append", "EventTime")
    return met.select(F.col("position_id").cast(kind).alias("position_id"), "exit_price", F.nullif("settled_ms", no_number).alias("settled_ms"), "outcome")
