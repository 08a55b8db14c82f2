"""The point-in-time grid on a stream: events wait in a buffer until their grid time has passed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..model import QUOTE, Clock
from .live import with_rocks

OUT = (
    T.StructType().add("market_id", "string").add("asset_id", "string").add("grid_timestamp_ms", "long").add("source_timestamp_ms", "long").add("source_sequence_id", "long")
    .add("bid", "double").add("ask", "double").add("bid_size", "double").add("ask_size", "double").add("event_age_ms", "long").add("is_stale", "boolean").add("degraded", "boolean")
)


def admit(events: DataFrame, receipt: str = "receipt_ms", source: str = "source_ms", tolerance: int = 5000) -> DataFrame:
    """Adds refused: INVALID_TIMESTAMP, FUTURE_DATED (source beyond receipt + tolerance) or null."""
    r = F.col(receipt)
    return events.withColumn("refused", F.when(r.isNull() | (r <= 0), "INVALID_TIMESTAMP").when(F.col(source) > r + tolerance, "FUTURE_DATED"))


class _Grid(StatefulProcessor):
    """Waiting events by grid cell: of a cell only its last quote and last mark can show."""

    def __init__(self, step: int, stale: int):
        self.step, self.stale = step, stale

    def init(self, handle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell long, mark boolean", "ts long, seq long, bid double, ask double, bid_size double, ask_size double, degraded boolean")
        self.place = handle.getValueState(
            "place", "next long, newest long, ts long, seq long, bid double, ask double, bid_size double, ask_size double, mark_ts long, mark_seq long, degraded boolean"
        )

    def handleInputRows(self, key, rows, timerValues):
        nxt, newest, *shown = self.place.get() if self.place.exists() else (None, None, *[None] * 8, False)
        fresh: dict[tuple[int, bool], tuple] = {}
        for f in rows:
            f = f.sort_values(["timestamp_ms", "sequence_id"], kind="stable")
            cell = -(-f["timestamp_ms"] // self.step) * self.step
            f = f.assign(cell=cell if nxt is None else cell.clip(lower=nxt))
            quotes, marks = f[f["mark"].isna()], f[f["mark"].isin(["OVERFLOW", "SNAPSHOT"])]
            if len(quotes):
                newest = max(int(quotes["timestamp_ms"].max()), newest or 0)
            for own, mark in ((quotes, False), (marks, True)):
                for r in own.drop_duplicates("cell", keep="last").itertuples(index=False):
                    at = (int(r.cell), mark)
                    value = (int(r.timestamp_ms), int(r.sequence_id), *((None,) * 4 if mark else (float(getattr(r, c)) for c in QUOTE)), r.mark == "OVERFLOW")
                    if at not in fresh or fresh[at][:2] <= value[:2]:
                        fresh[at] = value
        for at, value in fresh.items():
            old = self.cells.getValue(at) if self.cells.containsKey(at) else None
            if old is None or tuple(old[:2]) <= value[:2]:
                self.cells.updateValue(at, value)
        if nxt is None and newest is not None:
            nxt = min(c for c, mark in fresh if not mark)
        yield self._advance(key, nxt, newest, shown, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        nxt, newest, *shown = self.place.get()
        yield self._advance(key, nxt, newest, shown, timerValues)

    def _advance(self, key, nxt, newest, shown, timerValues) -> pd.DataFrame:
        """Grid times before the watermark, up to the newest event."""
        ts, seq, *quote = shown[:6]
        mark_ts, mark_seq, degraded = shown[6:]
        end, out = timerValues.getCurrentWatermarkInMs(), []
        if nxt is not None and nxt < end and nxt <= newest:
            waiting = {tuple(k): tuple(v) for k, v in self.cells.iterator()}
            # marks before the first quote's cell belong to it
            early = [k for k in waiting if k[0] < nxt]
            for k in sorted(early):
                mark_ts, mark_seq, degraded = *waiting[k][:2], bool(waiting[k][6])
                self.cells.removeKey(k)
            while nxt < end and nxt <= newest:
                e = waiting.get((nxt, False))
                if e is not None:
                    if ts is None or e[:2] >= (ts, seq):
                        ts, seq, *quote = e[:6]
                    self.cells.removeKey((nxt, False))
                m = waiting.get((nxt, True))
                if m is not None:
                    if mark_ts is None or m[:2] >= (mark_ts, mark_seq):
                        mark_ts, mark_seq, degraded = *m[:2], bool(m[6])
                    self.cells.removeKey((nxt, True))
                if ts is not None:
                    out.append((*key, nxt, ts, seq, *quote, nxt - ts, nxt - ts > self.stale, bool(degraded)))
                nxt += self.step
        self.place.update((nxt, newest, ts, seq, *quote, mark_ts, mark_seq, bool(degraded)))
        if nxt is not None and nxt <= newest:
            self.handle.registerTimer(nxt + 1)
        return pd.DataFrame(out, columns=OUT.names)

    def close(self) -> None:
        pass


def grid_stream(events: DataFrame, clock: Clock, delay: str = "10 seconds", tolerance: int | None = 5000) -> DataFrame:
    """Grid rows per stream as soon as the watermark has passed their time (append mode).

    events: streaming, with ``at`` (timestamp of receipt) besides the quote columns. Of the
    events that wait for a grid time only the last can show, so state holds one row a
    waiting cell and nothing is ever dropped for want of room. Late but not too late events find
    their place; nothing is retracted, and an event older than the quote shown already changes
    nothing. Events without a receipt time, or whose own time is more than ``tolerance`` ms
    beyond it, are refused (None: all are admitted).

    A column ``mark``, if there is one, is null for quotes; a row OVERFLOW (frames were lost
    upstream) makes the grid ``degraded`` from its time on, until a row SNAPSHOT.
    """
    if "mark" not in events.columns:
        events = events.withColumn("mark", F.lit(None).cast("string"))
    if tolerance is not None:
        receipt = events.withColumn("_receipt", F.unix_millis("at"))
        events = admit(receipt, "_receipt", "timestamp_ms", tolerance).where(F.col("refused").isNull()).drop("refused", "_receipt")
    with_rocks(events.sparkSession)
    marked = events.withWatermark("at", delay)
    return marked.groupBy("market_id", "asset_id").transformWithStateInPandas(_Grid(clock.step, clock.stale), OUT, "Append", "EventTime")


def burst_stream(events: DataFrame, gap: str, delay: str = "10 seconds") -> DataFrame:
    """Bursts as session windows: start, end, events."""
    marked = events.withWatermark("at", delay)
    out = marked.groupBy(F.session_window("at", gap).alias("w"), "market_id", "asset_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("market_id", "asset_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def append_new(path: str):
    """A foreachBatch function that appends records whose record_id is not stored yet."""
    from ..operators.dedup import append_once, record_id

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("record_id", record_id(batch))
        try:
            stored = spark.read.schema("record_id string").parquet(path)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], "record_id string")
        append_once(rows, stored).write.mode("append").parquet(path)

    return write
