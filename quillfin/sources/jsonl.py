"""JSON-lines sources: tolerant scans, envelopes, and the normaliser of raw book events."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT
from .book import Side

NORMALIZED = T.StructType([*EVENT.fields]).add("change_idx", "long").add("reject_reason", "string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_line (from 1), value; blank lines included, an empty file has none.

    Files are read in splits, by as many tasks as their size asks for. Lines are counted per
    split, splits are summed up in the order of their bytes, and a line adds its place in
    its split: numbers are exact and no file goes through one task.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    meta = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_block_start")]
    # a split's lines are read one after the other by one task, so their ids follow each other
    rows = text.select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_name").alias("source_file"), *meta, F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_file_path", "_file_block_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    ahead = Window.partitionBy("_file_path").orderBy("_file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("_file_path", "_file_block_start", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return rows.join(placed, ["_file_path", "_file_block_start"]).select("source_file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("long").alias("source_line"), "value")


def tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed JSON lines; a bad line is a row with ``_parse_error`` (its text)."""
    return spark.read.schema(T.StructType([*schema.fields]).add("_parse_error", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_parse_error").json(path)


def records(line_rows: DataFrame) -> DataFrame:
    """Envelopes unnested: source_file, source_line, source_record_idx, outer_asset_id, event (JSON).

    Envelope A holds its events in ``event``, B in ``data``; else the line is an event. A
    list gives a row an element. Lines that are blank or no JSON object have event null
    and ``problem`` EMPTY_RECORD or MALFORMED_JSON.
    """
    v = F.col("value")
    keep = ["source_file", "source_line"]
    own = line_rows.select(*keep, v, F.try_parse_json(v).alias("j"))
    inner = F.coalesce(F.get_json_object("value", "$.event"), F.get_json_object("value", "$.data"))
    wrapped = inner.isNotNull()
    listed = F.trim(inner).startswith("[")
    parts = F.when(wrapped & listed, F.from_json(inner, "array<string>")).otherwise(F.array(F.coalesce(inner, v)))
    is_object = F.trim(v).startswith("{") & F.col("j").isNotNull()
    problem = F.when(F.trim(v) == "", "EMPTY_RECORD").when(~is_object, "MALFORMED_JSON")
    out = own.withColumns({"problem": problem, "outer_asset_id": F.when(wrapped, F.get_json_object("value", "$.asset_id"))})
    out = out.withColumn("parts", F.when(F.col("problem").isNull(), parts).otherwise(F.array(F.lit(None).cast("string"))))
    return out.select(*keep, "outer_asset_id", "problem", F.posexplode("parts").alias("source_record_idx", "event")).withColumn("source_record_idx", F.col("source_record_idx").cast("long"))


def _number(x) -> float | None:
    if isinstance(x, bool):
        return float(x)
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class Book:
    """Price levels of one asset."""

    def __init__(self):
        self.bids, self.asks = Side(True), Side(False)

    def snapshot(self, bids, asks) -> None:
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            found = [tuple(_number(level.get(k)) for k in ("price", "size")) for level in levels or [] if isinstance(level, dict)]
            side.replace([(p, s) for p, s in found if p is not None and s is not None and p > 0 and s > 0])

    def change(self, side: str, price: float, size: float) -> None:
        levels = {"BUY": self.bids, "SELL": self.asks}.get(side)
        if levels is not None:
            levels.put(price, size)

    def best(self):
        b, a = self.bids.best(), self.asks.best()
        return b, a, self.bids.levels.get(b, 0.0), self.asks.levels.get(a, 0.0)


def _check(ts, market, asset, bid, ask, bid_size, ask_size, low, high, min_price, max_price) -> str | None:
    """The first broken rule, in the validator's order."""
    if ts is None or ts == "":
        return "MISSING_TIMESTAMP"
    try:
        ts = int(ts)
    except (TypeError, ValueError):
        return "INVALID_TIMESTAMP"
    if not low <= ts <= high:
        return "OUT_OF_BOUNDS_TIMESTAMP"
    if not market or not str(market).strip():
        return "MISSING_MARKET_ID"
    if not asset or not str(asset).strip():
        return "MISSING_ASSET_ID"
    for pair, kind in (((bid, ask), "PRICE"), ((bid_size, ask_size), "SIZE")):
        if None in pair:
            return f"MISSING_{kind}"
        a, b = map(_number, pair)
        if a is None or b is None or not math.isfinite(a) or not math.isfinite(b):
            return f"INVALID_{kind}"
        if kind == "PRICE":
            if min(a, b) <= min_price or (max_price is not None and max(a, b) >= max_price):
                return "IMPOSSIBLE_PRICE"
            if a >= b:
                return "CROSSED_BOOK"
        elif min(a, b) <= 0:
            return "NON_POSITIVE_DEPTH"
    return None


def _first(event: dict, *names):
    for n in names:
        if n in event:
            return event[n]
    return None


#: Lines of a file whose snapshots are counted by one task at a time.
LINE_BLOCK = 10_000


def segments(record_rows: DataFrame, line_block: int = LINE_BLOCK) -> DataFrame:
    """Records once for each asset they touch (``route``), with ``segment``: how many
    snapshots of it the file has had up to there.

    A snapshot replaces an asset's book, so segments fold by themselves. Snapshots are counted
    per block of lines, blocks are summed up in order, and a record adds those of its own
    block. Records of no book have a null route and their block for a segment.
    """
    event, key = F.col("event"), F.get_json_object("event", "$.event_type")
    changes = F.from_json(F.get_json_object("event", "$.price_changes"), "array<string>")
    outer = F.coalesce("outer_asset_id", F.lit(""))
    asset = F.when(F.array_contains(F.json_object_keys("event"), "asset_id"), F.coalesce(F.get_json_object("event", "$.asset_id"), F.lit(""))).otherwise(outer)
    of_changes = F.array_distinct(F.transform(changes, lambda c: F.coalesce(F.get_json_object(c, "$.asset_id"), F.lit(""))))
    none = F.array(F.lit(None).cast("string"))
    known = F.col("problem").isNull() & event.isNotNull()
    routes = F.when(known & (key == "book"), F.array(asset)).when(known & (key == "price_change") & (F.size(changes) > 0), of_changes).otherwise(none)
    rows = record_rows.withColumns({"_block": F.floor(F.col("source_line") / line_block), "_book": F.when(known & (key == "book"), 1).otherwise(0)}).withColumn("route", F.explode(routes))
    keys = ["source_file", "route"]
    own = Window.partitionBy(*keys, "_block").orderBy("source_line", "source_record_idx").rowsBetween(Window.unboundedPreceding, 0)
    per = rows.where("route IS NOT NULL").groupBy(*keys, "_block").agg(F.sum("_book").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    counted = rows.withColumn("_in", F.sum("_book").over(own)).join(before, [*keys, "_block"], "left")
    segment = F.when(F.col("route").isNull(), F.col("_block")).otherwise(F.col("_before") + F.col("_in"))
    return counted.withColumn("segment", segment).drop("_block", "_book", "_in", "_before")


def normalize(
    record_rows: DataFrame, target_asset: str | None = None, min_price: float = 0.0, max_price: float | None = 1.0, low: int = 1_577_836_800_000, high: int = 2_051_222_400_000,
    line_block: int = LINE_BLOCK,
) -> DataFrame:
    """Canonical events and rejections (reject_reason) out of :func:`records`.

    Book state is a true fold in order of line, record and change; the book changes even
    when the quote it gives is rejected. An asset's fold starts anew at each of its
    snapshots, so a file is folded by many tasks, whole segments each, one after the other as
    their sorted rows come along and with one book in memory; without snapshots an asset
    of a file is one segment. A target asset hides other assets' rows: of changes
    before the book is touched, of snapshots after.
    """

    def fold(pdf, book, at):
        out = []
        for row in pdf.itertuples(index=False):
            route, place = row.route, (row.source_file, row.route, row.segment)
            if place != at:
                book, at = Book(), place
            line, idx, file = int(row.source_line), int(row.source_record_idx), row.source_file

            def put(ts, seq, market, asset, bid, ask, bs, as_, change, reason=None):
                if reason is None:
                    reason = _check(ts, market, asset, bid, ask, bs, as_, low, high, min_price, max_price)
                    early = ("MISSING_TIMESTAMP", "INVALID_TIMESTAMP", "OUT_OF_BOUNDS_TIMESTAMP", "MISSING_MARKET_ID", "MISSING_ASSET_ID")
                    if target_asset is not None and reason not in early and str(asset).strip() != target_asset:
                        return
                try:
                    number = int(seq)
                except (TypeError, ValueError):
                    number = line * 1000 + idx + change
                ok = reason is None
                out.append((int(ts) if ok else None, number, str(market).strip() if ok else None, str(asset).strip() if ok else None, *([_number(x) for x in (bid, ask, bs, as_)] if ok else [None] * 4), file, line, idx + change, change, reason))

            bad = lambda reason: put(None, None, None, None, None, None, None, None, 0, reason)
            if row.problem is not None and row.problem == row.problem:
                bad(row.problem)
                continue
            try:
                event = json.loads(row.event)
            except (TypeError, ValueError):
                event = None
            if not isinstance(event, dict):
                bad("EMPTY_RECORD")
                continue
            kind, outer = event.get("event_type"), row.outer_asset_id if isinstance(row.outer_asset_id, str) else None
            if kind == "book":
                asset = event.get("asset_id", outer)
                if not asset:
                    bad("MISSING_ASSET_ID")
                    continue
                book.snapshot(event.get("bids"), event.get("asks"))
                put(event.get("timestamp"), event.get("sequence_id"), event.get("market"), asset, *book.best(), 0)
            elif kind == "price_change":
                changes = event.get("price_changes")
                if not isinstance(changes, list) or not changes:
                    bad("NON_QUOTE_EVENT")
                    continue
                for k, c in enumerate(changes):
                    asset = c.get("asset_id") if isinstance(c, dict) else None
                    if (str(asset) if asset else "") != route:
                        continue
                    if not asset:
                        put(None, None, None, None, None, None, None, None, k, "MISSING_ASSET_ID")
                        continue
                    if target_asset is not None and asset != target_asset:
                        continue
                    price, size = _number(c.get("price")), _number(c.get("size"))
                    if price is None or size is None:
                        put(None, None, None, None, None, None, None, None, k, "INVALID_PRICE")
                        continue
                    book.change(str(c.get("side", "")).upper(), price, size)
                    put(event.get("timestamp"), c.get("sequence_id", line * 1000 + idx + k), event.get("market"), asset, *book.best(), k)
            elif kind is None and ("bid" in event or "best_bid" in event):
                if "ask" not in event and "best_ask" not in event:
                    bad("NON_QUOTE_EVENT")
                    continue
                put(
                    _first(event, "timestamp_ms", "timestamp"), event.get("sequence_id"), _first(event, "market_id", "market"), event.get("asset_id", outer),
                    _first(event, "bid", "best_bid"), _first(event, "ask", "best_ask"), _first(event, "bid_size", "best_bid_size"), _first(event, "ask_size", "best_ask_size"), 0,
                )
            else:
                bad("NON_QUOTE_EVENT")
        import pandas as pd

        frame = pd.DataFrame(out, columns=NORMALIZED.names)
        return frame.astype({c: "Int64" for c in ("timestamp_ms", "sequence_id", "source_line", "source_record_idx", "change_idx")}), book, at

    def folds(frames):
        book, at = Book(), None
        for pdf in frames:
            out, book, at = fold(pdf, book, at)
            yield out

    place = ["source_file", "route", "segment"]
    rows = segments(record_rows, line_block).select(*place, "source_line", "source_record_idx", "outer_asset_id", "problem", "event")
    return rows.repartition(*place).sortWithinPartitions(*place, "source_line", "source_record_idx").mapInPandas(folds, NORMALIZED)


def canonical(normalized: DataFrame) -> DataFrame:
    """Valid events, of equal (market, asset, time, sequence) the first to arrive."""
    from ..operators.dedup import first_arrival

    ok = normalized.where(F.col("reject_reason").isNull())
    kinds = first_arrival(ok, ["source_file", "market_id", "asset_id", "timestamp_ms", "sequence_id"], ["source_line", "source_record_idx", "change_idx"], ["bid", "ask", "bid_size", "ask_size"])
    return kinds.where("kind = 'kept'").select(*EVENT.names)


#: Text frames of the exchange's protocol.
CONTROL_FRAMES = ("PONG", "PING", "OK", "HEARTBEAT")
PROTOCOL_FRAMES = ("INVALID OPERATION", "NO NEW ASSETS", "ALREADY SUBSCRIBED")


def frame_kind(text: F.Column) -> F.Column:
    """Class of a text frame: EMPTY, CONTROL, PROTOCOL_ERROR, JSON or MALFORMED."""
    t = F.upper(F.trim(text))
    known = F.when(text.isNull() | (t == ""), "EMPTY").when(t.isin(*CONTROL_FRAMES), "CONTROL").when(t.isin(*PROTOCOL_FRAMES), "PROTOCOL_ERROR")
    return known.when(F.try_parse_json(F.trim(text)).isNotNull(), "JSON").otherwise("MALFORMED")


def frame_bytes_kind(raw: F.Column) -> F.Column:
    """The same of binary frames; what is no UTF-8 is BINARY."""
    return F.when(~F.is_valid_utf8(raw.cast("string")), "BINARY").otherwise(frame_kind(F.make_valid_utf8(raw.cast("string"))))
