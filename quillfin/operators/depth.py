"""Depth rows: what a full order-book snapshot says about its levels, as plain projections.

A snapshot's sides are arrays of struct<price double, size double>, in any order. Snapshots
stand for themselves, so no state is kept and nothing is shuffled but for removing repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import ratio

#: Columns of a depth row and of a first-generation snapshot, in this order.
DEPTH = [
    "symbol", "last_update_id", "best_bid", "best_ask", "mid_price", "spread", "spread_bps", "order_book_imbalance_5", "microprice_5",
    "bid_depth_total", "ask_depth_total", "top_bids_json", "top_asks_json", "exchange_timestamp", "received_at",
]
SNAPSHOT = ["timestamp", "market_id", "asset_id", "best_bid", "best_ask", "best_bid_size", "best_ask_size", "mid_price", "spread", "bid_depth", "ask_depth", "imbalance", "microprice"]


def side(levels: Column, best_first: str) -> Column:
    """Levels of a feed (text or numbers) as numbers, best first: 'bid' from high to low,
    'ask' from low to high. Levels without a positive price and size are left out, and of a
    price that is named twice the last size holds. Null or empty gives an empty array."""
    number = lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size"))
    plain = F.filter(F.transform(levels, number), lambda x: (x["price"] > 0) & (x["size"] > 0))
    numbered = F.transform(plain, lambda x, k: F.struct(x["price"].alias("price"), k.alias("k"), x["size"].alias("size")))
    ordered = F.sort_array(numbered)
    # equal prices stand together, the last named one at their end
    last = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k + 1)["price"] != x["price"], F.lit(True)))
    out = F.transform(last, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    out = F.reverse(out) if best_first == "bid" else out
    return F.coalesce(out, F.array().cast("array<struct<price:double,size:double>>"))


def total(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["size"])


def _touch(bids: Column, asks: Column) -> tuple[Column, Column]:
    return F.get(bids, 0)["price"], F.get(asks, 0)["price"]


def _pairs(levels: Column, most: int) -> Column:
    return F.to_json(F.transform(F.slice(levels, 1, most), lambda x: F.array(x["price"], x["size"])))


def depth_rows(snapshots: DataFrame, levels: int = 10, near: int = 5) -> DataFrame:
    """The columns DEPTH of snapshots (symbol, last_update_id, bids, asks, exchange_timestamp,
    received_at); of rows with one symbol and last_update_id the first received stays (of equal times
    the one with the least content).

    Imbalance is 0 without depth, prices that need both sides are null if one is missing, and
    the microprice weighs each best price with the other side's depth of ``near`` levels.
    """
    whole = F.min(F.struct("received_at", "exchange_timestamp", "bids", "asks")).alias("s")
    s = snapshots.groupBy("symbol", "last_update_id").agg(whole).select("symbol", "last_update_id", "s.*")
    s = s.withColumns({"bids": side(F.col("bids"), "bid"), "asks": side(F.col("asks"), "ask")})
    bids, asks = F.col("bids"), F.col("asks")
    bid, ask = _touch(bids, asks)
    b, a = total(F.slice(bids, 1, near)), total(F.slice(asks, 1, near))
    middle = (bid + ask) / 2.0
    return s.withColumns({
        "best_bid": bid, "best_ask": ask, "mid_price": middle, "spread": ask - bid, "spread_bps": F.when(middle > 0, ratio(ask - bid, middle) * 10000.0),
        "order_book_imbalance_5": F.coalesce(ratio(b - a, b + a), F.lit(0.0)), "microprice_5": ratio(b * ask + a * bid, b + a),
        "bid_depth_total": total(bids), "ask_depth_total": total(asks), "top_bids_json": _pairs(bids, levels), "top_asks_json": _pairs(asks, levels),
    }).select(*DEPTH)


def snapshot_rows(books: DataFrame) -> DataFrame:
    """The columns SNAPSHOT of books (timestamp, market_id, asset_id, bids, asks).

    Sizes at the touch are 0 without a side, imbalance is over the whole depth and null
    without any, and the microprice weighs with the sizes at the touch.
    """
    s = books.withColumns({"bids": side(F.col("bids"), "bid"), "asks": side(F.col("asks"), "ask")})
    bids, asks = F.col("bids"), F.col("asks")
    bid, ask = _touch(bids, asks)
    bs, as_ = F.coalesce(F.get(bids, 0)["size"], F.lit(0.0)), F.coalesce(F.get(asks, 0)["size"], F.lit(0.0))
    return s.withColumns({
        "best_bid": bid, "best_ask": ask, "best_bid_size": bs, "best_ask_size": as_, "mid_price": (bid + ask) / 2.0, "spread": ask - bid,
        "bid_depth": total(bids), "ask_depth": total(asks), "imbalance": ratio(total(bids) - total(asks), total(bids) + total(asks)), "microprice": ratio(ask * bs + bid * as_, bs + as_),
    }).select(*SNAPSHOT)


def from_book_events(events: DataFrame, symbol: str) -> DataFrame:
    """'book' events of a feed without update ids as snapshots for ``depth_rows``: the row's
    time in milliseconds stands in for the id. Columns: event_type, timestamp, bids, asks,
    received_at (timestamp in milliseconds as text or number)."""
    books = events.where(F.col("event_type") == "book")
    ms = F.unix_millis("received_at")
    return books.select(F.lit(symbol).alias("symbol"), ms.alias("last_update_id"), "bids", "asks", F.col("timestamp").cast("string").alias("exchange_timestamp"), "received_at")
