"""Scalar functions on quotes, prices and probabilities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def mid(bid="bid", ask="ask") -> Column:
    return (_c(bid) + _c(ask)) / 2.0


def spread(bid="bid", ask="ask") -> Column:
    return _c(ask) - _c(bid)


def spread_bps(bid="bid", ask="ask") -> Column:
    return ratio(spread(bid, ask), mid(bid, ask)) * 10000.0


def microprice(bid="bid", ask="ask", bid_size="bid_size", ask_size="ask_size") -> Column:
    return ratio(_c(bid) * _c(ask_size) + _c(ask) * _c(bid_size), _c(bid_size) + _c(ask_size))


def depth_imbalance(bid_size="bid_size", ask_size="ask_size") -> Column:
    return ratio(_c(bid_size) - _c(ask_size), _c(bid_size) + _c(ask_size))


def book_imbalance(bids: Column, asks: Column, levels: int = 5) -> Column:
    """Imbalance of the best ``levels`` of two arrays of struct<price, size>; 0 if empty."""
    best_bids = F.slice(F.sort_array(bids, asc=False), 1, levels)
    best_asks = F.slice(F.sort_array(asks), 1, levels)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["size"])
    return F.coalesce(ratio(total(best_bids) - total(best_asks), total(best_bids) + total(best_asks)), F.lit(0.0))


def move_threshold(spread_: Column, least: float = 0.001) -> Column:
    return F.greatest(spread_ * 0.5, F.lit(least))


def move_label(delta: Column, threshold: Column) -> Column:
    return F.when(delta > threshold, "UP").when(delta < -threshold, "DOWN").otherwise("FLAT")


def grid_floor(ms, step: int) -> Column:
    return F.floor(_c(ms) / step).cast("long") * step


def grid_ceil(ms, step: int) -> Column:
    return F.floor((_c(ms) + (step - 1)) / step).cast("long") * step


def softmax(logits: list[Column], temperature: float | Column = 1.0) -> list[Column]:
    """Softmax shifted by the largest logit."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    parts = [F.exp((x - top) / temperature) for x in logits]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def argmax(probabilities: list[Column]) -> Column:
    """Number of the largest, the first one of equals."""
    a = F.array(*probabilities)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def signal(prediction: Column, confidence: Column, least: float = 0.60) -> Column:
    return F.when(confidence < least, "NO_TRADE").when(prediction == 2, "LONG").when(prediction == 0, "SHORT").otherwise("NO_TRADE")


def slipped(price: Column, side: Column, bps: float) -> Column:
    return F.when(side == "BUY", price * (1 + bps / 10000.0)).otherwise(price * (1 - bps / 10000.0))


def fill_class(side: Column, limit: Column, bid: Column, ask: Column) -> Column:
    """How a book observation touches a resting order; see the maker simulation."""
    invalid = bid.isNull() | ask.isNull() | (bid <= 0) | (ask <= 0) | (bid >= ask)
    buy = F.when(ask <= limit, "CONFIRMED_PRICE_THROUGH").when(bid < limit, "AMBIGUOUS_QUOTE_RETREAT").when(bid == limit, "TOUCH_REJECTED").otherwise("UNFILLED")
    sell = F.when(bid >= limit, "CONFIRMED_PRICE_THROUGH").when(ask > limit, "AMBIGUOUS_QUOTE_RETREAT").when(ask == limit, "TOUCH_REJECTED").otherwise("UNFILLED")
    return F.when(invalid, "UNFILLED").when(side == "BUY", buy).otherwise(sell)


def quotes_around(fair: Column, half_spread: Column | float, inventory: Column, skew: float) -> tuple[Column, Column]:
    """Bid and ask around a fair value leaned against the inventory."""
    centre = fair - inventory * skew
    return centre - half_spread, centre + half_spread


def no_nan(c) -> Column:
    """NaN becomes null, as at every boundary of this engine."""
    return F.when(~F.isnan(_c(c)), _c(c))
