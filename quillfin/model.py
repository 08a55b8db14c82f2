"""Schemas, column lists and time scales shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The canonical event columns.
EVENT = (
    T.StructType()
    .add("timestamp_ms", "long").add("sequence_id", "long").add("market_id", "string").add("asset_id", "string")
    .add("bid", "double").add("ask", "double").add("bid_size", "double").add("ask_size", "double")
    .add("source_file", "string").add("source_line", "long").add("source_record_idx", "long")
)
STREAM = ["market_id", "asset_id"]
QUOTE = ["bid", "ask", "bid_size", "ask_size"]
#: The eleven causal features, in this order.
FEATURES = [
    "mid_price", "spread", "spread_bps", "mid_return_1s", "mid_return_3s", "mid_return_5s", "mid_volatility_5s",
    "bid_change_1s", "ask_change_1s", "microprice", "depth_imbalance",
]
#: Class ids.
CLASSES = ["DOWN", "FLAT", "UP"]
#: Columns that must never reach a feature table.
FORBIDDEN_PREFIXES = ("future_", "target_", "next_")


@dataclass(frozen=True)
class Clock:
    """Grid step, staleness, label horizon [low, high], burst gap; all in ms."""

    step: int = 1000
    stale: int = 5000
    low: int = 5000
    high: int = 7000
    burst: int = 5000
    least_move: float = 0.001


LIVE = Clock()
#: The driver's events are hours apart, so their clock runs 3600 times slower.
HOURS = Clock(3_600_000, 18_000_000, 18_000_000, 25_200_000, 21_600_000)


def stream_keys(columns: list[str]) -> list[str]:
    """Keys of a stream: with ``session_id`` if the table has it."""
    return (["session_id"] if "session_id" in columns else []) + STREAM
