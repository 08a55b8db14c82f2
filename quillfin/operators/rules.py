"""Validator suites: a set of rules becomes one window pass and one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import share


@dataclass(frozen=True)
class Rule:
    """Rows for which ``wrong`` holds break the rule; ``severity`` is FAIL or WARNING.

    With ``unless`` the rule is broken if no row is marked instead.
    """

    name: str
    wrong: Column
    severity: str = "FAIL"
    unless: bool = False


def validated(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """keys, check, observed, status (PASS, WARNING or FAIL): a row a rule and group.

    Conditions may use windows; those of one order share a sort. Marks are summed up before
    the shuffle by ``keys``, so all rules cost one aggregate. A null condition is no breach;
    an empty table has no groups and gives no rows.
    """
    marked = rows.select(*keys, *[r.wrong.alias(f"_{k}") for k, r in enumerate(rules)])
    one = marked.groupBy(*keys).agg(*[F.count_if(f"_{k}").alias(f"_{k}") for k in range(len(rules))])
    items = []
    for k, r in enumerate(rules):
        seen = F.col(f"_{k}")
        ok = seen > 0 if r.unless else seen == 0
        items.append(F.struct(F.lit(r.name).alias("check"), seen.alias("observed"), F.when(ok, "PASS").otherwise(r.severity).alias("status")))
    return one.select(*keys, F.inline(F.array(*items)))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, failed, warned, verdict: FAIL if a check failed, else WARNING or PASS."""
    out = checks.groupBy(*keys).agg(F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "WARNING").alias("warned"))
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARNING").otherwise("PASS"))


#: What a candle must have.
CANDLE = ["source", "symbol", "source_timestamp", "open", "high", "low", "close", "volume"]


def candle_rules(order: str, time: str, keys: list[str], expected_ms: int) -> list[Rule]:
    """The session checks on candles (CANDLE columns, record_id, ``time`` when each was taken).

    Candles that lack a value count as missing alone and are not judged by price. ``order``
    is the order of arrival. A gap is more than 1.5 times what is allowed, which is twice
    ``expected_ms`` or two seconds over it, as a poll may take that long.
    """
    c = F.col
    there = F.lit(True)
    for name in CANDLE:
        there = there & c(name).isNotNull()
    arrival = Window.partitionBy(*keys).orderBy(order)
    chronological = Window.partitionBy(*keys).orderBy(time, order)
    pause = c(time) - F.lag(time).over(chronological)
    longest = 1.5 * max(2 * expected_ms, expected_ms + 2000)
    prices = (c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)
    highs = (c("high") < c("low")) | (c("high") < c("open")) | (c("high") < c("close"))
    again = F.row_number().over(Window.partitionBy(*keys, "record_id").orderBy(order)) > 1
    return [
        Rule("required_fields", ~there), Rule("positive_prices", there & prices), Rule("high_low_validity", there & highs), Rule("non_negative_volume", there & (c("volume") < 0)),
        Rule("duplicate_records", c("record_id").isNotNull() & again), Rule("timestamp_ordering", c(time) < F.lag(time).over(arrival)), Rule("duplicate_timestamps", pause == 0),
        Rule("missing_intervals", pause > longest), Rule("candle_source_timestamps", c("source_timestamp") < F.lag("source_timestamp").over(arrival)),
    ]


def depth_rules(order: str, keys: list[str]) -> list[Rule]:
    """The session checks on depth snapshots: last_update_id, bids and asks (arrays of structs price, size)."""
    w = Window.partitionBy(*keys).orderBy(order)
    bad = lambda x: (x["price"] <= 0) | (x["size"] < 0)
    wrong = F.coalesce(F.exists("bids", bad), F.lit(False)) | F.coalesce(F.exists("asks", bad), F.lit(False))
    crossed = F.array_max(F.transform("bids", lambda x: x["price"])) > F.array_min(F.transform("asks", lambda x: x["price"]))
    return [Rule("l2_uncrossed_books", crossed), Rule("l2_monotonic_sequence", F.col("last_update_id") <= F.coalesce(F.lag("last_update_id").over(w), F.lit(-1))), Rule("l2_valid_levels", wrong)]


def snapshot_rules(order: str, keys: list[str]) -> list[Rule]:
    """The checks on first-generation snapshots (best_bid, best_ask, mid_price, spread,
    bid_depth, ask_depth); a mid price that never moves is a warning."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(order)
    needed = ["best_bid", "best_ask", "mid_price", "spread", "bid_depth", "ask_depth"]
    missing = [Rule(f"missing_{n}", c(n).isNull(), "WARNING") for n in needed]
    moved = c("mid_price") != F.lag("mid_price").over(w)
    return [*missing, Rule("mid_price_positive", c("mid_price") <= 0), Rule("bid_over_ask", c("best_bid") > c("best_ask")), Rule("negative_spread", c("spread") < 0), Rule("price_movement", moved, "WARNING", unless=True)]


def movement(rows: DataFrame, keys: list[str], order: str, price: str = "mid_price") -> DataFrame:
    """keys, rows, distinct_prices, changes, change_ratio, mean_return, std_return of a price."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.lag(price).over(w)
    moved = rows.select(*keys, price, (F.col(price) != last).alias("_c"), (F.col(price) / F.nullif(last, F.lit(0)) - 1).alias("_r"))
    out = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(price).alias("distinct_prices"), F.count_if("_c").alias("changes"), F.avg("_r").alias("mean_return"), F.stddev_samp("_r").alias("std_return"))
    return out.withColumn("change_ratio", share(F.col("changes"), F.col("rows")))
