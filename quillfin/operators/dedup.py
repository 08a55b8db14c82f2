"""Deduplication, change and gap statistics, validators of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import no_nan, ratio


def reject_reason(min_price: float = 0.0, max_price: float = 1.0, low: int = 1_577_836_800_000, high: int = 2_051_222_400_000) -> Column:
    """The first broken rule of a raw quote (string columns), null if it is valid.

    Columns: timestamp, market_id, asset_id, bid, ask, bid_size, ask_size.
    """
    c = F.col
    ts = F.expr("try_cast(trim(timestamp) AS BIGINT)")
    num = {k: F.expr(f"try_cast({k} AS DOUBLE)") for k in ("bid", "ask", "bid_size", "ask_size")}
    odd = lambda k: num[k].isNull() | F.isnan(num[k]) | (F.abs(num[k]) == float("inf"))
    blank = lambda k: c(k).isNull() | (F.trim(c(k)) == "")
    return (
        F.when(c("timestamp").isNull() | (c("timestamp") == ""), "MISSING_TIMESTAMP").when(ts.isNull(), "INVALID_TIMESTAMP").when(~ts.between(low, high), "OUT_OF_BOUNDS_TIMESTAMP")
        .when(blank("market_id"), "MISSING_MARKET_ID").when(blank("asset_id"), "MISSING_ASSET_ID")
        .when(c("bid").isNull() | c("ask").isNull(), "MISSING_PRICE").when(odd("bid") | odd("ask"), "INVALID_PRICE")
        .when((num["bid"] <= min_price) | (num["ask"] <= min_price) | (num["bid"] >= max_price) | (num["ask"] >= max_price), "IMPOSSIBLE_PRICE").when(num["bid"] >= num["ask"], "CROSSED_BOOK")
        .when(c("bid_size").isNull() | c("ask_size").isNull(), "MISSING_SIZE").when(odd("bid_size") | odd("ask_size"), "INVALID_SIZE")
        .when((num["bid_size"] <= 0) | (num["ask_size"] <= 0), "NON_POSITIVE_DEPTH")
    )


def first_arrival(df: DataFrame, key: list[str], arrival: list[str], payload: list[str]) -> DataFrame:
    """Adds arrival number and kind: kept, identical (payload rounded to 8 places) or conflicting."""
    w = Window.partitionBy(*key).orderBy(*arrival)
    digest = F.struct(*[F.round(p, 8) for p in payload])
    out = df.withColumns({"_p": digest, "arrival": F.row_number().over(w)}).withColumn("_first", F.first("_p").over(w))
    return out.withColumn("kind", F.when(F.col("arrival") == 1, "kept").when(F.col("_p").eqNullSafe(F.col("_first")), "identical").otherwise("conflicting")).drop("_p", "_first")


def keep_last(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The last arrival of each key, by aggregation (no sort of whole rows)."""
    rest = [c for c in df.columns if c not in (*key, *arrival)]
    best = F.max(F.struct(*arrival, *rest)).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in (*arrival, *rest)])


def record_id(df: DataFrame, skip: tuple[str, ...] = ("collected_at", "record_id")) -> Column:
    """Digest of a record's sorted columns without its volatile ones."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in skip))), 256)


def append_once(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` whose record_id is neither stored nor seen before in ``new``."""
    return new.dropDuplicates(["record_id"]).join(stored.select("record_id").distinct(), "record_id", "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table: xor and sum of row hashes, and the row count."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.bit_xor(h).alias("xor"), F.sum(h % 1_000_003).alias("sum"), F.count(F.lit(1)).alias("rows"))


def clean(df: DataFrame, numbers: list[str]) -> DataFrame:
    """NaN and infinities become null in ``numbers``."""
    return df.withColumns({c: F.when(F.abs(no_nan(c)) != float("inf"), F.col(c)) for c in numbers})


def gap_stats(df: DataFrame, time: str, order: list[str], keys: list[str], limits: list[int]) -> DataFrame:
    """median, p95, max of gaps between neighbours, and counts at or above each limit."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    g = df.select(*keys, (F.col(time) - F.lag(time).over(w)).alias("gap")).where(F.col("gap").isNotNull())
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), F.median("gap").alias("median_gap"), F.percentile("gap", 0.95).alias("p95_gap"), F.max("gap").alias("max_gap"), *[F.count_if(F.col("gap") >= x).alias(f"at_least_{k}") for k, x in enumerate(limits)]
    )


def timestamp_quality(df: DataFrame, time: str, arrival: str, keys: list[str], expected: int) -> DataFrame:
    """rows, duplicates, first, last, out-of-order arrivals, gaps above 1.5 x expected, max gap."""
    came = Window.partitionBy(*keys).orderBy(arrival)
    ordered = Window.partitionBy(*keys).orderBy(time, arrival)
    d = df.select(*keys, time, F.lag(time).over(came).alias("_b"), F.lag(time).over(ordered).alias("_p"))
    gap = F.col(time) - F.col("_p")
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gap == 0).alias("duplicates"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_if(F.col(time) < F.col("_b")).alias("out_of_order"),
        F.count_if(gap > 1.5 * expected).alias("gaps"), F.max(gap).alias("max_gap"),
    )


def quality_score(samples: Column, unique_bbo: Column, price_changes: Column, spread_changes: Column) -> Column:
    """Heuristic score of a market's data, 0 to 100."""
    part = lambda x, full, weight: F.least(x / full, F.lit(1.0)) * weight
    return F.when(samples == 0, 0.0).otherwise(F.round(part(samples, 30, 40) + part(unique_bbo, 5, 30) + part(price_changes, 3, 20) + part(spread_changes, 3, 10), 2))


def missing_times(df: DataFrame, time: str, step: int, keys: list[str]) -> DataFrame:
    """Grid times between a key's first and last that it lacks."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    every = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step))).alias(time))
    return every.join(df.select(*keys, time).distinct(), [*keys, time], "left_anti")


def top_share(df: DataFrame, column: str) -> DataFrame:
    """Distinct values and the share of the most frequent one (near-constant from 0.98)."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(column).alias("distinct_values"), ratio(F.max("n"), F.sum("n")).alias("top_share"))


def by_first_complete_key(df: DataFrame, ladder: list[list[str]], arrival: list[str]) -> DataFrame:
    """The first arrival of each key, by the first key of ``ladder`` whose last column is never null.

    The last key of the ladder is taken if none is complete; keys with columns that the table
    lacks are passed over. Nulls are equal as keys. Only one row of counts reaches the driver.
    """
    known = [k for k in ladder if set(k) <= set(df.columns)]
    if not known:
        raise ValueError(f"no key of {ladder} is in the table")
    gaps = df.agg(*[F.count_if(F.col(k[-1]).isNull()).alias(f"k{j}") for j, k in enumerate(known)]).first()
    key = next((k for j, k in enumerate(known) if gaps[j] == 0), known[-1])
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*arrival, *[c for c in rest if c not in arrival])).alias("_b")
    return df.groupBy(*key).agg(first).select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in df.columns])
