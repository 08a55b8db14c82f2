"""Checks that stop a job, reasons against quotes, dedup ladders, session status and hard stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import QUOTE, stream_keys


def input_violations(quotes: DataFrame) -> DataFrame:
    """One row: rows, missing (a null in a needed column), not_monotonic (a time before the
    last row's of its stream, in order of sequence), crossed, no_depth. Two passes of partial
    sums; the window runs per stream."""
    keys = stream_keys(quotes.columns)
    needed = [*keys, "timestamp_ms", "sequence_id", *QUOTE]
    w = Window.partitionBy(*keys).orderBy("sequence_id")
    gone = F.lit(False)
    for c in needed:
        gone = gone | F.col(c).isNull()
    marked = quotes.select(*needed, (F.col("timestamp_ms") < F.lag("timestamp_ms").over(w)).alias("_back"))
    return marked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("missing"), F.count_if("_back").alias("not_monotonic"), F.count_if(F.col("bid") >= F.col("ask")).alias("crossed"),
        F.count_if((F.col("bid_size") <= 0) | (F.col("ask_size") <= 0)).alias("no_depth"),
    )


def require_valid(quotes: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """``quotes``, or an error that names what is wrong with them (but for what is allowed)."""
    keys = stream_keys(quotes.columns)
    absent = [c for c in [*keys, "timestamp_ms", "sequence_id", *QUOTE] if c not in quotes.columns]
    if absent or not keys:
        raise ValueError(f"columns are missing: {absent or 'stream keys'}")
    if dict(quotes.dtypes)["timestamp_ms"] not in ("bigint", "int"):
        raise ValueError("timestamp_ms is no whole number")
    found = input_violations(quotes).first().asDict()
    wrong = {k: v for k, v in found.items() if k != "rows" and k not in allow and v}
    if wrong:
        raise ValueError(f"quotes are not as they have to be: {wrong}")
    return quotes


def no_future(rows: DataFrame, age: str = "event_age_ms") -> DataFrame:
    """``rows``; a row whose source lies after its grid time stops the job that reads it."""
    leak = F.raise_error(F.concat(F.lit("a source lies after its grid time: "), F.col(age).cast("string")))
    return rows.where(F.when(F.col(age) < 0, leak.cast("boolean")).otherwise(F.lit(True)))


def quotability(bid: Column, ask: Column, update_ms: Column, grid_ms: Column) -> Column:
    """All reasons why a book gives no quote at a grid time, in a fixed order (fixed values)."""
    reasons = [
        (bid.isNull() | (bid <= 0), "MISSING_OR_NONPOSITIVE_BID"),
        (ask.isNull() | (ask <= 0), "MISSING_OR_NONPOSITIVE_ASK"),
        (bid >= ask, "CROSSED_OR_LOCKED_QUOTES"),
        (update_ms.isNull() | (update_ms <= 0), "INVALID_OR_MISSING_TIMESTAMP"),
        ((update_ms > 0) & (grid_ms < update_ms), "GRID_EARLIER_THAN_BOOK_UPDATE"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in reasons]))


def dedup_ladder(df: DataFrame, rungs: list[list[str]], order: list[str]) -> DataFrame:
    """Rows that are the first, by ``order``, under every key of the ladder in turn."""
    for key in rungs:
        w = Window.partitionBy(*key).orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per numeric column: n, mean, deviation (sample), least and greatest, nulls."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("least", F.min), ("most", F.max))], F.count(F.lit(1)).alias("_all"))
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{n}`").alias(n) for n in ("n", "mean", "std", "least", "most")], (F.col("_all") - F.col(f"`{c}|n`")).alias("nulls")) for c in columns]
    return one.select(F.inline(F.array(*each)))


#: Limits of the hard stops.
STOPS = {"missing_rate": 0.25, "mean_age_ms": 2000, "losses": 8, "drawdown": 2.5, "asymmetry": 0.40}


def hard_stop(missing_rate: Column, mean_age: Column, losses: Column, drawdown: Column, asymmetry: Column, observations: Column, least: int = 10) -> Column:
    """The first reason to stop a session, or null; ages count from ``least`` observations on."""
    return (
        F.when(missing_rate > STOPS["missing_rate"], "MISSING_QUOTE_RATE").when((observations >= least) & (mean_age > STOPS["mean_age_ms"]), "QUOTE_AGE")
        .when(losses >= STOPS["losses"], "CONSECUTIVE_LOSSES").when(drawdown >= STOPS["drawdown"], "DRAWDOWN").when(asymmetry > STOPS["asymmetry"], "DIRECTIONAL_ASYMMETRY")
    )


def session_sums(cells: DataFrame, trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, observations, missing_rate, mean_age, losses, drawdown, asymmetry: what the hard stops look at.

    ``cells``: grid cells (event_age_ms, is_stale); stale ones have no quote, and ages are of
    the others. ``trades``: side and pnl, in ``order`` within ``keys``: the longest run of losses,
    the deepest fall of the running sum below its peak (which starts at nothing) and how far the
    share of UP lies from a half. A session without trades has zeros; null results are no loss.
    """
    fresh = ~F.col("is_stale")
    seen = cells.groupBy(*keys).agg(F.count_if(fresh).alias("observations"), F.avg(F.when(fresh, 0.0).otherwise(1.0)).alias("missing_rate"), F.coalesce(F.avg(F.when(fresh, F.col("event_age_ms"))), F.lit(0.0)).alias("mean_age"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loss = F.coalesce(F.col("pnl") < 0, F.lit(False))
    run = trades.select(*keys, *order, "side", loss.alias("_loss"), F.sum(F.coalesce("pnl", F.lit(0.0))).over(w).alias("_cum"), F.sum(F.when(loss, 0).otherwise(1)).over(w).alias("_run"))
    run = run.withColumn("_peak", F.greatest(F.max("_cum").over(w), F.lit(0.0)))
    per = run.groupBy(*keys, "_run").agg(F.count_if("_loss").alias("_n"), F.max(F.col("_peak") - F.col("_cum")).alias("_fall"), F.count_if(F.col("side") == "UP").alias("_up"), F.count(F.lit(1)).alias("_all"))
    done = per.groupBy(*keys).agg(F.max("_n").alias("losses"), F.max("_fall").alias("drawdown"), F.abs(F.sum("_up") / F.sum("_all") - 0.5).alias("asymmetry"))
    return seen.join(done, keys, "left").na.fill({"losses": 0, "drawdown": 0.0, "asymmetry": 0.0})


def session_status(stop: Column, failed: Column, degraded: Column) -> Column:
    """COMPLETE, DEGRADED, ABORTED_HARD_STOP or FAILED (fixed values)."""
    return F.when(failed, "FAILED").when(stop.isNotNull(), "ABORTED_HARD_STOP").when(degraded, "DEGRADED").otherwise("COMPLETE")


def settled(positions: DataFrame, quotes: DataFrame, hold_ms: int = 5000, wait_ms: int = 2000) -> DataFrame:
    """Open positions (position_id, stream keys, opened_ms, side, entry_price) with exit_price,
    settled_ms and outcome: the first quote from ``hold_ms`` after opening settles one;
    a position whose quote comes more than ``wait_ms`` late or never is forced incomplete."""
    from .asof import forward_match

    keys = stream_keys(positions.columns)
    out = forward_match(positions, quotes, "opened_ms", hold_ms, hold_ms + wait_ms, ["bid", "ask"], keys=keys)
    price = F.when(F.col("side") == "BUY", F.col("target.bid")).otherwise(F.col("target.ask"))
    outcome = F.when(F.col("target").isNull(), "FORCED_INCOMPLETE").otherwise("SETTLED")
    return out.withColumns({"exit_price": price, "settled_ms": F.col("target.timestamp_ms"), "outcome": outcome}).drop("target")


def sessions(signals: DataFrame, status: DataFrame) -> DataFrame:
    """Signals (session_id, signal_id, burst_id, ...) of sessions that ended COMPLETE, with
    cluster: bursts numbered across sessions. A session or signal that stands twice stops the job."""
    twice = F.raise_error(F.lit("a session or signal stands twice")).cast("boolean")
    ended = status.groupBy("session_id").agg(F.count(F.lit(1)).alias("_c"), F.max("status").alias("status")).where(F.when(F.col("_c") > 1, twice).otherwise(F.lit(True)))
    per = signals.groupBy("session_id", "signal_id").agg(F.count(F.lit(1)).alias("_c"), F.first("burst_id").alias("burst_id")).where(F.when(F.col("_c") > 1, twice).otherwise(F.lit(True)))
    good = per.join(ended.where("status = 'COMPLETE'").select("session_id"), "session_id", "left_semi")
    # numbers within a session, then one running sum over the sessions' counts
    inside = good.withColumn("_in", F.dense_rank().over(Window.partitionBy("session_id").orderBy("burst_id")))
    counts = inside.groupBy("session_id").agg(F.max("_in").alias("_n"))
    before = counts.select("session_id", (F.sum("_n").over(Window.orderBy("session_id")) - F.col("_n")).alias("_before"))
    return inside.join(before, "session_id").select("session_id", "signal_id", "burst_id", (F.col("_before") + F.col("_in") - 1).alias("cluster"))


def selected(scores: DataFrame, dummy: str = "dummy") -> DataFrame:
    """Models (model, balanced_accuracy, macro_f1) with accepted: both figures beat the dummy's."""
    base = scores.where(F.col("model") == dummy).agg(F.max("balanced_accuracy").alias("_a"), F.max("macro_f1").alias("_f"))
    better = (F.col("balanced_accuracy") > F.col("_a")) & (F.col("macro_f1") > F.col("_f"))
    return scores.join(F.broadcast(base)).withColumn("accepted", F.coalesce(better, F.lit(False))).drop("_a", "_f")
