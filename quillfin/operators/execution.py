"""Execution: passive fills, back-tests, risk checks and positions."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quotes import fill_class, slipped
from .running import running
from .stats import bursts, cluster_robust


def maker_cohort(signals: DataFrame, quotes: DataFrame, step: int, hold: int, keys: list[str], conservative: bool = False, fee_bps: float = 5.0, penalty: float = -0.01) -> DataFrame:
    """Ledger of passive orders at the touch: filled one or two steps on, closed ``hold`` later.

    All look-ups are equality joins on shifted times. conservative: only trades through the
    limit fill; else a retreat of the own side does, too. A missing or invalid exit quote
    costs ``penalty``.
    """
    q = quotes.select(*keys, F.col("grid_timestamp_ms").alias("_t"), "bid", "ask")
    at = lambda name, shift: q.select(*keys, (F.col("_t") - shift).alias("grid_timestamp_ms"), F.col("bid").alias(f"bid_{name}"), F.col("ask").alias(f"ask_{name}"))
    out = signals.withColumn("side", F.when(F.col("prediction") == 2, "BUY").otherwise("SELL"))
    out = out.withColumn("limit_price", F.when(F.col("side") == "BUY", F.col("bid")).otherwise(F.col("ask")))
    for name, shift in (("1", step), ("2", 2 * step), ("x1", step + hold), ("x2", 2 * step + hold)):
        out = out.join(at(name, shift), [*keys, "grid_timestamp_ms"], "left")
    kinds = {k: fill_class(F.col("side"), F.col("limit_price"), F.col(f"bid_{k}"), F.col(f"ask_{k}")) for k in ("1", "2")}
    fills = ["CONFIRMED_PRICE_THROUGH"] if conservative else ["CONFIRMED_PRICE_THROUGH", "AMBIGUOUS_QUOTE_RETREAT"]
    out = out.withColumns({"_k1": kinds["1"], "_k2": kinds["2"]})
    first, second = F.col("_k1").isin(fills), F.col("_k2").isin(fills)
    out = out.withColumns({
        "fill_timestamp_ms": F.when(first, F.col("grid_timestamp_ms") + step).when(second, F.col("grid_timestamp_ms") + 2 * step),
        "fill_certainty": F.when(first, F.col("_k1")).when(second, F.col("_k2")).otherwise("UNFILLED"),
        "_b": F.when(first, F.col("bid_x1")).otherwise(F.col("bid_x2")),
        "_a": F.when(first, F.col("ask_x1")).otherwise(F.col("ask_x2")),
    })
    filled = F.col("fill_timestamp_ms").isNotNull()
    closable = F.coalesce((F.col("_b") > 0) & (F.col("_a") > 0) & (F.col("_b") < F.col("_a")), F.lit(False))
    buy = F.col("side") == "BUY"
    out = out.withColumn("exit_price", F.when(filled & closable, F.when(buy, F.col("_b")).otherwise(F.col("_a"))))
    gross = F.when(~filled, 0.0).when(~closable, penalty).when(buy, F.col("exit_price") - F.col("limit_price")).otherwise(F.col("limit_price") - F.col("exit_price"))
    fee = F.when(~filled, 0.0).otherwise(F.coalesce("exit_price", "limit_price") * (fee_bps / 10000.0))
    status = F.when(~filled, "CANCELLED_UNFILLED").when(closable, "COMPLETED").otherwise("INCOMPLETE_MISSING_EXIT")
    out = out.withColumns({"gross_pnl": gross, "taker_fee": fee, "outcome_status": status, "is_filled": filled})
    return out.withColumn("net_pnl", F.col("gross_pnl") - F.col("taker_fee")).drop("_k1", "_k2", "_b", "_a", *[f"{s}_{k}" for s in ("bid", "ask") for k in ("1", "2", "x1", "x2")])


@dataclass(frozen=True)
class Protocol:
    """Hurdles of the two cohorts and conditions for calling a trial complete."""

    itt_mean: float = 0.0025
    filled_mean: float = 0.0030
    profit_factor: float = 1.25
    profit_factor_target: float = 1.30
    decisive_win_rate: float = 0.50
    win_rate: float = 0.48
    asymmetry: float = 0.35
    t: float = 2.0
    filled: int = 400
    signals: int = 600
    bursts: int = 50
    sessions: int = 5


def cohort_verdict(ledger: DataFrame, order: list[str], block: Column, protocol: Protocol = Protocol(), sessions: int = 1, hard_stop: bool = False) -> DataFrame:
    """One row on a clustered ledger of signals: all of them (intention to treat, unfilled ones
    at 0), the filled ones, and all with only trades through the limit counted as filled.

    Means come with cluster-robust t; every hurdle and completion condition is a column of its
    own, and ``protocol_accepted`` needs all but the profit factor's target. A ledger without
    signals gives no row. Without filled trades their figures are 0. ``order`` and ``block``
    are as for running sums.
    """
    net, filled, sure = F.col("net_pnl"), F.col("is_filled"), F.col("fill_certainty") == "CONFIRMED_PRICE_THROUGH"
    cases = F.array(*[F.struct(F.lit(n).alias("cohort"), x.alias("v")) for n, x in (("itt", net), ("filled", F.when(filled, net)), ("conservative", F.when(filled & sure, net).otherwise(0.0)))])
    long = ledger.select("cluster_id", F.inline(cases)).where("v IS NOT NULL")
    wide = cluster_robust(long, "v", "cluster_id", ["cohort"]).groupBy().agg(*[F.max(F.when(F.col("cohort") == n, F.col(c))).alias(f"{n}_{c}") for n in ("itt", "filled", "conservative") for c in ("mean", "se", "t", "n_eff", "clusters")])
    win, loss = filled & (net > 1e-6), filled & (net < -1e-6)
    gain, lost = F.coalesce(F.sum(F.when(win, net)), F.lit(0.0)), F.coalesce(F.sum(F.when(loss, -net)), F.lit(0.0))
    counts = ledger.agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(filled).alias("filled"), F.count_if(filled & sure).alias("confirmed"), F.count_if(filled & ~sure).alias("ambiguous"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        F.when(lost > 0, gain / F.nullif(lost, F.lit(0.0))).when(gain > 0, 999.0).otherwise(0.0).alias("profit_factor"), F.count_if(F.col("side") == "BUY").alias("up"), F.count_if(F.col("side") == "SELL").alias("down"),
    )
    fall = running(ledger.where(filled), net, order, block).agg(F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"))
    one = counts.join(wide).join(fall).where("signals > 0")  # a row each
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c, p = F.col, protocol
    one = one.withColumns({f"filled_{k}": F.coalesce(f"filled_{k}", F.lit(0.0)) for k in ("mean", "se", "t", "n_eff")})
    one = one.withColumns({
        "fill_rate": share(c("filled"), c("signals")), "win_rate": share(c("wins"), c("filled")), "loss_rate": share(c("losses"), c("filled")), "scratch_rate": share(c("filled") - c("wins") - c("losses"), c("filled")),
        "decisive_win_rate": share(c("wins"), c("wins") + c("losses")), "asymmetry": share(F.abs(c("up") - c("down")), c("up") + c("down")), "balance_ratio": F.coalesce(F.try_divide(F.least("up", "down"), F.greatest("up", "down")), F.lit(1.0)),
    })
    hurdles = {
        "itt_hurdle": c("itt_mean") >= p.itt_mean, "filled_hurdle": c("filled_mean") >= p.filled_mean, "profit_factor_floor": c("profit_factor") >= p.profit_factor, "decisive_wins": c("decisive_win_rate") >= p.decisive_win_rate,
        "overall_wins": c("win_rate") >= p.win_rate, "balanced": c("asymmetry") <= p.asymmetry, "t_passed": c("filled_t") >= p.t,
    }
    complete = {"enough_filled": c("filled") >= p.filled, "enough_signals": c("signals") >= p.signals, "enough_bursts": c("itt_clusters") >= p.bursts, "enough_sessions": F.lit(sessions >= p.sessions), "no_hard_stop": F.lit(not hard_stop)}
    one = one.withColumns({**hurdles, **complete, "profit_factor_target": c("profit_factor") >= p.profit_factor_target})
    both = lambda names: F.forall(F.array(*names), lambda x: x)
    return one.withColumn("complete", both(complete)).withColumn("protocol_accepted", both([*hurdles, "complete"]))


def first_fills(orders: DataFrame, quotes: DataFrame, timeout: int, keys: list[str], run: int = 4) -> DataFrame:
    """(order_id, fill_timestamp_ms) of the orders that a later quote within ``timeout`` fills.

    ``orders``: keys, order_id, timestamp_ms, side, limit_price; ``quotes``: keys,
    timestamp_ms, sequence_id, bid, ask. A quote with 0 < bid < ask fills a BUY if its bid is
    below the limit and a SELL if its ask is above it, by which it either trades through or
    retreats; other quotes fill nothing, nor do quotes at the order's own time.

    A stream's span of ``run`` timeouts, with the quotes of the timeout after it, is sorted from
    late to early and passed through once. Of the quotes met, only those stay that no earlier
    one outdoes (their bids rise, their asks fall towards the present), so an order finds the
    first one that fills it by bisection: the work of a row grows with the logarithm of the
    quotes in a span, and 1 + 1 / ``run`` rows a quote pass through the shuffle. Null prices, sides
    and times fill nothing, NaN counts as infinite; orders are told apart by order_id, of equal
    ones the earliest fill is returned.
    """
    number = lambda c: F.when(F.isnan(c), F.lit(float("inf"))).otherwise(F.col(c).cast("double"))
    t, none = F.col("timestamp_ms").cast("long"), F.lit(None)
    span = F.floor(t / (timeout * run)).cast("long")
    spans = F.array_distinct(F.array(span, F.floor((t - timeout) / (timeout * run)).cast("long")))
    good = quotes.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & t.isNotNull())
    good = good.select(*keys, F.explode(spans).alias("_b"), t.alias("_t"), F.lit(True).alias("_q"), none.cast(orders.schema["order_id"].dataType).alias("order_id"), F.lit(False).alias("_buy"), number("bid").alias("_x"), number("ask").alias("_y"))
    asked = orders
    for c in (*keys, "timestamp_ms", "side", "limit_price"):
        asked = asked.where(F.col(c).isNotNull())
    asked = asked.select(*keys, span.alias("_b"), t.alias("_t"), F.lit(False).alias("_q"), "order_id", (F.col("side") == "BUY").alias("_buy"), number("limit_price").alias("_x"), none.cast("double").alias("_y"))
    # at equal times orders come first, so that they do not meet these quotes
    rows = good.unionByName(asked).repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", F.desc("_t"), "_q")
    width = len(keys) + 1

    def passed(batches):
        at = None
        for b in batches:
            ids, fills = [], []
            span = zip(*(b.column(k).to_pylist() for k in range(width)))
            for k, (where, t, quote, buy, x, y) in enumerate(zip(span, *(b.column(width + c).to_pylist() for c in (0, 1, 3, 4, 5)))):
                if where != at:
                    at, bids, bid_t, asks, ask_t = where, [], [], [], []
                if quote:
                    while bids and bids[-1] >= x:
                        bids.pop(), bid_t.pop()
                    bids.append(x), bid_t.append(t)
                    while asks and asks[-1] >= -y:
                        asks.pop(), ask_t.pop()
                    asks.append(-y), ask_t.append(t)
                    continue
                n = bisect_left(bids, x) if buy else bisect_left(asks, -x)
                if n:
                    first = (bid_t if buy else ask_t)[n - 1]
                    if first <= t + timeout:
                        ids.append(k), fills.append(first)
            yield pa.RecordBatch.from_arrays([b.column(width + 2).take(pa.array(ids, pa.int64())), pa.array(fills, pa.int64())], names=["order_id", "_at"])

    out = rows.mapInArrow(passed, T.StructType([orders.schema["order_id"]]).add("_at", "long"))
    return out.groupBy("order_id").agg(F.min("_at").alias("fill_timestamp_ms"))


def clustered(ledger: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Adds burst_id per stream and cluster_id = (stream, burst)."""
    out = bursts(ledger, "grid_timestamp_ms", keys, gap, keys)
    return out.withColumn("cluster_id", F.concat_ws("|", *keys, F.col("burst_id").cast("string")))


def backtest(df: DataFrame, time: list[str], keys: list[str], price: str, signal: str, cash: float = 1e6, size: float = 1000.0, fee_bps: float = 10.0, slip_bps: float = 5.0) -> DataFrame:
    """Equity by row of a long-only book a stream: buys on UP if flat, sells all on DOWN.

    The position after a row is long exactly if the last directional signal is UP, so no
    state machine is needed as long as the cash lasts; where it may not, use
    backtest_exact().
    """
    w = Window.partitionBy(*keys).orderBy(*time)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.when(F.col(signal).isin("UP", "DOWN"), F.col(signal))
    out = df.withColumn("_before", F.last(s, ignorenulls=True).over(past))
    out = out.withColumns({"buy": (F.col(signal) == "UP") & (F.coalesce("_before", F.lit("DOWN")) == "DOWN"), "sell": (F.col(signal) == "DOWN") & (F.col("_before") == "UP")})
    out = out.withColumns({"buy": F.coalesce("buy", F.lit(False)), "sell": F.coalesce("sell", F.lit(False))})
    out = out.withColumn("quantity", F.last(F.when(F.col("buy"), F.lit(size) / F.col(price)), ignorenulls=True).over(now))
    p = F.when(F.col("buy"), slipped(F.col(price), F.lit("BUY"), slip_bps)).otherwise(slipped(F.col(price), F.lit("SELL"), slip_bps))
    value = F.col("quantity") * p
    flow = F.when(F.col("buy"), -(value + value * (fee_bps / 10000.0))).when(F.col("sell"), value - value * (fee_bps / 10000.0)).otherwise(0.0)
    out = out.withColumn("_flow", flow).withColumn("cash", F.lit(cash) + F.sum("_flow").over(now))
    held = F.last(s, ignorenulls=True).over(now) == "UP"
    out = out.withColumn("position", F.when(held, F.col("quantity")).otherwise(0.0))
    return out.withColumn("equity", F.col("cash") + F.col("position") * F.col(price)).drop("_before", "_flow")


def backtest_exact(df: DataFrame, time: list[str], keys: list[str], price: str, signal: str, cash: float, size: float, fee_bps: float = 10.0, slip_bps: float = 5.0) -> DataFrame:
    """The same as a fold that checks the cash before each purchase. A stream's rows are sorted
    and folded as they come along, so no stream is in memory as a whole."""
    out_type = T.StructType([df.schema[k] for k in (*keys, *time)]).add("cash", "double").add("position", "double").add("equity", "double")

    def run(frames):
        at = None
        for pdf in frames:
            rows, streams = [], list(zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys]))
            for stream, p, s in zip(streams, pdf[price].tolist(), pdf[signal].tolist()):
                if stream != at:
                    at, money, held = stream, cash, 0.0
                if s == "UP" and held == 0:
                    qty, paid = size / p, p * (1 + slip_bps / 10000.0)
                    cost = qty * paid * (1 + fee_bps / 10000.0)
                    if cost <= money:
                        money, held = money - cost, qty
                elif s == "DOWN" and held > 0:
                    money, held = money + held * p * (1 - slip_bps / 10000.0) * (1 - fee_bps / 10000.0), 0.0
                rows.append((money, held, money + held * p))
            out = pdf[[*keys, *time]].copy()
            out[["cash", "position", "equity"]] = np.array(rows).reshape(-1, 3)
            yield out

    return df.select(*keys, *time, price, signal).repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in time]).mapInPandas(run, out_type)


def equity_metrics(df: DataFrame, time: list[str], keys: list[str]) -> DataFrame:
    """total_return, sharpe = mean / std * sqrt(n), relative max_drawdown, final_equity."""
    w = Window.partitionBy(*keys).orderBy(*time)
    e = F.col("equity")
    out = df.withColumns({"_r": e / F.nullif(F.lag(e).over(w), F.lit(0.0)) - 1, "_top": F.max(e).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    order = F.struct(*time)
    first, last = F.min_by("equity", order), F.max_by("equity", order)
    std = F.stddev_samp("_r")
    sharpe = F.when((F.count("_r") > 1) & (std > 0), F.avg("_r") / F.nullif(std, F.lit(0.0)) * F.sqrt(F.count("_r"))).otherwise(0.0)
    return out.groupBy(*keys).agg((last / first - 1).alias("total_return"), sharpe.alias("sharpe"), F.min((e - F.col("_top")) / F.col("_top")).alias("max_drawdown"), last.alias("final_equity"), F.count(F.lit(1)).alias("num_observations"))


def risk_check(side: Column, quantity: Column, position: Column, equity: Column, peak: Column, daily_pnl: Column, trades: Column, *, max_order: float, max_position: float, max_daily_loss: float, max_drawdown: float, max_trades: int) -> Column:
    """The first limit that an order breaks, in a fixed order, else APPROVED."""
    after = F.when(side == "BUY", position + quantity).otherwise(position - quantity)
    return (
        F.when(quantity > max_order, "MAX_ORDER_SIZE").when(F.abs(after) > max_position, "MAX_POSITION").when(daily_pnl <= -max_daily_loss, "MAX_DAILY_LOSS")
        .when((peak > 0) & ((peak - equity) / F.nullif(peak, F.lit(0.0)) >= max_drawdown), "MAX_DRAWDOWN").when(trades >= max_trades, "MAX_TRADES").otherwise("APPROVED")
    )


def latched(flag: Column, time: list[str], keys: list[str]) -> Column:
    """A circuit breaker: once tripped, it stays so."""
    return F.max(flag).over(Window.partitionBy(*keys).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0))


def loss_streak(df: DataFrame, pnl: str, time: list[str], keys: list[str]) -> DataFrame:
    """Adds streak: losses in a row up to here."""
    w = Window.partitionBy(*keys).orderBy(*time)
    loss = F.col(pnl) < 0
    out = df.withColumn("_g", F.sum(F.when(loss, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_g").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("streak", F.sum(F.when(loss, 1).otherwise(0)).over(inside)).drop("_g")
