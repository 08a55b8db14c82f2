"""Trading policies on predictions: gates, reasons, P&L metrics, stress scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import ratio
from .running import running


@dataclass(frozen=True)
class Gate:
    confidence: float = 0.55
    spread: float = 0.5
    imbalance: float = 1.2


def trades(df: DataFrame, quotes: DataFrame, step: int, keys: list[str]) -> DataFrame:
    """Predictions with the quotes at entry (their own) and at the target's grid time, and
    both legs again a step later (``*_delay``), as an order that arrives late would meet them.

    The later quote is the next row of the same stream if that stands exactly a step on, so
    it comes with the quote it follows: two equality joins serve four legs.
    """
    out = df.withColumn("exit_grid_ms", (F.floor(F.col("target.timestamp_ms") / step) * step).cast("long"))
    w = Window.partitionBy(*keys).orderBy("grid_timestamp_ms")
    follows = F.lead("grid_timestamp_ms").over(w) == F.col("grid_timestamp_ms") + step
    both = quotes.select(*keys, "grid_timestamp_ms", "bid", "ask", *[F.when(follows, F.lead(c).over(w)).alias(f"{c}_next") for c in ("bid", "ask")])
    entry = both.select(*keys, "grid_timestamp_ms", F.col("bid_next").alias("bid_entry_delay"), F.col("ask_next").alias("ask_entry_delay"))
    late = both.select(*keys, F.col("grid_timestamp_ms").alias("exit_grid_ms"), F.col("bid").alias("bid_exit"), F.col("ask").alias("ask_exit"), F.col("bid_next").alias("bid_exit_delay"), F.col("ask_next").alias("ask_exit_delay"))
    out = out.join(entry, [*keys, "grid_timestamp_ms"], "left").join(late, [*keys, "exit_grid_ms"], "left")
    long, short = F.col("prediction") == 2, F.col("prediction") == 0
    mid0, mid1 = (F.col("bid") + F.col("ask")) / 2.0, (F.col("bid_exit") + F.col("ask_exit")) / 2.0
    return out.withColumns({
        "is_directional": F.col("prediction") != 1,
        "has_exit_quote": F.col("bid_exit").isNotNull() & F.col("ask_exit").isNotNull(),
        "has_delay_quotes": F.col("bid_entry_delay").isNotNull() & F.col("ask_entry_delay").isNotNull() & F.col("bid_exit_delay").isNotNull() & F.col("ask_exit_delay").isNotNull(),
        "delayed_pnl": F.when(long, F.col("bid_exit_delay") - F.col("ask_entry_delay")).otherwise(F.col("bid_entry_delay") - F.col("ask_exit_delay")),
        "entry_price": F.when(long, F.col("ask")).otherwise(F.col("bid")),
        "exit_price": F.when(long, F.col("bid_exit")).otherwise(F.col("ask_exit")),
        "gross_pnl": F.when(long, F.col("bid_exit") - F.col("ask")).when(short, F.col("bid") - F.col("ask_exit")).otherwise(0.0),
        "mid_pnl": F.when(long, mid1 - mid0).when(short, mid0 - mid1).otherwise(0.0),
        "mid_entry": mid0,
        "mid_exit": mid1,
    })


def masks(gate: Gate) -> dict[str, Column]:
    # fixed values: the policies' names
    base = F.col("is_directional") & F.col("has_exit_quote")
    sure, tight, even = F.col("confidence") >= gate.confidence, F.col("scaled_spread") <= gate.spread, F.col("abs_scaled_imbalance") <= gate.imbalance
    return {"Policy_0_Mid_Counterfactual": base, "Policy_1_Unfiltered_Baseline": base, "Policy_2_Confidence_Gate": base & sure, "Policy_3_Spread_Gate": base & tight, "Policy_4_Depth_Imbalance_Gate": base & even, "Policy_5_Combined_Gate": base & sure & tight & even}


def reasons(gate: Gate, age: Column, most_age: int, gap: Column, most_gap: int) -> Column:
    """All reasons against a decision, in a fixed order."""
    r = [
        (F.col("prediction") == 1, "FLAT_PREDICTION"), (F.col("confidence") < gate.confidence, "LOW_CONFIDENCE"), (F.col("scaled_spread") > gate.spread, "WIDE_SPREAD"),
        (F.col("abs_scaled_imbalance") > gate.imbalance, "EXTREME_DEPTH_IMBALANCE"), (age > most_age, "STALE_ENTRY_QUOTE"), (gap > most_gap, "INTER_BURST_GAP"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in r]))


def decision(reasons_: Column, prediction: Column) -> Column:
    return F.when(F.size(reasons_) == 0, "EXECUTE").when(prediction == 1, "SKIP").otherwise("REJECT")


def metrics(df: DataFrame, pnl: str, keys: list[str], order: list[str], block: Column, total: int | None = None) -> DataFrame:
    """Per key: trades, P&L sum, mean and deviation, rates, profit factor (999 if no loss),
    largest fall of the running sum (no leading 0), Sharpe and Sortino per trade."""
    x = F.col(pnl)
    ran = running(df, x, order, block, keys)
    win, loss = x > 1e-6, x < -1e-6
    n = F.count(F.lit(1))
    gains, losses = F.coalesce(F.sum(F.when(win, x)), F.lit(0.0)), F.coalesce(F.sum(F.when(loss, -x)), F.lit(0.0))
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    std = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    out = ran.groupBy(*keys).agg(
        n.alias("trades"), F.sum(x).alias("pnl"), F.avg(x).alias("mean_pnl"), std.alias("std_pnl"), F.avg(win.cast("int")).alias("win_rate"), F.avg(loss.cast("int")).alias("loss_rate"),
        F.avg((~(win | loss)).cast("int")).alias("scratch_rate"), F.when(losses > 0, gains / F.nullif(losses, F.lit(0.0))).when(gains > 0, 999.0).otherwise(0.0).alias("profit_factor"),
        F.max("drawdown").alias("max_drawdown"), F.coalesce(ratio(F.avg(x), std), F.lit(0.0)).alias("sharpe"),
        F.when(F.coalesce(down, F.lit(0.0)) > 0, F.avg(x) / F.nullif(down, F.lit(0.0))).when(F.avg(x) > 0, 999.0).otherwise(0.0).alias("sortino"),
    )
    return out.withColumn("coverage", F.col("trades") / F.lit(total)) if total else out


def stress(df: DataFrame, gate: Gate) -> DataFrame:
    """Every trade under every scenario: scenario, pnl; unclosed trades join where they are
    penalised. Late ones (S4) need both quotes a step on and pass the gate whatever their
    direction: all but UP sell, so FLAT counts as a sale there. One explosion by a constant number of scenarios."""
    passed = (F.col("confidence") >= gate.confidence) & (F.col("scaled_spread") <= gate.spread) & (F.col("abs_scaled_imbalance") <= gate.imbalance)
    sure = passed & F.col("is_directional")
    done = sure & F.col("has_exit_quote")
    open_ = sure & ~F.col("has_exit_quote")
    g, both, entry = F.col("gross_pnl"), F.col("entry_price") + F.col("exit_price"), F.col("entry_price")
    # fixed values: the scenarios' names
    cases = [("S0_Baseline_Top_of_Book_0bps", F.when(done, g)), *[(f"S1_Fee_Schedule_{b}bps", F.when(done, g - both * (b / 10000.0))) for b in (5, 10, 15)]]
    cases += [(f"S2_Adverse_Slippage_{n}bps", F.when(done, g - 2.0 * (entry * (b / 10000.0)))) for n, b in (("0.5", 0.5), ("1.0", 1.0))]
    cases += [("S3_Adverse_Entry_1Tick", F.when(done, g - 0.01)), ("S4_Execution_Latency_1000ms", F.when(passed & F.col("has_delay_quotes"), F.col("delayed_pnl"))), ("S5_Missing_Exit_Forced_Liquidation_Penalty", F.when(done, g).when(open_, -0.01)), ("S6_Compounded_Multi_Stress", F.when(done, g - both * 0.001 - 2.0 * (entry * 0.00005)).when(open_, -0.015))]
    items = F.array(*[F.struct(F.lit(n).alias("scenario"), p.alias("pnl")) for n, p in cases])
    return df.withColumn("_s", F.explode(items)).select("*", "_s.scenario", "_s.pnl").drop("_s").where(F.col("pnl").isNotNull())
