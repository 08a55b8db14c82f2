"""Queries on policies, execution and risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quotes import fill_class, mid, quotes_around, ratio, signal
from ..model import HOURS, STREAM
from ..operators import execution, policy, stats
from ..operators.running import running
from .base import QUOTES_SQL, events, grid, query, with_
from .evaluation import PREDICT_SQL, predicted

GATE = policy.Gate()
_DAY = 86_400_000
_ORDER = ["grid_timestamp_ms", "market_id", "asset_id"]


def scored(spark, sf_dir):
    s = ratio(F.col("ask") - F.col("bid") - 0.03, F.lit(0.015))
    imbalance = F.abs(ratio(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))) * 2.0
    return predicted(spark, sf_dir).withColumns({"scaled_spread": s, "abs_scaled_imbalance": imbalance})


def trade_rows(spark, sf_dir):
    return policy.trades(scored(spark, sf_dir), grid(spark, sf_dir), HOURS.step, STREAM)


TRADES_SQL = (
    PREDICT_SQL
    + f""",
tr0 AS (SELECT p.*, (p.ask - p.bid - 0.03::DOUBLE) / 0.015::DOUBLE AS scaled_spread, abs((p.bid_size - p.ask_size) / (p.bid_size + p.ask_size)) * 2.0::DOUBLE AS abs_scaled_imbalance,
   x.bid AS bid_exit, x.ask AS ask_exit, e1.bid AS bid_entry_delay, e1.ask AS ask_entry_delay, x1.bid AS bid_exit_delay, x1.ask AS ask_exit_delay
  FROM pred p LEFT JOIN grid x ON p.market_id = x.market_id AND p.asset_id = x.asset_id AND x.grid_timestamp_ms = p.target_timestamp // {HOURS.step} * {HOURS.step}
  LEFT JOIN grid e1 ON p.market_id = e1.market_id AND p.asset_id = e1.asset_id AND e1.grid_timestamp_ms = p.grid_timestamp_ms + {HOURS.step}
  LEFT JOIN grid x1 ON p.market_id = x1.market_id AND p.asset_id = x1.asset_id AND x1.grid_timestamp_ms = p.target_timestamp // {HOURS.step} * {HOURS.step} + {HOURS.step}),
tr AS (SELECT *, prediction <> 1 AS is_directional, bid_exit IS NOT NULL AND ask_exit IS NOT NULL AS has_exit_quote,
  bid_entry_delay IS NOT NULL AND ask_entry_delay IS NOT NULL AND bid_exit_delay IS NOT NULL AND ask_exit_delay IS NOT NULL AS has_delay_quotes,
  CASE WHEN prediction = 2 THEN bid_exit_delay - ask_entry_delay ELSE bid_entry_delay - ask_exit_delay END AS delayed_pnl,
  CASE WHEN prediction = 2 THEN ask ELSE bid END AS entry_price, CASE WHEN prediction = 2 THEN bid_exit ELSE ask_exit END AS exit_price,
  CASE prediction WHEN 2 THEN bid_exit - ask WHEN 0 THEN bid - ask_exit ELSE 0.0 END AS gross_pnl,
  CASE prediction WHEN 2 THEN (bid_exit + ask_exit) / 2.0 - (bid + ask) / 2.0 WHEN 0 THEN (bid + ask) / 2.0 - (bid_exit + ask_exit) / 2.0 ELSE 0.0 END AS mid_pnl FROM tr0),
mk AS (
  SELECT *, UNNEST([{{'policy': 'Policy_0_Mid_Counterfactual', 'ok': true}}, {{'policy': 'Policy_1_Unfiltered_Baseline', 'ok': true}}, {{'policy': 'Policy_2_Confidence_Gate', 'ok': confidence >= 0.55}}, {{'policy': 'Policy_3_Spread_Gate', 'ok': scaled_spread <= 0.5}},
    {{'policy': 'Policy_4_Depth_Imbalance_Gate', 'ok': abs_scaled_imbalance <= 1.2}}, {{'policy': 'Policy_5_Combined_Gate', 'ok': confidence >= 0.55 AND scaled_spread <= 0.5 AND abs_scaled_imbalance <= 1.2}}]) AS m FROM tr)"""
)


@query(
    "trade_dataset",
    with_(TRADES_SQL, "SELECT market_id, asset_id, grid_timestamp_ms, prediction, confidence, is_directional, has_exit_quote, has_delay_quotes, entry_price, exit_price, gross_pnl, mid_pnl, delayed_pnl FROM tr"),
)
def trade_dataset(spark, sf_dir):
    return trade_rows(spark, sf_dir).select("market_id", "asset_id", "grid_timestamp_ms", "prediction", "confidence", "is_directional", "has_exit_quote", "has_delay_quotes", "entry_price", "exit_price", "gross_pnl", "mid_pnl", "delayed_pnl")


def by_policy(df):
    items = F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("ok")) for n, m in policy.masks(GATE).items()])
    return df.withColumn("_m", F.explode(items)).select("*", "_m.policy", "_m.ok").drop("_m")


@query(
    "policy_gate",
    with_(
        TRADES_SQL,
        """SELECT m.policy AS policy, count(*) AS total, count_if(m.ok AND is_directional AND has_exit_quote) AS executed, count_if(NOT is_directional) AS skipped_flat, count_if(is_directional AND NOT has_exit_quote) AS missing_quote,
       count(*) - count_if(m.ok AND is_directional AND has_exit_quote) - count_if(NOT is_directional) - count_if(is_directional AND NOT has_exit_quote) AS gated FROM mk GROUP BY 1""",
    ),
)
def policy_gate(spark, sf_dir):
    d = by_policy(trade_rows(spark, sf_dir))
    n, done, flat, missing = F.count(F.lit(1)), F.count_if("ok"), F.count_if(~F.col("is_directional")), F.count_if(F.col("is_directional") & ~F.col("has_exit_quote"))
    return d.groupBy("policy").agg(n.alias("total"), done.alias("executed"), flat.alias("skipped_flat"), missing.alias("missing_quote"), (n - done - flat - missing).alias("gated"))


_METRICS = """count(*) AS trades, round(sum(x), 8) AS pnl, round(avg(x), 8) AS mean_pnl, round(stddev_samp(x), 8) AS std_pnl, round(avg((x > 1e-6)::INT), 8) AS win_rate, round(avg((x < -1e-6)::INT), 8) AS loss_rate,
  round(avg((NOT (x > 1e-6 OR x < -1e-6))::INT), 8) AS scratch_rate,
  round(CASE WHEN coalesce(sum(CASE WHEN x < -1e-6 THEN -x END), 0) > 0 THEN coalesce(sum(CASE WHEN x > 1e-6 THEN x END), 0) / sum(CASE WHEN x < -1e-6 THEN -x END) WHEN coalesce(sum(CASE WHEN x > 1e-6 THEN x END), 0) > 0 THEN 999.0 ELSE 0.0 END, 8) AS profit_factor,
  round(max(pk - cum), 8) AS max_drawdown, round(avg(x) / stddev_samp(x), 8) AS sharpe,
  round(CASE WHEN sqrt(avg(CASE WHEN x < 0 THEN x * x END)) > 0 THEN avg(x) / sqrt(avg(CASE WHEN x < 0 THEN x * x END)) WHEN avg(x) > 0 THEN 999.0 ELSE 0.0 END, 8) AS sortino"""
_DOUBLES = ["pnl", "mean_pnl", "std_pnl", "win_rate", "loss_rate", "scratch_rate", "profit_factor", "max_drawdown", "sharpe", "sortino"]


def _cum(source: str, key: str) -> str:
    return f"""c1 AS (SELECT *, sum(x) OVER (PARTITION BY {key} ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING) AS cum FROM {source}),
c2 AS (SELECT *, max(cum) OVER (PARTITION BY {key} ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING) AS pk FROM c1)"""


@query(
    "policy_metrics",
    with_(
        TRADES_SQL,
        """, fe AS (SELECT m.policy AS policy, b AS fee_bps, grid_timestamp_ms, market_id, asset_id,
   CASE WHEN m.policy = 'Policy_0_Mid_Counterfactual' THEN mid_pnl - ((bid + ask) / 2.0 + (bid_exit + ask_exit) / 2.0) * (b / 10000.0::DOUBLE) ELSE gross_pnl - (entry_price + exit_price) * (b / 10000.0::DOUBLE) END AS x
  FROM mk, (VALUES (0), (5), (10)) v(b) WHERE m.ok AND is_directional AND has_exit_quote),
"""
        + _cum("fe", "policy, fee_bps")
        + f"\nSELECT policy, fee_bps, {_METRICS} FROM c2 GROUP BY policy, fee_bps",
    ),
)
def policy_metrics(spark, sf_dir):
    """Six policies at three fees, charged on the true exit price."""
    d = by_policy(trade_rows(spark, sf_dir)).where("ok").withColumn("fee_bps", F.explode(F.array(F.lit(0), F.lit(5), F.lit(10))))
    fee = F.col("fee_bps") / F.lit(10000.0)
    net = F.when(F.col("policy") == "Policy_0_Mid_Counterfactual", F.col("mid_pnl") - (F.col("mid_entry") + F.col("mid_exit")) * fee).otherwise(F.col("gross_pnl") - (F.col("entry_price") + F.col("exit_price")) * fee)
    out = policy.metrics(d.withColumn("net", net), "net", ["policy", "fee_bps"], _ORDER, F.floor(F.col("grid_timestamp_ms") / _DAY))
    return out.withColumns({c: F.round(c, 8) for c in _DOUBLES})


STRESS_SQL = (
    TRADES_SQL
    + """,
su AS (SELECT *, confidence >= 0.55 AND scaled_spread <= 0.5 AND abs_scaled_imbalance <= 1.2 AS passed FROM tr),
st AS (
  SELECT s.scenario, s.x, grid_timestamp_ms, market_id, asset_id FROM (SELECT *, UNNEST([
    {'scenario': 'S0_Baseline_Top_of_Book_0bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl END},
    {'scenario': 'S1_Fee_Schedule_5bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - (entry_price + exit_price) * 0.0005::DOUBLE END},
    {'scenario': 'S1_Fee_Schedule_10bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - (entry_price + exit_price) * 0.001::DOUBLE END},
    {'scenario': 'S1_Fee_Schedule_15bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - (entry_price + exit_price) * 0.0015::DOUBLE END},
    {'scenario': 'S2_Adverse_Slippage_0.5bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - 2.0::DOUBLE * (entry_price * 0.00005::DOUBLE) END},
    {'scenario': 'S2_Adverse_Slippage_1.0bps', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - 2.0::DOUBLE * (entry_price * 0.0001::DOUBLE) END},
    {'scenario': 'S3_Adverse_Entry_1Tick', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - 0.01::DOUBLE END},
    {'scenario': 'S4_Execution_Latency_1000ms', 'x': CASE WHEN has_delay_quotes THEN delayed_pnl END},
    {'scenario': 'S5_Missing_Exit_Forced_Liquidation_Penalty', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl ELSE -0.01 END},
    {'scenario': 'S6_Compounded_Multi_Stress', 'x': CASE WHEN NOT is_directional THEN NULL WHEN has_exit_quote THEN gross_pnl - (entry_price + exit_price) * 0.001::DOUBLE - 2.0::DOUBLE * (entry_price * 0.00005::DOUBLE) ELSE -0.015 END}]) AS s FROM su WHERE passed) WHERE s.x IS NOT NULL
)"""
)


@query("stress_scenarios", with_(STRESS_SQL, ",\n" + _cum("st", "scenario") + f"\nSELECT scenario, {_METRICS} FROM c2 GROUP BY scenario"))
def stress_scenarios(spark, sf_dir):
    d = policy.stress(trade_rows(spark, sf_dir), GATE)
    out = policy.metrics(d, "pnl", ["scenario"], _ORDER, F.floor(F.col("grid_timestamp_ms") / _DAY))
    return out.withColumns({c: F.round(c, 8) for c in _DOUBLES})


@query(
    "rejection_list",
    with_(
        TRADES_SQL,
        f""", gp AS (SELECT *, grid_timestamp_ms - lag(grid_timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) AS gap FROM tr),
rs AS (SELECT market_id, asset_id, grid_timestamp_ms, prediction, list_filter([CASE WHEN prediction = 1 THEN 'FLAT_PREDICTION' END, CASE WHEN confidence < 0.55 THEN 'LOW_CONFIDENCE' END, CASE WHEN scaled_spread > 0.5 THEN 'WIDE_SPREAD' END,
  CASE WHEN abs_scaled_imbalance > 1.2 THEN 'EXTREME_DEPTH_IMBALANCE' END, CASE WHEN event_age_ms > {2 * HOURS.step} THEN 'STALE_ENTRY_QUOTE' END, CASE WHEN gap > {HOURS.burst} THEN 'INTER_BURST_GAP' END], lambda x: x IS NOT NULL) AS r FROM gp)
SELECT market_id, asset_id, grid_timestamp_ms, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'EXECUTE' WHEN prediction = 1 THEN 'SKIP' ELSE 'REJECT' END AS decision FROM rs""",
    ),
)
def rejection_list(spark, sf_dir):
    w = Window.partitionBy(*STREAM).orderBy("grid_timestamp_ms")
    d = scored(spark, sf_dir).withColumn("gap", F.col("grid_timestamp_ms") - F.lag("grid_timestamp_ms").over(w))
    d = d.withColumn("r", policy.reasons(GATE, F.col("event_age_ms"), 2 * HOURS.step, F.col("gap"), HOURS.burst))
    return d.select(*STREAM, "grid_timestamp_ms", F.array_join("r", ",").alias("reasons"), policy.decision(F.col("r"), F.col("prediction")).alias("decision"))


BURST_SQL = (
    QUOTES_SQL
    + f""",
bu0 AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id) > {HOURS.burst // 6} THEN 1 ELSE 0 END AS n FROM q),
bu AS (SELECT *, sum(n) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING) AS burst_id FROM bu0)"""
)


def burst_rows(spark, sf_dir):
    return stats.bursts(events(spark, sf_dir), "timestamp_ms", ["sequence_id"], HOURS.burst // 6, STREAM)


@query("burst_ids", with_(BURST_SQL, "SELECT market_id, asset_id, sequence_id, burst_id::BIGINT AS burst_id FROM bu"))
def burst_ids(spark, sf_dir):
    return burst_rows(spark, sf_dir).select(*STREAM, "sequence_id", "burst_id")


@query(
    "cluster_robust",
    with_(
        BURST_SQL,
        """, x AS (SELECT market_id || '|' || asset_id || '|' || burst_id::BIGINT AS c, ask - bid - 0.03::DOUBLE AS v FROM bu),
p AS (SELECT c, sum(v) AS s, count(*) AS n FROM x GROUP BY c), t AS (SELECT sum(s) AS s, sum(n)::DOUBLE AS n, count(*) AS c FROM p),
z AS (SELECT t.s / t.n AS mean, t.n, t.c, sum(pow(p.s - p.n * (t.s / t.n), 2)) AS s2, sum(pow(p.s - p.n * (t.s / t.n), 4)) AS s4 FROM p, t GROUP BY ALL)
SELECT round(mean, 9) AS mean, round(sqrt(c / (c - 1.0) * s2 / (n * n)), 9) AS se, c AS clusters, round(least(s2 * s2 / s4, c), 5) AS n_eff, n::BIGINT AS rows, round(mean / sqrt(c / (c - 1.0) * s2 / (n * n)), 5) AS t FROM z""",
    ),
)
def cluster_robust(spark, sf_dir):
    d = burst_rows(spark, sf_dir).select(F.concat_ws("|", *STREAM, F.col("burst_id").cast("string")).alias("c"), (F.col("ask") - F.col("bid") - 0.03).alias("v"))
    return stats.cluster_robust(d, "v", "c").withColumns({"mean": F.round("mean", 9), "se": F.round("se", 9), "n_eff": F.round("n_eff", 5), "t": F.round("t", 5)})


_FILL = """CASE WHEN {b} IS NULL OR {a} IS NULL OR {b} <= 0 OR {a} <= 0 OR {b} >= {a} THEN 'UNFILLED'
  WHEN side = 'BUY' THEN CASE WHEN {a} <= lim THEN 'CONFIRMED_PRICE_THROUGH' WHEN {b} < lim THEN 'AMBIGUOUS_QUOTE_RETREAT' WHEN {b} = lim THEN 'TOUCH_REJECTED' ELSE 'UNFILLED' END
  ELSE CASE WHEN {b} >= lim THEN 'CONFIRMED_PRICE_THROUGH' WHEN {a} > lim THEN 'AMBIGUOUS_QUOTE_RETREAT' WHEN {a} = lim THEN 'TOUCH_REJECTED' ELSE 'UNFILLED' END END"""


@query(
    "maker_fill_class",
    with_(
        QUOTES_SQL,
        f""", nx AS (SELECT *, lead(bid) OVER w AS nb, lead(ask) OVER w AS na, CASE WHEN sequence_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN sequence_id % 2 = 0 THEN bid ELSE ask END AS lim
  FROM q WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id))
SELECT sequence_id, side, {_FILL.format(b="nb", a="na")} AS fill FROM nx""",
    ),
)
def maker_fill_class(spark, sf_dir):
    w = Window.partitionBy(*STREAM).orderBy("timestamp_ms", "sequence_id")
    even = F.col("sequence_id") % 2 == 0
    d = events(spark, sf_dir).withColumns({"nb": F.lead("bid").over(w), "na": F.lead("ask").over(w), "side": F.when(even, "BUY").otherwise("SELL"), "lim": F.when(even, F.col("bid")).otherwise(F.col("ask"))})
    return d.select("sequence_id", "side", fill_class(F.col("side"), F.col("lim"), F.col("nb"), F.col("na")).alias("fill"))


_S, _H = HOURS.step, 5 * HOURS.step
MAKER_SQL = (
    TRADES_SQL
    + f""",
sg AS (SELECT *, CASE WHEN prediction = 2 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN prediction = 2 THEN bid ELSE ask END AS lim FROM tr WHERE is_directional AND scaled_spread <= 0.5),
lk AS (SELECT sg.*, a.bid AS b1, a.ask AS a1, b.bid AS b2, b.ask AS a2, c.bid AS xb1, c.ask AS xa1, d.bid AS xb2, d.ask AS xa2 FROM sg
  LEFT JOIN grid a ON a.market_id = sg.market_id AND a.asset_id = sg.asset_id AND a.grid_timestamp_ms = sg.grid_timestamp_ms + {_S}
  LEFT JOIN grid b ON b.market_id = sg.market_id AND b.asset_id = sg.asset_id AND b.grid_timestamp_ms = sg.grid_timestamp_ms + {2 * _S}
  LEFT JOIN grid c ON c.market_id = sg.market_id AND c.asset_id = sg.asset_id AND c.grid_timestamp_ms = sg.grid_timestamp_ms + {_S + _H}
  LEFT JOIN grid d ON d.market_id = sg.market_id AND d.asset_id = sg.asset_id AND d.grid_timestamp_ms = sg.grid_timestamp_ms + {2 * _S + _H}),
kl AS (SELECT *, {_FILL.format(b="b1", a="a1")} AS k1, {_FILL.format(b="b2", a="a2")} AS k2 FROM lk),
fl AS (SELECT *, CASE WHEN k1 IN ('CONFIRMED_PRICE_THROUGH', 'AMBIGUOUS_QUOTE_RETREAT') THEN 1 WHEN k2 IN ('CONFIRMED_PRICE_THROUGH', 'AMBIGUOUS_QUOTE_RETREAT') THEN 2 END AS f FROM kl),
ex AS (SELECT *, CASE f WHEN 1 THEN xb1 WHEN 2 THEN xb2 END AS xb, CASE f WHEN 1 THEN xa1 WHEN 2 THEN xa2 END AS xa FROM fl),
ep AS (SELECT *, f IS NOT NULL AND coalesce(xb > 0 AND xa > 0 AND xb < xa, false) AS closed, CASE WHEN side = 'BUY' THEN xb ELSE xa END AS xp FROM ex),
mc AS (SELECT market_id, asset_id, grid_timestamp_ms, side, lim AS limit_price, grid_timestamp_ms + f * {_S} AS fill_timestamp_ms, CASE f WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE 'UNFILLED' END AS fill_certainty,
  CASE WHEN closed THEN xp END AS exit_price, CASE WHEN f IS NULL THEN 0.0 WHEN NOT closed THEN -0.01 WHEN side = 'BUY' THEN xp - lim ELSE lim - xp END AS gross_pnl,
  CASE WHEN f IS NULL THEN 0.0 ELSE (CASE WHEN closed THEN xp ELSE lim END) * 0.0005::DOUBLE END AS taker_fee,
  CASE WHEN f IS NULL THEN 'CANCELLED_UNFILLED' WHEN closed THEN 'COMPLETED' ELSE 'INCOMPLETE_MISSING_EXIT' END AS outcome_status FROM ep)"""
)


def ledger(spark, sf_dir):
    s = scored(spark, sf_dir).where((F.col("prediction") != 1) & (F.col("scaled_spread") <= GATE.spread))
    return execution.maker_cohort(s, grid(spark, sf_dir), _S, _H, STREAM)


@query("maker_cohort", with_(MAKER_SQL, "SELECT market_id, asset_id, grid_timestamp_ms, side, limit_price, fill_timestamp_ms, fill_certainty, exit_price, round(gross_pnl, 9) AS gross_pnl, round(taker_fee, 9) AS taker_fee, round(gross_pnl - taker_fee, 9) AS net_pnl, outcome_status FROM mc"))
def maker_cohort(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        *STREAM, "grid_timestamp_ms", "side", "limit_price", "fill_timestamp_ms", "fill_certainty", "exit_price", *[F.round(c, 9).alias(c) for c in ("gross_pnl", "taker_fee", "net_pnl")], "outcome_status"
    )


@query(
    "dual_cohort",
    with_(
        MAKER_SQL,
        """, n AS (SELECT *, gross_pnl - taker_fee AS net FROM mc)
SELECT count(*) AS itt_signals, count(fill_timestamp_ms) AS filled, round(count(fill_timestamp_ms)::DOUBLE / count(*), 9) AS fill_rate, count_if(outcome_status = 'COMPLETED') AS completed,
  count_if(fill_certainty = 'CONFIRMED_PRICE_THROUGH') AS confirmed, round(avg(net), 9) AS itt_mean, round(avg(CASE WHEN fill_timestamp_ms IS NOT NULL THEN net END), 9) AS filled_mean,
  round(avg(CASE WHEN fill_certainty = 'CONFIRMED_PRICE_THROUGH' THEN net END), 9) AS conservative_mean,
  avg(net) > 0 AS itt_hurdle, coalesce(avg(CASE WHEN fill_timestamp_ms IS NOT NULL THEN net END) > 0, false) AS filled_hurdle,
  avg(net) > 0 AND coalesce(avg(CASE WHEN fill_timestamp_ms IS NOT NULL THEN net END) > 0, false) AND count(fill_timestamp_ms) >= 100 AS accepted FROM n""",
    ),
)
def dual_cohort(spark, sf_dir):
    """All signals (intention to treat) beside the filled ones; acceptance needs both hurdles."""
    net, n = F.col("net_pnl"), F.count(F.lit(1))
    filled, sure = F.col("is_filled"), F.col("fill_certainty") == "CONFIRMED_PRICE_THROUGH"
    itt, own = F.avg(net), F.avg(F.when(filled, net))
    return ledger(spark, sf_dir).agg(
        n.alias("itt_signals"), F.count_if(filled).alias("filled"), F.round(F.count_if(filled) / n, 9).alias("fill_rate"), F.count_if(F.col("outcome_status") == "COMPLETED").alias("completed"), F.count_if(sure).alias("confirmed"),
        F.round(itt, 9).alias("itt_mean"), F.round(own, 9).alias("filled_mean"), F.round(F.avg(F.when(sure, net)), 9).alias("conservative_mean"), (itt > 0).alias("itt_hurdle"), F.coalesce(own > 0, F.lit(False)).alias("filled_hurdle"),
        ((itt > 0) & F.coalesce(own > 0, F.lit(False)) & (F.count_if(filled) >= 100)).alias("accepted"),
    )


_VERDICT = ["itt_mean", "itt_se", "itt_t", "filled_mean", "filled_se", "filled_t", "conservative_mean", "conservative_t", "profit_factor", "max_drawdown", "fill_rate", "win_rate", "loss_rate", "scratch_rate", "decisive_win_rate", "asymmetry", "balance_ratio"]


@query(
    "cohort_verdict",
    with_(
        MAKER_SQL,
        f""", b0 AS (SELECT *, fill_timestamp_ms IS NOT NULL AS fi, gross_pnl - taker_fee AS net, CASE WHEN grid_timestamp_ms - lag(grid_timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) > {HOURS.burst} THEN 1 ELSE 0 END AS nb FROM mc),
b1 AS (SELECT *, market_id || '|' || asset_id || '|' || (sum(nb) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms ROWS UNBOUNDED PRECEDING))::BIGINT AS c FROM b0),
co AS (SELECT 'i' AS k, c, net AS v FROM b1 UNION ALL SELECT 'f', c, net FROM b1 WHERE fi UNION ALL SELECT 'c', c, CASE WHEN fi AND fill_certainty = 'CONFIRMED_PRICE_THROUGH' THEN net ELSE 0 END FROM b1),
p AS (SELECT k, c, sum(v) AS s, count(*) AS n FROM co GROUP BY k, c), t AS (SELECT k, sum(s) AS s, sum(n)::DOUBLE AS n, count(*) AS c FROM p GROUP BY k),
z AS (SELECT k, t.s / t.n AS mean, t.c, sqrt(t.c / (t.c - 1.0) * sum(pow(p.s - p.n * (t.s / t.n), 2)) / (t.n * t.n)) AS se FROM p JOIN t USING (k) GROUP BY k, t.s, t.n, t.c),
zz AS (SELECT max(mean) FILTER (k = 'i') AS itt_mean, max(se) FILTER (k = 'i') AS itt_se, max(c) FILTER (k = 'i') AS itt_clusters, max(mean) FILTER (k = 'f') AS filled_mean, max(se) FILTER (k = 'f') AS filled_se,
  max(mean) FILTER (k = 'c') AS conservative_mean, max(se) FILTER (k = 'c') AS conservative_se FROM z),
dr AS (SELECT max(pk - cum) AS max_drawdown FROM (SELECT cum, max(cum) OVER (ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING) AS pk, grid_timestamp_ms, market_id, asset_id FROM
  (SELECT *, sum(net) OVER (ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING) AS cum FROM b1 WHERE fi))),
n AS (SELECT count(*) AS signals, count_if(fi) AS filled, count_if(fi AND fill_certainty = 'CONFIRMED_PRICE_THROUGH') AS confirmed, count_if(fi AND fill_certainty <> 'CONFIRMED_PRICE_THROUGH') AS ambiguous, count_if(fi AND net > 1e-6) AS w, count_if(fi AND net < -1e-6) AS l,
  sum(CASE WHEN fi AND net > 1e-6 THEN net ELSE 0 END) / sum(CASE WHEN fi AND net < -1e-6 THEN -net ELSE 0 END) AS profit_factor, count_if(side = 'BUY') AS up, count_if(side = 'SELL') AS down FROM b1),
a AS (SELECT *, w::DOUBLE / filled AS win_rate, w::DOUBLE / (w + l) AS decisive_win_rate, abs(up - down)::DOUBLE / (up + down) AS asymmetry, filled_mean / filled_se AS filled_t FROM n, zz, dr)
SELECT signals, filled, confirmed, ambiguous, up, down, itt_clusters, round(itt_mean, 9) AS itt_mean, round(itt_se, 9) AS itt_se, round(itt_mean / itt_se, 6) AS itt_t, round(filled_mean, 9) AS filled_mean, round(filled_se, 9) AS filled_se, round(filled_t, 6) AS filled_t,
  round(conservative_mean, 9) AS conservative_mean, round(conservative_mean / conservative_se, 6) AS conservative_t, round(profit_factor, 6) AS profit_factor, round(max_drawdown, 6) AS max_drawdown,
  round(filled::DOUBLE / signals, 9) AS fill_rate, round(win_rate, 9) AS win_rate, round(l::DOUBLE / filled, 9) AS loss_rate, round((filled - w - l)::DOUBLE / filled, 9) AS scratch_rate, round(decisive_win_rate, 9) AS decisive_win_rate, round(asymmetry, 9) AS asymmetry,
  round(least(up, down)::DOUBLE / greatest(up, down), 9) AS balance_ratio, itt_mean >= 0.0025 AS itt_hurdle, filled_mean >= 0.003 AS filled_hurdle, profit_factor >= 1.25 AS profit_factor_floor, profit_factor >= 1.3 AS profit_factor_target,
  decisive_win_rate >= 0.5 AS decisive_wins, win_rate >= 0.48 AS overall_wins, asymmetry <= 0.35 AS balanced, filled_t >= 2 AS t_passed, filled >= 400 AS enough_filled, signals >= 600 AS enough_signals, itt_clusters >= 50 AS enough_bursts,
  filled >= 400 AND signals >= 600 AND itt_clusters >= 50 AS complete,
  filled >= 400 AND signals >= 600 AND itt_clusters >= 50 AND itt_mean >= 0.0025 AND filled_mean >= 0.003 AND profit_factor >= 1.25 AND decisive_win_rate >= 0.5 AND win_rate >= 0.48 AND asymmetry <= 0.35 AND filled_t >= 2 AS protocol_accepted FROM a""",
    ),
)
def cohort_verdict(spark, sf_dir):
    """Both cohorts against the protocol; a trial of five sessions without a hard stop is supposed."""
    d = execution.clustered(ledger(spark, sf_dir), HOURS.burst, STREAM)
    out = execution.cohort_verdict(d, _ORDER, F.floor(F.col("grid_timestamp_ms") / _DAY), sessions=5)
    out = out.withColumns({c: F.round(c, 6 if c[-2:] == "_t" or c in ("profit_factor", "max_drawdown") else 9) for c in _VERDICT})
    return out.drop("itt_n_eff", "filled_n_eff", "conservative_n_eff", "conservative_se", "filled_clusters", "conservative_clusters", "wins", "losses", "enough_sessions", "no_hard_stop")


@query(
    "n_eff",
    with_(
        MAKER_SQL,
        f""", b0 AS (SELECT *, gross_pnl - taker_fee AS v, CASE WHEN grid_timestamp_ms - lag(grid_timestamp_ms) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms) > {HOURS.burst} THEN 1 ELSE 0 END AS nb FROM mc),
b1 AS (SELECT market_id || '|' || asset_id || '|' || (sum(nb) OVER (PARTITION BY market_id, asset_id ORDER BY grid_timestamp_ms ROWS UNBOUNDED PRECEDING))::BIGINT AS c, v FROM b0),
p AS (SELECT c, sum(v) AS s, count(*) AS n FROM b1 GROUP BY c), t AS (SELECT sum(s) AS s, sum(n)::DOUBLE AS n, count(*) AS c FROM p),
z AS (SELECT t.c, t.n, sum(pow(p.s - p.n * (t.s / t.n), 2)) AS s2, sum(pow(p.s - p.n * (t.s / t.n), 4)) AS s4 FROM p, t GROUP BY ALL)
SELECT c AS clusters, n::BIGINT AS rows, round(least(s2 * s2 / s4, c), 5) AS n_eff FROM z""",
    ),
)
def n_eff(spark, sf_dir):
    d = execution.clustered(ledger(spark, sf_dir), HOURS.burst, STREAM)
    return stats.cluster_robust(d, "net_pnl", "cluster_id").select("clusters", "rows", F.round("n_eff", 5).alias("n_eff"))


@query(
    "drawdown",
    with_(
        STRESS_SQL,
        """, s0 AS (SELECT *, sum(x) OVER (ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING) AS cum FROM st WHERE scenario = 'S0_Baseline_Top_of_Book_0bps')
SELECT market_id, asset_id, grid_timestamp_ms, round(cum, 8) AS cum, round(max(cum) OVER (ORDER BY grid_timestamp_ms, market_id, asset_id ROWS UNBOUNDED PRECEDING), 8) AS peak FROM s0""",
    ),
)
def drawdown(spark, sf_dir):
    d = policy.stress(trade_rows(spark, sf_dir), GATE).where("scenario = 'S0_Baseline_Top_of_Book_0bps'")
    out = running(d, F.col("pnl"), _ORDER, F.floor(F.col("grid_timestamp_ms") / _DAY))
    return out.select(*STREAM, "grid_timestamp_ms", F.round("cum", 8).alias("cum"), F.round("peak", 8).alias("peak"))


_BW = "OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING)"
_BP = "OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BACKTEST_SQL = (
    QUOTES_SQL
    + f""",
bt0 AS (SELECT *, (bid + ask) / 2.0 AS price, CASE sequence_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'FLAT' END AS signal FROM q),
bt1 AS (SELECT *, last_value(CASE WHEN signal <> 'FLAT' THEN signal END IGNORE NULLS) {_BP} AS bf, last_value(CASE WHEN signal <> 'FLAT' THEN signal END IGNORE NULLS) {_BW} AS nw FROM bt0),
bt2 AS (SELECT *, signal = 'UP' AND coalesce(bf, 'DOWN') = 'DOWN' AS buy, coalesce(signal = 'DOWN' AND bf = 'UP', false) AS sell FROM bt1),
bt3 AS (SELECT *, last_value(CASE WHEN buy THEN 1000.0::DOUBLE / price END IGNORE NULLS) {_BW} AS qty FROM bt2),
bt4 AS (SELECT *, CASE WHEN buy THEN -(qty * (price * (1 + 0.0005::DOUBLE)) + qty * (price * (1 + 0.0005::DOUBLE)) * 0.001::DOUBLE) WHEN sell THEN qty * (price * (1 - 0.0005::DOUBLE)) - qty * (price * (1 - 0.0005::DOUBLE)) * 0.001::DOUBLE ELSE 0.0 END AS flow FROM bt3),
bt AS (SELECT *, 1e6 + sum(flow) {_BW} AS cash, CASE WHEN nw = 'UP' THEN qty ELSE 0.0 END AS position FROM bt4)"""
)


def backtested(spark, sf_dir):
    m = F.col("sequence_id") % 3
    d = events(spark, sf_dir).withColumns({"price": mid(), "signal": F.when(m == 0, "UP").when(m == 1, "DOWN").otherwise("FLAT")})
    return execution.backtest(d, ["timestamp_ms", "sequence_id"], STREAM, "price", "signal")


@query("backtest_equity", with_(BACKTEST_SQL, "SELECT market_id, asset_id, sequence_id, round(cash, 5) AS cash, round(position, 6) AS position, round(cash + position * price, 5) AS equity FROM bt"))
def backtest_equity(spark, sf_dir):
    return backtested(spark, sf_dir).select(*STREAM, "sequence_id", F.round("cash", 5).alias("cash"), F.round("position", 6).alias("position"), F.round("equity", 5).alias("equity"))


@query("backtest_exact", with_(BACKTEST_SQL, "SELECT market_id, asset_id, sequence_id, round(cash, 2) AS cash, round(position, 4) AS position, round(cash + position * price, 2) AS equity FROM bt"))
def backtest_exact(spark, sf_dir):
    """The fold with the cash check gives the same while the cash lasts."""
    m = F.col("sequence_id") % 3
    d = events(spark, sf_dir).withColumns({"price": mid(), "signal": F.when(m == 0, "UP").when(m == 1, "DOWN").otherwise("FLAT")})
    out = execution.backtest_exact(d, ["timestamp_ms", "sequence_id"], STREAM, "price", "signal", 1e6, 1000.0)
    return out.select(*STREAM, "sequence_id", F.round("cash", 2).alias("cash"), F.round("position", 4).alias("position"), F.round("equity", 2).alias("equity"))


@query(
    "backtest_metrics",
    with_(
        BACKTEST_SQL,
        f""", e AS (SELECT market_id, asset_id, timestamp_ms, sequence_id, cash + position * price AS equity FROM bt),
r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id) - 1 AS r, max(equity) {_BW} AS top FROM e)
SELECT market_id, asset_id, round(arg_max(equity, (timestamp_ms, sequence_id)) / arg_min(equity, (timestamp_ms, sequence_id)) - 1, 8) AS total_return, round(avg(r) / stddev_samp(r) * sqrt(count(r)), 4) AS sharpe,
  round(min((equity - top) / top), 8) AS max_drawdown, round(arg_max(equity, (timestamp_ms, sequence_id)), 4) AS final_equity, count(*) AS num_observations FROM r GROUP BY ALL""",
    ),
)
def backtest_metrics(spark, sf_dir):
    out = execution.equity_metrics(backtested(spark, sf_dir), ["timestamp_ms", "sequence_id"], STREAM)
    return out.withColumns({"total_return": F.round("total_return", 8), "sharpe": F.round("sharpe", 4), "max_drawdown": F.round("max_drawdown", 8), "final_equity": F.round("final_equity", 4)})


PNL_SQL = (
    QUOTES_SQL
    + """,
pn AS (SELECT *, CASE WHEN sequence_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (sequence_id * 7919 % 21 - 10) / 100.0::DOUBLE AS pnl FROM q)"""
)


def pnl_rows(spark, sf_dir):
    s = F.col("sequence_id")
    return events(spark, sf_dir).withColumns({"side": F.when(s % 2 == 0, "BUY").otherwise("SELL"), "pnl": (s * 7919 % 21 - 10) / F.lit(100.0)})


@query(
    "rolling_asymmetry",
    with_(
        PNL_SQL,
        """SELECT market_id, asset_id, sequence_id, round(abs(avg(CASE WHEN side = 'BUY' THEN pnl END) OVER w - avg(CASE WHEN side = 'SELL' THEN pnl END) OVER w), 9) AS asymmetry, count(*) OVER w AS fills
FROM pn WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    ),
)
def rolling_asymmetry(spark, sf_dir):
    w = Window.partitionBy(*STREAM).orderBy("timestamp_ms", "sequence_id").rowsBetween(-49, 0)
    one = lambda s: F.avg(F.when(F.col("side") == s, F.col("pnl"))).over(w)
    return pnl_rows(spark, sf_dir).select(*STREAM, "sequence_id", F.round(F.abs(one("BUY") - one("SELL")), 9).alias("asymmetry"), F.count(F.lit(1)).over(w).alias("fills"))


@query(
    "loss_streak",
    with_(
        PNL_SQL,
        """, g0 AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING) AS grp FROM pn),
g1 AS (SELECT *, sum((pnl < 0)::INT) OVER (PARTITION BY market_id, asset_id, grp ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING) AS streak FROM g0)
SELECT market_id, asset_id, sequence_id, streak::BIGINT AS streak, max(streak >= 8) OVER (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING) AS stopped FROM g1""",
    ),
)
def loss_streak(spark, sf_dir):
    """Losses in a row, and the stop that eight of them trip for good."""
    d = execution.loss_streak(pnl_rows(spark, sf_dir), "pnl", ["timestamp_ms", "sequence_id"], STREAM)
    return d.select(*STREAM, "sequence_id", F.col("streak").cast("long").alias("streak"), execution.latched(F.col("streak") >= 8, ["timestamp_ms", "sequence_id"], STREAM).alias("stopped"))


@query(
    "risk_checks",
    with_(
        PNL_SQL,
        """, k AS (SELECT *, sum(pnl) OVER d AS daily, row_number() OVER d AS n, sum(CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) OVER p AS pos FROM pn
  WINDOW d AS (PARTITION BY market_id, asset_id, timestamp_ms // 86400000 ORDER BY timestamp_ms, sequence_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY market_id, asset_id ORDER BY timestamp_ms, sequence_id ROWS UNBOUNDED PRECEDING))
SELECT sequence_id, CASE WHEN bid_size > 95 THEN 'MAX_ORDER_SIZE' WHEN abs(CASE WHEN side = 'BUY' THEN pos + bid_size ELSE pos - bid_size END) > 100 THEN 'MAX_POSITION' WHEN round(daily, 6) <= -0.3 THEN 'MAX_DAILY_LOSS'
  WHEN (100 - (100 - ask_size)) / 100 >= 0.4 THEN 'MAX_DRAWDOWN' WHEN n >= 30 THEN 'MAX_TRADES' ELSE 'APPROVED' END AS verdict FROM k""",
    ),
)
def risk_checks(spark, sf_dir):
    t = ["timestamp_ms", "sequence_id"]
    day = Window.partitionBy(*STREAM, F.floor(F.col("timestamp_ms") / _DAY)).orderBy(*t)
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    ever = Window.partitionBy(*STREAM).orderBy(*t).rowsBetween(Window.unboundedPreceding, 0)
    d = pnl_rows(spark, sf_dir).withColumns({"daily": F.round(F.sum("pnl").over(upto), 6), "n": F.row_number().over(day), "pos": F.sum(F.when(F.col("side") == "BUY", 1).otherwise(-1)).over(ever)})
    v = execution.risk_check(F.col("side"), F.col("bid_size"), F.col("pos"), F.lit(100.0) - F.col("ask_size"), F.lit(100.0), F.col("daily"), F.col("n"), max_order=95, max_position=100, max_daily_loss=0.3, max_drawdown=0.4, max_trades=30)
    return d.select("sequence_id", v.alias("verdict"))


@query(
    "quote_engine",
    with_(
        QUOTES_SQL,
        "SELECT sequence_id, round((bid + ask) / 2.0 - (sequence_id % 11 - 5) * 0.001::DOUBLE - (bid + ask) / 2.0 * 0.002::DOUBLE, 9) AS our_bid, round((bid + ask) / 2.0 - (sequence_id % 11 - 5) * 0.001::DOUBLE + (bid + ask) / 2.0 * 0.002::DOUBLE, 9) AS our_ask FROM q",
    ),
)
def quote_engine(spark, sf_dir):
    b, a = quotes_around(mid(), mid() * 0.002, F.col("sequence_id") % 11 - 5, 0.001)
    return events(spark, sf_dir).select("sequence_id", F.round(b, 9).alias("our_bid"), F.round(a, 9).alias("our_ask"))


@query("signal_map", with_(PREDICT_SQL, "SELECT market_id, asset_id, grid_timestamp_ms, CASE WHEN confidence < 0.6 THEN 'NO_TRADE' WHEN prediction = 2 THEN 'LONG' WHEN prediction = 0 THEN 'SHORT' ELSE 'NO_TRADE' END AS signal FROM pred"))
def signal_map(spark, sf_dir):
    return predicted(spark, sf_dir).select(*STREAM, "grid_timestamp_ms", signal(F.col("prediction"), F.col("confidence")).alias("signal"))
