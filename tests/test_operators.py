"""Boundary cases of single operators on tiny frames."""

import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillfin.functions import quotes as fq
from quillfin.model import FEATURES, LIVE
from quillfin.operators import asof, features, label, metrics, running, scale, sequence, split, stats
from quillfin.sources import jsonl

COLUMNS = "timestamp_ms long, sequence_id long, market_id string, asset_id string, bid double, ask double, bid_size double, ask_size double"


def quotes(spark, rows):
    """rows: (ms, seq, bid)"""
    return spark.createDataFrame([(t, s, "m", "a", b, b + 0.02, 10.0, 30.0) for t, s, b in rows], COLUMNS)


def test_grid_takes_last_event_at_or_before(spark):
    g = asof.asof_grid(quotes(spark, [(41_370, 1, 0.1), (41_910, 2, 0.2), (42_050, 3, 0.3), (43_000, 4, 0.4)]), LIVE)
    got = {r.grid_timestamp_ms: (r.source_timestamp_ms, r.bid) for r in g.collect()}
    assert got == {42_000: (41_910, 0.2), 43_000: (43_000, 0.4)}


def test_grid_ties_take_highest_sequence_and_stale_is_strict(spark):
    g = asof.asof_grid(quotes(spark, [(1000, 1, 0.1), (1000, 2, 0.2), (7000, 3, 0.3)]), LIVE).orderBy("grid_timestamp_ms").collect()
    assert g[0].bid == 0.2 and [r.is_stale for r in g] == [False] * 6 + [False]
    assert g[5].event_age_ms == 5000 and not g[5].is_stale


@pytest.mark.parametrize(("elapsed", "found"), [(4999, False), (5000, True), (5001, True), (6999, True), (7000, True), (7001, False)])
def test_horizon_bounds(spark, elapsed, found):
    q = quotes(spark, [(10000, 1, 0.5), (10000 + elapsed, 2, 0.6)])
    g = asof.asof_grid(q, LIVE).where("grid_timestamp_ms = 10000")
    rows = label.physical_horizon(g, q, LIVE).collect()
    assert len(rows) == int(found)
    if found:
        assert rows[0].label == "UP"


def test_horizon_takes_first_and_lowest_sequence(spark):
    q = quotes(spark, [(10000, 1, 0.5), (15500, 3, 0.4), (15500, 2, 0.6), (16000, 4, 0.1)])
    g = asof.asof_grid(q, LIVE).where("grid_timestamp_ms = 10000")
    (row,) = label.audit(label.physical_horizon(g, q, LIVE)).collect()
    assert (row.target_sequence_id, row.physical_horizon_ms, row.label) == (2, 5500, "UP")


def test_label_threshold_is_strict(spark):
    d = spark.createDataFrame([(0.011, 0.01), (0.01, 0.01), (-0.011, 0.01)], "d double, t double")
    assert [r[0] for r in d.select(fq.move_label(F.col("d"), F.col("t"))).collect()] == ["UP", "FLAT", "DOWN"]


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    base = [(i * 1000, "m", "a", 0.3 + float(rng.random()) / 10, 0.5, 10.0, 20.0) for i in range(20)]
    cols = "grid_timestamp_ms long, market_id string, asset_id string, bid double, ask double, bid_size double, ask_size double"
    changed = [r if r[0] < 14000 else (*r[:3], 0.2, *r[4:]) for r in base]
    a, b = (features.causal(spark.createDataFrame(x, cols)).orderBy("grid_timestamp_ms").select(*FEATURES).collect() for x in (base, changed))
    assert a[:14] == b[:14] and a[14] != b[14]
    assert [r.mid_volatility_5s is None for r in a[:6]] == [True] * 5 + [False]


def test_row_index_and_running_equal_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=200)
    rows = [(int(i // 3), int(i), float(x)) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "t long, i long, v double")
    assert all(r.i == r.row_index for r in running.row_index(d, "t", ["i"]).collect())
    got = running.running(d, F.col("v"), ["i"], F.floor(F.col("i") / 17)).orderBy("i").toPandas()
    cum = np.cumsum(v)
    assert np.allclose(got.cum, cum) and np.allclose(got.peak, np.maximum.accumulate(cum))


def test_split_keeps_purge_and_errors(spark):
    d = spark.createDataFrame([(i * 1000, "m", "a", float(i)) for i in range(600)], "grid_timestamp_ms long, market_id string, asset_id string, x double")
    s = split.ratio_split(d, 22000)
    ends = {r.split: (r.lo, r.hi) for r in s.groupBy("split").agg(F.min("grid_timestamp_ms").alias("lo"), F.max("grid_timestamp_ms").alias("hi")).collect()}
    assert ends["validation"][0] - ends["train"][1] >= 22000 and ends["test"][0] - ends["validation"][1] >= 22000
    with pytest.raises(ValueError, match="purge"):
        split.required_purge(explicit=19999)
    with pytest.raises(ValueError, match="few"):
        split.ratio_split(d.where("grid_timestamp_ms < 30000"), 22000)


def test_sequences_count_and_weights(spark):
    d = spark.createDataFrame([(i * 1000, "m", "a", float(i)) for i in range(25)], "grid_timestamp_ms long, market_id string, asset_id string, x double")
    s = sequence.build(d, 10, columns=["x"])
    assert s.count() == 16
    cells = [v[0] for r in s.collect() for v in r.feature_matrix]
    w = sequence.multiplicity(d, 10, "grid_timestamp_ms", ["market_id", "asset_id"])
    (fit,) = scale.fit(w, ["x"], "standard", "weight").collect()
    assert fit.center == pytest.approx(np.mean(cells)) and fit.scale == pytest.approx(np.std(cells))
    (fit,) = scale.fit(w, ["x"], "robust", "weight").collect()
    assert fit.center == np.median(cells) and fit.scale == pytest.approx(np.subtract(*np.percentile(cells, [75, 25])))
    with pytest.raises(ValueError, match="training"):
        scale.fit(w, ["x"], split="validation")


def test_cluster_robust_against_numpy(spark):
    rng = np.random.default_rng(3)
    v, c = rng.normal(size=60), rng.integers(0, 7, 60)
    d = spark.createDataFrame([(float(a), str(b)) for a, b in zip(v, c)], "v double, c string")
    (r,) = stats.cluster_robust(d, "v", "c").collect()
    s = np.array([(v[c == k] - v.mean()).sum() for k in np.unique(c)])
    n = len(s)
    assert r.se == pytest.approx(np.sqrt(n / (n - 1) * (s**2).sum() / 60**2))
    assert r.n_eff == pytest.approx(min((s**2).sum() ** 2 / (s**4).sum(), n))
    (one,) = stats.cluster_robust(d.withColumn("c", F.lit("x")), "v", "c").collect()
    assert one.se == pytest.approx(v.std(ddof=1) / np.sqrt(60))


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(1.0, 1.0, 400)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    (r,) = stats.block_bootstrap(d, "v", ["i"], replicates=500).collect()
    assert r.lo < v.mean() < r.hi and r.hi - r.lo == pytest.approx(4 * v.std() / 20, rel=0.4)


def test_reliability_edges(spark):
    d = spark.createDataFrame([(0.3, True), (0.6, True), (0.7, False), (1.0, True)], "c double, ok boolean")
    got = {r.bin: r.n for r in metrics.reliability(d, "c", F.col("ok")).collect()}
    edges = np.linspace(0, 1, 11)
    want = {k: 0 for k in range(10)}
    for c in (0.3, 0.6, 0.7, 1.0):
        want[next(k for k in range(10) if edges[k] <= c and (c < edges[k + 1] or k == 9))] += 1
    assert got == want


def test_fill_classes(spark):
    cases = [("BUY", 0.5, 0.4, 0.5, "CONFIRMED_PRICE_THROUGH"), ("BUY", 0.5, 0.4, 0.6, "AMBIGUOUS_QUOTE_RETREAT"), ("BUY", 0.5, 0.5, 0.6, "TOUCH_REJECTED"), ("BUY", 0.5, 0.55, 0.6, "UNFILLED"),
             ("SELL", 0.5, 0.5, 0.6, "CONFIRMED_PRICE_THROUGH"), ("SELL", 0.5, 0.4, 0.6, "AMBIGUOUS_QUOTE_RETREAT"), ("SELL", 0.5, 0.4, 0.5, "TOUCH_REJECTED"), ("SELL", 0.5, 0.3, 0.4, "UNFILLED"),
             ("BUY", 0.5, 0.6, 0.6, "UNFILLED"), ("BUY", 0.5, None, 0.6, "UNFILLED")]
    d = spark.createDataFrame(cases, "side string, lim double, b double, a double, want string")
    bad = d.where(fq.fill_class(F.col("side"), F.col("lim"), F.col("b"), F.col("a")) != F.col("want"))
    assert bad.count() == 0


def raw(spark, tmp_path, lines):
    (tmp_path / "feed.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return jsonl.normalize(jsonl.records(jsonl.lines(spark, str(tmp_path / "feed.jsonl"))))


def test_book_replay(spark, tmp_path):
    t = 1700000000000
    n = raw(spark, tmp_path, [
        {"event_type": "book", "market": "m", "asset_id": "a", "timestamp": str(t), "bids": [{"price": "0.20", "size": "10"}], "asks": [{"price": "0.30", "size": "20"}]},
        {"timestamp": 1, "data": [{"event_type": "price_change", "market": "m", "timestamp": str(t + 1), "price_changes": [{"asset_id": "a", "price": "0.22", "size": "8", "side": "BUY"}]}]},
        {"event": {"event_type": "price_change", "market": "m", "timestamp": str(t + 2), "price_changes": [{"asset_id": "a", "price": "0.22", "size": "0", "side": "BUY"}]}},
        {"event_type": "last_trade_price"}, "", "   ", "{not json", "12345",
    ])
    got = n.orderBy("source_line").collect()
    assert [(r.bid, r.ask) for r in got[:3]] == [(0.20, 0.30), (0.22, 0.30), (0.20, 0.30)]
    assert [r.reject_reason for r in got[3:]] == ["NON_QUOTE_EVENT", "EMPTY_RECORD", "EMPTY_RECORD", "MALFORMED_JSON", "MALFORMED_JSON"]
    assert got[1].sequence_id == 2000


def test_flat_quotes_and_duplicates(spark, tmp_path):
    t = 1700000000000
    q = lambda **k: {"timestamp_ms": t, "sequence_id": 7, "market_id": "m", "asset_id": "a", "bid": 0.45, "ask": 0.50, "bid_size": 1, "ask_size": 1} | k
    n = raw(spark, tmp_path, [q(), q(), q(bid=0.46), q(sequence_id=8, bid=0.5), q(bid=None), q(bid="x"), q(bid=-0.1), q(ask=1.0), q(ask_size=0), q(timestamp_ms=5), q(timestamp_ms=""), q(asset_id=" ")])
    reasons = [r.reject_reason for r in n.orderBy("source_line").collect()]
    assert reasons == [None, None, None, "CROSSED_BOOK", "MISSING_PRICE", "INVALID_PRICE", "IMPOSSIBLE_PRICE", "IMPOSSIBLE_PRICE", "NON_POSITIVE_DEPTH", "OUT_OF_BOUNDS_TIMESTAMP", "MISSING_TIMESTAMP", "MISSING_ASSET_ID"]
    (kept,) = jsonl.canonical(n).collect()
    assert kept.bid == 0.45 and kept.source_line == 1


def test_temperature_fit_recovers(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z / 2.0)
    p /= p.sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    d = spark.createDataFrame([(k, *map(float, r)) for k, r in zip(y, z)], "y int, a double, b double, c double")
    assert metrics.fit_temperature(d, "y", ["a", "b", "c"], tolerance=1e-3) == pytest.approx(2.0, rel=0.15)


def test_source_has_no_lookahead_tricks():
    from pathlib import Path

    text = Path(features.__file__).read_text()
    assert "F.lead" not in text and "bfill" not in text


def test_quality_score_takes_all_events(spark):
    from quillfin.plans.base import events
    from quillfin.plans.registry import QUERIES

    got = {tuple(r[:2]): r.samples for r in QUERIES["quality_score"](spark, SF).collect()}
    q = events(spark, SF)
    assert got == {tuple(r[:2]): r[2] for r in q.groupBy("market_id", "asset_id").count().collect()} and sum(got.values()) == q.count()


def test_maker_event_sim_orders_on_every_quote(spark):
    from quillfin.plans.base import events
    from quillfin.plans.registry import QUERIES
    from quillfin.plans.replay_queries import _T, _X

    streams = {}
    for r in sorted(events(spark, SF).collect(), key=lambda r: (r.timestamp_ms, r.sequence_id)):
        streams.setdefault((r.market_id, r.asset_id), []).append(r)
    want = {}
    for rows in streams.values():
        for k, o in enumerate(rows):
            buy = o.sequence_id % 2 == 0
            lim = o.bid if buy else o.ask
            later = (e.timestamp_ms for e in rows[k + 1 :] if o.timestamp_ms < e.timestamp_ms <= o.timestamp_ms + _T and ((e.ask <= lim or e.bid < lim) if buy else (e.bid >= lim or e.ask > lim)))
            fill = next(later, None)
            x = None if fill is None else next((e for e in rows if e.timestamp_ms >= fill + _X), None)
            status = "CANCELLED_UNFILLED" if fill is None else "INCOMPLETE_MISSING_EXIT" if x is None else "COMPLETED"
            want[o.sequence_id] = ("BUY" if buy else "SELL", lim, fill, None if x is None else x.bid if buy else x.ask, status)
    got = QUERIES["maker_event_sim"](spark, SF).collect()
    assert len(got) == len(want) and {r[0]: (r.side, r.limit_price, r.fill_timestamp_ms, r.exit_price, r.outcome) for r in got} == want


@pytest.mark.parametrize("few,bins", [(10_000, 1024), (5, 64)])
def test_quantiles_are_exact_in_rounds(spark, few, bins):
    """Against sorted repetition: ties, signs, far outliers, a constant, doubles next to each other."""
    import numpy as np

    from quillfin.operators import scale

    rng = np.random.default_rng(4)
    columns = {
        "plain": rng.normal(size=400), "ties": rng.integers(0, 4, 400).astype(float), "far": np.concatenate((rng.normal(size=396), [1e300, -1e300, 1e-300, 0.0])),
        "same": np.full(400, 0.3), "near": 1.0 + np.arange(400) * 2.0**-52, "one": np.array([7.0]),
    }
    rows = [(f, float(v), int(w)) for f, x in columns.items() for v, w in zip(x, rng.integers(1, 9, len(x)))]
    got = scale.quantiles(spark.createDataFrame(rows, "feature string, value double, weight long").repartition(3), [0.25, 0.5, 0.75], few=few, bins=bins)
    for f in columns:
        long = np.sort(np.concatenate([np.full(w, v) for g, v, w in rows if g == f]))
        assert got[f] == pytest.approx([np.quantile(long, q) for q in (0.25, 0.5, 0.75)], rel=1e-15, abs=1e-300)


def test_time_range_volatility_in_a_dense_stream(spark):
    """40,000 rows within one range: a frame laid anew for every row would visit 8e8; also ties, nulls and both ends."""
    import time

    t = F.when(F.col("id") < 40_000, F.floor(F.col("id") / 4).cast("long")).otherwise(-50_000 + (F.col("id") - 40_000) * 7)
    d = spark.range(40_300).select(F.lit("m").alias("k"), F.when(F.col("id") % 1009 != 0, t).alias("t"), F.when(F.col("id") % 5 != 0, F.sin("id") + 1000).alias("v"))
    d.persist().count()
    began = time.time()
    got = features.time_range_volatility(d, F.col("v"), "t", 12_000, ["k"]).collect()
    assert time.time() - began < 60
    rows = [(r.t, r.v) for r in d.collect()]
    assert sorted((str(r.t), str(r.v)) for r in got) == sorted((str(t), str(v)) for t, v in rows)
    at, v = (np.array([np.nan if r[k] is None else r[k] for r in rows]) for k in (0, 1))
    for r in got[::173] + [x for x in got if x.t is None][:2]:
        own = np.isnan(at) if r.t is None else (at > r.t - 12_000) & (at <= r.t)
        x = v[own & ~np.isnan(v)]
        assert r["values"] == len(x)
        assert (r.volatility is None) if len(x) < 3 else np.isclose(r.volatility, x.std(ddof=1), rtol=1e-9)


def test_backtest_exact_folds_batch_by_batch(spark):
    """A stream goes through tasks in batches of rows, never as one frame; cash, position and both orders of rows are kept."""
    from quillfin.operators import execution

    rows = [(k % 3 if k % 3 else None, (k * 37) % 101 if k % 29 else None, k, 0.5 + k % 7, ["UP", "DOWN", "FLAT", None][k * k % 4 if k % 5 else 1]) for k in range(200)]
    d = spark.createDataFrame(rows, "g long, t long, k long, price double, signal string")
    run = lambda: {r.k: (r.cash, r.position, r.equity) for r in execution.backtest_exact(d, ["t", "k"], ["g"], "price", "signal", 1500.0, 1000.0).collect()}
    want = {}
    for g in (None, 1, 2):
        money, held = 1500.0, 0.0
        for _, _, k, p, s in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            if s == "UP" and held == 0 and 1000.0 / p * (p * 1.0005) * 1.001 <= money:
                money, held = money - 1000.0 / p * (p * 1.0005) * 1.001, 1000.0 / p
            elif s == "DOWN" and held > 0:
                money, held = money + held * p * 0.9995 * 0.999, 0.0
            want[k] = (money, held, money + held * p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert "FlatMapGroups" not in execution.backtest_exact(d, ["t", "k"], ["g"], "price", "signal", 1500.0, 1000.0)._jdf.queryExecution().toString()
