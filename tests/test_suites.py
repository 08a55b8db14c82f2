"""Validator suites, least squares and snapped splits on small tables."""

import random

import numpy as np

from quillfin.operators import guards, rules, split, stats


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 3
    y = x @ np.array([0.5, -1.0, 0.0, 2.0]) + rng.normal(size=400)
    rows = [(*map(float, x[k]), float(y[k]), "train" if k < 300 else "validation") for k in range(400)] + [(None, 1.0, 1.0, 1.0, 9.0, "train"), (1.0, 1.0, 1.0, 1.0, 9.0, "purged")]
    names = ["a", "b", "c", "d"]
    got = stats.least_squares(spark.createDataFrame(rows, "a double, b double, c double, d double, y double, part string"), "y", names, "part").collect()
    tr, va = slice(0, 300), slice(300, 400)
    z = np.column_stack([np.ones(400), (x - x[tr].mean(0)) / x[tr].std(0)])
    beta = np.linalg.lstsq(z[tr], y[tr], rcond=None)[0]
    r2 = lambda s: 1 - ((y[s] - z[s] @ beta) ** 2).sum() / ((y[s] - y[s].mean()) ** 2).sum()
    assert [r.term for r in got] == ["intercept", *names]
    assert np.allclose([r.beta for r in got], beta) and np.isclose(got[0].r2_train, r2(tr)) and np.isclose(got[0].r2_validation, r2(va))
    assert np.isclose(got[0].condition, np.linalg.cond(np.corrcoef(x[tr], rowvar=False)))


def test_least_squares_odd_tables(spark):
    schema = "a double, y double, part string"
    assert not stats.least_squares(spark.createDataFrame([], schema), "y", ["a"], "part").collect()
    got = stats.least_squares(spark.createDataFrame([(1.0, 2.0, "train"), (1.0, 4.0, "train")], schema), "y", ["a"], "part").collect()
    assert [(r.term, r.beta, r.r2_validation) for r in got] == [("intercept", 3.0, None), ("a", 0.0, None)]


def best_cut(markets, purge):
    """All pairs of cuts, by plain loops."""
    order = sorted((min(t), m) for m, t in markets.items())
    n, ahead, end, cuts = sum(map(len, markets.values())), 0, None, []
    for lo, m in order:
        if end is not None and lo - end >= purge:
            cuts.append((ahead / n, lo))
        ahead += len(markets[m])
        end = max(markets[m]) if end is None else max(end, max(markets[m]))
    pairs = [(round(abs(a - 0.7) + abs(b - a - 0.15) + abs(1 - b - 0.15), 12), s, t) for a, s in cuts for b, t in cuts if a < b]
    return min(pairs, default=None)


def test_snap_cuts_against_all_pairs(spark):
    rng = random.Random(4)
    for _ in range(6):
        markets, at = {}, 0
        for m in range(rng.randint(3, 25)):
            at += rng.choice([0, 50, 120, 400])
            markets[f"m{m}"] = [at + rng.randint(0, 90) for _ in range(rng.randint(1, 30))]
            at += 60
        rows = spark.createDataFrame([(m, t) for m, ts in markets.items() for t in ts], "market_id string, t long")
        got, want = split.snap_cuts(rows, 100, "t").first(), best_cut(markets, 100)
        if want is None:
            assert got is None
            continue
        assert abs(got.score - want[0]) < 1e-9 and (got.from_validation, got.from_test) == want[1:]
        parts = split.snapped_split(rows, 100, "t").groupBy("market_id").agg({"split": "count"}).count()
        assert parts == len(markets)


def test_snapped_split_falls_back(spark):
    rows = spark.createDataFrame([("a" if k % 2 else "b", "x", k * 10) for k in range(400)], "market_id string, asset_id string, t long")
    got = {r.split for r in split.snapped_split(rows, 100, "t").collect()}
    assert got == {"train", "validation", "test", "purged"}


def test_rules_on_nulls_and_empty_tables(spark):
    schema = "session string, sequence_id long, collected_at long, record_id long, source string, symbol string, source_timestamp long, open double, high double, low double, close double, volume double"
    rule_set = rules.candle_rules("sequence_id", "collected_at", ["session"], 1000)
    assert not rules.validated(spark.createDataFrame([], schema), ["session"], rule_set).collect()
    one = ("feed", "S", 0, 1.0, 2.0, 0.5, 1.5, 3.0)
    rows = [("s", 1, 0, 1, *one), ("s", 2, 1000, 1, *one), ("s", 3, 1000, None, *one), ("s", 4, None, 4, "feed", "S", None, -1.0, None, None, None, None), (None, 1, 0, 1, *one)]
    got = {(r.session, r.check): (r.observed, r.status) for r in rules.validated(spark.createDataFrame(rows, schema), ["session"], rule_set).collect()}
    broken = {k: v for k, v in got.items() if v[1] != "PASS"}
    assert broken == {("s", "required_fields"): (1, "FAIL"), ("s", "duplicate_records"): (1, "FAIL"), ("s", "duplicate_timestamps"): (1, "FAIL")}
    assert len(got) == 18


def test_session_sums_by_hand(spark):
    cells = spark.createDataFrame([("s", 100, False), ("s", 300, False), ("s", 9000, True), ("s", 200, False), ("t", 9000, True)], "session_id string, event_age_ms long, is_stale boolean")
    pnl = [1.0, -0.5, -0.5, None, -2.0, -0.25, -0.25, 3.0]
    trades = spark.createDataFrame([("s", k, "UP" if k < 6 else "DOWN", p) for k, p in enumerate(pnl)], "session_id string, at long, side string, pnl double")
    got = {r.session_id: r.asDict() for r in guards.session_sums(cells, trades, ["session_id"], ["at"]).collect()}
    # from a peak of 1 down to -2.5; the run of three losses follows the null
    assert got["s"] == {"session_id": "s", "observations": 3, "missing_rate": 0.25, "mean_age": 200.0, "losses": 3, "drawdown": 3.5, "asymmetry": 0.25}
    assert got["t"] == {"session_id": "t", "observations": 0, "missing_rate": 1.0, "mean_age": 0.0, "losses": 0, "drawdown": 0.0, "asymmetry": 0.0}
    assert not guards.session_sums(cells.limit(0), trades.limit(0), ["session_id"], ["at"]).collect()


def test_depth_rows_of_odd_books(spark):
    import json

    from pyspark.sql import functions as F

    from quillfin.operators import depth

    lv = lambda *x: [{"price": p, "size": s} for p, s in x]
    rows = [
        ("book", "1", lv(("0.40", "3"), ("0.45", "1"), ("0.40", "7"), ("0.1", "0"), ("-1", "2"), ("x", "2")), lv(("0.6", "5"), ("0.5", "2")), "m", "2024-01-01 00:00:01"),
        ("book", "2", [], lv(("0.6", "5")), "m", "2024-01-01 00:00:02"),
        ("book", "3", None, None, "m", "2024-01-01 00:00:03"),
        ("price_change", "4", None, None, "m", "2024-01-01 00:00:04"),
    ]
    side = "array<struct<price:string,size:string>>"
    feed = spark.createDataFrame(rows, f"event_type string, timestamp string, bids {side}, asks {side}, market string, at string").withColumn("received_at", F.to_timestamp("at"))
    snaps = depth.from_book_events(feed, "S")
    again = snaps.withColumns({"received_at": F.col("received_at") + F.expr("interval 1 hour"), "bids": F.array().cast(side)})
    a, b, c = depth.depth_rows(snaps.unionByName(again)).orderBy("last_update_id").collect()
    assert (a.best_bid, a.best_ask, a.bid_depth_total, a.ask_depth_total) == (0.45, 0.5, 8.0, 7.0)
    assert json.loads(a.top_bids_json) == [[0.45, 1.0], [0.4, 7.0]] and json.loads(a.top_asks_json) == [[0.5, 2.0], [0.6, 5.0]]
    assert abs(a.microprice_5 - (8 * 0.5 + 7 * 0.45) / 15) < 1e-12 and abs(a.order_book_imbalance_5 - 1 / 15) < 1e-12
    assert (b.best_bid, b.best_ask, b.mid_price, b.order_book_imbalance_5) == (None, 0.6, None, -1.0)
    assert (c.best_bid, c.best_ask, c.microprice_5, c.order_book_imbalance_5, c.top_bids_json) == (None, None, None, 0.0, "[]")
    books = snaps.select(F.col("last_update_id").alias("timestamp"), F.lit("m").alias("market_id"), F.lit("a").alias("asset_id"), "bids", "asks")
    got = {r.timestamp: r for r in depth.snapshot_rows(books).collect()}
    x = got[a.last_update_id]
    assert (x.best_bid_size, x.best_ask_size) == (1.0, 2.0) and abs(x.microprice - (0.5 * 1 + 0.45 * 2) / 3) < 1e-12
    assert (got[b.last_update_id].best_bid_size, got[c.last_update_id].imbalance) == (0.0, None)


def test_first_fills_against_plain_search(spark):
    """Dense and sparse stretches, ties in time, invalid quotes and runs of a few quotes."""
    from quillfin.operators import execution

    rng = random.Random(8)
    quotes, t = [], 0
    for n in range(500):
        t += rng.choice([0, 0, 1, 1, 3, 40])
        bid = rng.randint(20, 60)
        quotes.append((rng.choice("ab"), t, n, None if n % 31 == 0 else bid / 100, (bid + rng.choice([-1, 0, 1, 2])) / 100))
    orders = [(rng.choice("ab"), k, rng.randint(-5, t + 5), rng.choice(["BUY", "SELL"]), rng.randint(15, 65) / 100) for k in range(400)] + [("a", 900, None, "BUY", 0.5), ("a", 901, 5, "BUY", None), ("c", 902, 5, "BUY", 0.5)]
    want = {}
    for m, k, at, side, lim in orders:
        if at is None or lim is None:
            continue
        hits = [q[1] for q in quotes if q[0] == m and at < q[1] <= at + 50 and q[3] and 0 < q[3] < q[4] and (q[3] < lim if side == "BUY" else q[4] > lim)]
        if hits:
            want[k] = min(hits)
    o = spark.createDataFrame(orders, "m string, order_id long, timestamp_ms long, side string, limit_price double")
    q = spark.createDataFrame(quotes, "m string, timestamp_ms long, sequence_id long, bid double, ask double")
    for run in (4, 64):
        assert {r.order_id: r.fill_timestamp_ms for r in execution.first_fills(o, q, 50, ["m"], run).collect()} == want
    assert len(want) > 100 and not execution.first_fills(o.limit(0), q, 50, ["m"]).collect()


def test_first_fills_in_a_dense_span(spark):
    """Thousands of quotes in one timeout, unfilled orders among them, against a plain search;
    no order looks through arrays of quotes or runs, and orders without a side fill nothing."""
    from quillfin.operators import execution

    rng = random.Random(21)
    quotes = [("a", rng.randint(0, 900), n, b / 100, (b + 1 + n % 3) / 100) for n in range(3000) for b in [rng.randint(1, 90)]]
    quotes += [("a", 901, 3000, 0.5, float("nan"))]
    orders = [("a", n, t, ("BUY", "SELL")[n % 2], b if n % 2 == 0 else a) for _, t, n, b, a in quotes[:3000]] + [("a", 5000, 1, None, 0.5), (None, 5001, 1, "BUY", 0.9), ("a", 5002, 900, "SELL", 0.99)]
    best, want = {}, {}
    for _, t, _, b, a in quotes:
        low, high = best.get(t, (9.0, 0.0))
        best[t] = (min(low, b), max(high, 9.0 if a != a else a))
    for m, k, t, side, lim in orders:
        hit = next((x for x in range(t + 1, t + 1001) if x in best and (best[x][0] < lim if side == "BUY" else best[x][1] > lim)), None)
        if m and side and hit is not None:
            want[k] = hit
    o = spark.createDataFrame(orders, "m string, order_id long, timestamp_ms long, side string, limit_price double")
    q = spark.createDataFrame(quotes, "m string, timestamp_ms long, sequence_id long, bid double, ask double")
    out = execution.first_fills(o, q, 1000, ["m"])
    assert {r.order_id: r.fill_timestamp_ms for r in out.collect()} == want and 5002 in want and 2500 < len(want) < 3003
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_over_many_leaves(spark):
    """Quantiles of a plain bootstrap of blocks, within Monte Carlo error; ends and odd tables."""
    rng = np.random.default_rng(12)
    v = np.cumsum(rng.normal(size=300)) * 0.1 + rng.normal(size=300)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(7, None)], "i long, v double")
    (r,) = stats.block_bootstrap(d, "v", ["i"], leaf=16).collect()
    around = np.concatenate([v, v[:4]])
    starts = rng.integers(0, 300, (20_000, 60))
    q = np.quantile(sum(around[starts + k] for k in range(5)).sum(axis=1) / 300, [0.025, 0.5, 0.975])
    width = q[2] - q[0]
    assert r.replicates == 2000 and np.all(np.abs(np.array([r.lo, r.median, r.hi]) - q) < 0.06 * width)
    one = stats.block_bootstrap(spark.createDataFrame([(1, 2.5)], "i long, v double"), "v", ["i"], replicates=20).first()
    assert (one.lo, one.hi, one.replicates) == (2.5, 2.5, 20)
    two = stats.block_bootstrap(spark.createDataFrame([(1, 2.0), (2, 4.0)], "i long, v double"), "v", ["i"], replicates=20, leaf=1).first()
    assert 2.0 <= two.lo <= two.hi <= 4.0
    assert stats.block_bootstrap(d.limit(0), "v", ["i"]).first() is None


def test_raw_file_audit_of_odd_files(spark, tmp_path):
    import hashlib
    import json

    from quillfin.sources import audit, jsonl

    event = lambda kind, ts, **more: json.dumps({"received_at": f"2024-01-01T00:00:{more.pop('s', 0):02d}Z", "event": {"event_type": kind, "market": "m", "timestamp": ts, **more}})
    change = lambda ts, *assets: event("price_change", ts, price_changes=[{"asset_id": a} for a in assets])
    texts = {
        "a/one.jsonl": [event("book", "1000", asset_id="u"), "broken", change("90000", "d"), change("80000", "u"), change(300_000, "u", "d"), "[1]"],
        "b/one.jsonl": [event("book", "5", asset_id="u"), change("70005", "u")],
        "b/two.jsonl": [event("book", None, asset_id="u", s=1), event("tick", None, asset_id="d", s=59)],
        "b/none.jsonl": [event("tick", "5")],
    }
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    from pyspark.sql import functions as F

    rows = [(n, k + 1, v) for n, lines in texts.items() for k, v in enumerate(lines)]
    tokens = spark.createDataFrame([(n, "u", "d") for n in texts], "source_file string, up_token string, down_token string")
    raw = spark.createDataFrame(rows, "source_file string, source_line long, value string")
    for block in (2, 100_000):
        got = {r.source_file: r for r in audit.audit(raw, tokens, block=block).collect()}
        a, b, two, none = (got[n] for n in texts)
        assert (a.lines, a.malformed, a.quotes, a.assets, a.max_gap_ms, a.duration_ms, a.classification, a.files_of_slug) == (6, 2, 4, 2, 220_000, 299_000, "COMPLETE", 2)
        assert (b.classification, b.usable, b.slug, b.down_represented) == ("ONE_SIDED_OR_INCOMPLETE", False, "one", False)
        assert (two.duration_ms, two.classification, two.usable, two.max_gap_ms) == (58_000, "TRUNCATED", True, 0)
        assert (none.classification, none.event_types) == ("DEGENERATE_EMPTY", ["tick"])
    assert not audit.audit(raw.limit(0), tokens).collect()
    digest = {r.source_file.rsplit("/", 1)[1]: r.sha256 for r in audit.digests(spark, str(tmp_path / "b")).collect()}
    assert digest["two.jsonl"] == hashlib.sha256((tmp_path / "b/two.jsonl").read_bytes()).hexdigest()
    assert jsonl.lines(spark, str(tmp_path / "a")).where(F.col("value") == "broken").first().source_line == 2


def test_cohort_verdict_against_plain_figures(spark):
    from pyspark.sql import functions as F

    from quillfin.operators import execution

    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        kind = rng.choice(["UNFILLED", "CONFIRMED_PRICE_THROUGH", "AMBIGUOUS_QUOTE_RETREAT"])
        rows.append((k, f"c{k // 7}", str(rng.choice(["BUY", "SELL"])), bool(kind != "UNFILLED"), str(kind), 0.0 if kind == "UNFILLED" else float(rng.normal(0.01, 0.02))))
    schema = "t long, cluster_id string, side string, is_filled boolean, fill_certainty string, net_pnl double"
    small = execution.Protocol(filled=100, signals=200, bursts=20)
    run = lambda d, **o: execution.cohort_verdict(d, ["t"], F.floor(F.col("t") / 50), small, **o)
    d = spark.createDataFrame(rows, schema)
    r = run(d, sessions=5).first()
    x = np.array([v[5] for v in rows if v[3]])
    cum = np.cumsum(x)
    assert (r.signals, r.filled) == (300, len(x)) and np.isclose(r.itt_mean, x.sum() / 300) and np.isclose(r.filled_mean, x.mean())
    assert np.isclose(r.max_drawdown, (np.maximum.accumulate(cum) - cum).max()) and np.isclose(r.profit_factor, x[x > 1e-6].sum() / -x[x < -1e-6].sum())
    assert np.isclose(r.conservative_mean, sum(v[5] for v in rows if v[4] == "CONFIRMED_PRICE_THROUGH") / 300) and r.protocol_accepted
    stopped = run(d, sessions=5, hard_stop=True).first()
    assert not stopped.no_hard_stop and not stopped.complete and not stopped.protocol_accepted and not run(d).first().enough_sessions
    bare = run(d.where("NOT is_filled")).first()
    assert (bare.filled, bare.filled_mean, bare.profit_factor, bare.max_drawdown, bare.filled_hurdle) == (0, 0.0, 0.0, 0.0, False)
    assert run(d.limit(0)).first() is None


def test_ratio_split_with_a_sparse_end(spark):
    """Cuts by stepping back one row at a time, as a plain loop would."""
    import math

    rng = random.Random(2)
    for case in range(4):
        times = sorted(rng.choices(range(0, 2_000, 3), k=200) + [rng.randint(2_000, 9_000) for _ in range(rng.choice([0, 25, 60]))])
        purge, least, n = 120, 10, len(times)
        lo, hi = times[0], times[-1]
        per_purge = max(1, math.ceil(purge / max(1.0, (hi - lo) / (n - 1))))
        allowed = n - (2 * least + 2 * per_purge)
        n_train = max(least, round(max(3 * least, n - 2 * per_purge) * 0.7))
        n_train = min(n_train, allowed) if allowed >= least else n_train
        end = times[n_train - 1]
        rest = [k for k, t in enumerate(times) if t >= end + purge]
        n_val = min(max(least, round(max(2 * least, len(rest) - per_purge) * 0.5)), len(rest) - least)
        while True:
            val_end = max(t for k, t in enumerate(times) if t >= end + purge and times.index(t) < rest[0] + n_val)
            n_test = sum(t >= val_end + purge for t in times)
            if n_test >= least or n_val <= least:
                break
            n_val -= 1
        d = spark.createDataFrame([(t, "m", "a", k) for k, t in enumerate(times)], "grid_timestamp_ms long, market_id string, asset_id string, k long")
        if n_test < least:
            try:
                split.ratio_split(d, purge, least=least)
                raise AssertionError("too few rows for a test were let through")
            except ValueError:
                continue
        got = {r.k: r.split for r in split.ratio_split(d, purge, ties=["k"], least=least).collect()}
        want = {k: "train" if k < n_train else "validation" if t >= end + purge and k < rest[0] + n_val else "test" if t >= val_end + purge else "purged" for k, t in enumerate(times)}
        assert got == want


def test_rows_before_a_time_over_many_spans(spark, monkeypatch):
    from quillfin.operators import running

    monkeypatch.setattr(running, "SPAN", 10)
    rng = random.Random(3)
    times = [rng.randint(-50, 50) for _ in range(300)] + [None, None]
    got = {r.t: (r._n, r._before) for r in running.per_time(spark.createDataFrame([(t,) for t in times], "t long"), "t").collect()}
    assert got == {t: (times.count(t), 0 if t is None else 2 + sum(x is not None and x < t for x in times)) for t in set(times)}


def test_ratio_split_rounds_the_share_of_the_rest(spark):
    """The validation's share of the rest is one number, 0.5: half of 31 rows is 16, not 15."""
    from pyspark.sql import functions as F

    d = spark.range(103).select(F.col("id").alias("grid_timestamp_ms"), F.lit("m").alias("market_id"), F.lit("a").alias("asset_id"))
    parts = {r.split: r["count"] for r in split.ratio_split(d, 2).groupBy("split").count().collect()}
    assert (parts["train"], parts["validation"]) == (69, 16)


def test_audit_reads_lines_once_and_knows_no_blocks(spark):
    """Odd files give the same whatever the block, and every line is looked at once."""
    import json

    from pyspark.sql import functions as F

    from quillfin.sources import audit

    rng, rows = random.Random(8), []
    for f in ("d/a.jsonl", "e/a.jsonl", "e/b.jsonl"):
        for k in range(1, 41):
            e = {"event_type": rng.choice(["book", "price_change", "other"]), "market": rng.choice("mn"), "asset_id": rng.choice(["u", "d", None])}
            e |= {} if rng.random() < 0.4 else {"timestamp": str(rng.randint(0, 10**6))}
            rows.append((f, k, rng.choice([json.dumps({"event": e, "received_at": f"2026-01-01T00:00:{k:02d}Z"}), "{", " ", None]) if k % 4 == 0 or f != "e/b.jsonl" else "{"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked_at(v):
        seen.add(1)
        return v

    lines = spark.createDataFrame(rows, "source_file string, source_line long, value string")
    tokens = spark.createDataFrame([("d/a.jsonl", "u", "d")], "source_file string, up_token string, down_token string")
    want = sorted(map(str, audit.audit(lines, tokens, block=1000).collect()))
    assert sorted(map(str, audit.audit(lines, tokens, block=3).collect())) == want and len(want) == 3
    audit.audit(lines.withColumn("value", looked_at("value")), tokens).collect()
    assert seen.value == len(rows)


def test_baselines_make_their_rows_once(spark):
    from pyspark.sql import functions as F

    from quillfin.operators import learn

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        made.add(1)
        return float(x)

    d = spark.range(120).select("id", costly(F.sin("id")).alias("a"), F.cos("id").alias("b"), (F.col("id") % 3).alias("y"))
    got = {r.model: r.rows for r in learn.fit_and_score(d.where("id < 80"), d.where("id >= 80"), ["a", "b"]).collect()}
    assert got == {"majority": 40, "logistic": 40, "perceptron": 40}
    assert made.value == 240  # the filter on nulls and the column ask once each, no model asks again
