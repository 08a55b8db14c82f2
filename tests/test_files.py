"""File sources, sinks and guards."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillfin.operators import features, guards
from quillfin.sources import files

QUOTES = "market_id string, asset_id string, timestamp_ms long, sequence_id long, bid double, ask double, bid_size double, ask_size double"


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "p"}\nnot json\n{"x": 2, "z": [1]}\n')
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert set(rows.columns) == {"_corrupt_record", "x", "y", "z"} and rows.cache().where("x IS NULL").count() == 1
    (tmp_path / "b.csv").write_text("at,v\n2024-03-01 10:00:00,1\n2024-03-01T12:00:00+02:00,2\nsoon,3\n")
    from pyspark.sql.types import DoubleType, StructType, TimestampType

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = files.csv_utc(spark, str(tmp_path / "b.csv"), StructType().add("at", TimestampType()).add("v", DoubleType()), ["at"])
        assert [r[0] for r in got.select(F.unix_seconds("at")).collect()] == [1709287200, 1709287200, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_discovery_sidecars_and_counts(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, QUOTES).coalesce(1).write.parquet(str(tmp_path / "d" / name))

    row = lambda t, bid=0.4: ("m", "UP", t, t, bid, 0.5, 1.0, 1.0)
    put("long.parquet", [row(0), row(90_000)])
    put("short.parquet", [row(0), row(5_000)])
    put("one_sided.parquet", [row(0, None), row(90_000, None)])
    put("old_feed.parquet", [row(0), row(90_000)])
    got = files.discover(spark, str(tmp_path / "d" / "*"), ["old_feed"], 60_000)
    assert got.count() == 2 and all("/long.parquet/" in r.file for r in got.collect())
    assert files.footer_rows(spark, str(tmp_path / "d" / "*")) == 8
    for folder, slug in (("a", "s1"), ("b", "s2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x1.meta.json").write_text(json.dumps({"slug": slug}))
    a, b = (f"{tmp_path}/{folder}/x1.jsonl" for folder in "ab")
    named = spark.createDataFrame([(f"file://{a}",), (b,), (f"{tmp_path}/a/x2.jsonl",)], "file string")
    meta = files.with_sidecar(named, files.sidecars(spark, str(tmp_path / "*" / "*.meta.json"))).select("file", F.get_json_object("meta", "$.slug").alias("slug"))
    assert {tuple(r) for r in meta.collect()} == {(f"file://{a}", "s1"), (b, "s2"), (f"{tmp_path}/a/x2.jsonl", None)}
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "d")]) == str(tmp_path / "d")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(k % 2, 9 - k, f"n{k}") for k in range(10)], "g int, t int, name string")
    files.overwrite_parquet(d, str(tmp_path / "p"), by=["g"], sort=["t"])
    files.overwrite_parquet(d, str(tmp_path / "p"), by=["g"], sort=["t"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    assert [r.t for r in spark.read.parquet(str(tmp_path / "p" / "g=0")).collect()] == [1, 3, 5, 7, 9]
    for kind in ("csv", "json", "markdown"):
        files.report(d, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10 and spark.read.json(str(tmp_path / "json")).count() == 10
    lines = [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert lines[:2] == ["| g | t | name |", "|-|-|-|"] and len(lines) == 12
    a = files.decision_log(d, str(tmp_path / "log"), ["t"], "s1").first()
    b = files.decision_log(d.repartition(3), str(tmp_path / "log2"), ["t"], "s1").first()
    again = files.decision_log(d.repartition(2), str(tmp_path / "log"), ["t"], "s1").first()
    files.decision_log(d.limit(3), str(tmp_path / "log"), ["t"], "s2")
    assert a == again and spark.read.text(str(tmp_path / "log")).groupBy("epoch").count().orderBy("epoch").collect() == [("s1", 10), ("s2", 3)]
    with pytest.raises(ValueError):
        files.report(d, str(tmp_path / "large"), "csv", most=9)
    assert a == b and a.decisions == 10 and (a["first"], a["last"]) == (0, 9)
    assert files.decision_log(d.where("t > 0"), str(tmp_path / "log3"), ["t"], "s1").first().digest != a.digest
    assert files.record_abort(spark, str(tmp_path / "ledger"), "s1", "DRAWDOWN", 5)
    assert not files.record_abort(spark, str(tmp_path / "ledger"), "s1", "QUOTE_AGE", 6)
    assert files.record_abort(spark, str(tmp_path / "ledger"), "s2", "QUOTE_AGE", 7) and files.ledger(spark, str(tmp_path / "ledger")).count() == 2


def test_raw_frames_are_recorded(spark, tmp_path):
    spark.createDataFrame([('{"a":1}', 0), ("not json", 90_000_000)], "value string, ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string, ms long").parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_millis("ms"))
    files.record_raw(stream, str(tmp_path / "raw")).awaitTermination()
    got = {(str(r.day), r.value) for r in spark.read.text(str(tmp_path / "raw")).collect()}
    assert got == {("1970-01-01", '{"a":1}'), ("1970-01-02", "not json")}


def test_guards_stop(spark):
    row = ("m", "UP", 1000, 1, 0.4, 0.5, 1.0, 1.0)
    fine = spark.createDataFrame([row, ("m", "UP", 1000, 2, 0.4, 0.5, 1.0, 1.0)], QUOTES)
    assert guards.require_valid(fine) is fine
    for bad, what in (((*row[:2], 900, 3, *row[4:]), "not_monotonic"), ((*row[:4], 0.6, 0.5, 1.0, 1.0), "crossed"), ((*row[:7], 0.0), "no_depth"), ((*row[:4], None, *row[5:]), "missing")):
        with pytest.raises(ValueError, match=what):
            guards.require_valid(fine.union(spark.createDataFrame([bad], QUOTES)))
    with pytest.raises(ValueError, match="columns"):
        guards.require_valid(fine.drop("ask"))
    ages = spark.createDataFrame([(5,), (0,)], "event_age_ms int")
    assert guards.no_future(ages).count() == 2
    with pytest.raises(PySparkException, match="after its grid time"):
        guards.no_future(ages.union(spark.createDataFrame([(-1,)], "event_age_ms int"))).collect()
    twice = spark.createDataFrame([(1, "UP", 0.1), (1, "UP", 0.2), (1, "DOWN", 0.3)], "t int, side string, v double")
    with pytest.raises(PySparkException, match="twice"):
        features.pair_pivot(twice, "t", "side", ["v"]).collect()


def test_sessions_and_selection(spark):
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 1, 1), ("c", 1, 2)], "session_id string, signal_id int, burst_id int")
    st = spark.createDataFrame([("a", "COMPLETE"), ("b", "DEGRADED"), ("c", "COMPLETE")], "session_id string, status string")
    assert sorted((r.session_id, r.signal_id, r.cluster) for r in guards.sessions(s, st).collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("c", 1, 2)]
    with pytest.raises(PySparkException, match="twice"):
        guards.sessions(s.union(s.limit(1)), st).collect()
    m = spark.createDataFrame([("dummy", 0.33, 0.2), ("x", 0.5, 0.4), ("y", 0.5, 0.1)], "model string, balanced_accuracy double, macro_f1 double")
    assert {r.model: r.accepted for r in guards.selected(m).collect()} == {"dummy": False, "x": True, "y": False}
