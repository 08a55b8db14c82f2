"""Streams: parity with batch, bursts, idempotent appends, paged replay."""

import json

from conftest import SF

from quillfin.sources.replay import ReplaySource
from quillfin.streaming.grid import admit, append_new


def test_admission(spark):
    d = spark.createDataFrame([(1000, 1000), (1000, 6000), (1000, 6001), (None, 5), (0, 5)], "receipt_ms long, source_ms long")
    assert [r.refused for r in admit(d).collect()] == [None, None, "FUTURE_DATED", "INVALID_TIMESTAMP", "INVALID_TIMESTAMP"]


def test_append_new_is_idempotent(spark, tmp_path):
    write = append_new(str(tmp_path / "log"))
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    write(d, 0)
    write(d, 1)
    write(spark.createDataFrame([(3, "c")], "x int, y string"), 2)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3]


def test_replay_source_in_batch_and_as_stream(spark, tmp_path):
    path = tmp_path / "feed.jsonl"
    path.write_text("".join(json.dumps({"n": k}) + "\n" for k in range(25)))
    spark.dataSource.register(ReplaySource)
    batch = spark.read.format("jsonl_replay").option("path", str(path)).option("page", "10").load()
    assert batch.count() == 25
    q = spark.readStream.format("jsonl_replay").option("path", str(path)).option("page", "10").load().writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("replayed").collect()) == list(range(1, 26))


def test_late_event_does_not_turn_the_grid_back(spark, tmp_path):
    """A stream that is quiet while another moves the watermark, then gets an old event."""
    from pyspark.sql import functions as F

    from quillfin.model import LIVE
    from quillfin.streaming.grid import OUT, grid_stream

    schema = "market_id string, asset_id string, timestamp_ms long, sequence_id long, bid double, ask double, bid_size double, ask_size double, at_ms long"
    row = lambda m, ts, seq, at: (m, "UP", ts, seq, ts / 1e6, ts / 1e6 + 0.1, 1.0, 1.0, at)
    batches = [
        [row("a", 10_000, 1, 10_000), row("b", 10_000, 1, 10_000)],
        [row("b", 30_000, 2, 30_000)],
        [row("a", 9_500, 2, 30_500), row("b", 99_000, 9, 31_000)],  # old; and from the future, refused
        [row("a", 12_000, 3, 31_000), row("b", 60_000, 3, 60_000)],
        [row("b", 61_000, 4, 61_000)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    out = tmp_path / "out"
    for k in range(len(batches)):
        # one batch after the other through the same checkpoint
        target = tmp_path / "feed"
        target.mkdir(exist_ok=True)
        part = next((tmp_path / "in" / f"{k}").glob("*.parquet"))
        (target / f"{k}.parquet").write_bytes(part.read_bytes())
        stream = spark.readStream.schema(schema).parquet(str(target)).withColumn("at", F.timestamp_millis("at_ms"))
        grid_stream(stream, LIVE, "0 seconds").writeStream.format("parquet").outputMode("append").option("path", str(out)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(OUT).parquet(str(out)).collect()
    a = sorted((r.grid_timestamp_ms, r.source_timestamp_ms) for r in rows if r.market_id == "a")
    assert a == [(10_000, 10_000), (11_000, 10_000), (12_000, 12_000)]
    b = [(r.grid_timestamp_ms, r.source_timestamp_ms) for r in rows if r.market_id == "b"]
    assert b and all(s <= g for g, s in b) and max(s for _, s in b) < 99_000
