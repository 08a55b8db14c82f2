"""Splittable line numbers and book replay by segments against plain code over whole files."""

import json
import random
from collections import Counter, defaultdict

from conftest import SF
from pyspark.sql import functions as F

from quillfin.plans.replay_queries import raw_records
from quillfin.sources import jsonl


def test_line_numbers_of_split_files(spark, tmp_path):
    texts = {"a.jsonl": "".join(f"line {k} {'x' * (k % 97)}\r\n" if k % 3 else "\n" for k in range(4000)), "b.jsonl": "only", "c.jsonl": "", "d.jsonl": "\n\nlast"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = jsonl.lines(spark, str(tmp_path / "*.jsonl"))
        assert spark.read.text(str(tmp_path / "*.jsonl")).rdd.getNumPartitions() > 8
        got = sorted((r.source_file, r.source_line, r.value) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, k, line.removesuffix("\r")) for name, text in texts.items() if text for k, line in enumerate(text.removesuffix("\n").split("\n"), 1)]
    assert got == sorted(want)


def plain_replay(records):
    """The fold over whole files with dictionaries: (file, line, record, change) -> best quotes or None."""
    books, out = defaultdict(lambda: ({}, {})), {}
    for r in sorted(records, key=lambda r: (r["source_file"], r["source_line"], r["source_record_idx"])):
        e = json.loads(r["event"])
        changes = [e] if e["event_type"] == "book" else e["price_changes"]
        for k, c in enumerate(changes):
            bids, asks = books[r["source_file"], c["asset_id"]]
            if e["event_type"] == "book":
                for side, levels in ((bids, e["bids"]), (asks, e["asks"])):
                    side.clear()
                    side.update({float(x["price"]): float(x["size"]) for x in levels if float(x["size"]) > 0})
            elif float(c["size"]) <= 0:
                (bids if c["side"] == "BUY" else asks).pop(float(c["price"]), None)
            else:
                (bids if c["side"] == "BUY" else asks)[float(c["price"])] = float(c["size"])
            if bids and asks and max(bids) < min(asks):
                b, a = max(bids), min(asks)
                out[r["source_file"], r["source_line"], k] = (b, a, bids[b], asks[a])
            else:
                out[r["source_file"], r["source_line"], k] = None
    return out


def test_segments_replay_as_whole_files_do(spark):
    records = raw_records(spark, SF).cache()
    want = plain_replay([r.asDict() for r in records.collect()])
    got = jsonl.normalize(records, line_block=40).collect()
    seen = {(r.source_file, r.source_line, r.change_idx): None if r.reject_reason else (r.bid, r.ask, r.bid_size, r.ask_size) for r in got}
    assert len(seen) == len(got) and seen == want and sum(v is not None for v in want.values()) > 50
    cuts = jsonl.segments(records, 40).groupBy("source_file", "route", "segment").count()
    assert cuts.count() > 30  # tasks share a file
    reasons = Counter(r.reject_reason for r in got)
    assert set(reasons) <= {None, "CROSSED_BOOK", "MISSING_PRICE"}
    kept = jsonl.canonical(jsonl.normalize(records)).count()
    assert kept == reasons[None] - sum(n - 1 for n in Counter((r.source_file, r.market_id, r.asset_id, r.timestamp_ms, r.sequence_id) for r in got if not r.reject_reason).values())


def test_segments_of_odd_records(spark):
    book = lambda asset, bid, ask: {"event_type": "book", "market": "m", "timestamp": "1700000000000", "bids": [{"price": bid, "size": "5"}], "asks": [{"price": ask, "size": "6"}]} | ({} if asset is ... else {"asset_id": asset})
    change = lambda *cs: {"event_type": "price_change", "market": "m", "timestamp": "1700000000001", "price_changes": [dict(zip(("asset_id", "price", "size", "side"), c)) for c in cs]}
    rows = [
        ("f", 1, None, None, 0, book("A", "0.2", "0.4")),
        ("f", 2, "A", None, 0, book(None, "0.1", "0.9")),  # a null id is no id, whatever stands outside
        ("f", 3, None, None, 0, change(("A", "0.3", "2", "BUY"), ("B", "0.3", "2", "BUY"), (None, "0.3", "2", "BUY"))),
        ("f", 4, "B", None, 0, book(..., "0.5", "0.6")),
        ("f", 5, None, None, 0, change()),
        ("f", 6, None, None, 0, change(("B", "0.55", "1", "SELL"), ("A", "x", "1", "SELL"))),
        ("f", 7, None, "EMPTY_RECORD", 0, None),
    ]
    schema = "source_file string, source_line long, outer_asset_id string, problem string, source_record_idx long, event string"
    frame = spark.createDataFrame([(*r[:5], None if r[5] is None else json.dumps(r[5])) for r in rows], schema)
    for block in (1, 1000):
        got = jsonl.normalize(frame, line_block=block).orderBy("source_line", "change_idx").collect()
        assert [(r.source_line, r.change_idx, r.asset_id, r.bid, r.ask, r.reject_reason) for r in got] == [
            (1, 0, "A", 0.2, 0.4, None), (2, 0, None, None, None, "MISSING_ASSET_ID"), (3, 0, "A", 0.3, 0.4, None), (3, 1, None, None, None, "MISSING_PRICE"),
            (3, 2, None, None, None, "MISSING_ASSET_ID"), (4, 0, "B", 0.5, 0.6, None), (5, 0, None, None, None, "NON_QUOTE_EVENT"), (6, 0, "B", 0.5, 0.55, None),
            (6, 1, None, None, None, "INVALID_PRICE"), (7, 0, None, None, None, "EMPTY_RECORD"),
        ]


def test_numbered_over_blocks(spark):
    from quillfin.operators.running import numbered

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), k) for k in range(500)]
    d = spark.createDataFrame(rows, "g string, t long, k long")
    got = {r.k: r.n for r in numbered(d, ["g"], ["t", "k"], F.floor(F.col("t") / 7)).collect()}
    key = lambda t, k: (t is not None, t or 0, k)
    assert got == {k: 1 + sum(g2 == g and key(t2, k2) < key(t, k) for g2, t2, k2 in rows) for g, t, k in rows}


def test_folds_run_on_over_batches_of_rows(spark):
    """Books are kept from one batch of sorted rows to the next and no segment is a group of its own."""
    from quillfin.plans.replay_queries import raw_records

    raw = raw_records(spark, SF)
    whole = sorted(map(str, jsonl.normalize(raw).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, jsonl.normalize(raw).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in jsonl.normalize(raw)._jdf.queryExecution().toString()
