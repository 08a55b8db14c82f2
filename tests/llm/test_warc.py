"""Archives: exact round trip, revisits, and damage that is told."""

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from quillfin.llm import common, warc_zstd
from quillfin.llm.warc_zstd import WarcError

BIG, OTHER = "<p>é body</p>" * 200, "<p>other</p>" * 200
PAGES = [(1, "http://a/", BIG), (2, None, BIG), (3, "http://c d/\n", OTHER), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", BIG), (8, "u", BIG), (None, "u", OTHER), (9, "u", "x\r\n\r\ny" * 400)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, path string, records int").repartition(3)


def test_round_trip(spark, pages):
    manifest = warc_zstd.write_archives(pages, common.workspace(spark, "w"))
    rows = warc_zstd.read_archives(manifest, payloads=True).collect()
    key = lambda x: str(x)
    want = []
    for i, _, t in PAGES:
        raw = (t or "").encode()
        top = 8 if t == BIG else 3 if t == OTHER else i
        again = len(raw) >= 1000 and top is not None and (i is None or i < top)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert {r.url for r in rows} >= {"http://c%20d/%0A", "urn:none"}


def archive(dictionary=b"", n=3):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(write_checksum=True)
    body = (BIG + "tail").encode()
    digest = hashlib.sha1(body).hexdigest()
    return warc_zstd.dictionary_frame(dictionary) + b"".join(pack.compress(warc_zstd.record(k, "http://x/", body, digest, len(body), None)) for k in range(n))


@pytest.fixture(scope="module")
def dictionary():
    made = warc_zstd.train_dictionary([f"<html><p>page {k} of many, with words {k * 7919}</p>".encode() * 12 for k in range(300)], 8192)
    assert made
    return made


@pytest.mark.parametrize("chunk", [7, 100, 1 << 20])
def test_frames(dictionary, chunk):
    raw = archive(dictionary)
    got = list(warc_zstd.frames(io.BytesIO(raw), chunk))
    assert [warc_zstd.parse(r)["page_id"] for _, _, r in got] == [0, 1, 2]
    assert [a + n for a, n, _ in got] == [*[a for a, _, _ in got[1:]], len(raw)]
    packed = zstandard.ZstdCompressor().compress(dictionary)  # a dictionary may be compressed itself
    other = warc_zstd.dictionary_frame(packed) + raw[8 + len(dictionary) :]
    assert len(list(warc_zstd.frames(io.BytesIO(other), chunk))) == 3


def test_no_dictionary_and_skippable_frames():
    raw = archive(n=1) + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + archive(n=1)
    assert len(list(warc_zstd.frames(io.BytesIO(raw)))) == 2
    assert list(warc_zstd.frames(io.BytesIO(b""))) == []


def test_damage(dictionary):
    raw = archive(dictionary)
    flipped = bytearray(raw)
    flipped[-30] ^= 0x55
    for bad in (raw[:-5], raw[: len(dictionary) // 2], bytes(flipped), raw + b"junk", raw[8 + len(dictionary) :], b"junk" * 10):
        with pytest.raises(WarcError):
            list(warc_zstd.frames(io.BytesIO(bad)))


def test_record_checks():
    body, digest = b"hello", hashlib.sha1(b"hello").hexdigest()
    good = warc_zstd.record(1, "u", body, digest, 5, None)
    assert warc_zstd.parse(good)["payload"] == body
    for a, b in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"hello", b"hellO"), (b"WARC-Date:", b"WARC Date:"), (b"WARC-Type: response\r\n", b""), (b"\r\n\r\n", b"\r\n")):
        with pytest.raises(WarcError):
            warc_zstd.parse(good.replace(a, b))
    again = warc_zstd.record(1, "u", b"", digest, 5, 2)
    assert warc_zstd.parse(again)["refers_to"] == 2 and warc_zstd.parse(again)["payload_bytes"] == 5
    for bad in (again.replace(b"WARC-Profile", b"WARC-Portrait"), good.replace(b"response\r\nWARC-R", b"revisit\r\nWARC-R")):
        with pytest.raises(WarcError):  # a revisit names its profile and carries no payload
            warc_zstd.parse(bad)


def test_empty(spark):
    e = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zstd.read_archives(warc_zstd.write_archives(e, common.workspace(spark, "w"))).count() == 0


def test_a_task_an_archive(spark):
    many = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('<p>', id), 100) AS html")
    manifest = warc_zstd.write_archives(many.repartition(6), common.workspace(spark, "w"))
    files, before = manifest.count(), spark.conf.get("spark.sql.shuffle.partitions")
    assert files > 1
    spark.conf.set("spark.sql.shuffle.partitions", str(files))  # as many as there are archives
    try:
        per_task = warc_zstd.read_archives(manifest).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(per_task) == files and sum(r[1] for r in per_task) == 400
