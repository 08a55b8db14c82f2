"""Web archives (WARC 1.1) compressed with Zstandard and a shared dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every
record is a frame of its own, so records can be read alone. The reader loads the dictionary
from the leading frame, decodes frame by frame and checks each record's version line,
headers and lengths, and of responses the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, digest_tree

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


class WarcError(ValueError):
    """A file or record that is not what it has to be."""


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary of these samples; none (empty) if they are too few to learn from."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) < 20 * 1024 or len(samples) < 16:
        return b""
    size = max(4096, min(size, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or (refers_to given) a revisit with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    own = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(file, chunk: int = 1 << 20, largest: int = 1 << 31) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, record) of each frame of an open archive."""
    data, at, ended = b"", 0, False

    def more(least: int) -> bool:
        nonlocal data, ended
        while len(data) < least and not ended:
            new = file.read(max(chunk, least - len(data)))
            ended = not new
            data += new
        return len(data) >= least

    dictionary = None
    if more(8) and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        (n,) = struct.unpack_from("<I", data, 4)
        if not more(8 + n):
            raise WarcError("the dictionary frame is cut")
        raw = data[8 : 8 + n]
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", DICTIONARY):
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
        data, at = data[8 + n :], 8 + n
    opener = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while more(4):
        (magic,) = struct.unpack_from("<I", data)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames carry no record
            more(8)
            n = 8 + struct.unpack_from("<I", data, 4)[0]
            if not more(n):
                raise WarcError(f"at {at}: a skippable frame is cut")
            data, at = data[n:], at + n
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"at {at}: no frame starts here")
        more(18)
        declared = zstandard.get_frame_parameters(data[:18]).content_size
        if declared not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) and declared > largest:
            raise WarcError(f"at {at}: a record of {declared} bytes")
        one, parts, length = opener.decompressobj(), [], 0
        while True:
            length += len(data)
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"at {at}: {e}") from e
            if one.eof:
                break
            data = b""
            if not more(1):
                raise WarcError(f"at {at}: the last frame is cut")
        data = one.unused_data
        length -= len(data)
        body = b"".join(parts)
        if declared not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) and declared != len(body):
            raise WarcError(f"at {at}: {len(body)} bytes where the frame declares {declared}")
        yield at, length, body
        at += length
    if data:
        raise WarcError(f"at {at}: {len(data)} bytes after the last frame")


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, payload; checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            raise WarcError(f"no header: {line[:80]!r}")
        if name.lower() in fields:
            raise WarcError(f"{name} stands twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not re.fullmatch(r"\d+", fields["content-length"]) or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block is not as long as its header says")
    kind, block = fields["warc-type"], rest[:-4]
    if kind not in ("response", "revisit"):
        return {"record_type": kind, "block": block, "fields": fields}
    http, gap, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?mi)^content-length: *(\d+)\r?$", http)
    digest = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
    if not gap or not found or not digest:
        raise WarcError("HTTP headers or payload digest are not as they have to be")
    length, digest_hex = int(found[1]), base64.b32decode(digest[1]).hex()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest_hex):
        raise WarcError("the payload is not what its length and digest say")
    if kind == "revisit" and (payload or fields.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in fields):
        raise WarcError("a revisit has a profile, a target and no payload")

    def page(name: str) -> int | None:
        m = re.fullmatch(rf"<{_PAGE}(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    return {"page_id": page("warc-record-id"), "payload_bytes": length, "payload_digest": digest_hex, "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload, "url": fields.get("warc-target-uri")}


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, sample_pages: int = 500) -> DataFrame:
    """Archives of all pages; returns the manifest (path, records), staged.

    Of records with equal payloads of at least ``least_bytes``, that with the largest id is
    the response and the others are revisits of it; equality is decided by a tree-merge of
    digest runs. Rows that repeat an id and payload get the same kind of record: a response
    each, if theirs is the largest id. A row without an id revisits the one with the largest;
    where no row has an id, all are responses. An empty table gives no archive. Null
    payloads are empty, and records hold any number of bytes up to 2 GiB (readers refuse
    longer ones). The dictionary is trained on the first 20,000 characters of about
    ``sample_pages`` pages, chosen by a hash of their ids over the whole table, and of twice
    as many at most. Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    own = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("body"))
    own = own.withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    digests = own.where(F.octet_length("body") >= least_bytes).select(F.monotonically_increasing_id().alias("_uid"), "id", "sha1", F.octet_length("body").alias("bytes"), F.xxhash64("body").alias("check"))
    rows = common.stage(digest_tree.with_run(digests), f"{path}/digests")
    merged = digest_tree.merge_runs(rows, ["sha1", "bytes", "check"], "id", f"{path}/tree")
    again = merged.where((F.col("id") < F.col("_keep.id")) | F.col("id").isNull() & F.col("_keep.id").isNotNull()).select(F.col("id").alias("own"), F.col("sha1").alias("own_sha1"), F.col("_keep.id").alias("refers_to")).distinct()
    marked = own.join(again, F.col("id").eqNullSafe(F.col("own")) & (F.col("sha1") == F.col("own_sha1")), "left").select("id", "url", "body", "sha1", "refers_to")
    # pages of the whole table by a hash, twice as many at most as wanted
    share = min(1.0, sample_pages / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = chosen.select(F.substring("body", 1, 20_000).alias("body")).limit(2 * sample_pages).toArrow().column(0).to_pylist()
    trained = train_dictionary([s.encode() for s in sample])

    def write(batches):
        made = zstandard.ZstdCompressionDict(trained) if trained else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True) if made else zstandard.ZstdCompressor(level=3, write_checksum=True)
        count = 0

        def parts():
            nonlocal count
            yield dictionary_frame(trained)
            for b in source:
                for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                    id_, url, body, sha1, refers = row
                    raw = body.encode()
                    count += 1
                    yield packer.compress(record(id_, url, raw if refers is None else b"", sha1, len(raw), refers))

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        source = (b for some in ([first], batches) for b in some)
        uri = f"{path}/{uuid.uuid4().hex}.warc.zst"
        common.write_file(uri, parts())
        yield pa.RecordBatch.from_pylist([{"path": uri, "records": count}], schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return common.stage(marked.mapInArrow(write, "path string, records long"), f"{path}/manifest")


READ = T.StructType().add("page_id", "long").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "long")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per response or revisit of the archives in column ``path``, each checked.

    With ``payloads``, also url and payload (binary; null for revisits). A damaged file or
    record, or one above 2 GiB, stops the read with its path and offset.
    """
    spark = paths.sparkSession
    common.prepare(spark)
    schema = T.StructType([*READ.fields, T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())]) if payloads else READ
    names = schema.names
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())][: len(names)])

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = common.filesystem(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as file:
                    try:
                        for at, _, raw in frames(file):
                            got = parse(raw)
                            if "page_id" not in got:
                                continue
                            rows.append({k: got[k] for k in names} if got["record_type"] == "response" else {k: got[k] if k != "payload" else None for k in names})
                            size += len(raw) if payloads else 100
                            if size > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                                rows, size = [], 0
                    except WarcError as e:
                        raise WarcError(f"{uri}: {e}") from e
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = paths.select("path").distinct()
    # a number of its own keeps adaptive execution from putting all these tiny rows into one
    # task; by range, as a hash of the path would be taken for the exchange of distinct() and dropped
    return found.repartitionByRange(max(1, found.count()), "path").mapInArrow(read, schema)
