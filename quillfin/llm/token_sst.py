"""Token ids as sorted-string-table shards.

A shard holds documents in ascending order of their key (the id as 8 big-endian bytes, sign
bit flipped, so that byte order is number order; a document without id has the empty key,
which sorts first). Layout, all numbers little-endian:

    data blocks      zlib or zstd frames of entries; an entry is
                     shared u8 | unshared u8 | ids u32 | key suffix | ids (u16 or u32 each)
                     where ``shared`` bytes of the key repeat the entry before
    index block      per data block: last key (8) | its length u8 | offset u64 |
                     stored length u32 | entries u32 | ids in it u64
    Bloom filter     bits of all keys, HASHES probes
    footer (72)      index offset, length | bloom offset, length | documents | ids (u64 each) |
                     id width u32 | Bloom probes u32 | reserved u64 | magic

A lookup reads the footer, asks the Bloom filter, finds the block by binary search in the
sparse index and reads that block alone.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .lib_tokens import chunk_encoder

MAGIC = b"QFSST002"
FOOTER = struct.Struct("<6Q2IQ8s")
INDEX = struct.Struct("<8sBQIIQ")
ENTRY = struct.Struct("<BBI")
BLOOM_BITS, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if not key else int.from_bytes(key, "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [((a + i * b) & ((1 << 64) - 1)) % bits for i in range(HASHES)]


def shard_bytes(entries: Iterable[tuple[int | None, bytes]], width: int, block_bytes: int = 256 << 10, meta: dict | None = None) -> Iterator[bytes]:
    """The shard of (id, id array) pairs in ascending order of id, chunk by chunk.

    Only the current block, the sparse index and the keys' hashes are held. meta gets
    documents and ids.
    """
    pack, at, index, keys = zstandard.ZstdCompressor(level=1), 0, [], []
    block, size, count, ids, last, docs, total = [], 0, 0, 0, b"", 0, 0

    def flush() -> bytes:
        nonlocal at, size, count, ids, last
        raw = pack.compress(b"".join(block))
        index.append(INDEX.pack(last, len(last), at, len(raw), count, ids))
        at += len(raw)
        block.clear()
        size, count, ids = 0, 0, 0
        return raw

    before = b""
    for doc_id, body in entries:
        key = key_of(doc_id)
        if last > key:
            raise ValueError("keys must ascend")
        shared = 0
        while count and shared < min(len(key), len(before)) and key[shared] == before[shared]:
            shared += 1
        n = len(body) // width
        block += [ENTRY.pack(shared, len(key) - shared, n), key[shared:], body]
        keys.append(doc_id)
        before = last = key
        size, count, ids, docs, total = size + len(body) + 16, count + 1, ids + n, docs + 1, total + n
        if size >= block_bytes:
            yield flush()
    if count:
        yield flush()
    table, index_at = b"".join(index), at
    yield table
    bits = max(64, BLOOM_BITS * len(keys) + 7 & ~7)
    bloom = bytearray(bits // 8)
    for doc_id in keys:
        for p in _probes(key_of(doc_id), bits):
            bloom[p >> 3] |= 1 << (p & 7)
    yield bytes(bloom)
    yield FOOTER.pack(index_at, len(table), index_at + len(table), len(bloom), docs, total, width, HASHES, zlib.crc32(table), MAGIC)
    if meta is not None:
        meta.update(documents=docs, ids=total)


class Shard:
    """Reader of one shard; holds footer, sparse index and Bloom filter."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{uri}: too short for a shard")
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        at, length, bloom_at, bloom_length, self.documents, self.ids, self.width, _, crc, _ = foot
        table = self.file.read_at(length, at)
        if zlib.crc32(table) != crc:
            raise ValueError(f"{uri}: damaged index")
        self.index = [INDEX.unpack_from(table, i) for i in range(0, length, INDEX.size)]
        self.last = [x[0][: x[1]] for x in self.index]
        self.bloom = self.file.read_at(bloom_length, bloom_at)
        self.unpack = zstandard.ZstdDecompressor()
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, _, at, length, count, ids = self.index[k]
        raw = self.unpack.decompress(self.file.read_at(length, at), max_output_size=count * 14 + ids * self.width)
        pos, key = 0, b""
        for _ in range(count):
            shared, rest, n = ENTRY.unpack_from(raw, pos)
            pos += ENTRY.size
            key = key[:shared] + raw[pos : pos + rest]
            pos += rest
            yield key, np.frombuffer(raw, self.dtype, n, pos)
            pos += n * self.width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of all entries with this key (none: an empty list)."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] & (1 << (p & 7)) for p in _probes(key, bits)):
            return []
        found = []
        for k in range(bisect.bisect_left(self.last, key), len(self.index)):
            entries = list(self.block(k))
            found += [ids for x, ids in entries if x == key]
            if entries and entries[-1][0] > key:
                break
        return found


WRITTEN = T.StructType().add("part", "integer").add("file", "integer").add("path", "string").add("first_id", "long").add("last_id", "long").add("documents", "long").add("ids", "long")
#: Bounds between shards that a lookup holds in memory at most.
BOUNDS = 100_000
#: Shards whose counts are summed up as one when starts are found.
BLOCK_PARTS = 1000


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_bytes: int = 64 << 20, task_bytes: int = 4 << 20
) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write shards in ascending order of id.

    Returns the manifest (part, file, path, first_id, last_id, documents, ids), staged: a row
    a shard, in the order of part and file. Documents are dealt by ranges of id, and of a
    hash of the text where an id repeats. The number of ranges follows from the bytes of all
    texts: as many as hold ``file_bytes`` each, and on small tables as many as there are
    shuffle partitions while they hold ``task_bytes``; a range with long texts starts a new
    file at each ``file_bytes``. Null texts count as empty. Rows without id come first, under
    the empty key; rows that repeat an id are entries of their own. An empty table gives no
    shard. Each task streams its sorted rows into its files, written under a temporary name
    and moved, so a retry leaves no half shard.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes)))
    dealt = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")

    def write(batches):
        part = TaskContext.get().partitionId()
        encoder = chunk_encoder(tokenizer_path)
        width = encoder.dtype.itemsize
        end = np.asarray([end_id], encoder.dtype).tobytes()

        def entries():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), (x + end for x in encoder.encode_batch(b.column(1).cast(pa.binary()).to_pylist())))

        source, files = entries(), 0
        head = next(source, None)
        while head is not None:
            meta: dict = {"part": part, "file": files, "path": f"{path}/{part:08d}-{files:06d}.sst", "first_id": head[0]}

            def of_file(head=head, meta=meta):
                done = 0
                while head is not None and done < file_bytes:
                    yield head
                    done += len(head[1])
                    meta["last_id"] = head[0]
                    head = next(source, None)
                meta["next"] = head

            common.write_file(meta["path"], shard_bytes(of_file(), width, meta=meta))
            head = meta.pop("next")
            files += 1
            yield pa.RecordBatch.from_pylist([meta], schema=_WRITTEN_PA)

    return common.stage(dealt.mapInArrow(write, WRITTEN), f"{path}/manifest")


_WRITTEN_PA = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
READ = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest and ``start``: how many ids all shards before hold (a two-level running sum)."""
    block = F.floor(F.col("part") / BLOCK_PARTS)
    blocks = manifest.groupBy(block.alias("block")).agg(F.sum("ids").alias("own"))
    # a row for BLOCK_PARTS ranges of documents
    before = blocks.select("block", (F.sum("own").over(Window.orderBy("block")) - F.col("own")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("block").orderBy("part", "file")) - F.col("ids")
    return manifest.withColumn("block", block).join(before, "block").withColumn("start", F.col("before") + inside).drop("block", "before")


def _opened(batches, columns: list[str], each):
    """Record batches of what ``each(shard, row)`` yields, about 10,000 rows at a time."""
    out: list[list] = [[] for _ in columns]
    for b in batches:
        for row in b.to_pylist():
            for values in each(row):
                for col, v in zip(out, values):
                    col.append(v)
                if len(out[0]) >= 10_000:
                    yield out
                    out = [[] for _ in columns]
    yield out


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32 (over u32 ids)."""
    spark = manifest.sparkSession
    shards = manifest.count()
    if not shards:
        return spark.createDataFrame([], READ)

    def scan(row):
        at = row["start"]
        for doc_id, ids in Shard(row["path"]):
            yield doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
            at += len(ids)

    def read(batches):
        for cols in _opened(batches, READ.names, scan):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=READ.names)

    table = with_starts(manifest).select("path", "start").repartition(shards, "path")
    return table.mapInArrow(read, READ)


FOUND = T.StructType().add("doc_id", "long").add("ids", T.ArrayType(T.LongType()))


def lookup(manifest: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents whose ids are in ``wanted``: a row an entry, so a
    repeated id gives several and an id that no shard has gives none. Null ids are not asked for.

    Ids meet the shards whose range covers them by an equality join on stretches of the
    shards' order, bounded by the first ids of at most BOUNDS of them. A shard asks its Bloom
    filter, then finds the block by binary search and reads that block alone.
    """
    spark = manifest.sparkSession
    common.prepare(spark)
    keyed = manifest.where(F.col("last_id").isNotNull()).withColumn("first_id", F.coalesce("first_id", F.lit(-(1 << 63))))
    every = -(-((keyed.agg(F.max("part")).first()[0] or 0) + 1) // BOUNDS)
    bounds = np.sort(np.array([r[0] for r in keyed.where((F.col("part") % every == 0) & (F.col("file") == 0)).select("first_id").collect()], np.int64))  # BOUNDS at most

    @F.pandas_udf("long")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    ends = keyed.select("path", "first_id", "last_id", stretch("first_id").alias("a"), stretch("last_id").alias("b"))
    ranges = ends.select("path", "first_id", "last_id", F.explode(F.sequence("a", "b")).alias("stretch"))
    asked = wanted.select(wanted[id_col].cast("long").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("stretch", stretch("id"))
    met = asked.join(ranges, "stretch").where(F.col("id").between(F.col("first_id"), F.col("last_id"))).select("path", "id")

    def find(batches):
        now: dict = {"path": None, "shard": None}

        def ask(row):
            if row["path"] != now["path"]:
                now.update(path=row["path"], shard=Shard(row["path"]))
            for ids in now["shard"].get(row["id"]):
                yield row["id"], ids.tolist()

        for cols in _opened(batches, FOUND.names, ask):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64()))], names=FOUND.names)

    return met.repartition("path").sortWithinPartitions("path", "id").mapInArrow(find, FOUND)
