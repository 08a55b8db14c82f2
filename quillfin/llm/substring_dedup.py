"""Repeated passages, found by difference-cover anchors.

A window is ``window`` consecutive words. Anchors are shorter runs of words, hashed only
where the position modulo PERIOD lies in a difference cover: for any two positions i and j
some d < PERIOD puts both i + d and j + d in the cover, so two equal windows, wherever they
start, share an anchor of window - PERIOD + 1 words at equal offsets. Only windows around a
repeated anchor can be repeated; these are extended to whole windows, hashed (96 bits), and
counted exactly.

Hashes travel as packed, sorted, distinct arrays: a task sends one message a bucket, and a
bucket answers which hashes stand elsewhere too. A passage in a third of all documents is
one entry a message, and no pair of occurrences is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_hashes import hash_words_twice, run_hashes, split_words

#: Fixed value: a perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Hashes a task gathers before it sends them on; bounds its memory.
FLUSH = 1_500_000

MESSAGE = T.StructType().add("bucket", "integer").add("batch", "long").add("once", "binary").add("often", "binary")
_MESSAGE_PA = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("once", pa.binary()), ("often", pa.binary())])
REPLY = T.StructType().add("batch", "long").add("hashes", "binary")
_REPLY_PA = pa.schema([("batch", pa.int64()), ("hashes", pa.binary())])


#: Hash records are a 64-bit part and, for whole windows, a 32-bit part (else empty).
Record = tuple[np.ndarray, np.ndarray]


def _pack(h: np.ndarray, g: np.ndarray) -> bytes:
    return h.tobytes() + g.tobytes()


def _unpack(raw: bytes, wide: bool) -> Record:
    n = len(raw) // (12 if wide else 8)
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n if wide else 0, 8 * n)


def _order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """An order in which equal records are neighbours."""
    order = np.argsort(h)
    if len(g):
        same = h[order[1:]] == h[order[:-1]]
        if (same & (g[order[1:]] != g[order[:-1]])).any():  # one 64-bit hash of two windows
            order = np.lexsort((g, h))
    return order


def _equal_to_last(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    same = h[1:] == h[:-1]
    return same & (g[1:] == g[:-1]) if len(g) else same


class _Outbox:
    """Gathers hash records of one batch and packs them by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, record: Record) -> None:
        self.parts.append(record)
        self.size += len(record[0])

    def flush(self, batch: int) -> pa.RecordBatch:
        h, g = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = _order(h, g) if len(g) else None
        h, g = (h[order], g[order]) if len(g) else (np.sort(h), g)
        first = np.flatnonzero(np.concatenate(([True], ~_equal_to_last(h, g))))
        often = np.diff(np.append(first, len(h))) > 1
        h, g = h[first], g[first] if len(g) else g
        # buckets are ranges of the hash, so a message is a slice of the sorted array
        edge = np.array([(k << 64) // self.buckets for k in range(1, self.buckets)], np.uint64)
        cuts = [0, *np.searchsorted(h, edge).tolist(), len(h)]
        rows = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                o, hs, gs = often[a:b], h[a:b], g[a:b]
                rows.append((k, _pack(hs[~o], gs[~o] if len(g) else gs), _pack(hs[o], gs[o] if len(g) else gs)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            schema=_MESSAGE_PA,
        )


def _answers(wide: bool):
    """Per bucket: to each batch the hash records of its own that stand elsewhere too."""

    def reduce(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_pylist()
        once = [_unpack(x.as_py(), wide) for x in table.column("once")]
        often = [_unpack(x.as_py(), wide) for x in table.column("often")]
        h, g = (np.concatenate(x) for x in zip(*once, *often, *often))  # what a batch has twice counts twice
        owner = np.concatenate([np.full(len(x[0]), b, np.int64) for x, b in zip([*once, *often, *often], batches * 3)])
        order = _order(h, g)
        h, g, owner = h[order], g[order] if wide else g, owner[order]
        same = _equal_to_last(h, g)
        repeated = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        # records that a batch has twice stand next to each other, once is enough
        first = np.concatenate(([True], ~(same & (owner[1:] == owner[:-1]))))
        h, g, owner = h[repeated & first], g[repeated & first] if wide else g, owner[repeated & first]
        order = np.argsort(owner, kind="stable")
        h, g, owner = h[order], g[order] if wide else g, owner[order]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(owner))
        return pa.table(
            [pa.array(owner[cuts], pa.int64()), pa.array([_pack(h[a:b], g[a:b] if wide else g) for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary())], schema=_REPLY_PA
        )

    return reduce


def _exchange(messages: DataFrame, wide: bool, path: str) -> str:
    """Messages to buckets, answers to batches: stored as a folder a batch."""
    answers = messages.groupBy("bucket").applyInArrow(_answers(wide), REPLY)
    answers.repartition("batch").write.partitionBy("batch").option("compression", "none").parquet(path)
    return path


def _load(path: str, batch: int, wide: bool) -> Record:
    """The records answered to a batch, in ascending order."""
    fs, root = common.filesystem(f"{path}/batch={batch}")
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    parts = [_unpack(x.as_py(), wide) for f in found if f.base_name.endswith(".parquet") for x in pq.read_table(f.path, filesystem=fs, columns=["hashes"]).column(0)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    h, g = (np.concatenate(x) for x in zip(*parts))
    if not wide:
        return np.sort(h), g
    order = np.lexsort((g, h))
    return h[order], g[order]


def _among(known: Record, values: Record) -> np.ndarray:
    """Which of ``values`` stand in the sorted ``known``; both parts must agree where there are two."""
    (h, g), (x, y) = known, values
    if not len(h):
        return np.zeros(len(x), bool)
    at = np.searchsorted(h, x)
    inside = at < len(h)
    found = np.zeros(len(x), bool)
    todo = np.flatnonzero(inside)
    todo = todo[h[at[todo]] == x[todo]]
    if not len(g):
        found[todo] = True
        return found
    while len(todo):  # more than one turn only where windows share their first part
        same = g[at[todo]] == y[todo]
        found[todo[same]] = True
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < len(h)]
        todo = todo[h[at[todo]] == x[todo]]
    return found


#: The second part of records that have none.
_NONE = np.empty(0, np.uint32)


class _Batch:
    """Word hashes of some texts, and the windows and anchors among them."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [split_words(t) for t in texts]
        self.h, self.second, self.starts = hash_words_twice(self.words)
        self.window, self.anchor = window, window - PERIOD + 1
        n = len(self.h)
        lengths = np.diff(self.starts)
        self.pos = np.arange(n) - np.repeat(self.starts[:-1], lengths)
        self.left = np.repeat(lengths, lengths) - self.pos  # words from here to the text's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of runs at cover positions that lie in some window."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        ok = cover[self.pos % PERIOD] & (self.left >= self.anchor) & (self.pos + self.left >= self.window)
        at = np.flatnonzero(ok)
        return at, run_hashes(self.h, self.anchor)[at] if len(at) else np.empty(0, np.uint64)

    def candidates(self, known: Record) -> np.ndarray:
        """Window starts with a repeated anchor within their first PERIOD positions."""
        at, hashes = self.anchors()
        if not len(at):
            return at
        n = len(self.h)
        total = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(at[_among(known, (hashes, _NONE))], minlength=n), out=total[1:])
        starts = np.flatnonzero(self.left >= self.window)
        return starts[total[np.minimum(starts + PERIOD, n)] > total[starts]]

    def windows(self, at: np.ndarray) -> Record:
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        return run_hashes(self.h, self.window)[at], (run_hashes(self.second, self.window)[at] >> np.uint64(32)).astype(np.uint32)


def _runs(batch_col: pa.Array):
    """(value, first, end) of neighbouring rows of one batch."""
    v = batch_col.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
    return [(int(v[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


RESULT = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False, bucket_hashes: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text): words covered by a
    window that also starts anywhere else go.

    Words are runs without ASCII white space, unchanged; null texts have none. Windows are
    judged on the input. Texts shorter than a window keep all. Repeated rows are texts like
    any other, so they remove each other's windows; ids may be null; an empty table gives an
    empty result; other columns are not read. Exact but for collisions of 96-bit hashes of
    windows, made of two independent hashes of each word.
    """
    if window < 2 * PERIOD:
        raise ValueError(f"windows of less than {2 * PERIOD} words need a cover of a smaller period")
    spark = docs.sparkSession
    common.prepare(spark)
    path = common.workspace(spark, "substring-dedup")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = common.stage(own.withColumn("batch", F.spark_partition_id().cast("long")), f"{path}/docs")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / 6 * len(COVER) / PERIOD / bucket_hashes) + 1)

    def send(records):
        """Per task: the hash records of its texts, packed; records(batch, texts) gives them."""

        def run(batches):
            out, now = _Outbox(buckets), None
            for b in batches:
                texts = b.column("text").cast(pa.binary())
                for batch, first, end in _runs(b.column("batch")):
                    if now is not None and batch != now and out.size:
                        yield out.flush(now)
                    now = batch
                    for part in _parts(texts[first:end].to_pylist()):
                        out.add(records(batch, part))
                        if out.size >= FLUSH:
                            yield out.flush(now)
            if out.size:
                yield out.flush(now)

        return run

    def anchor_records(batch, texts):
        return _Batch(texts, window).anchors()[1], np.empty(0, np.uint32)

    first = _exchange(rows.select("batch", "text").mapInArrow(send(anchor_records), MESSAGE), False, f"{path}/anchors")
    anchors_of = _Loader(first, False)

    def window_records(batch, texts):
        b = _Batch(texts, window)
        return b.windows(b.candidates(anchors_of(batch)))

    second = _exchange(rows.select("batch", "text").mapInArrow(send(window_records), MESSAGE), True, f"{path}/windows")
    windows_of = _Loader(second, True)

    def remove(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for batch, first_row, end in _runs(b.column("batch")):
                at_row = first_row
                for part in _parts(texts[first_row:end].to_pylist()):
                    own = _Batch(part, window)
                    at = own.candidates(anchors_of(batch))
                    at = at[_among(windows_of(batch), own.windows(at))]
                    edge = np.zeros(len(own.h) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    lost = np.add.reduceat(np.append(gone, False), own.starts[:-1]) * (np.diff(own.starts) > 0)
                    kept = []
                    for words, a, n in zip(own.words, own.starts.tolist(), lost.tolist()):
                        kept.append(b" ".join([w for w, g in zip(words, gone[a : a + len(words)].tolist()) if not g] if n else words))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("doc_id")[at_row : at_row + len(part)],
                            pa.array([len(w) for w in own.words], pa.int64()),
                            pa.array(lost, pa.int64()),
                            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                            pa.array(kept if with_text else [None] * len(kept), pa.binary()).cast(pa.string()),
                        ],
                        names=RESULT.names,
                    )
                    at_row += len(part)

    result = rows.mapInArrow(remove, RESULT)
    return result if with_text else result.drop("kept_text")


def _parts(texts: list[bytes], most: int = 2 << 20):
    """Neighbouring texts of some megabytes together (one longer text alone)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class _Loader:
    """The answers to one batch, kept until another is asked for."""

    def __init__(self, path: str, wide: bool):
        self.path, self.wide, self.batch, self.value = path, wide, None, None

    def __call__(self, batch: int) -> Record:
        if batch != self.batch:
            self.batch, self.value = batch, _load(self.path, batch, self.wide)
        return self.value
