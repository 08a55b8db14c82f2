"""How two tokenizers cut the same texts: groups, links, and how often ids are linked.

Each text is encoded by a byte-level BPE (A) and a sentence-piece model (B); byte offsets at
which tokens of both end cut the text into groups, and tokens whose bytes overlap are linked.

Links are counted outside memory. A task gathers records (pair of ids, document, links) up to
RUN_RECORDS, sorts them side-major (by B's id, then A's, then document) and writes them as a run
of zstd blobs, one for each radix of B's id. Radixes are dealt into parts of runs, so a pair
that holds any share of all links is counted in many parts. A part's runs go through a k-way heap
merge that counts each pair; parts' counts are summed, and in side-major order each B id gets its
highest count. The counts of a radix then pass by its runs once more, and what each link's
count gives its document streams back, run by run.

Chunks of a text (white space and what follows it) are cut alike wherever they stand, so
each distinct one is encoded and aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

#: Radixes of B's id; records and documents of a run at most; records a part aims at.
RADIX, RUN_RECORDS, RUN_DOCS, PART_RECORDS = 8, 2_000_000, 1 << 16, 8_000_000
#: Keys that a run in a merge holds decoded.
BLOCK_KEYS = 1 << 15
#: Remembered chunks and their links at most.
MEMO_CHUNKS, MEMO_LINKS = 400_000, 6_000_000

#: Chunks: white space and what follows it, or plain letters before punctuation (pieces of B
#: may hold a carriage return inside).
_CHUNK = re.compile(r"[ \t\n\x0b\x0c]*+(?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[ \t\n\x0b\x0c!-/:-@\[-`{-~]|\Z)|[^ \t\n\x0b\x0c]+)|[ \t\n\x0b\x0c]+")
#: What makes texts be cut whole: white space beyond ASCII, controls, B's own space mark.
_WHOLE = re.compile("[\r\u2581\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Pieces:
    """B: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        # chunks are independent if no piece goes on across the start of one
        space, letter, mark = set("▁ \t\n\x0b\x0c"), re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][!-/:-@\\[-`{-~]"), range(self.size)
        self.chunks = not any(not self.model.is_byte(i) and (any(a not in space and b in space for a, b in zip(names[i], names[i][1:])) or letter.search(names[i])) for i in mark if not self.model.is_control(i) and not self.model.is_unknown(i))
        self.lead = self.model.encode("a")

    def of_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that follow a text's first space or its other chunks."""
        plain = self.model.encode([c[1:] if c[0] == " " else "a" + c for c in chunks], num_threads=1)
        n = len(self.lead)
        # a chunk that is one space has no text of its own left
        return [self.model.encode("a ", num_threads=1)[n:] if c == " " else ids if c[0] == " " else ids[n:] for c, ids in zip(chunks, plain)]


class Flat:
    """Growing rows of numbers of different lengths."""

    def __init__(self):
        self.values, self.starts, self.sizes, self.used, self.rows = np.zeros(1024, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), 0, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), np.int64)))

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = self._room(self.values, self.used + len(values))
        self.starts, self.sizes = (self._room(x, self.rows + len(sizes)) for x in (self.starts, self.sizes))
        self.values[self.used : self.used + len(values)] = values
        self.starts[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.rows : self.rows + len(sizes)] = sizes
        self.used, self.rows = self.used + len(values), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        return self.values[np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _counted(at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, minlength=n).astype(np.int64)


class Aligner:
    """Aligned chunks: counts (A, B, groups), groups as text, links (b * size of A + a)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = bpe.vocabulary(a_path), Pieces(b_path)
        self.length_a, self.length_b = (np.array([len(x) for x in of], np.int64) for of in (self.a.token_bytes, self.b.bytes))
        tables = [[f"{i}{mark}" for i in range(n)] for n, mark in ((self.a.size, ","), (self.a.size, "|"), (self.b.size, ","), (self.b.size, ";"))]
        self.a_inner, self.a_last, self.b_inner, self.b_last = (np.array(t, object) for t in tables)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.groups: list[str] = []
        self.keys, self.counts = Flat(), Flat()

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        split = [[t] if (x := t[1:] if t[:1] == " " else t).isascii() and x.isalpha() else bpe._SPLIT.findall(t) for t in texts]
        words = list({w for s in split for w in s})
        ids = dict(zip(words, (np.frombuffer(x, self.a.dtype).tolist() for x in self.a.merge([w.encode() for w in words]))))
        return [ids[s[0]] if len(s) == 1 else [i for w in s for i in ids[w]] for s in split]

    def _add(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[int]:
        """The numbers of texts (their first space included); -1 where bytes differ.

        The texts that agree stand one behind the other as one text: an end of either
        tokenizer ends a link, and an end of both ends a group.
        """
        ta, tb = self.a.token_bytes, self.b.bytes
        same = [b"".join([ta[i] for i in x]) == (raw := t.encode()) and b"".join([tb[i] for i in y]) == raw for t, x, y in zip(texts, a, b)]
        a, b = [x for x, s in zip(a, same) if s], [y for y, s in zip(b, same) if s]
        n, first = len(a), len(self.groups)
        numbers = iter(range(first, first + n))
        if n:
            na, nb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
            fa, fb = (np.fromiter((i for own in x for i in own), np.int64) for x in (a, b))
            ends_a, ends_b = np.cumsum(self.length_a[fa]), np.cumsum(self.length_b[fb])
            ends = np.union1d(ends_a, ends_b)
            left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
            own = np.repeat(np.arange(n), na)[left]
            both = np.intersect1d(ends_a, ends_b, assume_unique=True)
            last_a, last_b = np.zeros(len(fa), bool), np.zeros(len(fb), bool)
            last_a[np.searchsorted(ends_a, both)] = last_b[np.searchsorted(ends_b, both)] = True
            # A's tokens of a group, then B's, as text
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            text = np.concatenate((np.where(last_a, self.a_last[fa], self.a_inner[fa]), np.where(last_b, self.b_last[fb], self.b_inner[fb])))
            order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
            text, cuts = text[order].tolist(), np.cumsum(na + nb).tolist()
            self.groups += ["".join(text[i:j])[:-1] for i, j in zip([0, *cuts], cuts)]
            n_groups = _counted(np.repeat(np.arange(n), na)[last_a], n)
            self.keys.extend(fb[right] * self.a.size + fa[left], _counted(own, n))
            self.counts.extend(np.column_stack((na, nb, n_groups)).ravel(), np.full(n, 3))
        return [next(numbers) if s else -1 for s in same]

    def align(self, texts: list[str | None]) -> list[list[int]]:
        """Per text the numbers of its chunks; no numbers for texts without tokens."""
        if len(self.groups) > MEMO_CHUNKS or self.keys.used > MEMO_LINKS:
            self.forget()
        memo = self.memo
        chunks = [None if not t or not self.b.chunks or _WHOLE.search(t) else _CHUNK.findall(" " + t) for t in texts]
        new = list({c for own in chunks if own for c in own if c not in memo})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, self._add(part, self._a_ids(part), self.b.of_chunks(part))))
        out = []
        for t, own in zip(texts, chunks):
            numbers = [memo[c] for c in own] if own else None
            if t and (numbers is None or -1 in numbers):
                number = self._add([" " + t], self._a_ids([" " + t]), [self.b.model.encode(t, num_threads=1)])[0]
                numbers = [number] if number >= 0 else []
            out.append(numbers or [])
        return out


_worker: dict[tuple[str, str], Aligner] = {}
common.memo("align", _worker.clear)


def _aligner(a_path: str, b_path: str) -> Aligner:
    common.using("align")
    if (a_path, b_path) not in _worker:
        _worker[a_path, b_path] = Aligner(a_path, b_path)
    return _worker[a_path, b_path]


# ---- runs -----------------------------------------------------------------------------


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays in one zstd frame each, their sizes before them."""
    frames = [zstandard.compress(np.ascontiguousarray(a).tobytes(), 1) for a in arrays]
    return struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def _unzip(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}I", raw)
    at, out = 4 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(zstandard.decompress(raw[at : at + size]), kind))
        at += size
    return out


def _sorted_run(keys: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Records sorted by (key, document) as a summary (keys, links) and what remains to be
    known (documents a key, documents, links)."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    own = keys[new]
    deltas = np.diff(own, prepend=0)
    totals = np.add.reduceat(n, new)
    return _zip(deltas.astype("<i8"), totals.astype("<i8")), _zip(np.diff(np.append(new, len(keys))).astype("<u4"), docs.astype("<u2"), n.astype("<u4"))


class Run:
    """A run's summary, decoded block by block."""

    def __init__(self, raw: bytes):
        a, b = struct.unpack_from("<2I", raw)
        self._keys = zstandard.ZstdDecompressor().stream_reader(raw[8 : 8 + a])
        self._totals = zstandard.ZstdDecompressor().stream_reader(raw[8 + a : 8 + a + b])
        self._last = 0
        self.more()

    @staticmethod
    def _read(stream, size: int) -> bytes:
        parts, got = [], 0
        while got < size and (x := stream.read(size - got)):
            parts.append(x)
            got += len(x)
        return b"".join(parts)

    def more(self) -> bool:
        self.keys = np.cumsum(np.frombuffer(self._read(self._keys, 8 * BLOCK_KEYS), "<i8")) + self._last
        self.totals = np.frombuffer(self._read(self._totals, 8 * BLOCK_KEYS), "<i8")
        if len(self.keys):
            self._last = int(self.keys[-1])
        return len(self.keys) > 0

    def until(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        cut = int(np.searchsorted(self.keys, bound, "right"))
        out = self.keys[:cut], self.totals[:cut]
        self.keys, self.totals = self.keys[cut:], self.totals[cut:]
        return out


def heap_merge(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of summaries: sorted distinct keys with their links, block by block.

    A heap holds the last decoded key of each run. Up to its least one all runs are decoded,
    so what they hold up to there is merged at once and no later key can be less.
    """
    runs = [r for r in map(Run, raws) if len(r.keys)]
    heap = [(int(r.keys[-1]), i) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = [r.until(bound) for r in runs if len(r.keys) and r.keys[0] <= bound]
        keys, totals = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], totals[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        yield keys[new], np.add.reduceat(totals, new)
        while heap and heap[0][0] == bound:
            i = heap[0][1]
            if runs[i].more():
                heapq.heapreplace(heap, (int(runs[i].keys[-1]), i))
            else:
                heapq.heappop(heap)


# ---- the operator ---------------------------------------------------------------------


def _runs_schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType().add("run", "long").add("ordinal", "integer").add("doc_id", id_type).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long")
        .add("groups", "string").add("radix", "integer").add("records", "long").add("summary", "binary").add("detail", "binary")
    )


def write_runs(docs: DataFrame, a_path: str, b_path: str, path: str, *, id_col: str, text_col: str, digest: bool, run_records: int = RUN_RECORDS) -> DataFrame:
    """Store documents (radix null) and the runs of their records (radix not null)."""
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = _runs_schema(own.schema["doc_id"].dataType)

    def write(batches):
        aligner, run = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        size_a, at, gathered, records = aligner.a.size, 0, [], 0

        def flush():
            packed, n = np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered])
            # batches hold documents of their own, so records are distinct
            order = np.argsort(packed)
            packed, n = packed[order], n[order]
            keys, documents = packed >> 16, packed & 0xFFFF
            radix = (keys // size_a) % RADIX
            rows = []
            for r in range(RADIX):
                of = np.flatnonzero(radix == r)
                if len(of):
                    summary, detail = _sorted_run(keys[of], documents[of], n[of])
                    rows.append((r, len(of), summary, detail))
            count, cols = len(rows), list(zip(*rows))
            filled = {"run": pa.array([run] * count, pa.int64()), "radix": pa.array(cols[0], pa.int32()), "records": pa.array(cols[1], pa.int64()), "summary": pa.array(cols[2], pa.binary()), "detail": pa.array(cols[3], pa.binary())}
            return batch(count, filled)

        def batch(count, filled):
            return pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(count, f.type)) for f in arrow], schema=arrow)

        arrow = None
        for b in batches:
            arrow = arrow or pa.schema([(f.name, b.schema.field(0).type if f.name == "doc_id" else _ARROW[f.dataType.typeName()]) for f in schema])
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 1000):
                part = texts[i : i + 1000]
                if at + len(part) > RUN_DOCS:
                    if gathered:
                        yield flush()
                    run, at, gathered, records = run + 1, 0, [], 0
                numbers = aligner.align(part)
                flat = np.fromiter((n for own in numbers for n in own), np.int64)
                sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
                of = np.repeat(np.arange(len(numbers)), sizes)
                counts = np.zeros((len(numbers), 4), np.int64)
                if len(flat):
                    links = aligner.keys.sizes[flat]
                    per = np.column_stack((aligner.counts.take(flat).reshape(-1, 3), links))
                    firsts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                    counts[of[firsts]] = np.add.reduceat(per, firsts)
                    packed = aligner.keys.take(flat) << 16 | np.repeat(of + at, links)
                    packed.sort()
                    new = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
                    gathered.append((packed[new], np.diff(np.append(new, len(packed)))))
                    records += len(new)
                groups = [";".join([aligner.groups[n] for n in own]) for own in numbers]
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                filled = {"run": pa.array([run] * len(part), pa.int64()), "ordinal": pa.array(np.arange(at, at + len(part)), pa.int32()), "doc_id": b.column(0).slice(i, len(part)), "groups": pa.array(groups, pa.string())}
                yield batch(len(part), filled | {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
                at += len(part)
                if records >= run_records:
                    yield flush()
                    run, at, gathered, records = run + 1, 0, [], 0
        if gathered:
            yield flush()

    return common.stage(own.mapInArrow(write, schema), f"{path}/runs")


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _parts(runs: DataFrame, part_records: int) -> tuple[DataFrame, int]:
    """The runs' rows with their ``part``: a radix, and one of as many shares of the runs as
    make parts of about ``part_records`` records; and how many shares there are."""
    own = runs.where("radix IS NOT NULL")
    total = own.agg(F.sum("records")).first()[0] or 0
    tasks = runs.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-max(total // part_records, 2 * tasks) // RADIX))
    return own.withColumn("part", (F.col("radix") + RADIX * F.pmod(F.xxhash64("run"), F.lit(shares))).cast("int")), shares


def count_pairs(parts: DataFrame, shares: int, size_a: int, path: str) -> DataFrame:
    """Links of each pair of ids over all documents: b, a, n, best (n is b's highest)."""

    def merge(batches):
        now, raws = None, []

        def counted():
            for keys, totals in heap_merge(raws):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(totals)], names=["key", "n"])

        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != now:
                    yield from counted()
                    now, raws = part, []
                raws.append(raw)
        yield from counted()

    dealt = parts.select("part", "summary").repartitionById(RADIX * shares, "part").sortWithinPartitions("part")
    counts = dealt.mapInArrow(merge, "key long, n long").withColumn("b", F.expr(f"key div {size_a}"))
    # a B id has as many rows as A has ids, times the shares, at most
    own = counts.repartition("b").groupBy("b", "key").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy("b"))
    return common.stage(own.select("b", (F.col("key") % size_a).alias("a"), "key", "n", (F.col("n") == highest).alias("best")), f"{path}/pairs")


def contributions(parts: DataFrame, shares: int, pairs: DataFrame, size_a: int) -> DataFrame:
    """Per document (run, ordinal): n_best and count_sum over its links."""

    def tables(batches):
        for b in batches:
            key, n, best = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            order = np.argsort(key)
            key, n, best = key[order], n[order], best[order]
            radix = key // size_a % RADIX
            for r in np.unique(radix).tolist():
                of = radix == r
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_zip(key[of].astype("<i8"), n[of].astype("<i8"), best[of])])], names=["radix", "table"])

    def back(batches):
        now, held, ready = None, [], None
        for b in batches:
            for row in b.to_pylist():
                if row["part"] != now:
                    now, held, ready = row["part"], [], None
                if row["table"] is not None:
                    held.append(_unzip(row["table"], "<i8", "<i8", "?"))
                    continue
                if ready is None:
                    key, n, best = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(key)
                    ready, held = (key[order], n[order], best[order]), []
                key, n, best = ready
                deltas, _ = _unzip(row["summary"], "<i8", "<i8")
                documents_of, documents, links = _unzip(row["detail"], "<u4", "<u2", "<u4")
                at = np.repeat(np.searchsorted(key, np.cumsum(deltas)), documents_of)
                order = np.argsort(documents, kind="stable")
                documents, at, links = documents[order], at[order], links[order].astype(np.int64)
                new = np.flatnonzero(np.concatenate(([True], documents[1:] != documents[:-1])))
                sums, tops = np.add.reduceat(links * n[at], new), np.add.reduceat(links * best[at], new)
                yield pa.RecordBatch.from_arrays([pa.array([row["run"]]), pa.array([_zip(documents[new], sums.astype("<i8"), tops.astype("<i8"))])], names=["run", "sums"])

    def total(batches):
        now, sums, tops, seen = None, None, None, None

        def ended():
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(tops[at]), pa.array(sums[at])], names=["run", "ordinal", "n_best", "count_sum"])

        for b in batches:
            for run, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if run != now:
                    if now is not None:
                        yield ended()
                    now, sums, tops, seen = run, np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, bool)
                documents, s, t = _unzip(raw, "<u2", "<i8", "<i8")
                sums[documents] += s  # a document stands once in a blob
                tops[documents] += t
                seen[documents] = True
        if now is not None:
            yield ended()

    table = pairs.select("key", "n", "best").mapInArrow(tables, "radix int, table binary")
    # each share of a radix's runs meets that radix's counts, which come first
    shared = table.select("radix", "table", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("run", "long"), ("summary", "binary"), ("detail", "binary"))]
    told = shared.select((F.col("radix") + RADIX * F.col("share")).cast("int").alias("part"), "table", *nothing)
    rows = told.unionByName(parts.select("part", "run", F.lit(None).cast("binary").alias("table"), "summary", "detail"))
    met = rows.repartitionById(RADIX * shares, "part").sortWithinPartitions("part", F.col("table").isNull())
    sums = met.mapInArrow(back, "run long, sums binary")
    return sums.repartition("run").sortWithinPartitions("run").mapInArrow(total, "run long, ordinal int, n_best long, count_sum long")


def align(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
    run_records: int = RUN_RECORDS, part_records: int = PART_RECORDS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of ids in order, or with ``digest`` its
    SHA-256 as ``groups_sha256``; '' without tokens. n_best counts the links whose pair is its
    B id's most frequent (ties included) over all rows, count_sum adds up the counts of a
    row's links. A (byte-level BPE) encodes a space and the text, B (a sentence-piece model)
    the text, before which it puts a space itself; special tokens' strings are plain text. Null
    and empty texts, and those that either does not give back byte for byte, have no tokens.
    Ids keep their type and may be null or repeat: a row out for each row in. An empty table
    gives no rows; other columns are not read. A text is aligned in one task, whatever its length.
    """
    out, _ = aligned(docs, a_path, b_path, id_col=id_col, text_col=text_col, digest=digest, run_records=run_records, part_records=part_records)
    return out


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str, text_col: str, digest: bool, run_records: int = RUN_RECORDS, part_records: int = PART_RECORDS) -> tuple[DataFrame, DataFrame]:
    """What :func:`align` returns, and the stored counts of id pairs: b, a, key, n, best."""
    spark = docs.sparkSession
    path = common.workspace(spark, "alignment")
    size_a = bpe.vocabulary(a_path).size
    runs = write_runs(docs, a_path, b_path, path, id_col=id_col, text_col=text_col, digest=digest, run_records=run_records)
    parts, shares = _parts(runs, part_records)
    pairs = count_pairs(parts, shares, size_a, path)
    told = contributions(parts, shares, pairs, size_a)
    own = runs.where("radix IS NULL")
    out = own.join(told, ["run", "ordinal"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), F.col("groups").alias("groups_sha256" if digest else "groups")
    )
    return out, pairs
