"""Grid joins of vector blocks: a stated set of query rows against all rows, tile by tile.

Rows are packed into blocks of bounded bytes. Query blocks form groups, candidate blocks form
groups, and each pair of groups is a cell: one task gets the cell's query blocks (at most
QUERY_BLOCKS) and then streams its candidate blocks past them one at a time, so a task holds
the queries of one group, one candidate block and bounded heaps, whatever the table's size.
Blocks go by position, not by value, so no label, source or copy makes a cell hot.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows and bytes of a block, query blocks of a group, and candidate blocks of a group at most.
BLOCK_ROWS, BLOCK_BYTES, QUERY_BLOCKS, CANDIDATE_BLOCKS = 1024, 1 << 20, 8, 256
#: Query rows that are multiplied with a candidate block at once.
TILE_ROWS = 512
MOST_PARTITIONS = 100_000

BLOCK = (
    T.StructType().add("at", "long").add("dim", "integer").add("n", "integer").add("queries", "integer")
    .add("uid", "binary").add("id", "binary").add("none", "binary").add("tag", "binary").add("asks", "binary").add("data", "binary")
)
_KINDS = {"uid": "<i8", "id": "<i8", "none": "?", "tag": "<i8", "asks": "?"}


def usable(vec: Column) -> Column:
    """Whether a vector is there, not empty, and without null or non-finite components."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


class Block:
    """The rows of a block (all of one dimension) as arrays."""

    def __init__(self, dim: int, data: np.ndarray, **columns: np.ndarray):
        self.dim, self.data = dim, data
        self.uid, self.id, self.none, self.tag, self.asks = (columns[c] for c in _KINDS)

    def take(self, rows) -> Block:
        return Block(self.dim, self.data[rows], **{c: getattr(self, c)[rows] for c in _KINDS})

    @staticmethod
    def join(parts: list[Block]) -> Block:
        return Block(parts[0].dim, np.concatenate([p.data for p in parts]), **{c: np.concatenate([getattr(p, c) for p in parts]) for c in _KINDS})

    def row(self, at: int, dtype: str) -> dict:
        return {"at": at, "dim": self.dim, "n": len(self.uid), "queries": int(self.asks.sum())} | {c: getattr(self, c).astype(k).tobytes() for c, k in _KINDS.items()} | {"data": self.data.astype(dtype).tobytes()}

    @staticmethod
    def of(row: dict, dtype: str) -> Block:
        data = np.frombuffer(row["data"], dtype).reshape(row["n"], row["dim"])
        return Block(row["dim"], data, **{c: np.frombuffer(row[c], k) for c, k in _KINDS.items()})


_BLOCK_PA = pa.schema([("at", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("queries", pa.int32()), *((c, pa.binary()) for c in ("uid", "id", "none", "tag", "asks", "data"))])


def _packed(parts: Iterable[Block], dtype: str) -> Iterator[pa.RecordBatch]:
    """Blocks of full size out of smaller ones; numbered from the task's number on, so that
    blocks of all tasks go round the groups evenly."""
    pending: dict[int, list[Block]] = {}
    at = TaskContext.get().partitionId()
    width = np.dtype(dtype).itemsize
    for part in parts:
        own = pending.setdefault(part.dim, [])
        own.append(part)
        room = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (part.dim * width)))
        if sum(len(p.uid) for p in own) >= room:
            whole = Block.join(own)
            full = len(whole.uid) // room * room
            for i in range(0, full, room):
                yield pa.RecordBatch.from_pylist([whole.take(slice(i, i + room)).row(at, dtype)], _BLOCK_PA)
                at += 1
            pending[part.dim] = [whole.take(slice(full, None))] if full < len(whole.uid) else []
    for own in pending.values():
        if own:
            yield pa.RecordBatch.from_pylist([Block.join(own).row(at, dtype)], _BLOCK_PA)
            at += 1


def pack(rows: DataFrame, dtype: str, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of rows (id long, tag long, asks boolean, vec array<double>), each row numbered.

    prepare: what happens to each matrix of components (float64) before it is stored as dtype.
    """
    common.prepare(rows.sparkSession)
    own = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "tag", "asks", "vec")

    def parts(batches):
        for b in batches:
            uid, ids, tag, asks, vec = b.columns
            lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            columns = {
                "uid": uid.to_numpy(), "id": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "none": pc.is_null(ids).to_numpy(zero_copy_only=False),
                "tag": pc.fill_null(tag, 0).to_numpy(zero_copy_only=False), "asks": pc.fill_null(asks, False).to_numpy(zero_copy_only=False),
            }
            for dim in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == dim)
                data = values[starts[of][:, None] + np.arange(dim)]
                yield Block(dim, prepare(data) if prepare else data, **{c: v[of] for c, v in columns.items()})

    return own.mapInArrow(lambda batches: _packed(parts(batches), dtype), BLOCK)


def query_blocks(blocks: DataFrame, dtype: str) -> DataFrame:
    """The rows that ask, in blocks of their own."""

    def parts(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block.of(row, dtype)
                yield block.take(block.asks)

    return blocks.where("queries > 0").mapInArrow(lambda batches: _packed(parts(batches), dtype), BLOCK)


def cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each cell's query blocks (side 0) and candidate blocks (side 1), in that order.

    Both tables of blocks should be stored. A candidate block is sent once to each group of
    queries, a query block once to each group of candidates.
    """
    nq, nc = queries.count(), candidates.count()
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    by_q = max(1, math.ceil(nq / QUERY_BLOCKS))
    by_c = max(1, min(nc, max(math.ceil(nc / CANDIDATE_BLOCKS), math.ceil(2 * tasks / by_q))))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("*", F.lit(0).alias("side"), to(by_c).alias("other")).withColumn("cell", F.pmod("at", F.lit(by_q)) * by_c + F.col("other"))
    c = candidates.select("*", F.lit(1).alias("side"), to(by_q).alias("other")).withColumn("cell", F.col("other") * by_c + F.pmod("at", F.lit(by_c)))
    both = q.drop("other").unionByName(c.drop("other")).withColumn("cell", F.col("cell").cast("int"))
    return both.repartitionById(min(by_q * by_c, MOST_PARTITIONS), "cell").sortWithinPartitions("cell", "side", "at", F.hex(F.substring("uid", 1, 8)))


def each_cell(batches, dtype: str, start: Callable, meet: Callable, finish: Callable):
    """Run a cell: start(queries) -> state per dimension, meet(state, candidates) for each
    candidate block of that dimension, then what finish(state) yields."""
    cell, asking, states = None, {}, {}

    def end():
        for state in states.values():
            yield from finish(state)

    for b in batches:
        for row in b.to_pylist():
            if row["cell"] != cell:
                yield from end()
                cell, asking, states = row["cell"], {}, {}
            block = Block.of(row, dtype)
            if row["side"] == 0:
                asking.setdefault(block.dim, []).append(block)
            elif block.dim in asking:
                if block.dim not in states:
                    states[block.dim] = start(Block.join(asking[block.dim]))
                meet(states[block.dim], block)
    yield from end()


def first_k(group: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Positions of the first k of each group under the keys (most significant first), in order."""
    order = np.lexsort([*keys[::-1], group])
    sorted_group = group[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1]))) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < k]


class Heaps:
    """The best k entries of each of n owners: score down, then id up with nulls last.

    Held as flat sorted arrays; ``floor`` is what an entry must reach to get in.
    """

    def __init__(self, n: int, k: int, kind):
        self.n, self.k, self.lowest = n, k, -np.inf if kind == np.float64 else np.iinfo(np.int64).min
        self.owner, self.score = np.zeros(0, np.int64), np.zeros(0, kind)
        self.none, self.id = np.zeros(0, bool), np.zeros(0, np.int64)
        self.floor = np.full(n, self.lowest, kind)

    def add(self, owner: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        own, score = np.concatenate((self.owner, owner)), np.concatenate((self.score, score))
        none, ids = np.concatenate((self.none, none)), np.concatenate((self.id, ids))
        # scores of all signs descend by the complement of integers, by the negative of floats
        down = -score if score.dtype == np.float64 else ~score
        at = first_k(own, [down, none, ids], self.k)
        self.owner, self.score, self.none, self.id = own[at], score[at], none[at], ids[at]
        held = np.bincount(self.owner, minlength=self.n)
        full = np.flatnonzero(held >= self.k)
        self.floor[full] = self.score[np.cumsum(held)[full] - 1]


def top_rows(scores: np.ndarray, floor: np.ndarray, k: int, lowest) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries among their row's k highest, ties included, not below the
    row's floor and above ``lowest``."""
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    return np.nonzero((scores >= floor[:, None]) & (scores > lowest))


def merged(entries: DataFrame, owner: list[str], carry: list[str], score: str, ids: str, k: int) -> DataFrame:
    """Merge the heaps of all cells: ``entries`` (owner columns, carried columns, score, id)
    to each owner's first k, with a ``rank`` from 1.

    Entries are dealt by owner, sorted by Spark, and run through one heap of k entries at a
    time. What is carried depends on the owner or the entry alone.
    """
    fields = [*owner, *carry, score, ids]
    schema = T.StructType([*(entries.schema[c] for c in fields), T.StructField("rank", T.IntegerType())])

    def merge(batches):
        now, heap, kept = None, [], []

        def ended():
            best = sorted(heap, key=lambda e: e[:3], reverse=True)
            kept.extend((*now, *e[3], e[0], None if e[1] == 0 else -e[2], r) for r, e in enumerate(best, 1))

        def out():
            cols = list(zip(*kept))
            made = pa.RecordBatch.from_arrays([pa.array(col, type_) for col, type_ in zip(cols, types)], names=schema.names)
            kept.clear()
            return made

        types = None
        for b in batches:
            types = types or [*(b.schema.field(c).type for c in fields), pa.int32()]
            cols = {c: b.column(c).to_pylist() for c in fields}
            for key, carried, s, i in zip(zip(*(cols[c] for c in owner)), zip(*(cols[c] for c in carry)) if carry else [()] * b.num_rows, cols[score], cols[ids]):
                if key != now:
                    if now is not None:
                        ended()
                    now, heap = key, []
                # the heap's least entry has the lowest score, then no id, then the largest one
                entry = (s, i is not None, -(i or 0), carried)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry[:3] > heap[0][:3]:
                    heapq.heapreplace(heap, entry)
            if len(kept) > 4096:
                yield out()
        if now is not None:
            ended()
        if kept:
            yield out()

    return entries.select(*fields).repartition(*owner).sortWithinPartitions(*owner).mapInArrow(merge, schema)
