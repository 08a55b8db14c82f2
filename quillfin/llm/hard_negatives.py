"""Hard negatives from integer inner products, multiplied by Strassen's recursion.

Components become floor(scale * x), so every score is an integer and equal in any order of
summation. Tiles of anchors and candidates are int64 matrices, padded with zeros to even sizes
and split into quarters: seven products and exact additions instead of eight products
(sums that leave 64 bits on the way come back, as int64 arithmetic is that of a ring).

Pass 1 keeps each anchor's best rows of its label in heaps and merges these over all cells;
pass 2 multiplies again, now that each positive's window of scores is known, and keeps the
first rows of other labels inside each window in heaps, merged likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vector_tiles import TILE_ROWS, Block, Heaps, cells, each_cell, merged, pack, query_blocks, top_rows, usable

#: Sides up to this length are multiplied directly.
LEAF = 32
_LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices of any shape."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = (np.ascontiguousarray(x) for x in (a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]))
    b11, b12, b21, b22 = (np.ascontiguousarray(x) for x in (b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]))
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = m1 + m4 - m5 + m7
    out[:i, l:] = m3 + m5
    out[i:, :l] = m2 + m4
    out[i:, l:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def whole(scale: int):
    """floor(scale * x) of components, as int64."""

    def prepare(x: np.ndarray) -> np.ndarray:
        y = np.floor(scale * x)
        if len(y) and np.square(y).sum(axis=1).max() >= 2.0**63:
            raise ValueError("components are too large for scores of 64 bits")
        return y.astype(np.int64)

    return prepare


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest n with low * p <= 100 * n <= high * p, without leaving 64 bits."""
    whole_, rest = positive // 100, positive % 100
    return low * whole_ - (-low * rest) // 100, high * whole_ + high * rest // 100


def mine(
    rows: DataFrame, is_anchor: Column, *, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """Per anchor and positive, the hardest rows of other labels within a window of scores.

    Positives of an anchor are the first ``positives`` other rows of its label, highest score
    first, ties to the smaller id, a null id last. Negatives of a positive of score p are
    the first ``negatives`` rows of another label whose score n has low * p <= 100 * n <=
    high * p, in the same order. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score; a positive without negatives has no rows. Rows with a
    null label or vector, an empty vector, or null or non-finite components take no part; vectors of
    different lengths do not meet. Ids may repeat (each row counts by itself) or be null.
    Zero vectors score 0. An empty table gives no rows; other columns are not read.
    Components so large that a row's integer square sum leaves 64 bits raise an error.
    """
    spark = rows.sparkSession
    path = common.workspace(spark, "hard-negatives")
    vec = rows[vec_col].cast("array<double>")
    own = rows.where(usable(vec) & label.isNotNull()).select(
        rows[id_col].cast("long").alias("id"), label.cast("long").alias("tag"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), vec.alias("vec")
    )
    dtype = "<i8"
    blocks = common.stage(pack(own, dtype, whole(scale)), f"{path}/blocks")
    anchors = common.stage(query_blocks(blocks, dtype), f"{path}/anchors")
    # cells are the same in both passes, and so are the tiles
    grid = cells(anchors, blocks)

    def tiles(q: Block, c: Block):
        """Slices of the anchors with their scores against all of ``c``."""
        across = np.ascontiguousarray(c.data.T)
        for a in range(0, len(q.uid), TILE_ROWS):
            part = slice(a, min(a + TILE_ROWS, len(q.uid)))
            yield part, strassen(q.data[part], across)

    def start_positives(q: Block):
        return q, Heaps(len(q.uid), positives, np.int64)

    def meet_positives(state, c: Block) -> None:
        q, heaps = state
        _, own_q, own_c = np.intersect1d(q.uid, c.uid, assume_unique=True, return_indices=True)
        for part, score in tiles(q, c):
            score[q.tag[part][:, None] != c.tag] = _LOWEST
            inside = (own_q >= part.start) & (own_q < part.stop)
            score[own_q[inside] - part.start, own_c[inside]] = _LOWEST
            row, col = top_rows(score, heaps.floor[part], positives, _LOWEST)
            heaps.add(part.start + row, score[row, col], c.none[col], c.id[col])

    def finish_positives(state):
        q, heaps = state
        if len(heaps.owner):
            yield pa.RecordBatch.from_arrays([pa.array(q.uid[heaps.owner]), pa.array(heaps.score), pa.array(heaps.id, mask=heaps.none)], names=["uid", "score", "id"])

    found = grid.mapInArrow(lambda batches: each_cell(batches, dtype, start_positives, meet_positives, finish_positives), "uid long, score long, id long")
    best = merged(found, ["uid"], [], "score", "id", positives)
    best = common.stage(best.select("uid", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), f"{path}/positives")

    # an anchor's positives (a handful) go to the block that holds the anchor
    def owners(batches):
        for b in batches:
            for key, raw in zip(b.column("key").to_pylist(), b.column("uid").to_pylist()):
                uid = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array([key] * len(uid), pa.string())], names=["uid", "key"])

    keyed = anchors.withColumn("key", F.hex(F.substring("uid", 1, 8)))  # its first row's number names a block
    owner = keyed.select("uid", "key").mapInArrow(owners, "uid long, key string")
    # a block's anchors times a handful
    lists = owner.join(best, "uid").groupBy("key").agg(F.collect_list(F.struct("uid", "slot", "positive_score")).alias("wanted"))
    asking = common.stage(keyed.join(lists, "key").drop("key"), f"{path}/asking")
    wanted = cells(asking, blocks.withColumn("wanted", F.lit(None).cast(asking.schema["wanted"].dataType)))

    def second(batches):
        def rows_of():
            for b in batches:
                for k, row in enumerate(b.to_pylist()):
                    yield b.slice(k, 1), row

        slots: dict[int, list[tuple[int, int]]] = {}
        cell = [None]

        def noting():
            for one, row in rows_of():
                if row["cell"] != cell[0]:
                    cell[0] = row["cell"]
                    slots.clear()
                for w in row["wanted"] or ():
                    slots.setdefault(w["uid"], []).append((w["slot"], w["positive_score"]))
                yield one

        def start(q: Block):
            owners_of = [(i, s, p) for i, uid in enumerate(q.uid.tolist()) for s, p in slots.get(uid, ())]
            owners_of.sort(key=lambda x: (x[1], x[0]))
            at, slot, score = (np.array([x[n] for x in owners_of], np.int64) for n in range(3))
            least, most = window(score, low, high)
            return q, at, slot, score, least, most, Heaps(len(at), negatives, np.int64)

        def meet(state, c: Block) -> None:
            q, at, slot, _, least, most, heaps = state
            if not len(at):
                return
            for part, score in tiles(q, c):
                score[q.tag[part][:, None] == c.tag] = _LOWEST
                for s in np.unique(slot):
                    own = np.flatnonzero((slot == s) & (at >= part.start) & (at < part.stop))
                    if not len(own):
                        continue
                    seen = score[at[own] - part.start]
                    seen[(seen < least[own][:, None]) | (seen > most[own][:, None])] = _LOWEST
                    row, col = top_rows(seen, heaps.floor[own], negatives, _LOWEST)
                    heaps.add(own[row], seen[row, col], c.none[col], c.id[col])

        def finish(state):
            q, at, slot, score, _, _, heaps = state
            if len(heaps.owner):
                o = heaps.owner
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.uid[at[o]]), pa.array(slot[o]), pa.array(q.id[at[o]], mask=q.none[at[o]]), pa.array(score[o]), pa.array(heaps.score), pa.array(heaps.id, mask=heaps.none)],
                    names=["uid", "slot", "anchor_id", "positive_score", "score", "id"],
                )

        yield from each_cell(noting(), dtype, start, meet, finish)

    hard = wanted.mapInArrow(second, "uid long, slot long, anchor_id long, positive_score long, score long, id long")
    picked = merged(hard, ["uid", "slot"], ["anchor_id", "positive_score"], "score", "id", negatives)
    names = best.select("uid", F.col("slot").cast("long").alias("slot"), "positive_id")
    return picked.join(names, ["uid", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
