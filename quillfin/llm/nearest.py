"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are quantised to int8 with a scale of their own. A tile of int8 products, exact in
float arithmetic, gives each pair's inner product up to an error that is bounded by the
quantisation residues: |<q,c> - <q',c'>| <= |q - q'| |c| + |q'| |c - c'|. Pairs whose upper
bound reaches the k-th best lower bound, or the k-th best product found so far, survive; they are
recomputed in double precision on the original components and kept in heaps of k entries,
which are merged over all cells. No pair that belongs in the result can be lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vector_tiles import TILE_ROWS, Block, Heaps, cells, each_cell, merged, pack, query_blocks, usable

#: Products of int8 vectors up to this dimension are exact in float32.
_EXACT32 = (1 << 24) // (127 * 127)
#: Bytes of the pairs that are recomputed at once.
_EXACT_BYTES = 16 << 20


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; squares that would leave the range of doubles are avoided."""
    most = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny)
    return most * np.sqrt(np.square(x / most[:, None]).sum(axis=1))


class Quantised:
    """int8 copies of vectors with what their error bounds need."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float64)
        self.scale = np.maximum(np.abs(self.x).max(axis=1) / 127, np.finfo(np.float64).tiny)
        self.q = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.residue, self.norm, self.back = lengths(self.x - back), lengths(self.x), lengths(back)

    def tile(self, rows: slice, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of all products of some rows with all of ``other``, and their errors at most."""
        kind = np.float32 if self.q.shape[1] <= _EXACT32 else np.float64
        product = (self.q[rows].astype(kind) @ other.q.T.astype(kind)).astype(np.float64)
        product *= self.scale[rows][:, None]
        product *= other.scale
        error = self.residue[rows][:, None] * other.norm
        error += self.back[rows][:, None] * other.residue
        error += 1e-12 * self.norm[rows][:, None] * other.norm  # what double arithmetic itself rounds
        return product, error


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; the same for the same pair wherever it stands."""
    return (x * y).sum(axis=1)


def nearest(rows: DataFrame, k: int, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each row that ``is_query`` holds of.

    Returns query_id, rank (from 1), vec_id, score: best first, ties to the smaller id, a
    null id last. A row is a candidate for every query but itself; a query with fewer
    candidates than k gets them all. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, and vectors of different lengths do not meet. Ids
    may repeat (each row asks and is found by itself) or be null (``is_query`` decides). An
    empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    path = common.workspace(spark, "nearest")
    element = rows.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    vec = rows[vec_col].cast("array<double>")
    own = rows.where(usable(vec) & F.exists(vec, lambda x: x != 0)).select(
        rows[id_col].cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), F.coalesce(is_query, F.lit(False)).alias("asks"), vec.alias("vec")
    )
    blocks = common.stage(pack(own, dtype), f"{path}/blocks")
    queries = common.stage(query_blocks(blocks, dtype), f"{path}/queries")

    def start(q: Block):
        return q, Quantised(q.data), Heaps(len(q.uid), k, np.float64)

    def meet(state, c: Block) -> None:
        q, left, heaps = state
        right = Quantised(c.data)
        _, own_q, own_c = np.intersect1d(q.uid, c.uid, assume_unique=True, return_indices=True)
        found = []
        for a in range(0, len(q.uid), TILE_ROWS):
            part = slice(a, min(a + TILE_ROWS, len(q.uid)))
            low, error = left.tile(part, right)
            high = low + error
            low -= error
            inside = (own_q >= part.start) & (own_q < part.stop)
            low[own_q[inside] - a, own_c[inside]] = high[own_q[inside] - a, own_c[inside]] = -np.inf
            floor = heaps.floor[part]
            if low.shape[1] > k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            row, col = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
            step = max(1, _EXACT_BYTES // (8 * c.dim))
            score = [exact(left.x[a + row[i : i + step]], right.x[col[i : i + step]]) for i in range(0, len(row), step)]
            found.append((a + row, np.concatenate(score) if score else np.zeros(0), col))
        owner, score, col = (np.concatenate([f[i] for f in found]) for i in range(3))
        heaps.add(owner, score, c.none[col], c.id[col])

    def finish(state):
        q, _, heaps = state
        if len(heaps.owner):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.uid[heaps.owner]), pa.array(q.id[heaps.owner], mask=q.none[heaps.owner]), pa.array(heaps.score), pa.array(heaps.id, mask=heaps.none)], names=["uid", "query_id", "score", "vec_id"]
            )

    found = cells(queries, blocks).mapInArrow(lambda batches: each_cell(batches, dtype, start, meet, finish), "uid long, query_id long, score double, vec_id long")
    return merged(found, ["uid"], ["query_id"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")
