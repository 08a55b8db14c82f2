"""Nearest neighbours and hard negatives against brute force."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillfin.llm import hard_negatives, nearest, vector_tiles
from quillfin.llm.hard_negatives import strassen, window


def rows_of(spark, data, kind="float"):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in data], f"vec_id long, embedding array<{kind}>, label int, score string, uid int")


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def order(score, i):
    return (-score, i is None, i or 0)


def brute_nearest(data, k, every):
    rows = [(n, i, np.array(v, np.float64)) for n, (i, v, _) in enumerate(data) if good(v) and any(v)]
    out = []
    for n, i, v in rows:
        if i is not None and i % every == 0:
            found = sorted(((float((v * w).sum()), j) for m, j, w in rows if m != n and len(w) == len(v)), key=lambda x: order(*x))[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(found, 1)]
    return out


def brute_mine(data, every):
    rows = []
    for n, (i, v, y) in enumerate(data):
        if good(v) and y is not None:
            rows.append((n, i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    out = []
    for n, i, v, y in rows:
        if i is None or i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, z) for m, j, w, z in rows if m != n and len(w) == len(v)), key=lambda x: order(*x[:2]))
        for p, pj, _ in [x for x in scored if x[2] == y][:5]:
            hard = [x for x in scored if x[2] != y and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(i, pj, r, j, p, s) for r, (s, j, _) in enumerate(hard, 1)]
    return out


def bag(rows):
    return sorted(((tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows), key=str)


def odd_data(seed=0, n=260, dim=12):
    """Copies, ties, repeated and null ids, broken vectors, another length, a common label."""
    rng = np.random.default_rng(seed)
    base = (rng.integers(-40, 41, (n, dim)) / 64).tolist()
    data = [(i, base[i], int(rng.choice([0, 0, 1, 2])) if i % 11 else None) for i in range(n)]
    data += [(1000 + i, base[3], 1) for i in range(40)] + [(-100, base[5], 0), (100, base[7], 2), (100, base[7], 2), (None, base[3], 0), (None, base[9], 1)]
    data += [(500, None, 1), (550, [], 1), (600, [0.0] * dim, 1), (650, [1.0, None] + [0.0] * (dim - 2), 1), (700, [math.nan] * dim, 1), (750, [math.inf] * dim, 1)]
    data += [(800, [0.5, 0.25], 1), (801, [0.5, 0.125], 1), (802, [0.25, 0.5], 2), (850, [0.75], 3)]
    return data


@pytest.fixture
def small_blocks(monkeypatch):
    for name, v in (("BLOCK_ROWS", 16), ("QUERY_BLOCKS", 1), ("CANDIDATE_BLOCKS", 4), ("TILE_ROWS", 5)):
        monkeypatch.setattr(vector_tiles, name, v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_brute_force(spark, kind, small_blocks):
    data = odd_data()
    got = nearest.nearest(rows_of(spark, data, kind).repartition(5), 7, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert bag(got.collect()) == bag(brute_nearest(data, 7, 20))


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    for dim, size in ((3, 1.0), (64, 1e-300), (64, 1e30), (1500, 1.0)):
        x, y = rng.normal(size=(40, dim)) * size, rng.normal(size=(50, dim))
        a, b = nearest.Quantised(x), nearest.Quantised(y)
        product, error = a.tile(slice(0, 40), b)
        assert (np.abs(product - x @ y.T) <= error).all()


def test_mine_equals_brute_force(spark, small_blocks):
    data = odd_data(2)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    got = hard_negatives.mine(rows_of(spark, data).repartition(5), F.col("vec_id") % 50 == 0, label=moved)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_mine(data, 50)
    assert len(want) > 20 and bag(got.collect()) == bag(want)


def test_strassen_is_exact():
    rng = np.random.default_rng(5)
    for shape in ((1, 1, 1), (7, 64, 9), (33, 65, 129), (64, 64, 64), (100, 3, 50)):
        m, k, n = shape
        a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
        assert (strassen(a, b, leaf=4) == a @ b).all() and (strassen(a, b) == a @ b).all()


def test_window_is_exact():
    p = np.array([-5, -1, 0, 1, 2, 3, 7, 39, 100, 101, 199, 2**62], np.int64)
    low, high = window(p, 50, 95)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        assert a == -(-50 * x // 100) and b == 95 * x // 100


def test_too_large_components_raise(spark):
    rows = rows_of(spark, [(50, [1e12, 1e12], 1), (1, [1.0, 1.0], 1)])
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, label=F.col("label")).collect()


def test_empty_and_lonely(spark):
    for data in ([], [(0, [1.0, 2.0], 1)], [(0, None, None)]):
        rows = rows_of(spark, data)
        assert nearest.nearest(rows, 3, F.col("vec_id") % 20 == 0).count() == 0
        assert hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, label=F.col("label")).count() == 0


def test_queries_over_tables(spark):
    from quillfin.llm.queries import QUERIES

    data = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert bag(QUERIES["op11_block_nearest"](spark, SF).collect()) == bag(brute_nearest(data, 20, 20))
    assert bag(QUERIES["op12_hard_negatives"](spark, SF).collect()) == bag(brute_mine(data, 50))
