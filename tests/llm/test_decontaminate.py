"""Spaced seeds against brute force."""

import itertools
import random
import re

import pytest

from quillfin.llm import decontaminate as dc

ITEM = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew strong tea".split()


def caught(n, substituted, masks=dc.MASKS):
    """Whether some mask agrees on some window of n words of which some are substituted."""
    for m in masks:
        for at in range(n - len(m) + 1):
            if not any(c == "1" and at + k in substituted for k, c in enumerate(m)):
                return True
    return False


def test_short_masks_tolerate_one_substitution():
    for n in range(5, 15):
        masks = [m for m, least, most in dc.masks_for([n]) if least <= n <= most]
        assert all(caught(n, {a}, masks) for a in range(n)), n
    assert [m for m, least, most in dc.masks_for([3]) if least <= 3 <= most] == ["111"]


def test_masks_tolerate_two_substitutions():
    assert all(caught(15, {a}) for a in range(15))
    assert all(caught(15, set(p)) for p in itertools.combinations(range(15), 2))
    three = [caught(15, set(p)) for p in itertools.combinations(range(15), 3)]
    assert sum(three) / len(three) > 0.99


def brute(docs, items, least=13, share=0.8, stretch=16):
    """True overlaps, however found: per alignment, the equal words in stretches with enough of them."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            need = min(least, -(-len(v) * share // 1))
            for diagonal in range(-len(v), len(w)):
                equal = [k for k in range(len(v)) if 0 <= diagonal + k < len(w) and w[diagonal + k] == v[k]]
                found = set()
                for p in range(len(v)):
                    inside = [k for k in equal if p <= k < p + stretch]
                    if len(inside) >= need:
                        found |= set(inside)
                if found:
                    out[(d, i)] = max(out.get((d, i), 0), len(found))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "a", "of"]) for _ in range(n))
    items = [(1, " ".join(ITEM)), (2, "short item here"), (3, None), (4, ""), (5, filler(30)), (1, " ".join(ITEM))]
    docs = [(0, None), (1, ""), (2, filler(50)), (3, filler(20) + " Short, ITEM here! " + filler(5)), (4, " ".join(ITEM).upper())]
    for k in range(12):
        w = list(ITEM)
        for p in rng.sample(range(len(w)), k % 4):
            w[p] = "other"
        docs.append((10 + k, filler(rng.randint(0, 15)) + " " + "! ".join(w) + " " + filler(9)))
    docs += [(30, " ".join(ITEM[:9])), (31, " ".join(ITEM[:13])), (32, items[4][1] + " x " + items[4][1]), (4, " ".join(ITEM)), (None, " ".join(ITEM))]
    return docs, items


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_against_brute_force(spark, tables, broadcast):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, pos int, seed string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item_pos int")
    got = {(r.doc_id, r.item_id): r.matched_words for r in dc.decontaminate(d, b, broadcast_seeds=broadcast).collect()}
    assert got == brute(docs, items)
    clean = dc.decontaminated(d, b)
    assert clean.columns == d.columns
    bad = {k for k, _ in got}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in bad)  # None is contaminated


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.matched_words for r in dc.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_alignments_do_not_add_up(spark):
    v = [f"v{k}" for k in range(60)]
    apart = " ".join(v[40:49] + [f"x{k}" for k in range(50)] + v[:9])
    far = " ".join([*v[:9], *[f"y{k}" for k in range(31)], *v[40:49]])  # one alignment, no dense stretch
    inserted = " ".join([*v[:20], "z", *v[20:40]])
    docs, items = [(1, apart), (2, far), (3, inserted)], [(1, " ".join(v))]
    assert leaks(spark, docs, items) == brute(docs, items) == {(3, 1): 20}


def test_short_items(spark):
    docs, items = [], []
    for n in range(1, 16):
        v = [f"s{n}_{k}" for k in range(n)]
        items.append((n, " ".join(v)))
        docs += [(100 * n + k, "pre " + " ".join([*v[:k], "zz", *v[k + 1 :]]) + " post") for k in range(n)] + [(100 * n + 99, " ".join(v))]
    assert leaks(spark, docs, items) == brute(docs, items)


def test_long_text_in_chunks(spark, monkeypatch):
    filler = [f"f{k % 997}" for k in range(9_000)]
    docs = [(k, " ".join([*filler[: dc.CHUNK - k], *ITEM, *filler])) for k in range(0, 20, 3)]
    docs.append((50, " ".join(filler * 60 + ITEM)))
    assert leaks(spark, docs, [(1, " ".join(ITEM))]) == {(k, 1): 16 for k, _ in docs}


def test_rows_of_one_id(spark):
    d = spark.createDataFrame([(1, " ".join(ITEM)), (1, "clean text"), (1, None), (None, " ".join(ITEM)), (None, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    assert sorted(str(r.text) for r in dc.decontaminated(d, b).collect()) == ["None", "clean", "clean text"]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert dc.decontaminate(d, b).count() == 0
    assert dc.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b.limit(0)).count() == 0
