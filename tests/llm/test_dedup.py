"""Exact, near and substring deduplication against brute force on small fixtures."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest

from quillfin.llm import exact_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, kept boolean, key string, batch long"


def frame(spark, texts):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", False, "k", 7) for i, t in texts], SCHEMA).repartition(5)


def words(rng, n, size=60):
    return " ".join(rng.choice(VOCAB[:size]) for _ in range(n))


VOCAB = ["".join(p) for p in itertools.product("abcde", repeat=3)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 120), 125) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:  # near copies, some of them chains
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    texts += [base[3]] * 30 + [base[4].upper()] * 4 + ["", None, " \t\n", "one", "ONE", "one two three four", None]
    line = words(rng, 40)
    texts += [words(rng, 20, 125) + "\n" + line + " " + words(rng, 10, 125) for _ in range(12)]  # a shared passage
    texts.append(line + " " + line)
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(5, texts[5]), (None, "no id"), (None, base[3])]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, corpus, keep):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[lower(t)].append(i)
    got = exact_dedup.exact_dedup(frame(spark, corpus), keep=keep).collect()
    assert len(got) == len(corpus)
    want = Counter()
    for i, t in corpus:
        g = groups[lower(t)]
        ids = [x for x in g if x is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        want[(i, best, len(g), hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)  # a repeated row is kept once
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_stage_keeps_columns(spark, corpus):
    d = frame(spark, corpus)
    out = exact_dedup.deduplicated(d)
    assert out.columns == d.columns and out.count() == len({lower(t) for _, t in corpus})


def shingles(t):
    w = lower(t).encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def solved(corpus):
    sets = [shingles(t) for _, t in corpus]
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(corpus)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    texts = [find(k) for k in range(len(corpus))]
    first = {}
    for k, (i, _) in enumerate(corpus):  # rows that repeat an id are one document
        if i is not None and sets[k]:
            parent[find(first.setdefault(i, k))] = find(k)
    for k, (i, _) in enumerate(corpus):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(corpus)], texts, sets


def components(corpus):
    """(id, set size, component) of each row."""
    return solved(corpus)[0]


def staying(corpus):
    """How many of the rows of each text component stay, and how many rows with empty sets."""
    _, texts, sets = solved(corpus)
    return len({t for t, s in zip(texts, sets) if s}) + sum(not s for s in sets)


def test_near_one_id_on_different_texts(spark):
    rng = random.Random(5)
    a, b, c = (words(rng, 60, 125) for _ in range(3))
    corpus = [(3, a), (5, a + " x"), (5, b), (9, c), (None, a), (None, None), (7, ""), (9, c)]
    rows = near_dedup.near_duplicates(frame(spark, corpus)).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(3, 3): 1, (5, 3): 2, (9, 9): 2, (None, 3): 1, (None, None): 1, (7, 7): 1})
    stays = near_dedup.deduplicated(frame(spark, corpus)).collect()
    # b has no other copy, so it stays although its id is also on a near copy
    assert Counter((r.doc_id, r.text) for r in stays) == Counter([(3, a), (5, b), (9, c), (None, None), (7, "")])


def test_near_branching_recall(spark, monkeypatch):
    """Pairs at the threshold, each alone among texts that share a third of their shingles, in
    nodes that branch at least three times: links survive, and none is made up."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 1)
    rng = random.Random(23)
    passage = [f"p{k}" for k in range(100)]
    texts = []
    for n in range(150):
        own = [f"o{n}_{k}" for k in range(90)]
        for v in range(2):
            w = passage + own
            for k in rng.sample(range(102, 190, 6), 5 if v else 0):
                w[k] = f"v{n}_{k}"
            texts.append(" ".join(w))
    corpus = list(enumerate(texts))
    deepest = []
    real = near_dedup._branched
    monkeypatch.setattr(near_dedup, "_branched", lambda nodes, level: deepest.append(level) or real(nodes, level))
    got = near_dedup.near_duplicates(frame(spark, corpus)).collect()
    want = {i: c for i, _, c in components(corpus)}
    links = [i for i, c in want.items() if i != c]
    found = sum(r.component_id == want[r.doc_id] for r in got if r.doc_id in set(links))
    assert max(deepest) >= 2 and len(links) > 100
    assert found >= 0.99 * len(links) and all(r.component_id in (want[r.doc_id], r.doc_id) for r in got)


def test_near_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    corpus = [(1, long), (2, long + " end"), (3, long.upper()), (4, "short one here to stay")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, corpus)).collect()}
    n = len(shingles(long))
    assert got == {1: (n, 1), 2: (n + 1, 1), 3: (n, 1), 4: (1, 4)}


def test_near_against_all_pairs(spark, corpus):
    got = near_dedup.near_duplicates(frame(spark, corpus)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(components(corpus))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_large_group(spark):
    """A group far larger than a node that is compared exhaustively, and its lookalikes."""
    rng = random.Random(3)
    base = [rng.choice(VOCAB) for _ in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [rng.choice(VOCAB) for _ in range(90)]) for _ in range(60)]
    corpus = list(enumerate(texts))
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, corpus)).collect())
    want = Counter((i, c) for i, _, c in components(corpus))
    assert got == want


def test_near_many_components_in_large_nodes(spark):
    """Links at the threshold among many texts that are alike but not linked: none may be lost."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for n in range(240):
        w = list(base)
        for k in rng.sample(range(0, 200, 5), 4):  # a substitution costs five shingles
            w[k] = f"s{n}_{k}"
        texts.append(" ".join(w))
        for k in rng.sample([k for k in range(0, 200, 5) if w[k] == base[k]], 5):
            w[k] = f"t{n}_{k}"
        texts.append(" ".join(w))
    corpus = list(enumerate(texts))
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, corpus)).collect())
    assert got == Counter((i, c) for i, _, c in components(corpus))
    assert 50 < len({c for _, c in got}) < 300


def test_near_stage(spark, corpus):
    d = frame(spark, corpus)
    out = near_dedup.deduplicated(d)
    want = {i for i, _, c in components(corpus) if i is not None and i == c}
    rows = out.collect()
    assert out.columns == d.columns and {r.doc_id for r in rows if r.doc_id is not None} == want
    assert len(rows) == staying(corpus)


def removed(corpus, window=35):
    count = Counter()
    split = [(t or "").encode().split() for _, t in corpus]
    for w in split:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(corpus, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_substring_against_all_windows(spark, corpus):
    got = substring_dedup.substring_dedup(frame(spark, corpus), with_text=True).collect()
    want = removed(corpus)
    assert any(r[2] for r in want) and any(0 < r[2] < r[1] for r in want)
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_substring_every_alignment(spark):
    """Equal windows at any two offsets share an anchor."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(35)]
    texts = []
    for a in range(13):
        for _ in range(1 if a else 2):
            texts.append(" ".join([f"x{rng.random()}" for _ in range(a)] + passage + [f"y{rng.random()}"]))
    got = substring_dedup.substring_dedup(frame(spark, list(enumerate(texts)))).collect()
    assert [r.n_removed for r in got] == [35] * len(texts)
    with pytest.raises(ValueError, match="window"):
        substring_dedup.substring_dedup(frame(spark, [(1, "a")]), window=20)


def test_word_repeated_inside_one_text(spark):
    texts = [(1, " ".join(["w"] * 36)), (2, " ".join(["v"] * 35))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got == {1: 36, 2: 0}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup.exact_dedup, near_dedup.near_duplicates, substring_dedup.substring_dedup, exact_dedup.deduplicated, near_dedup.deduplicated):
        assert f(empty).count() == 0


def test_records_agree_in_both_parts():
    import numpy as np

    known = (np.array([3, 5, 5, 9], np.uint64), np.array([1, 2, 7, 4], np.uint32))
    asked = (np.array([3, 3, 5, 5, 5, 9, 10], np.uint64), np.array([1, 2, 2, 7, 8, 4, 4], np.uint32))
    assert substring_dedup._among(known, asked).tolist() == [True, False, True, True, False, True, False]


def test_substring_very_long_text(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    corpus = [(1, " ".join(long)), (2, "x " + " ".join(long[150_000:150_035]) + " y")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, corpus)).collect()}
    assert got == {1: (200_000, 35), 2: (37, 35)}


def test_exact_repeated_rows_and_names(spark):
    rows = [(1, "A", "p"), (1, "a", "q"), (1, "a", "q"), (None, "b", "r"), (None, "B", "s"), (2, "", "t"), (3, None, "u"), (7, "x " * 400_000, "v"), (8, "X " * 400_000, "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _uid string").repartition(3)
    out = exact_dedup.deduplicated(d)
    assert out.columns == d.columns
    assert Counter((r.doc_id, lower(r.text)[:2]) for r in out.collect()) == Counter([(1, "a"), (None, "b"), (3, ""), (8, "x ")])


def test_stored_tables_are_numbered_without_a_copy(spark, tmp_path, monkeypatch):
    """Stored rows have the same numbers in every scan and are not written again; other frames are."""
    from quillfin.llm import common

    d = spark.createDataFrame([(k % 40, f"{VOCAB[k % 50]} and some more words") for k in range(300)], "doc_id long, text string")
    d.repartition(7).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    own, uid = common.numbered(stored, f"{tmp_path}/copy")
    first = {tuple(r) for r in own.collect()}
    assert not (tmp_path / "copy").exists() and first == {tuple(r) for r in own.repartition(3).collect()}
    assert len({r[-1] for r in first}) == 300
    for f in (exact_dedup.deduplicated, near_dedup.deduplicated):
        out = f(stored).collect()
        assert {r.text for r in out} == {r.text for r in d.collect()} and len(out) == 50
    for k, other in enumerate((stored.where("doc_id > 3"), stored.union(stored), d)):
        own, uid = common.numbered(other, f"{tmp_path}/copy{k}")
        assert (tmp_path / f"copy{k}").exists() and own.select(uid).distinct().count() == other.count()
    monkeypatch.setattr(common, "FILE_BITS", 0)  # files that cannot be told apart
    own, uid = common.numbered(stored, f"{tmp_path}/clash")
    assert (tmp_path / "clash").exists() and own.select(uid).distinct().count() == 300
