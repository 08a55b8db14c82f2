"""Classifier and language models: held-out accuracy, exact code lengths, isolation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from quillfin.llm import ppm_language, pu_quality

BIG = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BIG}/labels.parquet")


def test_quality_on_held_out(docs, labels):
    model = pu_quality.fit(docs, labels)
    got = {r.doc_id: r for r in pu_quality.classify(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.quality for r in held]
    assert len(held) > 40 and np.mean(right) >= 0.95
    share = np.mean([r.quality for r in labels.collect()])
    assert model.prior == pytest.approx(share, abs=0.1)
    kept = pu_quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_learns_nothing_from_held_out_labels(spark, docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = pu_quality.fit(docs, labels), pu_quality.fit(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_nonnegative_risk_recovers_prior():
    rng = np.random.default_rng(1)
    p = np.abs(rng.normal(0, 1, (2000, pu_quality.WIDTH)))
    u = np.concatenate([np.abs(rng.normal(0, 1, (2100, pu_quality.WIDTH))), 8 + rng.normal(0, 1, (900, pu_quality.WIDTH))])
    m = pu_quality.train(p, u)
    assert m.prior == pytest.approx(0.7, abs=0.1)
    assert (m.score(u[:2100]) > 0.5).mean() > 0.95 and (m.score(u[2100:]) < 0.3).mean() > 0.95
    assert (m.weights <= 0).all()


def test_quality_odd_rows(spark, labels):
    d = spark.createDataFrame([(1, None, 5), (None, "text", 5), (2, "", 5), (2, "", 5), (3, "wort " * 30000, 5)], "doc_id long, text string, score int")
    model = pu_quality.fit(d, labels)
    got = pu_quality.classify(d, model).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = pu_quality.fit(d.limit(0), labels.limit(0))
    assert pu_quality.classify(d.limit(0), none).count() == 0


def brute_bits(samples, text):
    """Code length by walking the context trees byte by byte."""
    follow = [dict() for _ in range(ppm_language.ORDER + 1)]
    for s in samples:
        data = b"\0" * ppm_language.ORDER + s
        for k in range(ppm_language.ORDER, len(data)):
            for order in range(ppm_language.ORDER + 1):
                follow[order].setdefault(data[k - order : k], Counter())[data[k]] += 1
    data, bits = b"\0" * ppm_language.ORDER + text, 0.0
    for k in range(ppm_language.ORDER, len(data)):
        for order in range(ppm_language.ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            seen = follow[order].get(data[k - order : k])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def test_code_lengths_are_exact():
    samples = {"x": [b"abracadabra", b"abc"], "y": [b"zzzzyzz \xff\x00a", b""]}
    model = ppm_language.Languages(samples)
    texts = [b"abra", b"", b"zz", b"\x00\x01q", b"cadabrazzz" * 5, b"a"]
    got = model.bits(texts)
    for t, row in zip(texts, got):
        assert row.tolist() == pytest.approx([brute_bits(samples[n], t) for n in model.names], rel=1e-5, abs=1e-4)


def test_slices_are_exact(monkeypatch):
    """A long text's code length does not depend on where it is cut."""
    rng = np.random.default_rng(4)
    samples = {k: [bytes(rng.choice(list(abc), 5000).tolist())] for k, abc in (("x", b"abcde "), ("y", b"cdefgh "))}
    model = ppm_language.Languages(samples)
    text = bytes(rng.choice(list(b"abcdefgh xyz"), 4001).tolist())
    whole = model.bits([text])
    assert whole[0].tolist() == pytest.approx([brute_bits(samples[n], text) for n in model.names], rel=1e-5)
    for size in (1, 2, 5, 1000, 4000):
        monkeypatch.setattr(ppm_language, "SLICE", size)
        assert model.bits_of_long(text)[0].tolist() == pytest.approx(whole[0].tolist(), rel=1e-9)
    monkeypatch.setattr(ppm_language, "SLICE", 1000)
    names, scores = model.identify([text.decode()])
    assert names == ["x" if whole[0][0] < whole[0][1] else "y"] and scores == pytest.approx([1.0])


def test_languages_are_bounded_and_names_clash(spark):
    rows = [(k, "the and of that", "en", 1.0, "x", True) for k in range(40)] + [(100 + k, "noise", f"junk{k}", 1.0, "x", True) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, held_out boolean")
    with pytest.raises(ValueError, match="more than 3"):  # it dropped the others once
        ppm_language.fit(d, most_languages=3)
    model = ppm_language.fit(d)
    assert set(model.names) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    got = ppm_language.identify(d, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 70


def test_risk_gradient_equals_naive():
    """The trainer's gradient against finite differences of the risk as written down."""
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(0, 1, (40, 3)), rng.normal(0.3, 1, (60, 3)), 0.4
    soft = lambda z: np.log1p(np.exp(-z))

    def parts(w):
        zp, zu = (x @ w[:-1] + w[-1] for x in (p, u))
        return prior * soft(zp).mean(), soft(-zu).mean() - prior * soft(-zp).mean()

    for w in (np.array([-0.2, -0.5, -0.1, 0.3]), np.array([0.4, -0.3, 0.2, -4.0])):
        up, rest = parts(w)
        value = lambda w, s=1 if rest >= 0 else -1: (parts(w)[0] + parts(w)[1]) if s > 0 else -parts(w)[1]
        step = 1e-6
        naive = [(value(w + step * e) - value(w - step * e)) / 2 / step for e in np.eye(4)]
        assert pu_quality.gradient(p, u, w, prior) == pytest.approx(naive, abs=1e-5)


def test_ranking_on_held_out(docs, labels):
    """AUC over held-out labels, and what the cut at 0.3 lets through."""
    got = {r.doc_id: r for r in pu_quality.classify(docs, pu_quality.fit(docs, labels)).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc >= 0.97 and np.mean([s >= 0.3 for s in good]) >= 0.97


def test_language_on_held_out(docs):
    got = {r.doc_id: r for r in ppm_language.identify(docs, ppm_language.fit(docs)).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got.values())
    assert len(held) > 100 and np.mean([lang == g.lang_pred for lang, g in held]) >= 0.97


def test_language_odd_rows(spark, docs):
    model = ppm_language.fit(docs)
    long = "und das ist nicht der " * 80_000
    d = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (None, "the and of that"), (4, "the"), (4, "the"), (5, long)], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred): r.score for r in ppm_language.identify(d, model).collect()}
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 0.0
    assert (None, "en") in got and (5, "de") in got
    nothing = ppm_language.fit(docs.limit(0))
    assert {r.lang_pred for r in ppm_language.identify(d, nothing).collect()} == {"und"}


def test_ppm_takes_picked_texts_whole(spark, monkeypatch):
    """Long texts count beyond 20,000 characters, and low ids do not come first."""
    from quillfin.llm import ppm_language

    seen = {}
    monkeypatch.setattr(ppm_language, "Languages", lambda samples: seen.update(samples))
    rows = [(k, f"{k:03d} " + "word " * 5_999, "en") for k in range(60)]
    ppm_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bytes_each=200_000)
    texts = seen["en"]
    assert sum(map(len, texts)) == 200_000 and all(len(t) == len(rows[0][1]) for t in texts[:-1])
    assert [t[:3] for t in texts] != sorted(t[:3] for t in texts)


def test_quality_samples_are_bounded_by_row(spark):
    """One id on thousands of rows, of one text or of many."""
    for text in ("concat('Some plain words of row ', k, ' are here.')", "'always the same words'"):
        docs = spark.range(5000).toDF("k").selectExpr("1L AS doc_id", f"{text} AS text")
        labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
        own = docs.selectExpr("doc_id AS id", "text").crossJoin(spark.createDataFrame([(0,), (1,)], "kind int"))
        got = pu_quality._measured(own, 10, 7)
        assert len(got[1]) == 10 and len(got[0]) == 7
        seen = []
        train, pu_quality.train = pu_quality.train, lambda p, u: seen.append((len(p), len(u))) or train(p, u)
        try:
            pu_quality.fit(docs, labels, positives=10, unlabelled=10)
        finally:
            pu_quality.train = train
        assert seen == [(10, 10)]


def test_quality_without_labels_warns(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="trusted positive"):
        model = pu_quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in pu_quality.classify(docs, model).collect()] == [0.5]


def test_languages_learn_from_one_id_and_within_bounds(spark):
    one = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1)
    same = spark.range(4000).selectExpr(f"{one}L AS doc_id", "'the very same words' AS text", "'en' AS lang")
    many = spark.range(4000).selectExpr(f"{one}L AS doc_id", "concat('mots du texte ', id) AS text", "'fr' AS lang")
    learned = ppm_language.fit(same.union(many), bytes_each=500)
    assert sorted(learned.names) == ["en", "fr"]
    rows = many.selectExpr("doc_id AS id", "text", "lang", "pmod(hash(text), 100) AS by")
    picked = ppm_language._within(rows, 500)
    assert 500 <= sum(len(t) for _, t in picked) < 540


def test_every_language_is_learned_or_an_error(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('text of language ', id % 300) AS text", "concat('l', id % 300) AS lang")
    assert set(ppm_language.fit(docs).names) == {f"l{k % 300}" for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1}
    with pytest.raises(ValueError, match="more than 5"):
        ppm_language.fit(docs, most_languages=5)
