"""Each stage of the pipeline against plain Python on that stage's own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SF
from test_dedup import components, lower
from tokenizers import Tokenizer

from quillfin.llm import common, decontaminate, pu_quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "exact", "near", "benchmark", "tokens"]
    rows = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    path = common.workspace(spark, "test")
    out = common.stage(steps["quality"](spark, docs, SF), f"{path}/0")
    model = pu_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {i for i, _ in rows(out)} == {r.doc_id for r in pu_quality.classify(docs, model).where("predicted = 1").collect()}
    assert out.columns == docs.columns
    before = rows(out)
    out = common.stage(steps["exact"](spark, out, SF), f"{path}/1")
    top = defaultdict(int)
    for i, t in before:
        top[lower(t)] = max(top[lower(t)], i)
    assert sorted(i for i, _ in rows(out)) == sorted(top.values()) and out.columns == docs.columns
    before = rows(out)
    out = common.stage(steps["near"](spark, out, SF), f"{path}/2")
    assert sorted(i for i, _ in rows(out)) == sorted(i for i, _, c in components(before) if i == c) and out.columns == docs.columns
    before = rows(out)
    bad = {r.doc_id for r in decontaminate.decontaminate(out, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = common.stage(steps["benchmark"](spark, out, SF), f"{path}/3")
    assert sorted(i for i, _ in rows(clean)) == sorted(i for i, _ in before if i not in bad) and clean.columns == docs.columns
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in steps["tokens"](spark, clean, SF).collect())
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in rows(clean)}
    assert got == Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == got


def test_stages_on_odd_tables(spark):
    """Nulls, empties, repeats, clashing names and an empty table through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _uid string, _r1 long"
    text = "several sentences of plain prose, which are long enough to be judged as they are and kept by everything that follows here."
    rows = [(1, None), (2, ""), (None, text), (4, text), (4, text), (4, text + " More."), (7, text.upper()), (7, "quite another text, on other matters " * 9), (8, None)]
    odd = spark.createDataFrame([(i, t, "en", "web", 1, True, "x", 2) for i, t in rows], schema)
    for docs in (odd, odd.limit(0)):
        path = common.workspace(spark, "odd")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = common.stage(stage(spark, docs, SF), f"{path}/{k}")
            assert name == "tokens" or out.columns == odd.columns
            if name == "exact":
                assert out.count() == len({lower(r.text) for r in docs.collect()})
            if name == "near":
                assert {lower(r.text)[:9] for r in out.collect()} == {lower(r.text)[:9] for r in docs.collect()}
            docs = out
        assert docs.columns[0] == "doc_id"
