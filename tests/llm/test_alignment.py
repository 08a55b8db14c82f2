"""Token alignment against the libraries and a plain count in memory."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillfin.llm import align_tokens, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=" abcXYZ's1ééΣÅ漢\U0001f642\n\t\r\x0b\x1c\x85\xa0 　​▁!?.,|<>;)}'\"-", max_size=40) | st.text(max_size=20)
DOCS = [
    (0, "Hello world, hello WORLD!! don't"), (1, None), (2, ""), (3, "<|endoftext|> a<s>b</s> <0x41>"), (4, "aaaa " * 500), (5, "é naïve Straße   x \t\n y"),
    (-7, "under▁score"), (9, "same text"), (9, "same text"), (10, "x" * 70000), (11, "  \n "), (None, "no id here"), (12, "if (a) {\r\n}\r\n  b();\r\n"), (13, " "), (14, "a "),
]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.of_a = bpe.Vocabulary(A).token_bytes

    def of_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def cut(self, text):
        """Groups [(a ids, b ids)] and links [(b, a)] from byte ranges."""
        if not text:
            return [], [], 0, 0
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        xa, xb = [self.of_a[i] for i in a], [self.of_b(i) for i in b]
        raw = (" " + text).encode()
        if b"".join(xa) != raw or b"".join(xb) != raw:
            return [], [], 0, 0
        ea, eb = np.cumsum([len(x) for x in xa]), np.cumsum([len(x) for x in xb])
        groups, links = [], []
        both = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups = [([], []) for _ in both]
        for side, (ids, ends) in enumerate(((a, ea), (b, eb))):
            for i, k in zip(ids, np.searchsorted(both, ends).tolist()):
                groups[k][side].append(i)
        for k, (i, e) in enumerate(zip(a, ea)):
            first, last = np.searchsorted(eb, e - len(xa[k]), "right"), np.searchsorted(eb, e, "left")
            links += [(b[j], i) for j in range(first, last + 1)]
        return groups, links, len(a), len(b)


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows):
    plain = Plain()
    cuts = [(i, *plain.cut(t)) for i, t in rows]
    count = Counter(x for c in cuts for x in c[2])
    best = defaultdict(int)
    for (b, _), n in count.items():
        best[b] = max(best[b], n)
    out = [(i, na, nb, len(g), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), text_of(g)) for i, g, links, na, nb in cuts]
    return out, count, best


def key(rows):
    return Counter(tuple(r) for r in rows)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(ODD, max_size=4))
def test_cuts_equal_libraries(texts):
    aligner, plain = align_tokens._aligner(A, B), Plain.__new__(Plain)
    plain.__dict__ = _PLAIN.__dict__
    for text, numbers in zip(texts, aligner.align(texts)):
        groups, links, *_ = plain.cut(text)
        assert ";".join(aligner.groups[n] for n in numbers) == text_of(groups)
        got = Counter(aligner.keys.take(np.array(numbers, np.int64)).tolist())
        assert got == Counter(b * aligner.a.size + a for b, a in links)


_PLAIN = Plain()


@pytest.mark.parametrize("run_records", [align_tokens.RUN_RECORDS, 40])
def test_align_equals_plain_count(spark, run_records):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, groups string, run int").repartition(3)
    out, pairs = align_tokens.aligned(docs, A, B, id_col="doc_id", text_col="text", digest=False, run_records=run_records, part_records=30)
    want, count, best = expected(DOCS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert key(out.collect()) == key(want)
    assert {(r.b, r.a): (r.n, r.best) for r in pairs.collect()} == {x: (n, n == best[x[0]]) for x, n in count.items()}


def test_query_equals_plain_count(spark):
    from quillfin.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in expected(rows)[0]]
    got = QUERIES["op13_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert key(got.collect()) == key(want)


def test_empty_table_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert align_tokens.align(none, A, B).count() == 0
    got = align_tokens.align(spark.createDataFrame([("k", "one two"), (None, None)], "doc_id string, text string"), A, B, digest=True).collect()
    assert {r.doc_id: r.n_groups for r in got} == {"k": 2, None: 0}
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in align_tokens.align(blank, A, B).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_heap_merge_sums_runs():
    rng = np.random.default_rng(3)
    total, raws = Counter(), []
    for _ in range(7):
        keys = np.sort(rng.choice(200_000, 90_000, replace=False)).astype(np.int64)
        n = rng.integers(1, 5, len(keys))
        total.update(dict(zip(keys.tolist(), n.tolist())))
        raws.append(align_tokens._sorted_run(keys, np.zeros(len(keys), np.int64), n)[0])
    keys, totals = (np.concatenate(x) for x in zip(*align_tokens.heap_merge(raws)))
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), totals.tolist())) == total
    assert list(align_tokens.heap_merge([])) == []
