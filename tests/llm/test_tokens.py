"""BPE, token shards and token counts against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillfin.llm import bpe, common, lib_tokens, token_counts, token_sst
from quillfin.llm.transducer import Lexicon, compile_lexicon

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet=" abcXYZ's1é́ßΣσÅKİ漢🙂\n\t\r\x0b\x1c\x85\xa0 　​!?.,|<>", max_size=40) | st.text(max_size=20)
DOCS = [
    (0, "Hello world, hello WORLD!! don't"), (1, None), (2, ""), (3, "<|endoftext|> a<|startoftext|>b"), (4, "aaaa " * 500), (5, "é naïve Straße   x \t\n y"),
    (-7, "negative id"), (9, "same"), (9, "same"), (10, "x" * 70000), (11, "  \n "),
]


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, ids string, start int").repartition(3)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD, max_size=5))
def test_bpe_equals_library(texts):
    enc, lib = bpe.Encoder(bpe.vocabulary(BYTE)), Tokenizer.from_file(BYTE)
    for t, raw in zip(texts, enc.encode_batch(texts)):
        ids = np.frombuffer(raw, enc.v.dtype)
        assert ids.tolist() == ids_of(lib, t)
        assert enc.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD, max_size=5))
def test_chunks_equal_library(texts):
    enc, lib = lib_tokens.chunk_encoder(WORD), Tokenizer.from_file(WORD)
    for t, raw in zip(texts, enc.encode_batch([x.encode() for x in texts])):
        assert np.frombuffer(raw, enc.dtype).tolist() == ids_of(lib, t)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a", "été"])}
    compile_lexicon(words, tmp_path / "lex")
    lex = Lexicon(tmp_path / "lex")
    probe = [*sorted(words), b"", b"ta", b"tapsy", b"zzz", b"\xff"]
    assert lex.ordinals(probe).tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    assert [lex.ids(k).tolist() for k in range(len(words))] == [words[w] for w in sorted(words)]
    # right languages of the words' prefixes: as many states as distinct ones
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    right = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert lex.states == len(right)


def test_lexicon_changes_no_ids(tmp_path):
    v = bpe.vocabulary(BYTE)
    raw = [w.encode() for w in [" the", " of", " and", "ing", " Hello"]]
    compile_lexicon({w: np.frombuffer(i, v.dtype).tolist() for w, i in zip(raw, v.merge(raw))}, tmp_path / "lex")
    texts = ["the sound of and Hello the thing", " the", ""]
    assert bpe.Encoder(v, Lexicon(tmp_path / "lex")).encode_batch(texts) == bpe.Encoder(v).encode_batch(texts)


def test_round_trip_rows(docs, byte):
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BYTE).collect())
    want = []
    for i, t in DOCS:
        ids = ids_of(byte, t)
        text = byte.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    enc = {(r.doc_id, r.text): r.ids for r in bpe.encode(docs.drop("ids"), BYTE).collect()}
    assert all(enc[d] == ids_of(byte, d[1]) for d in DOCS)


def test_shards_round_trip(spark, docs, word):
    path = common.workspace(spark, "test-sst")
    manifest = token_sst.write_shards(docs, path, WORD, end_id=2)
    got = sorted(token_sst.read_shards(manifest).collect())
    start, want = 0, []
    for i, t in sorted(DOCS, key=lambda d: d[0]):
        ids = [*ids_of(word, t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_shard_lookup_and_damage(tmp_path):
    rng = np.random.default_rng(1)
    entries = [(int(k) * 3 - 300, rng.integers(0, 49000, rng.integers(0, 50)).astype("<u2").tobytes()) for k in range(500)]
    entries += [(entries[-1][0], b"\1\0")]  # a repeated key
    path = tmp_path / "x.sst"
    path.write_bytes(b"".join(token_sst.shard_bytes(entries, 2, block_bytes=500)))
    shard = token_sst.Shard(str(path))
    assert len(shard.index) > 10 and shard.documents == 501
    assert [(k, v.tobytes()) for k, v in shard] == entries
    for k, body in entries[:-2:37]:
        assert [x.tobytes() for x in shard.get(k)] == [body]
    assert len(shard.get(entries[-1][0])) == 2
    assert all(shard.get(k) == [] for k in (-301, -299, 10**6))
    assert sum(all(shard.bloom[p >> 3] & (1 << (p & 7)) for p in token_sst._probes(token_sst.key_of(k), len(shard.bloom) * 8)) for k in range(10**6, 10**6 + 2000)) < 60
    raw = bytearray(path.read_bytes())
    raw[len(raw) - 200] ^= 1
    for bad in (bytes(raw[:40]), bytes(raw[:-1]), b"".join(token_sst.shard_bytes([], 2))[:-4]):
        path.write_bytes(bad)
        with pytest.raises(ValueError, match="shard|index"):
            token_sst.Shard(str(path))
    with pytest.raises(ValueError, match="ascend"):
        list(token_sst.shard_bytes([(2, b""), (1, b"")], 2))


@pytest.mark.parametrize("file_bytes", [200, 64 << 20])
def test_shards_without_ids_and_with_one_id(spark, word, file_bytes):
    """Null ids are one key, before all; one id on many rows is dealt into several files."""
    rows = [(None, "nobody"), (None, None), *[(5, f"text {k} of five") for k in range(60)], (-(1 << 63), "least"), (6, "long " * 500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_sst.write_shards(table, common.workspace(spark, "t"), WORD, end_id=2, file_bytes=file_bytes, task_bytes=300)
    assert manifest.count() > 3 and token_sst.with_starts(manifest).agg({"start": "max"}).first()[0] > 0
    got = sorted(token_sst.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*ids_of(word, t), 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    wanted = spark.createDataFrame([(5,), (5,), (6,), (7,), (None,), (-(1 << 63),)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in token_sst.lookup(manifest, wanted).collect())
    assert found == sorted((i, [*ids_of(word, t), 2]) for i, t in rows if i is not None)


def test_lookup_of_a_table(spark, word, docs, monkeypatch):
    monkeypatch.setattr(token_sst, "BOUNDS", 2)
    manifest = token_sst.write_shards(docs, common.workspace(spark, "t"), WORD, end_id=2, file_bytes=100, task_bytes=50)
    found = sorted((r.doc_id, r.ids) for r in token_sst.lookup(manifest, docs).collect())
    assert found == sorted((i, [*ids_of(word, t), 2]) for i, t in DOCS)
    assert token_sst.lookup(manifest.limit(0), docs).count() == 0


@pytest.mark.parametrize("block", [500, 4096, 1 << 20])
def test_counts_across_blocks(docs, word, block):
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, WORD, 65535, block_tokens=block).collect())
    assert got == sorted((i, len(ids_of(word, t))) for i, t in DOCS)


def test_scan_of_a_given_file(spark, tmp_path):
    ids = np.array([9, 9, 5, 5, 1, 2, 3, 5, 4, 4], "<u2")  # end id 5; the last document is cut
    (tmp_path / "f.tokens").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(str(tmp_path / "f.tokens"),)], "file string")
    for block in (2, 3, 100):
        got = sorted((r.ordinal, r.start, r.n_tokens) for r in token_counts.scan(files, 5, block_tokens=block).collect())
        assert got == [(0, 0, 2), (1, 3, 0), (2, 4, 3)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(e, BYTE).count() == 0
    assert token_counts.token_counts(e, WORD, 65535).count() == 0
    assert token_sst.read_shards(token_sst.write_shards(e, common.workspace(spark, "t"), WORD)).count() == 0
