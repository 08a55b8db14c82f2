"""Byte-level BPE: encoding over a minimal acyclic transducer lexicon, and decoding.

Frequent words, counted over all documents, are compiled with their ids into a
shared-suffix automaton that workers memory-map; words it lacks are merged exactly, many at
once: each round finds every word's lowest-ranked pair by a hash of the merge table and
joins its occurrences from left to right. Results equal the tokenizers library's.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .transducer import Lexicon, compile_lexicon

#: Fixed value: the byte-level BPE splitting pattern of the public 50k vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, and controls on which engines differ: such texts are split whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: White space and a word of plain letters before punctuation, or white space and all up to the next.
_CHUNK = re.compile(r"[ \t-\r]*+(?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[ \t-\r!-&(-/:-@\[-`{-~]|\Z)|[^ \t-\r]+)|[ \t-\r]+")
#: As the library's engine sees them: White_Space without the information separators.
_SPLIT = regex.compile(SPLIT.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Vocabulary:
    """Merge table and token bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._hash(left << np.uint64(32) | right)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    _MULT = np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, pairs: np.ndarray) -> None:
        """Open addressing with linear probing, filled round by round."""
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_rank = np.full(1 << bits, len(pairs), np.int64)
        self.none = len(pairs)
        todo, at = np.arange(len(pairs)), ((pairs * self._MULT) >> self.shift).astype(np.int64)
        self.longest = 0
        while len(todo):
            self.longest += 1
            free = self.slot_key[at[todo]] == np.uint64(2**64 - 1)
            spots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.slot_key[spots], self.slot_rank[spots] = pairs[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        at = ((pairs * self._MULT) >> self.shift).astype(np.int64)
        key = self.slot_key[at]
        out = np.where(key == pairs, self.slot_rank[at], self.none)
        todo = np.flatnonzero((key != pairs) & (key != np.uint64(2**64 - 1)))
        for _ in range(self.longest):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            key = self.slot_key[at[todo]]
            hit = key == pairs[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (key != np.uint64(2**64 - 1))]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact BPE of each word, all at once: little-endian id arrays."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), lengths)
        done_sym, done_word = [], []
        while len(sym):
            # pairs of neighbours in one word
            last = np.empty(len(sym), bool)
            last[-1] = True
            np.not_equal(word[1:], word[:-1], out=last[:-1])
            rank = np.full(len(sym), self.none, np.int64)
            inner = np.flatnonzero(~last)
            rank[inner] = self.ranks(sym[inner].astype(np.uint64) << np.uint64(32) | sym[inner + 1].astype(np.uint64))
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            ended = best == self.none
            if ended.any():
                over = np.repeat(ended, sizes)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                best, sizes = best[~ended], sizes[~ended]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # of overlapping occurrences (a run of neighbours) every second one counts
            run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return [b""] * n
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        raw = np.concatenate(done_sym)[order].astype(self.dtype).tobytes()
        ends = np.cumsum(np.bincount(word, minlength=n)) * self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """encode/decode with a vocabulary and, if given, a compiled lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo_entries: int = 400_000):
        self.v, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, bytes] = {}
        self.memo_entries = memo_entries
        if lexicon is not None:
            self.lex_raw = np.asarray(lexicon.flat).astype(vocabulary.dtype).tobytes()
            self.lex_starts = (np.asarray(lexicon.starts, np.int64) * vocabulary.dtype.itemsize).tolist()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def words_to_ids(self, words: list[bytes]) -> list[bytes]:
        if self.lexicon is None:
            return self.v.merge(words)
        raw, starts = self.lex_raw, self.lex_starts
        ordinals = self.lexicon.ordinals(words).tolist()
        out = [raw[starts[o] : starts[o + 1]] if o >= 0 else b"" for o in ordinals]
        rest = [k for k, o in enumerate(ordinals) if o < 0]
        for k, ids in zip(rest, self.v.merge([words[k] for k in rest])):
            out[k] = ids
        return out

    def _learn(self, chunks: list[str]) -> None:
        split = [[c] if c.isascii() and (c[1:] if c[0] == " " else c).isalpha() else _SPLIT.findall(c) for c in chunks]
        words = list({w for s in split for w in s})
        ids = dict(zip(words, self.words_to_ids([w.encode() for w in words])))
        self.memo.update([(c, ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s])) for c, s in zip(chunks, split)])

    def _pieces(self, text: str) -> list[str]:
        """Special tokens and chunks that split alone as they do in the text."""
        if self.special is not None and self.special.search(text):
            return [p for k, part in enumerate(self.special.split(text)) for p in ([part] if k % 2 else self._pieces(part))]
        if not text:
            return []
        return [text] if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def encode_batch(self, texts: list[str], chars_at_once: int = 2 << 20) -> list[bytes]:
        """Per text its ids as a little-endian array (uint16 or uint32)."""
        out, i, memo = [], 0, self.memo
        one = {t: np.asarray([n], self.v.dtype).tobytes() for t, n in self.v.special.items()}
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= chars_at_once):
                size += len(texts[j])
                j += 1
            pieces = [self._pieces(t) for t in texts[i:j]]
            if len(memo) > self.memo_entries:
                memo.clear()
            memo.update(one)
            missing = {p for ps in pieces for p in ps if p not in memo}
            if missing:
                self._learn(list(missing))
            out += [b"".join([memo[p] for p in ps]) for ps in pieces]
            for p in [p for p in missing if len(p) > 1000]:
                del memo[p]  # whole texts need no memory
            i = j
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.v.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_worker: dict[str, tuple[str, Encoder]] = {}
common.memo("bpe", _worker.clear)


def worker_encoder(path: str, lexicon_file: str) -> Encoder:
    """One for the life of a Python worker; a new lexicon takes over the memo, whose ids hold."""
    common.using("bpe")
    name, encoder = _worker.get(path, ("", None))
    if encoder is None or name != lexicon_file:
        fresh = Encoder(vocabulary(path), Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)
        if encoder is not None:
            fresh.memo = encoder.memo
        _worker[path] = (lexicon_file, fresh)
    return _worker[path][1]


def frequent_words(texts: DataFrame, top: int, rare: float = 2e-6) -> list[str]:
    """The ``top`` most frequent words over all texts (one string column).

    A task counts all its words and passes on those with over ``rare`` of its total, so a
    word that is that frequent in the corpus is passed on by some task; sums of these
    counts rank the words. The choice decides speed, never ids.
    """

    def count(batches):
        total: Counter[str] = Counter()
        chunks: Counter[str] = Counter()

        def settle() -> None:
            for c, n in chunks.items():
                for w in _SPLIT.findall(c):
                    total[w] += n
            chunks.clear()
            if len(total) > 400_000:  # bounded memory: the rarest go
                least = sorted(total.values())[len(total) - 200_000]
                for w in [w for w, n in total.items() if n <= least]:
                    del total[w]

        for b in batches:
            for t in b.column(0).to_pylist():
                chunks.update(_CHUNK.findall(t or ""))
                if len(chunks) > 200_000:
                    settle()
        settle()
        least = max(2, rare * sum(total.values()))
        kept = [(w, n) for w, n in total.items() if n >= least and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = common.stage(counted.withColumn("size", F.floor(F.log2("n") * 64).cast("int")), common.workspace(texts.sparkSession, "words"))
    # how many words are how frequent (some thousand rows), then the words above the cut and
    # of the words at the cut a share by their hash: about ``top`` reach the driver
    room, cut, share = top, 0, 1.0
    for size, words in sorted(((r["size"], r["count"]) for r in counted.groupBy("size").count().collect()), reverse=True):
        cut, share = size, min(1.0, room / words)
        room -= words
        if room <= 0:
            break
    at_cut = (F.col("size") == cut) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000))
    return [r.word for r in counted.where((F.col("size") > cut) | at_cut).select("word", "n").collect()]


def ship_lexicon(spark: SparkSession, tokenizer_path: str, words: list[str]) -> str:
    """Compile words with their ids and send the file to every executor; its name there."""
    v = vocabulary(tokenizer_path)
    raw = [w.encode() for w in words]
    to = os.path.join(tempfile.mkdtemp(prefix="quillfin-lex-"), f"lexicon-{uuid.uuid4().hex}.bin")
    compile_lexicon({w: np.frombuffer(ids, v.dtype).tolist() for w, ids in zip(raw, v.merge(raw))}, to)
    spark.sparkContext.addFile(to)
    return os.path.basename(to)


ROUND_TRIP = T.StructType().add("doc_id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")


def round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 32_768) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids as u32), decoded_sha256.

    Encodes whole texts, then decodes the ids. Null texts count as empty (no ids). Ids may
    be null or repeat: a row out for each row in. Other columns are not read.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    lexicon = ship_lexicon(spark, tokenizer_path, frequent_words(own.select("text"), lexicon_words))

    def digest(batches):
        encoder = worker_encoder(tokenizer_path, lexicon)
        dtype = encoder.v.dtype
        for b in batches:
            ids = [np.frombuffer(x, dtype) for x in encoder.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=ROUND_TRIP.names,
            )

    return own.mapInArrow(digest, ROUND_TRIP)


def encode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", ids_col: str = "ids", lexicon_words: int = 32_768) -> DataFrame:
    """``docs`` with the ids of each text as an array column; null texts give no ids."""
    spark = docs.sparkSession
    common.prepare(spark)
    lexicon = ship_lexicon(spark, tokenizer_path, frequent_words(docs.select(docs[text_col].cast("string")), lexicon_words))

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        import pandas as pd

        encoder = worker_encoder(tokenizer_path, lexicon)
        return pd.Series([np.frombuffer(x, encoder.v.dtype).astype("int32") for x in encoder.encode_batch([t or "" for t in texts])])

    return docs.withColumn(ids_col, ids_of(docs[text_col].cast("string")))
