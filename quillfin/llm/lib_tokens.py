"""Whole-text encoding with the tokenizers library, each distinct chunk of text once.

A chunk is a maximal run without ASCII white space. For a tokenizer that drops white space,
splits letters from punctuation and ends words with a mark, a text's ids are its chunks' ids
in order, so the library encodes a chunk once and a memo serves its repetitions. White
space put between a letter and ASCII punctuation, and A-Z in lower case, change no id as
long as no combining mark is near; texts with one, or with a special token, stay as they are.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from . import common


#: An ASCII or Latin-1 letter (in UTF-8) before ASCII punctuation other than the apostrophe.
_EDGE = re.compile(rb"([a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([!-&(-/:-@\[-`{-~]+)")


def chunks(text: bytes) -> list[bytes]:
    if b"\xcc" in text or b"\xcd" in text or b"<|" in text:  # U+0300 to U+037F
        return text.split()
    return _EDGE.sub(rb"\1 \2", text).lower().split()


class ChunkEncoder:
    """encode_batch(texts) -> one little-endian id array (uint16 or uint32) per text.

    separator: a special token of the vocabulary; chunks to encode are strung together
    with it, so that one call of the library encodes many.
    """

    def __init__(self, path: str, memo_entries: int = 1_000_000, separator: str = "<|startoftext|>"):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # the same model behind a plain splitter, for words that are in normal form already
        self.plain = Tokenizer.from_file(path)
        self.plain.no_padding()
        self.plain.no_truncation()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator, self.sep_id = separator, self.tokenizer.token_to_id(separator)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.memo_entries = memo_entries

    def _learn(self, missing: list[bytes]) -> None:
        one = functools.partial(self.tokenizer.encode, add_special_tokens=False)
        words, mixed, odd = [], [], []
        for c in missing:
            t = c.decode("utf-8", "replace")
            if t.isalpha() and (t.isascii() or max(t) < "\u0100"):
                words.append((c, t.lower()))  # one word, composed; whatever stands around it
            else:
                (odd if "<|" in t else mixed).append((c, t))
        for c, t in odd:
            self.memo[c] = np.asarray(one(t).ids, dtype=self.dtype).tobytes()
        quick = functools.partial(self.plain.encode, add_special_tokens=False)
        for own, between, last, of in ((words, " ", False, quick), (mixed, self.separator, True, one)):
            for i in range(0, len(own), 2000):
                part = own[i : i + 2000]
                ids = np.asarray(of(between.join([t for _, t in part])).ids, dtype=self.dtype)
                w, raw = self.dtype.itemsize, ids.tobytes()
                if last:
                    at = np.flatnonzero(ids == self.sep_id)
                    starts, ends = [0, *((at + 1) * w).tolist()], [*(at * w).tolist(), len(raw)]
                else:
                    ends = ((np.flatnonzero(self.ends[ids]) + 1) * w).tolist()
                    starts = [0, *ends[:-1]]
                if len(starts) != len(part):
                    raise AssertionError("the tokenizer does not keep chunks apart")
                self.memo.update(zip([c for c, _ in part], [raw[a:b] for a, b in zip(starts, ends)]))

    def encode_batch(self, texts: list[bytes], bytes_at_once: int = 4 << 20) -> list[bytes]:
        """Per text its ids; asks the library for the new chunks of many texts in one go."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= bytes_at_once):
                size += len(texts[j])
                j += 1
            split = [chunks(t) for t in texts[i:j]]
            if len(self.memo) > self.memo_entries:
                self.memo.clear()
            missing = {w for words in split for w in words if w not in self.memo}
            if missing:
                self._learn(list(missing))
            memo = self.memo
            out += [b"".join([memo[w] for w in words]) for words in split]
            i = j
        return out


_encoders: dict[str, ChunkEncoder] = {}
common.memo("chunks", _encoders.clear)


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for the life of a Python worker."""
    common.using("chunks")
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
