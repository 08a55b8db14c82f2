"""Words of texts as 64-bit numbers, and hashes of runs of words, for whole batches."""

from __future__ import annotations

from array import array

import numpy as np
import xxhash

from . import common

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


class _Memo(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class _Pairs(dict):
    """word -> number of two independent 64-bit hashes of it, bounded."""

    def __init__(self):
        self.high, self.low = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.high.append(h >> 64)
        self.low.append(h & 0xFFFFFFFFFFFFFFFF)
        n = self[word] = len(self.high) - 1
        return n

    def forget(self) -> None:
        self.clear()
        self.high, self.low = array("Q"), array("Q")


_memo, _pairs = _Memo(), _Pairs()


def _forget() -> None:
    _memo.clear()
    _pairs.forget()


common.memo("words", _forget)


def split_words(text: bytes) -> list[bytes]:
    """Maximal runs without the ASCII white space bytes 20 and 09 to 0D."""
    return text.split()


def hash_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in one array, and where each text begins (one more for the end)."""
    common.using("words")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    out = np.empty(int(starts[-1]), np.uint64)
    look = _memo.__getitem__
    for w, a, b in zip(words, starts[:-1].tolist(), starts[1:].tolist()):
        if b > a:
            out[a:b] = np.fromiter(map(look, w), np.uint64, b - a)
    return out, starts


def hash_words_twice(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hash_words`, with two arrays of hashes that are independent of each other."""
    common.using("words")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    if len(_pairs.high) > 300_000:
        _pairs.forget()
    look = _pairs.__getitem__
    at = np.empty(int(starts[-1]), np.int64)
    for w, a, b in zip(words, starts[:-1].tolist(), starts[1:].tolist()):
        if b > a:
            at[a:b] = np.fromiter(map(look, w), np.int64, b - a)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), starts
    return np.frombuffer(_pairs.high, np.uint64)[at], np.frombuffer(_pairs.low, np.uint64)[at], starts


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hash arrays."""
    h = (a * _M1) ^ b
    h ^= h >> _S
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` numbers from each position on (by doubling).

    Positions within ``length`` - 1 of the end are left out; runs that cross from one text
    to the next are the caller's to mask.
    """
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, done, out, at = h, 0, None, 1
    while True:
        if length & at:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out, part)
            done += at
        if at * 2 > length:
            return out
        power = mix(power[:-at], power[at:])
        at *= 2
