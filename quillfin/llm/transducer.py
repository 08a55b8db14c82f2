"""Minimal acyclic transducer: a memory-mapped word lexicon with id outputs.

Words are byte strings. Equal suffixes share states; outputs are numbers on the arcs whose
sum along a word's path is the word's ordinal in sorted order, which selects its id
sequence. Look-ups run over many words at once, a byte position a step.
"""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np

MAGIC = b"QFMAT001"


class _Node:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final = False
        self.number = -1
        self.words = -1

    def signature(self):
        return (self.final, tuple((b, n.number) for b, n in sorted(self.arcs.items())))


def compile_lexicon(entries: dict[bytes, list[int]], path: str | Path) -> None:
    """Write the automaton of ``entries`` (word -> ids) to a local file.

    Incremental construction over the sorted words: when a word leaves a branch, the
    branch's states are replaced by registered equivalent ones, so the automaton is
    minimal at every step and never larger than the words read so far.
    """
    words = sorted(w for w in entries if w)
    root, register, states = _Node(), {}, []

    def close(path_nodes: list[tuple[_Node, int, _Node]]) -> None:
        for parent, byte, child in reversed(path_nodes):
            sig = child.signature()
            known = register.get(sig)
            if known is None:
                child.number = len(states)
                states.append(child)
                register[sig] = child
            else:
                parent.arcs[byte] = known

    open_path: list[tuple[_Node, int, _Node]] = []
    before = b""
    for w in words:
        shared = 0
        for a, b in zip(before, w):
            if a != b:
                break
            shared += 1
        close(open_path[shared:])
        del open_path[shared:]
        node = open_path[-1][2] if open_path else root
        for b in w[shared:]:
            child = _Node()
            node.arcs[b] = child
            open_path.append((node, b, child))
            node = child
        node.final = True
        before = w
    close(open_path)
    root.number = len(states)
    states.append(root)
    for s in states:  # children have lower numbers than their parents
        s.words = s.final + sum(c.words for c in s.arcs.values())
    used = sorted({b for s in states for b in s.arcs})
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    step = np.full((len(states), width), -1, np.int32)
    out = np.zeros((len(states), width), np.int32)
    final = np.array([s.final for s in states], np.int32)
    for s in states:
        skipped = int(s.final)
        for b, c in sorted(s.arcs.items()):
            step[s.number, classes[b]] = c.number
            out[s.number, classes[b]] = skipped
            skipped += c.words
    ids = [entries[w] for w in words]
    starts = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.array([i for x in ids for i in x], np.int32)
    arrays = {"classes": classes, "step": step, "out": out, "final": final, "starts": starts, "flat": flat}
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [at, list(a.shape)]
        at += a.nbytes
    text = json.dumps({"arrays": head, "root": root.number, "words": len(words)}).encode()
    text += b" " * (-(len(text) + len(MAGIC) + 4) % 8)
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", len(text)) + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a, "<i4").tobytes())


class Lexicon:
    """A compiled lexicon, memory-mapped: workers of a machine share its pages."""

    def __init__(self, path: str | Path):
        with open(path, "rb") as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{path}: not a lexicon")
            (n,) = struct.unpack("<I", f.read(4))
            head = json.loads(f.read(n))
        data = np.memmap(path, "<i4", "r", offset=len(MAGIC) + 4 + n)
        part = {k: data[at // 4 : at // 4 + int(np.prod(shape))].reshape(shape) for k, (at, shape) in head["arrays"].items()}
        self.classes, self.step, self.out, self.final, self.starts, self.flat = (part[k] for k in ("classes", "step", "out", "final", "starts", "flat"))
        self.root, self.words, self.states = head["root"], head["words"], len(self.final)

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """Per word its ordinal, -1 where the lexicon lacks it."""
        n = len(words)
        if not n or not self.words:
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        order = np.argsort(-lengths, kind="stable")
        sizes = -lengths[order]
        state = np.full(n, self.root, np.int64)
        total = np.zeros(n, np.int64)
        for k in range(int(lengths.max())):
            live = order[: np.searchsorted(sizes, -k)]  # words longer than k
            live = live[state[live] >= 0]
            if not len(live):
                break
            cls, at = data[starts[live] + k], state[live]
            total[live] += self.out[at, cls]
            state[live] = self.step[at, cls]
        found = (state >= 0) & (lengths > 0)
        found[found] = self.final[state[found]] == 1
        return np.where(found, total, -1)

    def ids(self, ordinal: int) -> np.ndarray:
        return self.flat[self.starts[ordinal] : self.starts[ordinal + 1]]
