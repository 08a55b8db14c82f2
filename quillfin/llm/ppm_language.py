"""Language identification by prediction by partial matching.

Each language has context trees over bytes up to ORDER: how often each byte followed each
context. A byte costs the code length of its count in the longest context known, plus that
of an escape for every longer context without it (method C: a context with n occurrences
of d distinct bytes escapes with probability d / (n + d)). Statistics are frozen, so code
lengths are computed once for every (context, byte) seen in some language, for all
languages side by side; texts are scored by look-ups, many bytes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pu_quality import held_out
from .substring_dedup import _parts

ORDER = 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULT = np.uint32(2654435769)
_FREE = -1


class _Table:
    """Hash table from 32-bit numbers to rows."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.key, self.row, self.probes = np.zeros(size, np.uint32), np.full(size, _FREE, np.int32), 0
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            self.probes += 1
            free = self.row[at[todo]] == _FREE
            spots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.key[spots], self.row[spots] = keys[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        row = self.row[at]
        todo = np.flatnonzero((row != _FREE) & (self.key[at] != keys))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            row[todo] = self.row[at[todo]]
            todo = todo[(row[todo] != _FREE) & (self.key[at[todo]] != keys[todo])]
        row[todo] = _FREE  # no key is further from its home than that
        return row


#: A longer text is scored in slices of so many bytes.
SLICE = 1 << 20


def _joined(texts: list[bytes], lead: bytes = b"\0" * ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text led by ORDER bytes (zeros, or what stood before a slice);
    and where each begins."""
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join([x for t in texts for x in (lead, t)]), np.uint8), np.cumsum(sizes) - sizes


def _contexts(data: np.ndarray) -> np.ndarray:
    key = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        key[back:] |= data[:-back].astype(np.uint32) << np.uint32(8 * back)
    return key


class Languages:
    """Frozen statistics of some languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.names = sorted(samples)
        width = len(self.names)
        seen = []
        for name in self.names:
            data, starts = _joined(samples[name])
            key = _contexts(data)
            real = np.ones(len(data), bool)
            for k in range(ORDER):
                real[starts + k] = False
            seen.append(key[real])
        cost = np.full((1, width), 8.0)  # below order 0 all bytes are equal
        keys_below = None
        self.order = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1 & 0xFFFFFFFF)
            counts = [np.unique(k & mask, return_counts=True) for k in seen]
            keys = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.empty(0, np.uint32)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            n = np.zeros((len(keys), width))
            for j, (k, c) in enumerate(counts):
                n[np.searchsorted(keys, k), j] = c
            total, distinct = (np.stack([np.bincount(of, x[:, j], len(contexts)) for j in range(width)], axis=1) if width else np.zeros((len(contexts), 0)) for x in (n, n > 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(n / (total + distinct)[of])
            shorter = cost[np.searchsorted(keys_below, keys & (mask >> np.uint32(8)))] if order else np.repeat(cost, len(keys), axis=0)
            cost = np.where(n > 0, own, escape[of] + shorter)
            keys_below = keys
            # a context's number holds no byte, so it gets a table of its own
            self.order.append((_Table(keys), cost.astype(np.float32), _Table(contexts.astype(np.uint32)), escape.astype(np.float32)))

    def bits_of_long(self, text: bytes) -> np.ndarray:
        """(1, languages): the code length of one text, slice by slice. A slice is led by the
        ORDER bytes before it, so every byte has the context it has in the whole text."""
        total = np.zeros((1, len(self.names)))
        for i in range(0, len(text), SLICE):
            lead = text[max(0, i - ORDER) : i].rjust(ORDER, b"\0")
            total += self.bits([text[i : i + SLICE]], lead)
        return total

    def bits(self, texts: list[bytes], lead: bytes = b"\0" * ORDER) -> np.ndarray:
        """(texts, languages): code length of each text in bits."""
        width = len(self.names)
        data, starts = _joined(texts, lead)
        key = _contexts(data)
        cost = np.zeros((len(data), width), np.float32)
        todo = np.ones(len(data), bool)
        for k in range(ORDER):
            todo[starts + k] = False
        todo = np.flatnonzero(todo)
        for order in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1 & 0xFFFFFFFF)
            table, known, contexts, escape = self.order[order]
            own = key[todo] & mask
            row = table.find(own)
            hit = row >= 0
            cost[todo[hit]] += known[row[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                break
            row = contexts.find(own >> np.uint32(8))
            hit = row >= 0
            cost[todo[hit]] += escape[row[hit]]
        cost[todo] += 8.0  # a byte that no language has shown
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64) if len(texts) else np.zeros((0, width))

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.names else []
        raw = [texts[k].encode() for k in real]
        at = 0
        for part in _parts(raw, SLICE):
            bits = self.bits_of_long(part[0]) if len(part) == 1 and len(part[0]) > SLICE else self.bits(part)
            best = bits.argmin(axis=1)
            chance = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
            for k, b, c in zip(real[at : at + len(part)], best.tolist(), chance.tolist()):
                names[k], scores[k] = self.names[b], c
            at += len(part)
        return names, scores


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_rows: int = 4_000, bytes_each: int = 500_000, bytes_all: int = 125_000_000, most_languages: int = 10_000,
) -> Languages:
    """Count contexts on a bounded sample of labelled training documents.

    sample_rows: about so many documents a language; bytes_each: at most so many bytes of
    text a language, filled in the order of a hash of id and text (a text that would pass
    the bound is cut there, no other is); bytes_all: so many bytes over all languages, which
    share it evenly where there are too many for bytes_each. Every value of ``lang`` with
    text is learned; a column with more than most_languages values is no language column
    and raises an error. Rows without text, lang or id teach nothing; repeated rows count
    as often as they stand there, up to the bounds; other columns, whatever their names, are
    not read; an empty table gives no language.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    own = own.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"), 3, 1))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(F.octet_length("text"), F.lit(bytes_each))).alias("size"))
    sizes = sizes.limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    if not sizes:
        return Languages({})
    bytes_each = min(bytes_each, max(1000, bytes_all // len(sizes)))
    # a share a language that gives enough bytes, but not many more
    cuts = [(r.lang, int(min(1.0, sample_rows / r.n, 2 * bytes_each / max(1.0, r.n * r["size"]) + 20 / r.n) * 1_000_000) + 1) for r in sizes]
    told = spark.createDataFrame(cuts, "lang string, cut long")  # a row a language
    by = F.pmod(F.xxhash64(F.lit(93), "id", "text"), F.lit(1_000_000))
    rows = own.withColumn("by", by).join(F.broadcast(told), "lang")
    picked = _within(rows.where(F.col("by") < F.col("cut")), bytes_each)
    if missing := sorted({r.lang for r in sizes} - {lang for lang, _ in picked}):
        # copies of one text share a hash: all in or all out; then one of them stands for them
        first = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(F.struct("id", F.substring("text", 1, bytes_each).alias("text")), "by").alias("r"))
        picked += [(r.lang, r.text) for r in first.select("lang", "r.text").collect()]
    samples: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for lang, text in picked:
        raw = text.encode()[: room.setdefault(lang, bytes_each)]
        room[lang] -= len(raw)
        if raw:
            samples.setdefault(lang, []).append(raw)
    return Languages(dict(sorted(samples.items())))


def _within(rows: DataFrame, bytes_each: int) -> list[tuple[str, str]]:
    """(lang, text) of the rows that begin within ``bytes_each`` bytes of their language, in order of hash."""
    order = Window.partitionBy("lang").orderBy("by", "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    short = rows.select("lang", "by", "id", F.substring("text", 1, bytes_each).alias("text"))
    kept = short.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0))).where(F.col("before") < bytes_each)
    found = kept.select("lang", "before", "text").toArrow().to_pylist()
    return [(r["lang"], r["text"]) for r in sorted(found, key=lambda r: (r["lang"], r["before"], r["text"]))]


RESULT = T.StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")


def identify(docs: DataFrame, languages: Languages, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the language's share of probability).

    Texts that are null or have no letter are 'und' with score 0, and so are all if no
    language was learned. Every byte of a text counts, in its whole context however long the
    text is. Repeated rows get the same answer each; null ids are not held out.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(languages)  # its size follows from fit's bounds
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            names, scores = shared.value.identify(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=RESULT.names)

    out = own.mapInArrow(run, RESULT)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
