"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text of the training fold train a linear model on the
make-up of whole texts (letter case, symbols, repetition, ...) by the non-negative unbiased
risk; the class prior is estimated from the same two samples. Negative labels are not used.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .substring_dedup import _parts
from .word_hashes import hash_words

_CLASSES = {b: 0 for b in range(256)}
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\r\x0b\x0c", b"\n"], 1):
    _CLASSES.update(dict.fromkeys(_chars, _k))
_CLASSES.update({b: 10 for b in range(128, 256)})
_LUT = np.array([_CLASSES[b] for b in range(256)], np.int64)
#: Number of features.
WIDTH = 16


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, WIDTH) numbers in which length counts little; an empty text gives zeros in most."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    kinds = np.bincount(np.repeat(np.arange(n) * 11, sizes) + _LUT[np.frombuffer(b"".join(texts), np.uint8)], minlength=n * 11).reshape(n, 11).astype(float)
    words = [t.split() for t in texts]
    h, starts = hash_words(words)
    count = np.diff(starts).astype(float)
    owner = np.repeat(np.arange(n), np.diff(starts))

    def again(lag: int) -> np.ndarray:
        if len(h) <= lag:
            return np.zeros(n)
        same = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
        return np.bincount(owner[lag:][same], minlength=n).astype(float)

    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], float)
    lines = [t.split(b"\n") for t in texts]
    twice = np.array([sum(map(len, ls)) - sum(map(len, set(ls))) for ls in lines], float)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 10] / 2
    size = sizes + 60.0
    w = count + 12
    ratios = [
        kinds[:, 1] / (letters + 60), kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size,
        kinds[:, 8] / size, kinds[:, 9] / size, kinds[:, 10] / size, kinds[:, 0] / size, again(1) / w, again(2) / w, again(3) / w, again(4) / w,
        np.maximum(0, count - distinct - 0.5 * count * (count > 0)) / w, twice / size,
    ]
    return np.stack(ratios, axis=1)


class Model:
    """score = sigmoid(bias - what each feature's distance from the trusted middle costs).

    A distance above or below the middle half of the trusted texts counts by its logarithm,
    and its weight is never positive: odd make-up cannot raise a score.
    """

    def __init__(self, middle: np.ndarray, spread: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.middle, self.spread, self.weights, self.bias, self.prior = middle, spread, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = distances(x, self.middle, self.spread) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def distances(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = (x - middle) / spread
    return np.log1p(np.concatenate([np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1))


def estimate_prior(of_positives: np.ndarray, of_unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores that rank positives high.

    Above any threshold the unlabelled hold at least the prior times the positives' share;
    the least quotient over thresholds, with an allowance for small shares, bounds the
    prior from above, tightly where some threshold leaves positives alone.
    """
    cuts = np.quantile(of_positives, np.linspace(0.0, 0.95, 96))
    p = np.array([(of_positives >= c).mean() for c in cuts])
    u = np.array([(of_unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / doubt) / 2 / len(of_positives)) + np.sqrt(np.log(4 / doubt) / 2 / len(of_unlabelled))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float | None) -> np.ndarray:
    """Of the non-negative PU risk (logistic loss) at weights ``w`` (the last one the bias).

    Where the unlabelled less the prior's share of positives falls below zero, that part is
    fitted noise, and the gradient steps back. Without a prior: positives against unlabelled.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50))) for x in (p, u))
    mean = lambda x, s: np.append(x.T @ s, s.sum()) / len(x)
    if prior is None:
        return mean(p, sp - 1) + mean(u, su)
    rest = mean(u, su) - prior * mean(p, sp)
    risk = -np.log(np.maximum(1 - su, 1e-12)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-12)).mean()
    return prior * mean(p, sp - 1) + rest if risk >= 0 else -rest


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, l2: float, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the risk's gradient, with weights that stay at or below zero."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(p, u, w, prior)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.minimum(w[:-1], 0, out=w[:-1])
    return w[:-1], float(w[-1])


def train(positives: np.ndarray, unlabelled: np.ndarray, steps: int = 400, l2: float = 1e-4) -> Model:
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 0.5)
    low, middle, high = np.quantile(positives, [0.25, 0.5, 0.75], axis=0)
    spread = high - low + 0.002
    p, u = (distances(x, middle, spread) for x in (positives, unlabelled))
    w, b = _fit(p, u, None, steps, l2)
    prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = _fit(p, u, prior, steps, l2)
    return Model(middle, spread, w, b, prior)


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _sampled(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` of df by a hash of the id, the same ones at every run."""
    total = df.count()
    share = min(1.0, rows / max(1, total))
    return df.where(F.pmod(F.xxhash64(F.lit(71), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", positives: int = 10_000, unlabelled: int = 20_000) -> Model:
    """Train on bounded samples of the training fold.

    positives, unlabelled: the most rows of each sample, however often ids repeat: about so
    many ids are chosen by their hash, and of their rows the first by a hash of id and
    text. Where that leaves a side without a row although there are some (one id holds
    nearly all), its first rows stand in. An id with several labels is a trusted positive
    only if all say 1. A side without any row gives a warning and a model that scores 0.5.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    own = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    trusted = labels.select(labels[id_col].cast("long").alias("id"), labels["quality"].alias("q")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    trusted = trusted.groupBy("id").agg(F.min("q").alias("q")).where("q = 1").select("id")
    fold = own.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = _sampled(trusted, "id", positives).withColumn("kind", F.lit(1)).union(_sampled(fold.select("id"), "id", unlabelled).distinct().withColumn("kind", F.lit(0)))
    # at most positives + unlabelled rows of 12 bytes, give or take the hash's chance
    got = _measured(own.join(F.broadcast(chosen), "id"), positives, unlabelled)
    sides = {k: got[k] if len(got[k]) else _measured(rows.withColumn("kind", F.lit(k)), positives, unlabelled)[k] for k, rows in ((1, fold.join(trusted, "id", "left_semi").limit(positives)), (0, fold.limit(unlabelled)))}
    for k, x in sides.items():
        if not len(x):
            warnings.warn(f"no {'trusted positive' if k else 'unlabelled'} row to learn from: all texts will score 0.5", stacklevel=2)
    return train(sides[1], sides[0])


def _measured(sample: DataFrame, positives: int, unlabelled: int) -> dict[int, np.ndarray]:
    """Features of the first rows of each kind by a hash of id and text, in an order of their own."""

    def measure(batches):
        for b in batches:
            at = 0
            for part in _parts(b.column("text").cast(pa.binary()).to_pylist()):
                x = [r.astype("<f4").tobytes() for r in features(part)]
                yield pa.RecordBatch.from_arrays([b.column("kind")[at : at + len(part)], b.column("by")[at : at + len(part)], pa.array(x, pa.binary())], names=["kind", "by", "x"])
                at += len(part)

    rows = sample.select("kind", F.xxhash64(F.lit(72), "id", "text").alias("by"), "text").mapInArrow(measure, "kind int, by long, x binary")
    # each task passes on so many rows of a kind at most, of some hundred bytes
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("by", "x"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= max(positives, unlabelled)).where(F.col("nth") <= F.when(F.col("kind") == 1, positives).otherwise(unlabelled))
    got = kept.select("kind", "x").toArrow()
    kind = got.column("kind").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(-1, WIDTH).astype(float)
    order = np.lexsort(x.T)  # whatever order the tasks ended in
    x, kind = x[order], kind[order]
    return {1: x[kind == 1], 0: x[kind == 0]}


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones, all alike; whole texts count, however long; repeated
    rows get the same score each; null ids are not held out; an empty table gives an empty
    result; other columns, whatever their names, are not read. A model fitted on nothing
    scores 0.5.
    """
    common.prepare(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def score(batches):
        for b in batches:
            at = 0
            for part in _parts(b.column("text").cast(pa.binary()).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + len(part)], pa.array(model.score(features(part)))], names=["doc_id", "score"])
                at += len(part)

    scored = own.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all their columns.

    Each row is judged by itself: null and empty texts as one empty text, repeated rows
    alike; an empty table stays empty.
    """
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            raw = b.column(at).cast(pa.string()).fill_null("").cast(pa.binary()).to_pylist()
            if raw:
                yield b.filter(pa.array(np.concatenate([model.score(features(p)) for p in _parts(raw)]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
