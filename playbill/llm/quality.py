"""Operator 1: a quality classifier from positives and unlabelled text only.

A logistic model over the shape of a text (which bytes, which pairs of kinds of bytes, how much is repeated) is fitted by the
non-negative unbiased risk: with the class prior p, the risk of the negatives is what the unlabelled texts have beyond p times
the positives' share, and where an update would drive that estimate below zero it is turned round instead. The prior is
estimated from the positives and the unlabelled texts alone: a model that tells the two apart needs no prior; above any of its
scores the share of unlabelled texts is at least p times the positives' share. The quotient is read at the score where it,
with the sampling error of both shares, is least. Labelled negatives are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, narrow, sampled, text_bytes

#: Trusted positives and unlabelled texts used, at most; the bounds of the training sample.
TRAIN_POSITIVE, TRAIN_UNLABELLED = 8000, 12000

# kinds of bytes: lower, upper, digit, blank, line end, non-ASCII, and one each for common marks
_KINDS = 20
_KIND = np.full(256, 5, np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 11, 12, 32]] = 3
_KIND[[10, 13]] = 4
for _place, _mark in enumerate(".,|!*%$#&-:;\"'", start=6):
    _KIND[ord(_mark)] = min(_place, _KINDS - 1)
_KIND[[b for b in range(33, 127) if _KIND[b] == 5]] = _KINDS - 1
REPEATS = 12
WIDTH = _KINDS + _KINDS * _KINDS + REPEATS


def _repetition(words: list[bytes], size: int) -> tuple[float, ...]:
    """How long a text and its words are, and how much it repeats words, neighbours and pairs; with squares."""
    n = len(words)
    distinct, pairs = len(set(words)), len(set(zip(words, words[1:])))
    x = (
        math.log1p(n) / 10,
        math.log1p(size / max(1, n)) / 5,
        1 - distinct / max(1, n),
        math.log1p(distinct) / math.log1p(max(1, n)),  # falls slowly with the length of prose
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n),
        1 - pairs / max(1, n - 1),
    )
    return (*x, *(v * v for v in x))


def features(column: pa.Array) -> np.ndarray:
    """(rows, WIDTH): log-scaled shares of kinds and pairs of kinds, and measures of repetition; empty texts are zero."""
    data, starts = text_bytes(column)
    kind = _KIND[data]
    pairs = kind[:-1] * _KINDS + kind[1:]
    out = np.zeros((len(column), WIDTH), np.float32)
    for row, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if hi == lo:
            continue
        out[row, :_KINDS] = np.bincount(kind[lo:hi], minlength=_KINDS) / (hi - lo)
        if hi - lo > 1:
            out[row, _KINDS:-REPEATS] = np.bincount(pairs[lo : hi - 1], minlength=_KINDS * _KINDS) / (hi - lo - 1)
        out[row, -REPEATS:] = _repetition(data[lo:hi].tobytes().split(), hi - lo)
    out[:, :-REPEATS] = np.log1p(1000 * out[:, :-REPEATS]) / 7
    return out


@dataclass
class QualityModel:
    """A linear model on standardised features, and the class prior that it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """For the logistic loss: the positives' risk prior * R_p(+1), the negatives' R_u(-1) - prior * R_p(-1), and their gradients."""
    v = w.astype(positive.dtype)  # samples are kept in single precision
    zp, zu = positive @ v, unlabelled @ v
    plus = prior * np.logaddexp(0, -zp).mean()
    minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up = _sigmoid(zp)
    of_plus = prior * (positive.T @ (up - 1)) / len(positive)
    of_minus = unlabelled.T @ _sigmoid(zu) / len(unlabelled) - prior * (positive.T @ up) / len(positive)
    return float(plus), float(minus), of_plus, of_minus


#: Steps of Adam, whatever the size of the sample, and texts of either kind in a step, about.
STEPS, BATCH = 720, 1000


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> QualityModel:
    """Minimise prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) for the logistic loss, by minibatch Adam.

    Without a prior: tell positives and unlabelled texts apart, both classes weighing the same.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale < 1e-3, 1, scale)
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v, average, rng = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), np.random.default_rng(seed)
    parts = max(1, min(len(p), len(u), round(len(u) / BATCH)))
    batches: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, STEPS + 1):
        if not batches:
            batches = list(zip(np.array_split(rng.permutation(len(p)), parts), np.array_split(rng.permutation(len(u)), parts)))
        a, b = batches.pop()
        if prior is None:
            single, xp, xu = w.astype(p.dtype), p[a], u[b]
            grad = xp.T @ (_sigmoid(xp @ single) - 1) / len(a) + xu.T @ _sigmoid(xu @ single) / len(b)
        else:
            _, minus, of_plus, of_minus = risk(w, p[a], u[b], prior)
            grad = of_plus + of_minus if minus >= 0 else -of_minus
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > STEPS // 2:
            average += w / (STEPS - STEPS // 2)
    return QualityModel(mean, scale, average[:-1], float(average[-1]), math.nan if prior is None else prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled texts.

    Each half is scored by a model of the other half that tells positives from unlabelled texts. For every score c, of the
    shares u(c) and p(c) above it, u / p bounds the prior; it is read where u / p plus the sampling error of both shares (with
    probability 1 - `doubt`, over p) is least. The same rule at any size; one text of a kind is scored by its own model.
    """
    scores: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for half in (0, 1):
        (learn_p, test_p), (learn_u, test_u) = ((x[half::2], x[1 - half :: 2]) if len(x) > 1 else (x, x) for x in (positive, unlabelled))
        model = fit(learn_p, learn_u, None)
        scores[0].append(model.score(test_p))
        scores[1].append(model.score(test_u))
    p, u = (np.sort(np.concatenate(s)) for s in scores)
    cut = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    error = sum(math.sqrt(math.log(4 / doubt) / 2 / len(x)) for x in (p, u))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, usable: Column, positives: int = TRAIN_POSITIVE, unlabelled: int = TRAIN_UNLABELLED) -> QualityModel | None:
    """Fit on bounded samples of the rows for which `usable` (a condition on doc_id) holds.

    Labels are read only where `usable` holds, and only the positives; a null label or id is no label. Samples are taken by a
    hash, and cut at the bound by it, so repeated ids or rows cannot exceed it. None if there are no positives or no texts.
    """
    trusted = narrow(labels, doc_id="long", quality="int").where(usable & F.col("doc_id").isNotNull() & (F.col("quality") == 1))
    docs = narrow(docs, doc_id="long", text="string").where(usable)
    ids = sampled(trusted, positives, "positive", "doc_id").groupBy("doc_id").agg(F.min("lot").alias("lot")).orderBy("lot", "doc_id").limit(positives)
    chosen = {1: (docs.join(F.broadcast(ids), "doc_id"), positives), 0: (sampled(docs, unlabelled, "unlabelled", "doc_id", "text"), unlabelled)}

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text")).astype(np.float16)
        return pa.record_batch([batch.column("lot"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lot", "x"])

    samples = {}
    for y, (rows, bound) in chosen.items():
        got = map_batches(rows.select("lot", "text"), measure, "lot long, x binary").orderBy("lot", "x").limit(bound).toArrow()
        if not got.num_rows:
            return None
        samples[y] = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit(samples[1], samples[0], estimate_prior(samples[1], samples[0]))


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: good quality likelier), predicted (1 if score >= 0.5).

    Null text counts as empty; empty texts are scored too. Without a model (no trusted positives) every score is 0.5. Every
    row gives a row, repeats too; only doc_id and text are read. An empty table gives an empty result.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        s = np.full(rows.num_rows, 0.5) if model is None else model.score(features(rows.column("text"))).astype(float)
        return pa.record_batch([rows.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(narrow(docs, doc_id="long", text="string"), batch, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The documents whose score is at least 0.5, all columns as they were; the rows stay where they are."""
    if model is None:
        return docs

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(model.score(features(rows.column("text"))) >= 0.5))

    return map_batches(docs, batch, docs.schema)
