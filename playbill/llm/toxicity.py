"""Operator 9: toxic spans by a linear-chain conditional random field.

Tokens are labelled from the document labels: a word, or a word's first letters, that is common in toxic documents and
(nearly) absent from the others marks a token of a toxic document as toxic; how many witnesses that takes follows from the
number of words tested. A two-state chain learns these labels from hashed features of the token; forward-backward gives each
token's marginal. A document's score is a logistic function of its greatest marginal and of the expected number of toxic
tokens; tokens with a marginal of at least one half are its offending offsets. Training uses bounded samples of labelled rows;
everything else covers whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import lot, map_batches, narrow, persist_table, pieces, sampled

#: Labelled documents of either class used, at most; the bounds of the training sample.
TRAIN_DOCS = 3000
#: Sequences of each kind that the chain is fitted on, at most, and their length in tokens.
TRAIN_SEQUENCES, SEQUENCE = 4000, 48
#: Marks are this many times as frequent in toxic documents (as a natural logarithm), and a share of them, at most, is due to chance.
MARK_LIFT, MARK_FALSE = 3.0, 0.05
BUCKETS = 1 << 16
#: Letters of a word that count as its own mark.
LONG = 48
_TOKEN = re.compile(r"[^\W_]+")
#: Scores of distinct tokens that a worker keeps; beyond this it starts anew.
MEMO = 200_000


def stems(token: str) -> list[str]:
    """The word itself, or the start of a very long one, and its first 4 to 6 letters, if it has more."""
    return [token[:LONG], *(token[:k] + "~" for k in (4, 5, 6) if len(token) > k)]


def token_features(token: str) -> list[int]:
    """Hashed features of a token: word, first and last letters, length."""
    n = len(token)
    names = [f"w{token}", f"n{min(n, 12)}", *(f"p{token[:k]}" for k in (3, 4, 5, 6) if n >= k), f"s{token[-3:]}"]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in names]


# -- the chain ------------------------------------------------------------------------------------------------------


def marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(state 1) of every token of many sequences laid end to end.

    emit: (n,) log-odds of state 1; trans: (2, 2) and start: (2,) scores; first: (n,) true where a sequence begins. A
    sequence's beginning forgets the state before it, so the whole batch is one chain. It is cut into rows of about the
    square root of its length: first every row's product of step matrices, then the state at each row's edge, then the
    steps within all rows at once, the four entries of a step in arrays of their own. Exact up to rounding.
    """
    n = len(emit)
    if not n:
        return np.zeros(0)
    length = max(8, int(math.sqrt(n)))
    rows = -(-n // length)
    pad = rows * length - n
    # m[i][j][t]: from state i at t-1 to j at t, with t's emission; a step's scale does not matter, so its largest entry is 1
    e = np.clip(emit, -40, 40)
    scale = np.maximum(e, 0)
    m = [[None, None], [None, None]]
    for i in (0, 1):
        for j in (0, 1):
            x = np.exp(np.where(first, start[j] - start.max(), trans[i, j] - trans.max()) + (e if j else 0) - scale)
            m[i][j] = np.append(x, np.full(pad, float(i == j))).reshape(rows, length).T.copy()
    (a, b), (c, d) = m
    wa, wb, wc, wd = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(length):
        wa, wb, wc, wd = wa * a[t] + wb * c[t], wa * b[t] + wb * d[t], wc * a[t] + wd * c[t], wc * b[t] + wd * d[t]
        top = 1 / np.maximum(np.maximum(wa, wb), np.maximum(wc, wd))
        wa, wb, wc, wd = wa * top, wb * top, wc * top, wd * top
    # the share of state 1 before each row, and the weight of state 1 for what follows it
    ahead, behind = np.empty(rows), np.empty(rows)
    whole = list(zip(wa.tolist(), wb.tolist(), wc.tolist(), wd.tolist()))
    p = 0.5
    for r, (x, y, z, u) in enumerate(whole):
        ahead[r] = p
        zero, one = (1 - p) * x + p * z, (1 - p) * y + p * u
        p = one / (zero + one)
    p = 0.5
    for r in range(rows - 1, -1, -1):
        x, y, z, u = whole[r]
        behind[r] = p
        zero, one = x * (1 - p) + y * p, z * (1 - p) + u * p
        p = one / (zero + one)
    alpha = np.empty((length, rows))
    for t in range(length):
        zero, one = (1 - ahead) * a[t] + ahead * c[t], (1 - ahead) * b[t] + ahead * d[t]
        ahead = one / (zero + one)
        alpha[t] = ahead
    for t in range(length - 1, -1, -1):
        one = alpha[t] * behind
        alpha[t] = one / (one + (1 - alpha[t]) * (1 - behind))
        zero, one = a[t] * (1 - behind) + b[t] * behind, c[t] * (1 - behind) + d[t] * behind
        behind = one / (zero + one)
    return alpha.T.reshape(-1)[:n]


@dataclass
class Chain:
    """weights: (BUCKETS,) of state 1; trans, start: scores of states; level: bias, and weights of the two document features."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    level: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0]))

    def emission(self, token: str) -> float:
        return float(sum(self.weights[k] for k in token_features(token)))

    def scores(self, documents: np.ndarray) -> np.ndarray:
        """documents: (n, 2) of greatest log-odds and log of one plus the expected count."""
        return 1 / (1 + np.exp(-np.clip(self.level[0] + documents @ self.level[1:], -30, 30)))


class Sequences:
    """Labelled sequences as arrays, for the likelihood: places x sequences, and each distinct word's features."""

    def __init__(self, sequences: list[list[str]], states: list[list[int]]) -> None:
        words = sorted({w for s in sequences for w in s})
        place = {w: k for k, w in enumerate(words)}
        feats = [token_features(w) for w in words]
        self.words = len(words)
        self.owner = np.repeat(np.arange(len(words)), [len(f) for f in feats])
        self.bucket = np.array([b for f in feats for b in f], np.int64)
        shape = max(map(len, sequences)), len(sequences)
        self.ids, self.y, self.live = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        for k, (s, z) in enumerate(zip(sequences, states)):
            self.ids[: len(s), k], self.y[: len(s), k], self.live[: len(s), k] = [place[w] for w in s], z, True

    def loss(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative conditional log-likelihood of all states, and its gradient. w: weights, transitions, starts."""
        ids, y, live, (length, n) = self.ids, self.y, self.live, self.ids.shape
        trans, start = w[BUCKETS : BUCKETS + 4].reshape(2, 2), w[BUCKETS + 4 :]
        emit = np.stack((np.zeros((length, n)), np.bincount(self.owner, w[self.bucket], self.words)[ids]), 2)
        alpha, beta = np.empty((length, n, 2)), np.zeros((length, n, 2))
        alpha[0] = start + emit[0]
        for t in range(1, length):
            alpha[t] = np.where(live[t][:, None], np.logaddexp(alpha[t - 1][:, :1] + trans[0], alpha[t - 1][:, 1:] + trans[1]) + emit[t], alpha[t - 1])
        for t in range(length - 2, -1, -1):
            ahead = emit[t + 1] + beta[t + 1]
            beta[t] = np.where(live[t + 1][:, None], np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:]), 0)
        norm = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - norm)
        pair = np.exp(alpha[:-1, :, :, None] + trans + (emit + beta)[1:, :, None, :] - norm[None, :, None, None])
        both = live[1:]
        gold = np.bincount((y[:-1] * 2 + y[1:])[both], minlength=4)
        gold_start = np.bincount(y[0], minlength=2)
        grad = np.empty(BUCKETS + 6)
        grad[:BUCKETS] = np.bincount(self.bucket, np.bincount(ids[live], (p - y)[live], self.words)[self.owner], BUCKETS)
        grad[BUCKETS : BUCKETS + 4] = pair[both].sum(axis=0).reshape(-1) - gold
        grad[BUCKETS + 4 :] = np.exp(alpha[0] + beta[0] - norm[:, None]).sum(axis=0) - gold_start
        right = (emit[..., 1] * y)[live].sum() + trans.reshape(-1) @ gold + start @ gold_start
        return float(norm.sum() - right), grad


def fit_chain(sequences: list[list[str]], states: list[list[int]], epochs: int = 25, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by Adam; all sequences are stepped through together."""
    data = Sequences(sequences, states)
    total = data.live.sum()
    w, m, v = np.zeros(BUCKETS + 6), np.zeros(BUCKETS + 6), np.zeros(BUCKETS + 6)
    for turn in range(1, epochs + 1):
        grad = data.loss(w)[1] / total * 100 + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Chain(w[:BUCKETS].copy(), w[BUCKETS : BUCKETS + 4].reshape(2, 2).copy(), w[BUCKETS + 4 :].copy())


class Tagger:
    """Tags batches of texts; keeps the emissions of tokens seen."""

    def __init__(self, chain: Chain) -> None:
        self.chain, self.memo, self.weights = chain, {}, chain.weights.tolist()

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The marginals of all tokens, and each text's first token (one more at the end)."""
        found = [_TOKEN.findall((t or "").lower()) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(chained.from_iterable(found)).difference(memo):
            memo[w] = sum(map(self.weights.__getitem__, token_features(w)))
        starts = np.concatenate(([0], np.cumsum(list(map(len, found))))).astype(np.int64)
        emit = np.fromiter(map(memo.__getitem__, chained.from_iterable(found)), float, int(starts[-1]))
        first = np.zeros(len(emit), bool)
        first[starts[:-1][starts[:-1] < len(emit)]] = True
        return marginals(emit, self.chain.trans, self.chain.start, first), starts

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, 2): each text's greatest log-odds, and log of one plus its expected toxic tokens; and what `tag` gives."""
        p, starts = self.tag(texts)
        out = np.tile([-20.0, 0.0], (len(texts), 1))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            top = np.clip(np.maximum.reduceat(p, starts[some]), 1e-9, 1 - 1e-9)
            out[some] = np.stack((np.log(top / (1 - top)), np.log1p(np.add.reduceat(p, starts[some]))), 1)
        return out, p, starts


# -- training -------------------------------------------------------------------------------------------------------


def _marks(rows: DataFrame) -> set[str]:
    """Words and beginnings of words of toxic documents, from a bounded sample of documents with text and y.

    A likelihood ratio tests whether a word is in more of the toxic documents than of the others. Of all words in toxic
    documents, those pass that keep the expected share of chance findings at MARK_FALSE (Benjamini and Hochberg's rule): the
    fewer labelled documents there are, the more witnesses a word needs, at any size. The chance of a finding is Chernoff's bound,
    which holds for few witnesses too; a chi-square would make it ten times too small there and let chance words pass.
    """

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, clean = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            (toxic if y else clean).update({s for w in set(_TOKEN.findall((text or "").lower())) for s in stems(w)})
        keys = list(toxic.keys() | clean.keys())
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys]), pa.array([clean[k] for k in keys])], names=["stem", "toxic", "clean"])

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    sums = map_batches(rows.select("text", "y"), tally, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    lift = F.log((F.col("t") + 0.5) / a) - F.log((F.col("c") + 0.5) / b)
    share = a / (a + b)
    n = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0))
    tested, _ = persist_table(sums.where("t > 0").select("stem", ratio.alias("ratio"), (lift > MARK_LIFT).alias("lifted")), "stems")
    # no rank lets a greater chance than MARK_FALSE pass
    found = tested.where("lifted").where(F.col("ratio") >= -2 * math.log(MARK_FALSE)).orderBy(F.desc("ratio"), "stem").toArrow()
    chance = np.exp(-found.column("ratio").to_numpy() / 2)
    passing = np.flatnonzero(chance <= MARK_FALSE * np.arange(1, len(chance) + 1) / max(1, tested.count()))
    return set(found.column("stem").to_pylist()[: passing[-1] + 1]) if len(passing) else set()


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, bound: int) -> DataFrame:
    """(text, y): at most `bound` toxic and `bound` other labelled rows, by a hash of id and text; equal rows count once."""
    labels = narrow(labels, doc_id="long", toxic="int").where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).withColumnRenamed("toxic", "y")
    ids = [sampled(labels.where(F.col("y") == y), bound, "toxic", "doc_id").groupBy("doc_id", "y").agg(F.min("lot").alias("lot")).orderBy("lot", "doc_id").limit(bound) for y in (1, 0)]
    rows = narrow(docs, doc_id="long", text="string").join(F.broadcast(ids[0].unionByName(ids[1]).drop("lot")), "doc_id").withColumn("h", F.xxhash64("text"))
    key = ["y", "doc_id", "h"]
    chosen = [rows.where(F.col("y") == y).select(*key).distinct().orderBy(lot("toxic", "doc_id"), *key).limit(bound) for y in (1, 0)]
    rows = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), key).groupBy(*key).agg(F.first("text").alias("text"))
    return persist_table(rows.select("text", "y"), "labelled")[0]


def train(docs: DataFrame, labels: DataFrame, usable: Column, bound: int = TRAIN_DOCS) -> Chain | None:
    """Fit on at most `bound` toxic and `bound` other labelled documents for which `usable` (a condition on doc_id) holds.

    A null label or id is no label. None if one of the classes is missing, or if nothing sets toxic documents apart.
    """
    rows = labelled(docs, labels, usable, bound)
    marks = _marks(rows)
    if not marks:
        return None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """Pieces of texts: tokens joined by spaces, states as digits, whether any is toxic, and a hash for sampling."""
        out = []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            tokens = _TOKEN.findall((text or "").lower())
            for at in range(0, len(tokens), SEQUENCE):
                piece = tokens[at : at + SEQUENCE]
                states = "".join("1" if y and any(s in marks for s in stems(w)) else "0" for w in piece)
                joined = " ".join(piece)
                out.append((joined, states, "1" in states, xxhash.xxh64_intdigest(joined) >> 1))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["tokens", "states", "hit", "h"]) if out else None

    pieces = map_batches(rows.select("text", "y"), cut, "tokens string, states string, hit boolean, h long").distinct()
    taken = [r for hit in (True, False) for r in pieces.where(F.col("hit") == hit).orderBy("h", "tokens", "states").limit(TRAIN_SEQUENCES).collect()]
    chain = fit_chain([r["tokens"].split(" ") for r in taken], [[int(c) for c in r["states"]] for r in taken])

    def sum_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _, _ = Tagger(chain).documents(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("y"), *map(pa.array, x.T)], names=["y", "top", "many"])

    seen = map_batches(rows.select("text", "y"), sum_up, "y int, top double, many double").toPandas().sort_values(["y", "top", "many"])
    usable_labels = narrow(labels, doc_id="long", toxic="int").where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    shares = {r["toxic"]: r["n"] for r in usable_labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chain.level = _fit_level(seen[["top", "many"]].to_numpy(), seen["y"].to_numpy(), shares)
    return chain


def _fit_level(x: np.ndarray, y: np.ndarray, shares: dict[int, int], rounds: int = 25, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the classes weigh as they do among all labels."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weigh = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum())) / (shares[0] + shares[1])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + decay * w * [0, 1, 1]
        curve = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, decay, decay])
        w = w - np.linalg.solve(curve, grad)
    return w


# -- scoring --------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5), spans (array of start, end, marginal).

    Spans are in code points, end exclusive. Null or empty texts have no tokens and get the score of a text without toxic
    tokens. Without a model (a class is missing) every score is 0. Every row gives a row, repeats too; only doc_id and text
    are read. An empty table gives an empty result.
    """

    def run(batches):
        tagger = Tagger(chain) if chain is not None else None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for rows in pieces(batches):
            texts = rows.column("text").to_pylist()
            spans: list[list[dict]] = [[] for _ in texts]
            s = np.zeros(len(texts))
            if tagger:
                x, p, starts = tagger.documents(texts)
                s = chain.scores(x)
                for k in np.flatnonzero(x[:, 0] >= 0):  # some token's marginal is at least one half
                    spans[k] = _offsets(texts[k], p[starts[k] : starts[k + 1]])
            yield pa.record_batch([rows.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "spans"])

    schema = "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, marginal: double>>"
    return narrow(docs, doc_id="long", text="string").mapInArrow(run, schema)


def _offsets(text: str, p: np.ndarray) -> list[dict]:
    """Where the tokens with a marginal of at least one half are in the text as it was before lower-casing."""
    lowered = text.lower()
    if len(lowered) == len(text):
        place = None
    else:  # some characters become several; each of those points to its source
        place = [k for k, c in enumerate(text) for _ in c.lower()]
    out = []
    for m, q in zip(_TOKEN.finditer(lowered), p):
        if q >= 0.5:
            a, b = (m.start(), m.end()) if place is None else (place[m.start()], place[m.end() - 1] + 1)
            out.append({"start": a, "end": b, "marginal": float(q)})
    return out
