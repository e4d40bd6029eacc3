"""Operator 10: language identification by error-correcting output codes.

Every language gets a codeword. One binary classifier for each bit, over hashed byte n-grams of the lower-cased letters,
predicts that bit; a text's language is the codeword with the least summed logistic loss, and a text whose two best
codewords are close is flagged as ambiguous. The classifiers are fitted on a bounded sample of labelled rows; the sample's
counts are made by the executors and only those reach the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import lot, map_batches, narrow, text_bytes

#: Buckets of n-gram counts.
BUCKETS = 4096
#: Labelled rows used for each language, and languages, the commonest, at most; the bounds of the training sample.
TRAIN_PER_LANG, TRAIN_LANGS = 700, 256
#: Margins of loss below this are flagged as ambiguous.
AMBIGUOUS = 1.0

# letters, and some characters that only look like them to this pattern: fractions and raised digits
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
# ASCII bytes that are no letters count as a space
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def gram_counts(column: pa.Array) -> np.ndarray:
    """(rows, BUCKETS): square roots of the shares of hashed byte bigrams and trigrams, at unit length; empty texts are zero."""
    data, starts = text_bytes(pc.utf8_lower(column.fill_null("")))
    b = _FOLD[data]
    out = np.zeros((len(column), BUCKETS), np.float32)
    two = three = np.zeros(0, np.uint32)
    if len(b) > 2:
        pair = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        two = ((pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        triple = pair[:-1] + b[2:] * np.uint32(0x27D4EB2F)
        three = ((triple ^ (triple >> np.uint32(13))) * np.uint32(0x165667B1)) >> np.uint32(20)
    for row, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        if hi - lo > 2:
            counts = np.bincount(two[lo : hi - 1], minlength=BUCKETS) + np.bincount(three[lo : hi - 2], minlength=BUCKETS)
            out[row] = np.sqrt(counts / counts.sum())
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1 and 1: for few languages every two-way split, else the best of many random codes by least distance."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 else (1 if not splits[j] >> (k - 1) & 1 else -1) for j in range(len(splits))] for k in range(n)], float)
    bits, rng, best = max(15, int(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = n * bits if n == 1 else (code.shape[1] - code @ code.T + 4 * bits * np.eye(n)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


@dataclass
class LanguageModel:
    """langs: the codewords' languages; code: (langs, bits); weights: (BUCKETS + 1, bits), the last row is the bias."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(rows, langs): the loss of every codeword, each bit weighted by its classifier's loss."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        return np.logaddexp(0, -margin) @ (self.code > 0).T + np.logaddexp(0, margin) @ (self.code < 0).T

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's place, its share of exp(-loss), and the margin of loss to the second."""
        loss = self.losses(x)
        best = loss.argmin(axis=1)
        low = loss.min(axis=1)
        share = 1 / np.exp(low[:, None] - loss).sum(axis=1)
        margin = np.partition(loss, 1, axis=1)[:, 1] - low if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, share, margin


def fit(x: np.ndarray, langs: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-6) -> LanguageModel:
    """One logistic classifier for each bit, by full-batch Adam; languages weigh the same."""
    names, y = np.unique(langs, return_inverse=True)
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    weigh = (1 / np.bincount(y))[y][:, None].astype(np.float32) / len(names)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = target * (x @ w[:-1] + w[-1])
        pull = -target * weigh / (1 + np.exp(np.clip(margin, -30, 30)))
        grad = np.vstack([x.T @ pull, pull.sum(axis=0)]) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LanguageModel([str(k) for k in names], code, w)


def train(docs: DataFrame, usable: Column, per_lang: int = TRAIN_PER_LANG, most_langs: int = TRAIN_LANGS) -> LanguageModel | None:
    """Fit on rows for which `usable` holds and lang and text are not null: at most `per_lang` of each language.

    The rows of a language are taken by the least hashes of their id and text, so the sample is the same at every run; rows
    that agree in both count once. Of more than `most_langs` languages the commonest are learned. None if there are no
    labelled rows.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return None
    # a threshold for each language leaves somewhat more than its share of rows, which are then ranked
    cut = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], (1 << 30) * min(r["n"], per_lang + 4 * int(per_lang**0.5) + 4) // r["n"])])
    near = rows.select("lang", "text", lot("language", "doc_id", "text").alias("lot")).where(F.col("lot") < cut[F.col("lang")])
    near = near.groupBy("lang", "lot").agg(F.first("text").alias("text"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("lot")))
    chosen = ranked.where(F.col("place") <= per_lang).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = (gram_counts(batch.column("text")) * 255).round().astype(np.uint8)
        return pa.record_batch([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = map_batches(chosen, count, "lang string, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "x"])  # the same order, whatever the partitions
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), BUCKETS).astype(np.float32) / 255
    return fit(x, got["lang"].to_numpy())


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous.

    Null text, or a text without any letter, or no model: `und` with score 0 and ambiguous. Every row gives a row, repeats
    too; only doc_id and text are read. An empty table gives an empty result.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text")
        known = np.array([model is not None and has_letter(t) for t in texts.to_pylist()], bool)
        names, score, unsure = np.full(len(known), "und", object), np.zeros(len(known)), np.ones(len(known), bool)
        if known.any():
            best, share, margin = model.predict(gram_counts(texts))
            names[known] = np.array(model.langs, object)[best[known]]
            score[known], unsure[known] = share[known], margin[known] < AMBIGUOUS
        return pa.record_batch([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_batches(narrow(docs, doc_id="long", text="string"), batch, "doc_id long, lang_pred string, score double, ambiguous boolean")
