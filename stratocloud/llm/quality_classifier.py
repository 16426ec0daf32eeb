"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; negative labels are not used. A linear model over
features of a text's bytes and words minimises the non-negative unbiased risk
``prior * E_P[l(x)] + max(0, E_U[l(-x)] - prior * E_P[l(-x)])``. The prior is the share of positives among
unlabelled web text, estimated from first models: among the documents that one likes best, the ratio of
the unlabelled share to the positive share is at least the prior, and comes near it.

Edge cases: null and empty text have zero features and get the score that the model gives them. Null ids
are scored, and held_out is false. Repeated rows have the same score. Without any trusted positive every score is
0.5. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.llm.common import fold_of, kept
from stratocloud.llm.packing import _slices
from stratocloud.llm.training import first_by_hash, labelled_ids, logistic, sigmoid, texts_of

POSITIVES = 4000  # bounds of the sample that the model is fitted to
UNLABELLED = 8000
THRESHOLD = 0.7

_KINDS = 12


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".,;:", "!?", "\"'()-", "#*$%&|<>@^~_=+\\/{}[]`")):
        kind[list(chars.encode())] = k
    kind[0x80:0xC0], kind[0xC0:] = 10, 11
    return kind


_KIND = _byte_kinds()
N_FEATURES = _KINDS * _KINDS + 7


def features(text: str | None) -> np.ndarray:
    """Shares of pairs of neighbouring kinds of bytes, and measures of words and lines."""
    data = text.encode() if text else b""
    words = data.split()
    out = np.zeros(N_FEATURES)
    if not words:
        return out
    kinds = _KIND[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * np.uint8(_KINDS) + kinds[1:], minlength=_KINDS * _KINDS)
        out[: _KINDS * _KINDS] = np.sqrt(pairs / (len(kinds) - 1))
    n = len(words)
    again = sum(map(bytes.__eq__, words[:-1], words[1:]))
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), float, n)
    out[_KINDS * _KINDS :] = (
        again / n, len(set(words)) / n, sizes.mean() / 10, sizes.std() / 10, np.log1p(n) / 10, 1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The ratio of the shares above a threshold, at the threshold where its upper confidence bound is least. The least ratio itself would
    be the one that chance made smallest."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p, u = (1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (positive, unlabelled))
    width = np.sqrt(np.log(4 / risk) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    at = int(np.argmin((u + width) / np.maximum(p, 1e-9)))
    return float(np.clip(u[at] / max(p[at], 1e-9), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, steps: int = 600, rate: float = 0.02, ridge: float = 1e-4) -> Model:
    """Non-negative PU learning by Adam over all rows at each step."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    p, u = (np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))] for x in (p, u))
    half = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    (p0, p1), (u0, u1) = half(p), half(u)
    guess = lambda p, u: logistic(np.concatenate([p, u])[:, :-1], np.r_[np.ones(len(p)), np.zeros(len(u))], ridge=10.0)
    each = [estimate_prior(p @ w, u @ w) for w, p, u in ((guess(p0, u0), p1, u1), (guess(p1, u1), p0, u0))]  # each half by the other's model
    prior = sum(each) / 2
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        gp, gu = sigmoid(p @ w), sigmoid(u @ w)
        # logistic loss: l(z) = log(1 + exp(-z)); its slope is -sigmoid(-z)
        risk = np.mean(-np.log(np.maximum(1 - gu, 1e-12))) - prior * np.mean(-np.log(np.maximum(1 - gp, 1e-12)))
        negative = u.T @ gu / len(u) - prior * (p.T @ gp) / len(p)
        grad = prior * (p.T @ (gp - 1)) / len(p) + negative if risk >= 0 else -negative
        grad = grad + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _slices(batch.column(1)):
            x = pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), x], ["y", "x"])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, positives: int = POSITIVES,
    unlabelled: int = UNLABELLED, seed: int = 42,
) -> Model:
    """A model from at most ``positives`` trusted and ``unlabelled`` web texts, none of the held-out fold. The web texts are drawn from all
    texts, whatever they are labelled, and independently of the trusted ones: a text drawn as both counts as both."""
    known = labelled_ids(labels, label, modulus, held_out).filter("y = 1")
    p = first_by_hash(known, positives, seed)
    web = docs.select("doc_id").filter(fold_of(F.col("doc_id"), modulus) != held_out).withColumn("y", F.lit(0))
    u = first_by_hash(web, unlabelled, seed + 1).dropDuplicates(["doc_id"])
    chosen = p.unionByName(u)
    rows = texts_of(docs, chosen).select("y", "text").mapInArrow(_feature_rows, "y int, x array<double>")
    rows = kept(rows).toPandas()  # at most positives + unlabelled rows of about 150 numbers
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, N_FEATURES))
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # rows come in no certain order, and the fit takes every other one
    x, y = x[order], y[order]
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), 0.5)
    return fit(x[y == 1], x[y == 0])


def score_quality(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` with a score from 0 to 1; a column of that name that they have is replaced."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(at_text)):
                score = shared.value.score(np.stack([features(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, pa.array(score)], [*batch.schema.names, "score"])

    plain = [f"c{k}" for k in range(len(names))]  # columns may be called anything
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema)), T.StructField("score", T.DoubleType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names, column)


def classify_quality(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    # the text must not travel back from Python
    scored = _scores_only(docs, model)
    fold = F.coalesce(fold_of(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores_only(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                score = shared.value.score(np.stack([features(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score)], ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
