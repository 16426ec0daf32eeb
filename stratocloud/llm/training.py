"""What the two classifiers share: bounded samples of labelled documents, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import fold_of, words_of


def labelled_ids(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and y (0 or 1) of the documents whose label may be learnt. A document with several labels has the largest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold_of(F.col("doc_id"), modulus) != held_out))
    return known.groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("y"))


def first_by_hash(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, those whose keyed hash of doc_id is least: a random sample, the same in every run."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y and text of the sampled ids, which are few and are broadcast; so only sampled texts are shuffled. Of rows that repeat
    an id, one is taken, the same in every run. An id that was drawn for both values of y appears with each."""
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"), "text")).alias("text"))


def one_of_copies(sample: DataFrame, shingle: int = 5) -> DataFrame:
    """mark, y and text: of the texts of a small sample that share y and their least hash of ``shingle`` words (``mark``), as copies and most
    near copies do, one. Statistics over what is left count passages, not how often a text was copied."""
    words = words_of(F.lower("text"))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - shingle, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, shingle)))
    marked = sample.withColumn("_w", words).withColumn("mark", F.array_min(each))
    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id"))
    return marked.groupBy("mark", "y").agg(F.min_by("text", order).alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights, the last of which is the constant, by Newton's method."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
