"""Toxicity by compression distance.

Two zstandard dictionaries of one size are trained on labelled text. Each is made of passages, stretches of up to
``SEGMENT`` bytes of the texts themselves, chosen by the bytes that they save on text that they were not taken from:
a compressor saves what a passage shares with a text, so each ``GRAM``-byte string is worth the share of the *other*
documents of the passage's class that hold it. Passages that save as much in either class stand in both dictionaries.
Before them the toxic one has passages of toxic documents, the ordinary one passages of ordinary documents; there a string is
worth only what it saves its own class beyond ``CONTRAST`` times what it saves the other (languages and subjects that are merely more
frequent in one class are no mark of it), less ``SIGNIFICANCE`` standard errors. Of copies and near copies one counts. Passages are taken
greedily, and what one covers is worth nothing to the next, as in the library's own trainer (which has no means to leave
out what both classes share, and so could not tell toxic from ordinary prose).

A text is cut into windows of a few words; where the toxic dictionary shortens a window by more bytes than the ordinary
one, the window looks toxic. How many windows do so by how many bytes is turned into a score by a logistic function
fitted to the other half of the sample.

Edge cases: null and empty text have no windows and are scored by the calibration like a text without
toxic windows. Null ids are scored, and held_out is false. Repeated rows have the same score. With fewer than two
labelled documents of a class every score is the smoothed share of label 1. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import fold_of, kept
from stratocloud.llm.packing import _slices
from stratocloud.llm.training import first_by_hash, labelled_ids, logistic, one_of_copies, sigmoid, texts_of

WINDOW = 6  # words
LEVEL = 12
TOXIC_DOCS = 3000  # bounds of the labelled sample
ORDINARY_DOCS = 6000
GRAM = 6  # bytes
SEGMENT = 20
SHARED_BYTES = 48_000  # of passages that both dictionaries hold
OWN_BYTES = 2_000  # at most, of passages of one class
SIGNIFICANCE = 4.5  # standard errors between a string's shares of toxic and ordinary documents
CONTRAST = 5.0
LEAST_DOCS = 3
STRINGS = 20_000  # most valuable strings of each kind, and passages, that are gathered
THRESHOLD = 0.7
BINS = 12
KINDS = ("toxic", "ordinary", "shared")


@dataclass
class Dictionaries:
    toxic: bytes
    ordinary: bytes


def _plain(text: str | None) -> bytes:
    """Lower case, one space between words and at both ends."""
    return b" %b " % b" ".join(text.lower().encode().split()) if text else b"  "


def grams(data: bytes) -> np.ndarray:
    """Each ``GRAM`` bytes of the data as a number."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x) - GRAM + 1
    return sum((x[k : k + n] << (8 * (GRAM - 1 - k)) for k in range(GRAM)), np.zeros(n, np.int64)) if n > 0 else np.empty(0, np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, k1 and k0: in how many toxic and ordinary texts of a slice it is."""
    for batch in batches:
        for at, texts in _slices(batch.column(1)):
            ys = batch.column(0).slice(at, len(texts)).to_pylist()
            sets = [np.unique(grams(_plain(t))) for t in texts]
            found, of = np.unique(np.concatenate(sets), return_inverse=True)
            toxic = np.repeat(np.array(ys, np.int64), [len(s) for s in sets])
            k = np.bincount(of, minlength=len(found))
            k1 = np.bincount(of, weights=toxic, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(k1), pa.array(k - k1)], ["gram", "k1", "k0"])


def _passages(values: dict[str, tuple[np.ndarray, np.ndarray]]):
    """kind, passage and value: of each stretch of ``SEGMENT`` bytes of a text its best passage, cut to where it is worth something."""

    def of(data: bytes, known: np.ndarray, worth: np.ndarray) -> Iterator[tuple[bytes, float]]:
        g = grams(data)
        if not len(known) or not len(g):
            return
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        v = np.where(known[at] == g, worth[at], 0.0)
        for k in range(0, len(v), SEGMENT):
            part = v[k : k + SEGMENT]
            on = np.diff(np.concatenate([[0], (part > 0).astype(np.int8), [0]]))
            for i, j in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1)):
                yield data[k + i : k + j - 1 + GRAM], float(part[i:j].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                for y, t in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts):
                    data = _plain(t)
                    for kind in KINDS[:1] if y else KINDS[1:]:
                        best = dict(of(data, *values[kind]))
                        arrays = [pa.array([kind] * len(best), pa.string()), pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.float64())]
                        yield pa.RecordBatch.from_arrays(arrays, ["kind", "passage", "value"])

    return run


def cover(passages: list[tuple[bytes, float]], worth: dict[int, float], most: int) -> list[bytes]:
    """Passages in order of what they add, the best first, up to ``most`` bytes; a string counts for the first passage that has it."""
    left = dict(worth)
    queue = [(-v, p) for p, v in passages]
    heapq.heapify(queue)
    out, size = [], 0
    while queue and size < most:
        _, passage = heapq.heappop(queue)
        own = set(grams(passage).tolist())
        value = sum(left.get(g, 0.0) for g in own)
        if value <= 0:
            continue
        if queue and value < -queue[0][0] - 1e-12:
            heapq.heappush(queue, (-value, passage))
            continue
        for g in own:
            left.pop(g, None)
        out.append(passage)
        size += len(passage) + 1
    return out


def train_dictionaries(
    sample: DataFrame, shared: int = SHARED_BYTES, own: int = OWN_BYTES, significance: float = SIGNIFICANCE,
    contrast: float = CONTRAST,
) -> Dictionaries:
    """From texts with y. What is gathered is bounded: the ``STRINGS`` most valuable strings and passages of each kind."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if min(n1, n0) < 2:
        return Dictionaries(b"", b"")
    rows = sample.select("y", "text")
    counts = rows.mapInArrow(_gram_counts, "gram bigint, k1 bigint, k0 bigint").groupBy("gram").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    share = (F.col("k1") + F.col("k0") + 1) / F.lit(n1 + n0 + 2)
    error = F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0)) * F.lit(significance)
    beyond = lambda k, n, j, m: F.greatest(F.col(k) - 1, F.lit(0)) / F.lit(n - 1) - F.lit(contrast) * F.col(j) / F.lit(m) - error
    worth = (beyond("k1", n1, "k0", n0), beyond("k0", n0, "k1", n1), F.least(F.col("k1") / F.lit(n1), F.col("k0") / F.lit(n0)))
    counts = kept(counts.filter(F.col("k1") + F.col("k0") >= LEAST_DOCS).select("gram", *(w.alias(kind) for w, kind in zip(worth, KINDS))))
    values = {}
    for kind in KINDS:
        top = counts.filter(F.col(kind) > 0).orderBy(F.desc(kind), "gram").limit(STRINGS).select("gram", kind).collect()
        top.sort()
        values[kind] = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], float)
    found = rows.mapInArrow(_passages(values), "kind string, passage binary, value double")
    found = kept(found.groupBy("kind", "passage").agg(F.max("value").alias("value")))
    chosen = {}
    for kind, most in zip(KINDS, (own, own, shared + own)):
        best = found.filter(F.col("kind") == kind).orderBy(F.desc("value"), "passage").limit(STRINGS).collect()
        chosen[kind] = cover([(bytes(r["passage"]), r["value"]) for r in best], dict(zip(*(x.tolist() for x in values[kind]))), most)
    joined = [b" ".join(reversed(chosen[kind])) for kind in KINDS]
    # Both halves are of one size: the shorter one is filled up with what both classes have in common beyond ``shared`` bytes.
    common, filler = joined[2][-shared:], joined[2][:-shared]
    size = max(len(joined[0]), len(joined[1]))
    toxic, ordinary = ((filler[-max(0, size - len(x)) :] if size > len(x) else b"").rjust(size - len(x)) + x for x in joined[:2])
    return Dictionaries(toxic + b" " + common, ordinary + b" " + common)  # what both hold is at the same distance in both


class Distance:
    """Features of texts: how many windows the toxic dictionary shortens more, by how many bytes."""

    def __init__(self, d: Dictionaries, level: int = LEVEL):
        plain = zstandard.ZstdCompressionParameters.from_level(
            level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        )

        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=plain).compress
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=plain).compress

        self.toxic, self.ordinary = compressor(d.toxic), compressor(d.ordinary)

    def features(self, text: str | None, window: int = WINDOW) -> np.ndarray:
        words = text.lower().encode().split() if text else []
        toxic, ordinary = self.toxic, self.ordinary
        gains = [len(ordinary(w)) - len(toxic(w)) for w in (b" %b " % b" ".join(words[k : k + window]) for k in range(0, len(words), window))]
        n = max(1, len(gains))
        h = np.bincount(np.clip(np.array(gains, np.int64), -2, BINS - 1) + 2, minlength=BINS + 2).astype(float)
        least = h[3:][::-1].cumsum()[::-1]  # windows of a gain of 1, 2, ... bytes or more
        return np.concatenate([10 * least / n, np.log1p(least), [np.log(n)], h[:2] / n])


N_FEATURES = 2 * (BINS - 1) + 3


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def _feature_rows(dictionaries: Dictionaries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(dictionaries)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                x = [distance.features(t).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, toxic_docs: int = TOXIC_DOCS,
    ordinary_docs: int = ORDINARY_DOCS, seed: int = 42,
) -> Model:
    """A model of the labels outside the held-out fold, from at most toxic_docs + ordinary_docs documents."""
    ids = labelled_ids(labels, label, modulus, held_out)
    chosen = first_by_hash(ids.filter("y = 1"), toxic_docs, seed).unionByName(first_by_hash(ids.filter("y = 0"), ordinary_docs, seed))
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.lit(2)).alias("half")  # so no text has a copy in the other half
    sample = kept(one_of_copies(texts_of(docs, chosen)).select("y", "text", half))
    dictionaries = train_dictionaries(sample.filter("half = 0").select("y", "text"))
    rows = sample.filter("half = 1").select("y", "text").mapInArrow(_feature_rows(dictionaries), "y int, x array<double>").toPandas()
    y = rows["y"].to_numpy(float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not dictionaries.toxic or not 0 < y.sum() < len(y):
        return Model(dictionaries, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.r_[np.zeros(N_FEATURES), np.log(share / (1 - share))])
    x = np.stack(rows["x"].to_numpy())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(dictionaries, mean, scale, logistic((x - mean) / scale, y, ridge=1.0))


def score_toxicity(docs: DataFrame, model: Model, modulus: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some 50 KB and a few weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        distance = Distance(model.dictionaries)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                x = np.stack([distance.features(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(model.score(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    fold = F.coalesce(fold_of(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
