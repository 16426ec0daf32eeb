"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary and one smoothing; the background's counts are scaled to
the target's number of words, so that smoothing weighs alike in both. A document's score is the mean over its words of
the background's loss minus the target's: higher is more like the target.

Counts are taken over all texts of both corpora; no word is cut off, nothing is sampled, and what is gathered grows
with the corpora. Tasks deal texts into slices of about ``slice_words`` words and count the distinct words and bigrams
(grams) of each slice. A gram's key is a hash; keys are dealt by range into shards, whose number follows the corpora, so
that a shard holds about ``shard_words`` of them. A shard adds up the counts of its keys over all slices and answers each slice
with the totals of the keys it asked for, in the order asked; the slice's own words, kept as short codes, then meet the answers. So a
gram crosses the network once a slice, however often it occurs there, and no text does. A gram that is in every
document is one key a slice for its shard, so hot words need no salt.

Keys have ``bits`` + log2(number of shards) bits: of two million grams of a shard about one in 2^19 meets another by chance, at
every size of the corpora.

Edge cases: null, empty and blank text has no words and scores 0, with zero losses. Null ids and repeated rows
are scored like any. With an empty target or background the other's smoothing alone remains. Words that neither corpus has count 0 in
both. Extra columns are ignored. Texts are read whole; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import kept
from stratocloud.llm.packing import _slices

SEED = 42
PRIOR = 2.0  # words by which the unigram model weighs in each bigram context
FLOOR = 0.5  # added to each word's count
START = np.uint64(xxhash.xxh64_intdigest(b"", SEED))  # the word before a text's first; no word is empty
BITS = 40
SLICE_WORDS = 1_000_000
SHARD_WORDS = 2_000_000
WORD_BYTES = 6  # of text a word, about; it only sizes the shards
TEXT_BYTES = 2 << 20  # of text that is split into words at once, which takes some twenty times as much memory
GROUP_SLICES = 256  # added up together before shards are
SLICE_TEXTS = 200_000  # of texts without words, say
TARGET, BACKGROUND, ASKED = range(3)

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD)]


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their bytes, as many as the largest needs, compressed if that pays."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    if len(planes) < 64:
        return bytes([width]) + planes
    return bytes([width | 128]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes) -> np.ndarray:
    width, planes = data[0] & 127, data[1:]
    if data[0] & 128:
        planes = zstandard.ZstdDecompressor().decompress(planes)
    bytes_ = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((bytes_.shape[1], 8), np.uint8)
    out[:, :width] = bytes_.T
    return out.view("<u8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Keys:
    """How grams become keys, and keys shards: the same for all slices."""

    bits: int
    shards: int

    def of(self, gram: np.ndarray, word: bool) -> np.ndarray:
        """Keys of mixed hashes; the last bit tells words from bigrams."""
        one = np.uint64(1)
        return (gram >> np.uint64(64 - self.bits)) & ~one | (one if word else np.uint64(0))

    def shard(self, keys: np.ndarray) -> np.ndarray:
        """In order of the keys."""
        top = keys >> np.uint64(self.bits - 32) if self.bits > 32 else keys << np.uint64(32 - self.bits)
        return ((top * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return self.of(_mixed(hashes * _ODD[3] + _ODD[0]), True)

    def pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.of(_mixed(before * _ODD[0] + word * _ODD[1]), False)


class Grams:
    """The distinct words (0: the start of a text) and bigrams of a slice, given by word hashes, codes and sizes of texts."""

    def __init__(self, keys: Keys, words: np.ndarray, codes: np.ndarray, sizes: np.ndarray):
        self.words, self.codes = words, codes
        self.texts = int((sizes > 0).sum())
        before = np.zeros_like(codes)
        before[1:] = codes[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        pairs, self.pair_of = np.unique(before * len(words) + codes, return_inverse=True)
        self.before, self.word = pairs // len(words), pairs % len(words)
        every = np.concatenate([keys.word(words), keys.pair(words[self.before], words[self.word])])
        self.keys, self.at = np.unique(every, return_inverse=True)  # ``at``: the key of each word, then of each pair

    def counts(self) -> np.ndarray:
        """How often each key occurs in the slice."""
        words = np.bincount(self.codes, minlength=len(self.words))
        words[0] = self.texts
        n = np.concatenate([words, np.bincount(self.pair_of, minlength=len(self.before))])
        return np.bincount(self.at, weights=n, minlength=len(self.keys)).astype(np.int64)

    def split(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the keys as those of each pair, of its word and of its context."""
        words, pairs = totals[self.at[: len(self.words)]], totals[self.at[len(self.words) :]]
        return pairs, words[self.word], words[self.before]


_ROW = "slice bigint, role int, sizes array<bigint>, words binary, codes binary, total bigint, shard int, first bigint, keys binary, counts binary"


def sliced(texts: DataFrame, keys: Keys, role: int, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Rows of two kinds, written down: a slice (``shard`` is null) with its texts' ids and words, and what it has for each shard."""
    names = [x.split()[0] for x in _ROW.split(", ")]
    rows = texts.select("doc_id", "text") if "doc_id" in texts.columns else texts.select(F.lit(None).cast("long").alias("doc_id"), "text")
    kinds = {"slice": pa.int64(), "role": pa.int32(), "sizes": pa.list_(pa.int64()), "words": pa.binary(), "codes": pa.binary(), "total": pa.int64()}
    kinds |= {"shard": pa.int32(), "first": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    def emit(number: int, ids: list[pa.Array], hashes: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size, ids_ = np.concatenate(sizes), pa.concat_arrays(ids)
        distinct, codes, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")  # frequent words have small codes, which compress better
        place = np.empty_like(often)
        place[often] = np.arange(1, len(often) + 1)
        words, codes = np.concatenate([[START], distinct[often]]), place[codes]
        grams = Grams(keys, words, codes, size)
        shards = keys.shard(grams.keys)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        counts = grams.counts()
        parts = [(int(shards[a]), grams.keys[a:b], counts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(shards)])]
        own = {"sizes": [size.tolist()], "words": [words.tobytes()], "codes": [packed(codes)], "total": [len(codes)]}
        own |= {"shard": [None], "first": [None], "keys": [None], "counts": [None]}
        asked = {"sizes": [None] * len(parts), "words": [None] * len(parts), "codes": [None] * len(parts), "total": [None] * len(parts)}
        asked |= {"shard": [s for s, _, _ in parts], "first": [int(k[0].view(np.int64)) for _, k, _ in parts]}
        asked |= {"keys": [packed(np.diff(k, prepend=k[:1])) for _, k, _ in parts], "counts": [packed(c) for _, _, c in parts]}
        for row, n_rows, ids_column in (
            (own, 1, pa.ListArray.from_arrays([0, len(ids_)], ids_)),
            (asked, len(parts), pa.nulls(len(parts), pa.list_(ids_.type))),
        ):
            row = {"slice": [number] * n_rows, "role": [role] * n_rows} | row
            yield pa.RecordBatch.from_arrays([ids_column, *(pa.array(row[c], kinds[c]) for c in names)], ["ids", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (role << 60) | (TaskContext.get().partitionId() << 30)
        ids, hashes, sizes, n, m = [], [], [], 0, 0
        for batch in batches:
            for at, part in _slices(batch.column(1), TEXT_BYTES):
                words: list[bytes] = []
                size = np.empty(len(part), np.int64)
                for k, t in enumerate(part):
                    before = len(words)
                    words += t.lower().encode().split() if t else ()
                    size[k] = len(words) - before
                codes, distinct = pd.factorize(np.array(words, object)) if words else (np.empty(0, np.int64), ())
                known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
                ids.append(batch.column(0).slice(at, len(part)))
                hashes.append(known[codes])
                sizes.append(size)
                n, m = n + len(words), m + len(part)
                if n >= slice_words or m >= SLICE_TEXTS:
                    yield from emit(number, ids, hashes, sizes)
                    ids, hashes, sizes, n, m, number = [], [], [], 0, 0, number + 1
        if m:
            yield from emit(number, ids, hashes, sizes)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return kept(rows.mapInArrow(run, f"ids array<{kind}>, {_ROW}"))


def _keys_of(t: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(unpacked(d.as_py())) + np.int64(f).view(np.uint64) for d, f in zip(t["keys"], t["first"].to_numpy())]


def _totals(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where each key is among them, and sums of the counts (one list for each of both corpora)."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate(c).astype(float), minlength=len(distinct)).astype(np.uint64) for c in counts]
    return distinct, at, sums


def _by_role(t: pa.Table) -> list[list[np.ndarray]]:
    """The counts of each row, for the target and for the background; zeros where a row is of another role."""
    roles, counts = t["role"].to_numpy(), [unpacked(d.as_py()) for d in t["counts"]]
    return [[c if r == role else np.zeros(len(c), np.uint64) for r, c in zip(roles, counts)] for role in (TARGET, BACKGROUND)]


def answers(asks: DataFrame, role: int, group_slices: int = GROUP_SLICES) -> DataFrame:
    """(slice, shard, n, m, distinct): to each slice of the role, the target's and the background's totals of its keys; and without a
    slice, how many distinct words each shard has.

    Slices are added up in groups of about ``group_slices``, a group and shard a task, and groups to totals, a shard a task, so that a gram that all slices
    hold is one number a group there. Totals go back the same way.
    """
    names = {"slice": pa.int64(), "shard": pa.int32(), "n": pa.binary(), "m": pa.binary(), "distinct": pa.int64()}

    def replied(t: pa.Table, shard: int, at: np.ndarray, sizes: list[int], sums: list[np.ndarray], out: dict) -> dict:
        ends = np.cumsum(sizes)
        for r, s, a, b in zip(t["role"].to_pylist(), t["slice"].to_pylist(), (ends - sizes).tolist(), ends.tolist()):
            if r == role:
                for c, v in zip(names, (s, shard, packed(sums[0][at[a:b]]), packed(sums[1][at[a:b]]), None)):
                    out[c].append(v)
        return out

    def met(distinct: np.ndarray, sums: list[np.ndarray]) -> int:
        return int((((distinct & np.uint64(1)) == 1) & (sums[0] + sums[1] > 0)).sum())

    def at_once(key: tuple, t: pa.Table) -> pa.Table:
        keys, shard = _keys_of(t), key[0].as_py()
        distinct, at, sums = _totals(keys, _by_role(t))
        out = replied(t, shard, at, list(map(len, keys)), sums, {c: [None] for c in names} | {"shard": [shard], "distinct": [met(distinct, sums)]})
        return pa.table({c: pa.array(v, names[c]) for c, v in out.items()})

    def added(key: tuple, t: pa.Table) -> pa.Table:
        distinct, _, sums = _totals(_keys_of(t), _by_role(t))
        row = {"shard": key[0].as_py(), "part": key[1].as_py(), "first": int(distinct[0].view(np.int64)), "keys": packed(np.diff(distinct, prepend=distinct[:1]))}
        kinds = {"shard": pa.int32(), "part": pa.int32(), "first": pa.int64()}
        return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in (row | {"n": packed(sums[0]), "m": packed(sums[1])}).items()})

    def in_all(key: tuple, t: pa.Table) -> pa.Table:
        keys = _keys_of(t)
        distinct, at, sums = _totals(keys, [[unpacked(d.as_py()) for d in t[c]] for c in ("n", "m")])
        cut = [0, *np.cumsum(list(map(len, keys))).tolist()]
        each = [[packed(x[at[a:b]]) for a, b in zip(cut, cut[1:])] for x in sums]
        n = t.num_rows
        return pa.table({
            "shard": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "part": pa.array([*t["part"].to_pylist(), None], pa.int32()),
            "n": pa.array([*each[0], None], pa.binary()), "m": pa.array([*each[1], None], pa.binary()), "distinct": pa.array([None] * n + [met(distinct, sums)], pa.int64()),
        })

    def back(key: tuple, t: pa.Table, totals: pa.Table) -> pa.Table:
        keys = _keys_of(t)
        _, at = np.unique(np.concatenate(keys), return_inverse=True) if keys else (None, np.zeros(0, np.int64))
        out = {c: [] for c in names}
        if keys:
            out = replied(t, key[0].as_py(), at, list(map(len, keys)), [unpacked(totals[c][0].as_py()) for c in ("n", "m")], out)
        return pa.table({c: pa.array(v, names[c]) for c, v in out.items()})

    asked = asks.filter("shard IS NOT NULL").select("slice", "shard", "role", "first", "keys", "counts")
    schema = "slice bigint, shard int, n binary, m binary, distinct bigint"
    parts = max(1, -(-asks.filter("shard IS NULL").count() // group_slices))
    if parts == 1:
        return kept(asked.groupBy("shard").applyInArrow(at_once, schema))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int"))
    sums = kept(asked.groupBy("shard", "part").applyInArrow(added, "shard int, part int, first bigint, keys binary, n binary, m binary"))
    totals = kept(sums.groupBy("shard").applyInArrow(in_all, "shard int, part int, n binary, m binary, distinct bigint"))
    known = totals.filter("part IS NOT NULL").select("shard", "part", "n", "m")
    replies = asked.groupBy("shard", "part").cogroup(known.groupBy("shard", "part")).applyInArrow(back, schema)
    counted = totals.filter("part IS NULL").select(F.lit(None).cast("long").alias("slice"), "shard", "n", "m", "distinct")
    return kept(replies.unionByName(counted))


@dataclass
class Models:
    """Both corpora in slices, the background's also with its ids, and how many words each has."""

    slices: DataFrame
    background: DataFrame
    source: DataFrame
    keys: Keys
    n: int
    m: int
    slice_words: int


def train(target: DataFrame, background: DataFrame, bits: int = BITS, slice_words: int = SLICE_WORDS, shard_words: int = SHARD_WORDS) -> Models:
    """Both models from all of both corpora (DataFrames with a text column). ``bits`` are those of a key within its shard."""
    size = sum(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for df in (target, background))
    shards = max(1, -(-size // (WORD_BYTES * shard_words)))
    keys = Keys(min(64, bits + (shards - 1).bit_length()), shards)
    own = sliced(background, keys, BACKGROUND, slice_words)
    slices = sliced(target.select("text"), keys, TARGET, slice_words).drop("ids").unionByName(own.drop("ids"))
    totals = dict(slices.groupBy("role").agg(F.sum("total")).collect())  # at most two rows
    return Models(slices, own, background, keys, totals.get(TARGET) or 0, totals.get(BACKGROUND) or 0, slice_words)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of every document."""
    known = docs is models.source
    own = models.background if known else sliced(docs, models.keys, ASKED, models.slice_words)
    every = models.slices if known else models.slices.unionByName(own.drop("ids"))
    found = answers(every, BACKGROUND if known else ASKED)
    met = found.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    distinct = met - (1 if models.n + models.m else 0)  # without the start of a text
    keys, n, m = models.keys, models.n, models.m
    scale = n / m if n and m else 1.0

    def loss(grams: Grams, totals: np.ndarray, size: int, scale: float) -> np.ndarray:
        pair, word, context = (x * scale for x in grams.split(totals.astype(float)))
        share = (word + FLOOR) / (size * scale + FLOOR * (distinct + 1))  # one more for words not met
        return -np.log((pair + PRIOR * share) / (context + PRIOR))[grams.pair_of]

    def run(_: tuple, slices: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sizes = (slices[c].combine_chunks().flatten() for c in ("ids", "sizes"))
        size = sizes.to_numpy(zero_copy_only=False)
        codes = unpacked(slices["codes"][0].as_py()).astype(np.int64)
        grams = Grams(keys, np.frombuffer(slices["words"][0].as_py(), np.uint64), codes, size)
        order = np.argsort(replies["shard"].to_numpy())
        totals = [np.concatenate([unpacked(column[int(k)].as_py()) for k in order]) for column in (replies["n"], replies["m"])]
        text = np.repeat(np.arange(len(size)), size)
        both = (loss(grams, totals[0], n, 1.0), loss(grams, totals[1], m, scale))
        means = [np.bincount(text, weights=x, minlength=len(size)) / np.maximum(1, size) for x in both]
        return pa.table({"doc_id": ids, "n_words": sizes, "target_loss": pa.array(means[0]), "background_loss": pa.array(means[1])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    left = own.filter("shard IS NULL").select("slice", "ids", "sizes", "words", "codes").groupBy("slice")
    right = found.filter("slice IS NOT NULL").select("slice", "shard", "n", "m").groupBy("slice")
    scored = left.cogroup(right).applyInArrow(run, f"doc_id {kind}, n_words bigint, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))
