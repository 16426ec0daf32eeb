"""Alignment of two tokenizers' tokens over the same bytes.

Each text is tokenized whole by both: a byte-level BPE (A), given a space and the text, and a piece model (B), which puts the
space itself. Where a space-marked token of either begins at the same byte, both have a token's end just before: these
verified anchors split the document into windows of token ids. What is known of a window, its groups (the stretches between bytes
where both have an end), its links (pairs of an A and a B token in one group) and their number, depends on its ids alone and is
remembered by them. Documents repeat windows, so few are aligned more than once.

A pair's count is the number of documents that hold it linked. Tasks count pairs slice by slice (``SLICE_BYTES`` of text, at least a
document); a pair crosses the network once a slice, and so does its total on the way back. What a slice knows of its documents' pairs
stays in the written table, as indices into the slice's pairs. The highest count of each A id is a row for each id
of A's vocabulary at most, which is what bounds the one broadcast.

Tokens are found word by word, each distinct word once: neither A's pattern nor any piece of B reaches over a single space between
two characters that are not white space (for B this is checked on the vocabulary; other models get whole texts). What is remembered
is dropped beyond ``REMEMBERED`` entries or ``REMEMBERED_BYTES``.

Edge cases: null and empty texts, and those of which A or B does not give back the bytes of space and text (a text with
U+2581, for one), have no tokens: zeros and an empty digest. Rows with a null id and repeated rows are documents like any. An
empty table gives none. Extra columns are ignored. Texts are read whole; the longest stretch without a single space is tokenized at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stratocloud.llm.common import kept
from stratocloud.llm.packing import _byte_letters, _slices

#: Of text whose pairs are counted together, and of text tokenized and aligned at once.
SLICE_BYTES = 8 << 20
STEP_BYTES = 1 << 20
#: Words, and windows, remembered between steps, and the bytes that they may take together.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64 << 20
#: Links of windows that are listed at once while windows are aligned.
LINKS = 1 << 21

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^ | $| \s|\s ")
_MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

#: Columns of a document's alignment; the counts of the corpus come later.
_OWN = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Rows:
    """Numbers in rows of several lengths, ``width`` numbers at each place, to which rows are added."""

    def __init__(self, width: int, kind: type):
        self.ends, self.values, self.n, self.used = np.zeros(1, np.int64), np.zeros((width, 1 << 10), kind), 0, 0

    def add(self, counts: np.ndarray, values: np.ndarray) -> None:
        end = self.used + values.shape[1]
        if end > self.values.shape[1]:
            grown = np.zeros((len(self.values), 2 * end), self.values.dtype)
            grown[:, : self.used] = self.values[:, : self.used]
            self.values = grown
        self.values[:, self.used : end] = values
        self.ends = np.concatenate([self.ends[: self.n + 1], self.ends[self.n] + np.cumsum(counts)])
        self.n, self.used = self.n + len(counts), end

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and numbers of the rows asked for."""
        start = self.ends[rows]
        size = self.ends[rows + 1] - start
        return size, self.values[:, _spread(start, size)]


class Words:
    """Token ids of distinct words (a space and what stands up to the next cut), and whether both tokenizers give back their bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = {c: b for b, c in _byte_letters().items()}
        n_a = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.a_mark, self.b_mark = (np.fromiter((x[:1] == b" " for x in t), bool, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.flat = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum(n) - n) for t, n in ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size))]
        self.by_word = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = Rows(1, np.int32), Rows(1, np.int32)
        self.ok = np.zeros(0, bool)
        self.bytes = 0

    def _learn(self, words: list[str]) -> None:
        whole = [(" " + w).encode() for w in words]
        length = np.fromiter(map(len, whole), np.int64, len(whole))
        raw, ok = np.frombuffer(b"".join(whole), np.uint8), np.ones(len(whole), bool)
        found = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)], self.b.encode(words, num_threads=1)
        for lists, rows, size, (flat, at) in zip(found, self.ids, (self.a_size, self.b_size), self.flat):
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
            rows.add(counts, ids[None])
            own = np.bincount(np.repeat(np.arange(len(words)), counts), weights=size[ids], minlength=len(words)).astype(np.int64)
            back, word = flat[_spread(at[ids], size[ids])], np.repeat(np.arange(len(words)), length)
            ok &= own == length
            start = np.cumsum(own) - own  # bytes are compared where there are as many
            alike = np.flatnonzero(ok[word])
            place = _spread(start[ok], length[ok])
            ok[word[alike[back[place] != raw[alike]]]] = False
        self.known.update(zip(words, range(len(self.ok), len(self.ok) + len(words))))
        self.ok = np.concatenate([self.ok, ok])
        self.bytes += 10 * len(raw)

    def cut(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: all ids in one array, and the number of each text's ids, zero where a text has no tokens."""
        if len(self.ok) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.clear()
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                at = len(words)
                words += self.cut(t)
                sizes[k] = len(words) - at
        codes, distinct = pd.factorize(np.array(words, object))
        new = [w for w in distinct if w not in self.known]
        for k in range(0, len(new), 5000):
            self._learn(new[k : k + 5000])
        word = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[codes]
        text = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)
        bad[text[~self.ok[word]]] = True
        good = ~bad[text]
        word, text = word[good], text[good]
        out = []
        for rows in self.ids:
            size, ids = rows.of(word)
            out.append((ids[0].astype(np.int64), np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64)))
        return out


def _summed(owner: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted and distinct (owner, code), with the sums of ``times``."""
    order = np.lexsort([codes, owner])
    owner, codes = owner[order], codes[order]
    new = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(codes, prepend=-1).astype(bool))
    return owner[new], codes[new], np.add.reduceat(times[order], new) if len(new) else times[:0]


class Windows:
    """What is known of windows, by the ids of both sides."""

    def __init__(self, words: Words):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.bytes = 0
        self.n_groups, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = Rows(2, np.int64)  # of each window: pair codes (A's id shifted, and B's), and how often it links them

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of texts' ids, in order, as numbers in this memory, and the byte at which each starts."""
        if len(self.texts) > REMEMBERED or self.bytes + 16 * self.pairs.used > REMEMBERED_BYTES:
            self.clear()
        w = self.words
        sizes = w.a_size[a], w.b_size[b]
        starts = [np.cumsum(s) - s for s in sizes]
        anchors = np.intersect1d(starts[0][w.a_mark[a]], starts[1][w.b_mark[b]], assume_unique=True)
        first = [np.searchsorted(s, anchors) for s in starts]
        count = [np.diff(f, append=len(x)) for f, x in zip(first, (a, b))]
        total = count[0] + count[1] + 1
        at = np.cumsum(total) - total
        ids = np.full(int(total.sum()), -1, np.int32)  # -1 stands between the sides
        ids[_spread(at, count[0])] = a
        ids[_spread(at + count[0] + 1, count[1])] = b
        raw, cut = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
        keys = [raw[s:e] for s, e in zip(cut, cut[1:])]
        found = list(map(self.known.get, keys))
        missing = [k for k, at in enumerate(found) if at is None]
        new = dict(zip([keys[k] for k in missing], missing))
        if new:
            chosen = np.fromiter(new.values(), np.int64, len(new))
            n = len(self.texts)
            for lo in range(0, len(chosen), 20_000):
                part = chosen[lo : lo + 20_000]
                ca, cb = count[0][part], count[1][part]
                self._align(a[_spread(first[0][part], ca)], b[_spread(first[1][part], cb)], ca, cb)
            self.known.update(zip(new, range(n, n + len(new))))
            self.bytes += 3 * sum(map(len, new))
            for k in missing:
                found[k] = self.known[keys[k]]
        return np.array(found, np.int64), anchors

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        ends = [np.cumsum(self.words.a_size[a]), np.cumsum(self.words.b_size[b])]
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, e) for e in ends]
        size = [np.bincount(g, minlength=len(shared)) for g in group]
        window = np.empty(len(shared), np.int64)
        window[group[0]] = np.repeat(np.arange(len(n_a)), n_a)
        links = size[0] * size[1]
        self.n_groups = np.concatenate([self.n_groups, np.bincount(window, minlength=len(n_a))])
        self.n_links = np.concatenate([self.n_links, np.bincount(window, weights=links, minlength=len(n_a)).astype(np.int64)])
        self._texts(a, b, size, np.bincount(window, minlength=len(n_a)))
        begin = [np.cumsum(s) - s for s in size]
        found = []
        large = links > LINKS  # their distinct ids are paired instead of their tokens
        for g in np.flatnonzero(large):
            (ua, ka), (ub, kb) = (np.unique(x[s[g] : s[g] + z[g]], return_counts=True) for x, s, z in zip((a, b), begin, size))
            pairs = (ua[:, None] << 32 | ub).ravel()
            found.append((np.full(len(pairs), window[g]), pairs, (ka[:, None] * kb).ravel()))
        few = np.flatnonzero(~large)
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(links[few]) // LINKS)) + 1) if len(few) else ():
            tokens = _spread(begin[0][part], size[0][part])  # of A; each meets its group's tokens of B
            of = np.repeat(part, size[0][part])
            met = size[1][of]
            pairs = np.repeat(a[tokens], met) << 32 | b[_spread(begin[1][of], met)]
            found.append(_summed(np.repeat(window[of], met), pairs, np.ones(len(pairs), np.int64)))
        owner, codes, times = _summed(*(np.concatenate(x) for x in zip(*found)))
        self.pairs.add(np.bincount(owner, minlength=len(n_a)), np.stack([codes, times]))

    def _texts(self, a: np.ndarray, b: np.ndarray, size: list[np.ndarray], n_groups: np.ndarray) -> None:
        """Each window's groups as text."""
        a, b, i, j, groups = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, []
        for m, n in zip(size[0].tolist(), size[1].tolist()):
            if m == n == 1:
                groups.append(f"{a[i]}|{b[j]}")
            else:
                groups.append(f"{','.join(a[i : i + m])}|{','.join(b[j : j + n])}")
            i, j = i + m, j + n
        at = 0
        for n in n_groups.tolist():
            self.texts.append(groups[at] if n == 1 else ";".join(groups[at : at + n]))
            at += n


@lru_cache(1)
def _memory(a_path: str, b_path: str) -> Windows:
    """Of this worker, for as long as it lives."""
    return Windows(Words(a_path, b_path))


def _deltas(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Differences within each row of rising numbers, and the first number of each; backwards by ``_sums``."""
    out = np.diff(values, prepend=0)
    first = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    out[first] = values[first]
    return out


def _sums(ends: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas)
    size = np.diff(ends, prepend=0)
    before = np.concatenate([[0], total])[ends - size]
    return total - np.repeat(before, size)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Slice:
    """Documents whose pairs are counted together."""

    def __init__(self):
        self.ids, self.parts, self.bytes = [], [], 0
        self.rows = {c: [] for c in _OWN}

    def add(self, memory: Windows, ids: pa.Array, texts: list[str | None]) -> None:
        (a, n_a), (b, n_b) = memory.words.encode(texts)
        windows, start = memory.of(a, b)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), n_a), weights=memory.words.a_size[a], minlength=len(texts))).astype(np.int64)
        text = np.searchsorted(ends, start, side="right")
        n = len(texts)
        self.rows["n_a"].append(n_a)
        self.rows["n_b"].append(n_b)
        for c, of in (("n_groups", memory.n_groups), ("n_links", memory.n_links)):
            self.rows[c].append(np.bincount(text, weights=of[windows], minlength=n).astype(np.int64))
        cut = [0, *np.cumsum(np.bincount(text, minlength=n)).tolist()]
        lines = list(map(memory.texts.__getitem__, windows.tolist()))
        self.rows["groups_sha256"] += [hashlib.sha256(";".join(lines[s:e]).encode()).hexdigest() if s < e else "" for s, e in zip(cut, cut[1:])]
        both, times = np.unique(text * len(memory.texts) + windows, return_counts=True)
        text, window = np.divmod(both, max(1, len(memory.texts)))
        size, (code, occurs) = memory.pairs.of(window)
        text, code, sums = _summed(np.repeat(text, size), code, occurs * np.repeat(times, size))
        self.parts.append((np.bincount(text, minlength=n), code, sums))
        self.ids.append(ids)
        self.bytes += sum(map(len, filter(None, texts)))

    def row(self, uid: int, kind: pa.DataType) -> pa.RecordBatch:
        counts, codes, occurs = (np.concatenate(x) for x in zip(*self.parts))
        pairs, at, n = np.unique(codes, return_inverse=True, return_counts=True)
        rows = {c: v if c == "groups_sha256" else np.concatenate(v) for c, v in self.rows.items()}
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        ids = pa.concat_arrays(self.ids)
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind))
        columns = {"slice": pa.array([uid], pa.int64()), "doc_id": listed}
        columns |= {c: one(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in rows.items()}
        columns |= {"pairs": one(pairs, pa.int64()), "docs": one(n, pa.int32())}
        held = (counts, _deltas(np.cumsum(counts), at), occurs)
        columns |= {c: pa.array([_packed(v)], pa.binary()) for c, v in zip(("held", "which", "times"), held)}
        return pa.RecordBatch.from_pydict(columns)


def _slices_of(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory, uid, now = _memory(a_path, b_path), TaskContext.get().partitionId() << 32, Slice()
        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            for at, texts in _slices(batch.column(1), STEP_BYTES):
                now.add(memory, batch.column(0).slice(at, len(texts)), texts)
                if now.bytes >= slice_bytes:
                    yield now.row(uid, arrow)
                    uid, now = uid + 1, Slice()
        if now.ids:
            yield now.row(uid, arrow)

    long = T.ArrayType(T.LongType())
    schema = T.StructType().add("slice", T.LongType()).add("doc_id", T.ArrayType(kind))
    for c in _OWN:
        schema.add(c, T.ArrayType(T.StringType()) if c == "groups_sha256" else long)
    schema.add("pairs", long).add("docs", T.ArrayType(T.IntegerType()))
    for c in ("held", "which", "times"):
        schema.add(c, T.BinaryType())
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether no pair of its A id is held by more."""
    counts = slices.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    counts = kept(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    slices = kept(_slices_of(docs, a_path, b_path, slice_bytes))
    counts = pair_counts(slices)
    back = slices.select("slice", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("slice").alias("of"), "at", "n", "best")

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        size = len(left["pairs"][0])
        n, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        held, which, times = (_unpacked(left[c][0].as_py()) for c in ("held", "which", "times"))
        ends = np.cumsum(held)
        which = _sums(ends, which)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        own = {c: left[c].chunk(0).flatten() for c in ("doc_id", *_OWN)}
        return pa.table(own | {"n_best": total(times * best[which]), "count_sum": total(times * n[which])})

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType)
    for c in (*_OWN, "n_best", "count_sum"):
        schema.add(c, T.StringType() if c == "groups_sha256" else T.LongType())
    return slices.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(close, schema)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups of every document: the ids of both sides and the bytes (of space and text) from ``start`` to before ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(a_path, b_path)
        words = memory.words
        kind = pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "start": pa.int64(), "end": pa.int64()}))
        for batch in batches:
            for at, texts in _slices(batch.column(1), STEP_BYTES):
                (a, n_a), (b, n_b) = words.encode(texts)
                windows, _ = memory.of(a, b)
                listed, k, i = [], 0, 0
                for n in n_a.tolist():
                    found, start, end = [], 0, i + n
                    while i < end:
                        for group in memory.texts[windows[k]].split(";"):
                            left, right = ([int(x) for x in side.split(",")] for side in group.split("|"))
                            size = int(words.a_size[left].sum())
                            found.append({"a": left, "b": right, "start": start, "end": start + size})
                            start, i = start + size, i + len(left)
                        k += 1
                    listed.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(listed, kind)], ["doc_id", "groups"])

    item = T.StructType().add("a", T.ArrayType(T.IntegerType())).add("b", T.ArrayType(T.IntegerType())).add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("groups", T.ArrayType(item))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
