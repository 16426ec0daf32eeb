"""Substring dedup: words of 50-word windows that also start in a document with a smaller id go.

First pass, a count-min sketch. Every window is counted under its least ``gram``-word hash: equal
windows have the same one, so the count of documents under it is never below the number of documents
that hold the window, and neighbouring windows share it, so a document adds about one count for each
thirteen windows. Tasks send the sketch cells of their documents; cells are merged shard by
shard to one bit each (two documents or more) and the bits are broadcast. Their number follows the input up to
``max_cells``; a fuller sketch only lets more windows through.

Second pass: windows whose cells are all set are grouped by 96 bits of hashes of their words (among 10^13 different windows the
odds are 1 in 1,600 that any two are taken for each other) and runs by 128. Neighbouring
windows that share their least gram travel together as a run. Equal runs are first merged to one row
with the least document id; only where a gram has several different runs are their windows told apart, each
with the least id of the runs that hold it. A window is removed if its document's id is larger than that.
Windows are judged on the input, not on what is left. Only documents that have such a window are joined with their runs.

Edge cases: null or blank text has no words and no windows. A null id is neither smaller nor larger than
another: its row keeps all its words and removes none. Rows with the same id are judged each by its own
text and do not mark one another. Extra columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.llm.common import all_of, kept
from stratocloud.llm.packing import _slices

WINDOW = 50
GRAM = 25
DEPTH = 2
CELLS_PER_BYTE = 0.2  # cells of each row of the sketch for each byte of text: about twenty a count
MAX_CELLS = 1 << 28  # of each row of the sketch: 32 MB of bits
SHARD_CELLS = 1 << 20
LONGEST_RUN = 4096
SALTS = 16  # tasks over which the runs that hold one window are spread
SLICE_BYTES = 2 << 20  # of text at once; hashing needs some forty times as much memory

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so powers can be inverted modulo 2^64
_ROWS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)  # odd multipliers of the sketch's rows


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.steps = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.powers[0]) < n:
            self.powers = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, s, np.uint64))]) for s in self.steps]
        return self.powers


class Hasher:
    """Hashes of all runs of words in a slice of texts."""

    def __init__(self):
        self.powers = [_Powers(b) for b in _BASES]

    def read(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of all texts, the ends of the texts among them, and two 64-bit hashes a word."""
        words: list[bytes] = []
        ends = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            words += t.encode().split() if t else ()
            ends[k] = len(words)
        if not words:
            return words, ends, np.empty((2, 0), np.uint64)
        codes, distinct = pd.factorize(np.array(words, object))
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2)
        return words, ends, np.ascontiguousarray(both[codes].T)

    def runs(self, hashes: np.ndarray, n: int, which: int) -> np.ndarray:
        """One of the two hashes of each run of ``n`` words, whatever text they are in."""
        size = len(hashes)
        if size < n:
            return np.empty(0, np.uint64)
        at = np.arange(size - n + 1)
        return self.spans(hashes, at, at + n, which)

    def spans(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """One of the two hashes of the words from each start to before its end."""
        up, down = self.powers[which].upto(len(hashes) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)])])
        h = (total[end] - total[start]) * down[start]
        return h ^ (h >> np.uint64(29))


def least_over(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    if len(h) < n:
        return h[:0]
    width, m = 1, h
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(h) - n + 1], m[n - width : n - width + len(h) - n + 1])


class Windows:
    """The windows of a slice of texts: where they start, in which text, and their least gram."""

    def __init__(self, hasher: Hasher, ends: np.ndarray, hashes: np.ndarray, window: int, gram: int):
        self.hasher, self.hashes, self.window = hasher, hashes, window
        sizes = np.diff(ends, prepend=0)
        count = np.maximum(0, sizes - window + 1)
        self.text = np.repeat(np.arange(len(ends)), count)
        self.first = ends - sizes
        self.start = np.repeat(self.first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        least = least_over(hasher.runs(hashes[0], gram, 0), window - gram + 1)
        self.least = least[self.start]
        new = np.ones(len(self.least), bool)
        new[1:] = (self.least[1:] != self.least[:-1]) | (self.text[1:] != self.text[:-1])
        self.head = np.flatnonzero(new)  # of each run of windows that follow one another in a text and share their least gram

    def runs(self, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run, long ones cut."""
        size = np.diff(self.head, append=len(self.least))
        parts = -(-size // longest)
        at = np.repeat(self.head, parts)
        k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        return at + k * longest, np.minimum(longest, np.repeat(size, parts) - k * longest)


def _cells(least: np.ndarray, depth: int, bits: int) -> Iterator[np.ndarray]:
    for r in range(depth):
        yield ((least * np.uint64(_ROWS[r])) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int, depth: int = DEPTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row, shard, bits): for each shard of the sketch that anything counts in, its cells of two or more documents."""
    shard_bits = min(bits, SHARD_CELLS.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, texts in _slices(batch.column(0), SLICE_BYTES):
                _, ends, hashes = hasher.read(texts)
                w = Windows(hasher, ends, hashes, window, gram)
                heads = pd.DataFrame({"t": w.text[w.head], "h": w.least[w.head]}).drop_duplicates()["h"].to_numpy()
                rows: dict[str, list] = {"row": [], "shard": [], "cells": []}
                for r, cells in enumerate(_cells(heads, depth, bits)):
                    cells.sort()
                    shards = cells >> shard_bits
                    cut = np.flatnonzero(np.diff(shards, prepend=-1))
                    for at, part in zip(cut, np.split(cells, cut[1:])) if len(cells) else ():
                        rows["row"].append(r)
                        rows["shard"].append(int(shards[at]))
                        rows["cells"].append((part & ((1 << shard_bits) - 1)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["row"], pa.int32()), pa.array(rows["shard"], pa.int32()), pa.array(rows["cells"], pa.binary())],
                    ["row", "shard", "cells"],
                )

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << shard_bits, np.uint8)
        for part in parts:
            for cells in part.column("cells"):
                at, n = np.unique(np.frombuffer(cells.as_buffer(), "<u4"), return_counts=True)
                counts[at] = np.minimum(2, counts[at] + np.minimum(2, n)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary()),
            ],
            ["row", "shard", "bits"],
        )

    cells = docs.select("text").mapInArrow(count, "row int, shard int, cells binary")
    return cells.groupBy("row", "shard").applyInArrow(merge, "row int, shard int, bits binary")


def _passed(bitmaps: list[np.ndarray], least: np.ndarray, bits: int) -> np.ndarray:
    """Whether two documents or more are estimated for each least gram."""
    ok = np.ones(len(least), bool)
    for bitmap, cells in zip(bitmaps, _cells(least, len(bitmaps), bits)):
        ok &= (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
    return ok


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def sketch_bits(docs: DataFrame, max_cells: int = MAX_CELLS) -> int:
    """log2 of the cells of a row of the sketch, by the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(12, min(max_cells.bit_length() - 1, int(size * CELLS_PER_BYTE).bit_length()))


def _bitmaps(docs: DataFrame, bits: int, depth: int, window: int, gram: int) -> list[np.ndarray]:
    """The merged sketch, a bit a cell: ``depth`` arrays of at most MAX_CELLS / 8 bytes."""
    out = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(depth)]
    shard = min(1 << bits, SHARD_CELLS) >> 3
    for row, k, found in sketch(docs, bits, depth, window, gram).toLocalIterator():
        out[row][k * shard : (k + 1) * shard] = np.frombuffer(found, np.uint8)
    return out


#: Columns beside the document's own in the table that the second pass writes. ``again`` is true for a
#: document with a window to be grouped, and null for the rows of the runs: least gram, hashes of
#: all words, hashes of each window, first word and number of windows.
_PASS = "uid bigint, again boolean, n_words bigint, kept_sha256 string, gram bigint, d1 bigint, d2 bigint, h1 array<bigint>, h2 array<int>, pos int, n int"
_OWN = tuple(x.split()[0] for x in _PASS.split(", "))


def _second_pass(docs: DataFrame, bitmaps, bits: int, window: int, gram: int, text: bool) -> DataFrame:
    names, schema = docs.columns, docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)
    id_at, text_at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        kinds = {
            "gram": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int32()),
            "pos": pa.int32(), "n": pa.int32(),
        }
        for batch in batches:
            own, uid = batch.columns[:-1], batch.columns[-1]
            for at, texts in _slices(batch.column(text_at), SLICE_BYTES):
                words, ends, hashes = hasher.read(texts)
                w = Windows(hasher, ends, hashes, window, gram)
                first, size = w.runs()
                named = own[id_at].slice(at, len(texts)).is_valid().to_numpy(zero_copy_only=False)
                ok = _passed(shared.value, w.least[first], bits) & named[w.text[first]]
                first, size = first[ok], size[ok]
                again = np.zeros(len(texts), bool)
                again[w.text[first]] = True
                sizes = np.diff(ends, prepend=0)
                sha = [None if text or a else _sha(words[e - n : e]) for a, e, n in zip(again, ends.tolist(), sizes.tolist())]
                row = {name: c.slice(at, len(texts)) for name, c in zip(names, own)}
                if not text:
                    row["text"] = pa.array([t if a else None for a, t in zip(again, texts)], row["text"].type)
                row |= {"uid": uid.slice(at, len(texts)), "again": pa.array(again), "n_words": pa.array(sizes), "kept_sha256": pa.array(sha, pa.string())}
                yield pa.RecordBatch.from_pydict(row | {k: pa.nulls(len(texts), kind) for k, kind in kinds.items()})
                if not len(first):
                    continue
                h1, h2 = (hasher.runs(hashes[k], window, k) for k in (0, 1))
                start = w.start[first]
                d1, d2 = (hasher.spans(hashes[k], start, start + size + (window - 1), k).view(np.int64) for k in (0, 1))
                each = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                rows, n = pa.array(at + w.text[first]), len(first)
                row = {name: c.take(rows) if k == id_at else pa.nulls(n, c.type) for k, (name, c) in enumerate(zip(names, own))}
                row |= {"uid": uid.take(rows), "again": pa.nulls(n, pa.bool_()), "n_words": pa.nulls(n, pa.int64()), "kept_sha256": pa.nulls(n, pa.string())}
                row |= {"gram": pa.array(w.least[first].view(np.int64)), "d1": pa.array(d1), "d2": pa.array(d2)}
                row |= {
                    "h1": pa.ListArray.from_arrays(cuts, pa.array(h1[each].view(np.int64))),
                    "h2": pa.ListArray.from_arrays(cuts, pa.array((h2[each] >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                }
                row |= {"pos": pa.array((start - w.first[w.text[first]]).astype(np.int32)), "n": pa.array(size.astype(np.int32))}
                table = pa.RecordBatch.from_pydict(row)
                for k in range(0, n, 50_000):
                    yield table.slice(k, 50_000)

    own = [T.StructField(f.name, f.dataType) for f in schema]
    return docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, T.StructType([*own, *T.StructType.fromDDL(_PASS)]))


def _least_ids(runs: DataFrame) -> DataFrame:
    """(gram, d1, d2, least) of distinct runs that hold a repeated window; ``least`` has the least document
    id of each window, or a single one that holds for all."""
    key = ["gram", "d1", "d2"]
    per = runs.groupBy(*key).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    per = kept(per).withColumn("run", F.monotonically_increasing_id())  # of a written table, so the same at each read
    groups = kept(per.groupBy("gram").agg(F.count("*").alias("k"), F.min("low").alias("a"), F.max("high").alias("b")).filter("a < b").select("gram", "k"))
    alone = per.join(groups.filter("k = 1").select("gram"), "gram").select(*key, F.array("low").alias("least"))
    apart = kept(per.join(groups.filter("k > 1").select("gram"), "gram").select("run", *key, "low", "h1", "h2"))
    # No run of a gram has a smaller id than its first: windows that another run shares with that one are told by one row a run.
    first = kept(apart.groupBy("gram").agg(F.min_by(F.struct("run", "low", "h1", "h2"), F.struct("low", "run")).alias("first")))
    apart = kept(_beside_first(apart.join(first, "gram").filter(F.col("run") != F.col("first.run"))))
    each = apart.select("run", "low", F.posexplode(F.arrays_zip("at", "h1", "h2")).alias("k", "h")).select(
        "run", F.col("h.at").cast("smallint").alias("at"), "low", "h.h1", "h.h2",
    )
    # A window may be in very many runs: these are dealt by a salt, and a window's least id is taken to each of its salts.
    # A window that a single distinct run holds needs no word from others: its run's least id is its own.
    each = each.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("tinyint"))
    parts = each.groupBy("h1", "h2", "salt").agg(F.min("low").alias("least"), F.count("*").alias("k"))
    window = W.partitionBy("h1", "h2")  # at most SALTS rows
    lows = parts.select("h1", "h2", "salt", F.min("least").over(window).alias("least"), F.sum("k").over(window).alias("k")).filter("k > 1").drop("k")
    lower = each.join(lows, ["h1", "h2", "salt"]).filter("least < low").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("m"))
    told = apart.select("run", *key, "low", "n", "shared", "first_low").join(lower, "run", "left")
    of = lambda i: F.coalesce(F.try_element_at("m", i.cast("smallint")), F.col("low"))
    least = F.when(F.col("m").isNull(), F.array_repeat("low", F.col("n"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), of))
    least = F.zip_with(least, "shared", lambda own, shared: F.when(shared, F.least(own, F.col("first_low"))).otherwise(own))
    leading = first.select("gram", F.col("first.run").alias("run")).join(per.select("gram", "run", "d1", "d2", "low"), ["gram", "run"])
    alone = alone.unionByName(leading.select(*key, F.array("low").alias("least")))
    return alone.unionByName(told.select(*key, least.alias("least")))


def _beside_first(rows: DataFrame) -> DataFrame:
    """Of each run beside the first of its gram: which of its windows that one holds (``shared``), and place and hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "shared": [], "at": [], "h1": [], "h2": []}
            last, known = None, np.empty(0, np.uint64)
            for head, of, h1, h2 in zip(*(batch.column(c) for c in ("first_run", "first", "h1", "h2"))):
                if head.as_py() != last:
                    last, known = head.as_py(), _windows_of(*(of.values.field(k).to_numpy() for k in range(2)))
                own = h1.values.to_numpy(), h2.values.to_numpy()
                shared = np.isin(_windows_of(*own), known)
                other = np.flatnonzero(~shared)
                for c, v in zip(out, (len(shared), shared, other, own[0][other], own[1][other])):
                    out[c].append(v)
            kinds = {"n": pa.int32(), "shared": pa.list_(pa.bool_()), "at": pa.list_(pa.int32()), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int32())}
            kept_columns = {c: batch.column(c) for c in ("run", "gram", "d1", "d2", "low", "first_low")}
            yield pa.RecordBatch.from_pydict(kept_columns | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    zipped = F.arrays_zip("first.h1", "first.h2").alias("first")
    rows = rows.select("run", "gram", "d1", "d2", "low", F.col("first.low").alias("first_low"), F.col("first.run").alias("first_run"), zipped, "h1", "h2")
    schema = "run bigint, gram bigint, d1 bigint, d2 bigint, low bigint, first_low bigint, n int, shared array<boolean>, at array<int>, h1 array<bigint>, h2 array<int>"
    return rows.mapInArrow(run, schema)


def _windows_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Both hashes of windows as one value each."""
    return np.rec.fromarrays([h1.astype("<i8"), h2.astype("<i4")]).view(np.dtype((np.void, 12)))


_WORD_AND_SPACE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut_words(text: str, starts: np.ndarray, window: int) -> tuple[str, int]:
    """The text without the words that windows at ``starts`` cover, each with the space behind it, and their number."""
    parts = _WORD_AND_SPACE.findall(text.encode())
    cover = np.zeros(len(parts) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return b"".join(p for p, g in zip(parts, gone.tolist()) if not g).decode(), int(gone.sum())


def _starts(runs: list[dict] | None, own: int) -> np.ndarray:
    """Where windows begin that also begin in a document with a smaller id."""
    found = [np.empty(0, np.int64)]
    for r in runs or ():
        every = r["least"] is None  # all of them do
        found.append(r["pos"] + (np.arange(r["n"]) if every else np.flatnonzero(np.broadcast_to(np.array(r["least"]), r["n"]) < own)))
    return np.concatenate(found)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, max_cells: int = MAX_CELLS, text: bool = True) -> DataFrame:
    """Every document with n_words and n_removed. With ``text``, all its columns, the text without the
    removed words; otherwise doc_id and kept_sha256, of the kept words joined by single spaces.
    Columns named like those made here are replaced."""
    given = [c for c in docs.columns if c.lower() not in (*_OWN, "n_removed")] if text else ["doc_id", "text"]
    plain = [c if c in ("doc_id", "text") else f"_c{k}" for k, c in enumerate(given)]  # columns may be called anything
    docs = docs.select(*all_of(docs, given)).toDF(*plain)
    names = docs.columns
    bits = sketch_bits(docs, max_cells)
    passed = kept(_second_pass(docs, _bitmaps(docs, bits, depth, window, gram), bits, window, gram, text))
    runs = passed.filter("again IS NULL").withColumn("id", F.col("doc_id"))
    least = _least_ids(runs)
    own = runs.select("gram", "d1", "d2", "id", "uid", "pos", "n").join(least, ["gram", "d1", "d2"]).filter(F.array_min("least") < F.col("id"))
    marks = own.groupBy("uid").agg(F.collect_list(F.struct("pos", "n", F.when(F.array_max("least") >= F.col("id"), F.col("least")).alias("least"))).alias("runs"))
    base = passed.filter("again IS NOT NULL")
    out = [*names, "n_words"] if text else ["doc_id", "n_words", "kept_sha256"]
    same = base.filter("NOT again").select(*out, F.lit(0).cast("long").alias("n_removed"))
    again = base.filter("again").join(marks, "uid", "left").select(*names, "n_words", "runs")
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _slices(b.column(text_at)):
                part = b.slice(at, len(texts))
                starts = [_starts(r, i) for r, i in zip(part.column("runs").to_pylist(), part.column("doc_id").to_pylist())]
                done = [cut_words(t, s, window) if len(s) else (t, 0) for t, s in zip(texts, starts)]
                row = {n: part.column(n) for n in [*names, "n_words"]}
                if text:
                    row["text"] = pa.array([t for t, _ in done], row["text"].type)
                else:
                    row = {n: row[n] for n in ("doc_id", "n_words")} | {"kept_sha256": pa.array([_sha(t.encode().split()) for t, _ in done], pa.string())}
                yield pa.RecordBatch.from_pydict(row | {"n_removed": pa.array([n for _, n in done], pa.int64())})

    done = same.unionByName(again.mapInArrow(cut, same.schema))
    return done.toDF(*given, *done.columns[len(given) :]) if text else done
