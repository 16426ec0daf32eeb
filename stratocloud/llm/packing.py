"""Bound-certified best-fit packing of documents into token sequences.

Documents are tokenized once, cut into pieces of at most ``capacity`` tokens, and the pieces dealt by
a hash into partitions of about ``part_rows`` pieces. Each partition is packed by best-fit
decreasing, and dual-feasible functions give a lower bound on the sequences that its pieces need.
A partition that meets its bound is certified. While all sequences together number more than the
bound over all pieces, partitions with a gap give up the pieces of all sequences that are not full,
certified ones those of their emptiest sequence; these pieces are dealt anew and packed again.

Edge cases: null or empty text is the end mark alone. Rows with a null id and repeated rows are packed like any.
An empty table gives no pieces. Extra columns are ignored. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratocloud.llm.common import kept

CAPACITY = 4096
END = 1
PART_ROWS = 50_000
IDLE = 2
#: Texts are tokenized in slices of about so many bytes, so that a batch of long texts needs little memory.
SLICE_BYTES = 8 << 20
#: Words remembered between slices; the memory is emptied beyond that.
REMEMBERED = 800_000

#: Words of these characters alone can be split here as the tokenizer's own pattern splits them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\n]*")
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The steps before the model in the vocabulary files whose words can be tokenized one by one. Text of other files
#: goes through the library's tokenizer whole.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class _Pieces(dict):
    """Token ids of the pieces that the pattern leaves, found when first asked for."""

    def __init__(self, model):
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(33, 256)}
        self.model = model

    def __missing__(self, piece: str) -> list[int]:
        found = self[piece] = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        return found


class WordTokenizer:
    """Token ids of many texts, with each distinct word tokenized once.

    Where the tokenizer drops white space and no token of it spans any, a text's ids are those of its
    words one after the other. A file with other steps than those known to do so is used as it is, text by text.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.full.no_padding()
        self.full.no_truncation()
        spec = json.loads(self.full.to_str())
        whole = all("<|" in t["content"] for t in spec["added_tokens"]) and spec["post_processor"] is None
        self.by_word = whole and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.pieces = _Pieces(self.full.model)
        self.words: dict[bytes, list[int]] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Adds words (none of which has white space) to those known."""
        text = b"\n".join(words).decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            plain = []
            for w, t in zip(words, text.split("\n")):
                if "<|" in t or not _PLAIN.fullmatch(t):
                    self.words[w] = self.full.encode(t, add_special_tokens=False).ids
                else:
                    plain.append(w)
            words, text = plain, b"\n".join(plain).decode()
        pieces, at, ids = self.pieces, iter(words), []
        for piece in _PIECES.findall(text.lower() + "\n") if words else ():
            if piece == "\n":
                self.words[next(at)] = ids
                ids = []
            else:
                ids = ids + pieces[piece] if ids else pieces[piece]

    def encode(self, texts: list[str | None], end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, ``end`` after each text, and the number of ids of each text."""
        if not self.by_word:
            found = self.full.encode_batch([t or "" for t in texts], add_special_tokens=False)
            lists = [[*e.ids, end] for e in found]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        words: list[bytes] = []
        sizes = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            at = len(words)
            words += t.encode(errors="replace").split() if t else ()
            words.append(b"\n")
            sizes[k] = len(words) - at
        codes, distinct = pd.factorize(np.array(words, object))
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.pieces.clear()
        known = self.words
        known[b"\n"] = [end]
        self._learn([w for w in distinct if w not in known])
        lists = [known[w] for w in distinct]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        size = lengths[codes]
        before = np.cumsum(size) - size
        out = ids[np.repeat(starts[codes] - before, size) + np.arange(size.sum())]
        ends = np.cumsum(sizes)
        total = np.concatenate([before, [len(out)]])
        return out, total[ends] - total[ends - sizes]


def _slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of about so many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                ids, sizes = tokenizer.encode(texts, end)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, sizes[row] - piece * capacity)
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at + row)), pa.array(piece, pa.int32()),
                        pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), data,
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that ``counts[w]`` pieces of each length w need at least, by dual-feasible functions."""
    w = np.arange(capacity + 1)
    counts = counts.astype(np.int64)
    n, total = np.cumsum(counts), np.cumsum(counts * w)
    e = np.arange(capacity // 2 + 1)  # pieces over capacity - e count as full, those under e as nothing
    full = n[-1] - n[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[e - 1], 0)
    best = int(np.max(full + -(-middle // capacity)))
    for k in range(1, 33):  # round down to k-ths, but keep whole (k+1)-ths as they are
        kths, whole = (k + 1) * w // capacity, (k + 1) * w % capacity == 0
        value = np.where(whole, w * k, kths * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, for lengths in descending order: the fullest bin with room takes it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, n = 0, 0  # bit r of some: a bin with room r is open
    for k, w in enumerate(lengths.tolist()):
        fits = some >> w
        if fits:
            room = w + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[k], offsets[k] = b, capacity - room
        if room > w:
            by_room[room - w].append(b)
            some |= 1 << (room - w)
    return bins, offsets


def _packer(capacity: int, round_: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        t = t.take(order)
        lengths = t["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # What the partition gives up if its round is not the last.
        loose = (fill < capacity)[bins] if gap > 0 else bins == int(np.argmin(fill))
        ids = (round_ << 56) + (key[0].as_py() << 32) + bins
        out = {"bucket": t["bucket"], "sequence_id": ids, "offset": offsets, "gap": np.full(len(bins), gap), "loose": loose & (fill < capacity)[bins]}
        t = t.drop_columns(["bucket"])
        return pa.table({n: t[n] for n in t.column_names} | {k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in out.items()})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32 and more) with sequence_id and offset. Repacking ends at the bound, or when ``IDLE`` rounds in a row save nothing."""
    columns = pieces.columns
    todo = kept(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in todo.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    bound = lower_bound(counts, capacity)
    rows, done, n_done = int(counts.sum()), None, 0
    best, idle = None, 0
    for r in count():
        n_parts = max(1, -(-rows // part_rows))
        bucket = F.pmod(F.xxhash64(F.lit(r), "doc_id", "start", "ids_crc32"), F.lit(n_parts)).cast("long").alias("bucket")
        schema = todo.select(*columns, F.lit(0).cast("long").alias("bucket")).schema.add("sequence_id", "long").add("offset", "long").add("gap", "long").add("loose", "boolean")
        packed = kept(todo.select(*columns, bucket).groupBy("bucket").applyInArrow(_packer(capacity, r), schema))
        seen = packed.agg(
            F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("loose"), F.col("sequence_id"))),
            F.sum(F.col("loose").cast("long")),
        ).first()
        n_bins, n_loose, loose_rows = seen[0], seen[1], seen[2] or 0
        now = packed if done is None else done.unionByName(packed)
        idle = 0 if best is None or n_done + n_bins < best[0] else idle + 1
        if not idle:
            best = (n_done + n_bins, now)
        if idle == IDLE or n_done + n_bins <= bound or not loose_rows or n_loose < 2 or (r and n_parts == 1):
            break
        firm = packed.filter("NOT loose")
        done = firm if done is None else done.unionByName(firm)
        n_done += n_bins - n_loose
        todo, rows = packed.filter("loose"), loose_rows
    return best[1].select(*columns, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, part_rows: int = PART_ROWS,
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` also ids."""
    pieces = token_pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces if keep_ids else pieces.drop("ids"), capacity, part_rows)
