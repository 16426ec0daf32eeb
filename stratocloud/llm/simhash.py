"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit j is 1 if it is set in over half the hashes of a text's shingles.
Fingerprints link at ``radius`` or fewer differing bits. The 2^(radius+1)-1 tables each keep the
bits whose code vector has odd parity with the table's number. The code vectors of any ``radius``
bits leave some table number orthogonal to all of them, so a pair within the radius agrees on all
bits which that table keeps: every such pair meets in some table, with certainty.

Equal fingerprints are one node. Tables are grouped by (table, kept bits). A bucket of two is
checked by Spark itself; larger ones go, at most ``bucket`` fingerprints at a time, to a task that
returns a spanning forest of the verified links, never all pairs. A larger bucket is cut into blocks
and every pair of blocks gets its own task, so none is dropped.

Edge cases: null, empty or blank text has fingerprint zero, linked like any other. A text with
fewer words than a shingle is one shingle. Rows with a null id take part; a class that has only null ids has a
null component_id. Repeated rows are repeated in the result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import kept
from stratocloud.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """For each table the bits it keeps, as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    codes = np.resize(np.arange(1, n + 1), 64)  # each code vector serves about as many bits
    codes = np.random.default_rng(seed).permutation(codes)
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i, c in enumerate(codes) if bin(int(c) & v).count("1") & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among the given fingerprints."""
    left, a, b = np.unique(fps), [], []
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius  # signed numbers would count the absolute value's bits
                if near.any():
                    found = left[near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.append(found)
                    left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                u, v = forest(group.values.to_numpy(zero_copy_only=False), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``; their components are those of all links."""
    masks = covering_masks(radius)
    one = kept(fps.select("fp").distinct())
    tables = one.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    sizes = kept(tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = sizes.filter("n = 2").filter(near).select("u", "v")
    more = tables.join(sizes.filter("n > 2").select("t", "key", "n"), ["t", "key"])
    blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), blocks).cast("int")
    more = more.select("t", "key", "fp", blocks.alias("k"), own.alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))  # 0 alone unless the bucket is large
    more = more.withColumn("o", other)
    groups = more.groupBy("t", "key", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).agg(F.collect_list("fp").alias("fps"))
    return pairs.unionByName(groups.select("fps").mapInArrow(_forests(radius), "u bigint, v bigint")).distinct()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id that links reach) of every document."""
    fps = kept(fingerprints(docs, shingle))
    root = connected_components(links(fps, radius, bucket))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = least.join(root, least["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("class"), "least")
    classes = kept(classes)
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "class").join(ids, "class").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
