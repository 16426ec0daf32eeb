"""Exact top-k search of binary codes by incremental multi-index hashing.

The index is dealt into shards by a hash of the code, each of about ``shard`` codes, and the queries
into blocks; one task searches one block in one shard. There the 64 bits are cut into m segments (about
log2 of the shard's size each) and each segment has a table. The search radius grows segment by
segment: once segments 0..j have been searched to radius s and the others to s-1, every code within
m*s + j differing bits has been met, so a query is done when its kth verified distance is at most that.
Each shard gives its k nearest codes for each query, and the k nearest of those are the answer.

Equal codes are searched once (their k smallest ids, as a larger one cannot be among the nearest k, are joined to what is found;
tasks know only the first and how many there are), and equal query codes are searched once.

Edge cases: a null vector has no code: as a row of the index it is skipped, as a query it has no
result. A code's bit j is 1 if component j is above zero; missing, null and NaN components give 0, and those
beyond 64 are ignored. Rows with a null id cannot be returned. Repeated ids are separate rows of the index.
Fewer than k rows give fewer results. Extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.llm.common import kept

BITS = 64
K = 10
SHARD = 1_000_000
LEAST_BLOCK = 200  # queries; few are dealt over the cores as far as that allows
BLOCK = 100_000


def code_of(embedding: Column, bits: int = BITS) -> Column:
    """The signs of the first ``bits`` components as a 64-bit number; null for a null vector."""
    x = lambda i: F.get(embedding, F.lit(i))
    parts = [F.when((x(i) > 0) & ~F.isnan(x(i)), F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])] + ([parts[-1]] if len(parts) % 2 else [])
    return F.when(embedding.isNotNull(), parts[0])


@cache
def flips(width: int, radius: int) -> np.ndarray:
    """All ``width``-bit numbers with ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Tables over the segments of a shard's distinct codes."""

    def __init__(self, codes: np.ndarray, bits: int = BITS):
        self.codes = codes
        m = max(1, round(bits / max(1.0, min(20.0, np.log2(max(2, len(codes)))))))
        edges = [bits * j // m for j in range(m + 1)]
        self.segments = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
        self.tables = []
        for lo, width in self.segments:
            keys = (codes.view(np.uint64) >> np.uint64(lo)).astype(np.int64) & ((1 << width) - 1)
            order = np.argsort(keys, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << width))])))

    def search(self, query: int, k: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the codes that hold the k nearest (with ``copies`` ids each), all ties included."""
        n, m = len(self.codes), len(self.segments)
        seen, rows, dist, count = np.zeros(n, bool), [], [], np.zeros(BITS + 1, np.int64)
        q = np.uint64(query & (1 << 64) - 1)
        for s in range(max(w for _, w in self.segments) + 1):
            for j, ((lo, width), (order, starts)) in enumerate(zip(self.segments, self.tables)):
                if s <= width:
                    probe = (int(q) >> lo & ((1 << width) - 1)) ^ flips(width, s)
                    first, size = starts[probe], starts[probe + 1] - starts[probe]
                    hit = size > 0
                    first, size = first[hit], size[hit]
                    if len(size):
                        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        found = order[at]
                        found = found[~seen[found]]
                        seen[found] = True
                        d = np.bitwise_count(self.codes[found].view(np.uint64) ^ q)
                        rows.append(found)
                        dist.append(d)
                        count += np.bincount(d, weights=copies[found], minlength=BITS + 1).astype(np.int64)
                if count[: m * s + j + 1].sum() >= k:  # the kth distance is covered
                    break
            else:
                continue
            break
        rows, dist = np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *dist]).astype(np.int64)
        within = np.cumsum(count)
        kth = int(np.argmax(within >= k)) if within[-1] >= k else BITS
        near = dist <= kth
        return rows[near], dist[near]


def _searcher(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, found, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(index) and len(queries):
            codes, copies, first = (index[c].to_numpy() for c in ("code", "n", "first"))
            tables = MultiIndex(codes)
            for q in queries["code"].tolist():
                rows, dist = tables.search(q, k, copies)
                best = np.lexsort((first[rows], dist))[:k]  # a code behind k others, by distance and first id, has none of the k nearest ids
                asked.append(np.full(len(best), q))
                found.append(codes[rows[best]])
                apart.append(dist[best])
        return pd.DataFrame({"code": np.concatenate(asked), "found": np.concatenate(found), "distance": np.concatenate(apart)})

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, id, distance and rank (from 1) of the k nearest ``index`` rows to each row of ``queries``.

    Both have id and code. Ties go to smaller ids; a query that is in the index finds itself.
    """
    ids = index.filter("id IS NOT NULL AND code IS NOT NULL").select("code", F.col("id").cast("long").alias("id"))
    first = W.partitionBy("code").orderBy("id")
    ids = ids.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).drop("r")
    codes = kept(ids.groupBy("code").agg(F.collect_list("id").alias("ids")))
    wanted = kept(queries.filter("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").cast("long").alias("query_id"), "code"))
    asked = kept(wanted.select("code").distinct())
    n_shards, n_asked = max(1, -(-codes.count() // shard)), asked.count()
    cores = index.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n_asked // block), min(cores // n_shards, n_asked // LEAST_BLOCK))  # more shards would make each query's work more
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("code", F.size("ids").alias("n"), F.array_min("ids").alias("first"), dealt(1, n_shards).alias("shard"), every(n_blocks).alias("block"))
    right = asked.select("code", every(n_shards).alias("shard"), dealt(2, n_blocks).alias("block"))
    tasks = min(4 * n_shards * n_blocks, 10_000)  # given as a number, or few bytes would be put together to one task
    left, right = (df.repartition(tasks, "shard", "block").groupBy("shard", "block") for df in (left, right))
    near = left.cogroup(right).applyInPandas(_searcher(k), "code bigint, found bigint, distance bigint")
    near = near.join(codes.select(F.col("code").alias("found"), "ids"), "found").select("code", "distance", F.explode("ids").alias("id"))
    best = W.partitionBy("code").orderBy("distance", "id")
    near = near.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    return wanted.join(near, "code").select("query_id", "id", "distance", "rank")
