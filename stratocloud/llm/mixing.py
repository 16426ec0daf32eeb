"""Mixing sources to target weights, natively.

Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all
words. A target stops at ``cap`` times its source's words; the excess is shared again by weight
until no target is above. Within a source the documents stand in the order of a keyed hash. The
mix takes whole epochs of the source while the target allows, then the documents whose running
total of words fits, and of the document at the cut just the words that still fit, so that a
source gives exactly the whole part of its target.

The running totals are distributed: a source is cut into hash ranges of about ``range_rows``
documents, the totals of the ranges are summed up per source, and each range sums up its own rows.
So a source with a third of all rows is spread over many tasks; no step gathers a source.

Edge cases: null text has size 0; sources of size 0 have target 0 and are left out of the sharing.
Null is a source of its own. Repeated rows count each; null ids are kept. An empty table gives an
empty result. Extra columns are ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.llm.common import all_of, fresh, kept, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
RANGE_ROWS = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: source, n_rows, source_size, target. ``sizes`` has source and size.

    The water level solves sum(min(cap * size, level * weight)) = share * total: with sources in
    order of the level at which they fill up, it is the first level that does not fill the
    next source, and later levels are lower. The
    windows here run over the table of sources in one task. It has a row of some fifty bytes for each distinct source: tens of millions
    of sources (hosts, say) fit; beyond that sources should be grouped first.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), at))
    limit = F.col("source_size") * F.lit(cap)
    fill = W.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.col("source"))
    per = per.withColumns(
        {
            "limit": limit,
            "goal": F.sum("source_size").over(W.partitionBy()) * F.lit(share),
            "full_before": F.coalesce(F.sum(limit).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    )
    level = (F.col("goal") - F.col("full_before")) / F.col("weight_left")
    fits = F.when(level * F.col("weight") <= F.col("limit"), level)
    per = per.withColumn("level", F.max(fits).over(W.partitionBy()))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return per.select("source", "n_rows", "source_size", target.alias("target"))


def hash_key(seed: int) -> Column:
    """A keyed hash of the id, as hexadecimal digits; their order is a random order, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _unit(key: Column) -> Column:
    """The first 13 digits of the key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document that the mix holds)."""
    sizes = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per = kept(source_targets(sizes, weights, share, cap))
    same = sizes["source"].eqNullSafe(per["source"])
    df = sizes.join(per, same).select("doc_id", sizes["source"], "size", "source_size", "target", "n_rows", hash_key(seed).alias("key"))
    df = df.withColumn("range", F.floor(_unit(F.col("key")) * F.ceil(F.col("n_rows") / F.lit(range_rows))).cast("int"))
    df = df.drop("n_rows")
    totals = df.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before_range"))
    df = df.join(totals, df["source"].eqNullSafe(totals["s"]) & (df["range"] == totals["r"])).drop("s", "r")
    # Rows that tie on all of the order are alike, so which of them comes first cannot be seen.
    order = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before_range") + F.coalesce(F.sum("size").over(order), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return df.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its words are taken, to the nearest whole document.

    A row without words appears once. The texts are not shuffled with the running totals but joined by id; rows that share an
    id share their words taken.
    """
    own, taken, size, copy = fresh(docs, "_id", "_taken", "_size", "_copy")
    mixed = mix(docs, **options).groupBy(F.col("doc_id").alias(own)).agg(F.sum("taken").alias(taken), F.sum("size").alias(size))
    copies = F.when(F.col(size) == 0, 1).otherwise(F.floor(F.try_divide(F.col(taken), F.col(size)) + 0.5))
    joined = docs.join(mixed, docs["doc_id"].eqNullSafe(F.col(own)))
    each = F.explode(F.sequence(F.lit(1), copies.cast("int")))
    return joined.filter(copies >= 1).withColumn(copy, each).select(*all_of(docs))
