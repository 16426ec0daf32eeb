"""Joins on an order within keys: rows with the intervals that hold them, and rows with the last, next or nearest row of another table.

Keys of few rows are joined, or sorted, each by itself. A key of more than ``ROWS`` rows is cut into ranges at quantiles of a sketch, so one long key is many tasks: intervals go to every
range that they reach, and what the last row of a range hands on goes through a table of ranges. The cuts, at most ``MOST_CUTS`` numbers in all (the ranges of still
larger tables grow), are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.operators.scenes import settled

ROWS = 200_000
MOST_CUTS = 1_000_000
#: Pairs of rows and intervals of a key up to which they are compared one by one.
PAIRS = 1_000_000


class Cuts:
    """Where the keys of more than ``rows`` rows (by, at) are cut."""

    def __init__(self, table: DataFrame, by: str, at: str, rows: int = ROWS):
        self.by, self.held = by, {}
        sizes = settled(table.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows))
        total = sizes.agg(F.sum("_n")).first()[0] or 0
        size = max(rows, -(-total // MOST_CUTS))
        if total:
            many = table.join(sizes, by).filter(F.col(at).isNotNull())
            cuts = many.groupBy(by).agg(F.max("_n").alias("_n"), F.percentile_approx(F.col(at).cast("double"), F.array(*(F.lit(k / 1000) for k in range(1, 1000))), F.lit(10_000)).alias("_c"))
            for key, n, marks in cuts.collect():  # at most 999 numbers a key; only keys of over ``rows`` rows
                step = max(1, len(marks) * size // n)
                self.held[key] = np.unique(np.array(marks[step - 1 :: step], float))

    def deal(self, rows: DataFrame, low: str, high: str | None = None) -> DataFrame:
        """``rows`` with ``_range``; with ``high``, each once for every range from that of ``low`` to that of ``high`` (excluded itself)."""
        if not self.held:
            return rows.withColumn("_range", F.lit(0))
        shared, by = rows.sparkSession.sparkContext.broadcast(self.held), self.by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                keys = batch.column(names.index(by)).dictionary_encode()
                of = np.asarray(keys.indices.fill_null(-1))
                first = np.zeros(len(batch), np.int64)
                last = first.copy()
                values = [batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ((low,) if high is None else (low, high))]
                for k, key in enumerate(keys.dictionary.to_pylist()):
                    if key in shared.value:
                        own = of == k
                        first[own] = last[own] = np.searchsorted(shared.value[key], values[0][own], side="right")
                        if high is not None:
                            last[own] = np.searchsorted(shared.value[key], values[1][own], side="left")
                count = np.maximum(last - first, 0) + 1
                row = np.repeat(np.arange(len(batch)), count)
                part = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(part.astype(np.int32))], [*names, "_range"])

        return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("_range", T.IntegerType())]))


def interval_join(rows: DataFrame, intervals: DataFrame, by: str, at: str, start: str = "start", end: str = "end", size: int = ROWS, pairs: int = PAIRS) -> DataFrame:
    """Each row with every interval of its key from ``start`` to before ``end`` that holds its ``at``; intervals may overlap. Rows in none are left out.

    The columns are those of both, the key once. Null keys and places meet nothing. ``at``, ``start`` and ``end`` are numbers below 2^53."""
    rows = rows.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    intervals = intervals.filter(F.col(by).isNotNull() & (F.col(start) < F.col(end)))
    sizes = rows.groupBy(by).agg(F.count("*").alias("_k")).join(intervals.groupBy(by).agg(F.count("*").alias("_m")), by)
    many = settled(sizes.filter(F.col("_k") * F.col("_m") > pairs).select(by))
    met = rows.join(intervals, by).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    if many.isEmpty():
        return met
    few = [d.join(many, by, "left_anti") for d in (rows, intervals)]
    met = few[0].join(few[1], by).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    rows, intervals = (settled(d.join(many, by, "left_semi")) for d in (rows, intervals))
    ends = rows.select(by, F.col(at).cast("double").alias("_at")).unionByName(intervals.select(by, F.col(start).cast("double").alias("_at")))
    cuts = Cuts(ends, by, "_at", size)
    left, right = cuts.deal(rows, at), cuts.deal(intervals, start, end)
    out = T.StructType([*rows.schema, *(f for f in intervals.schema if f.name != by)])
    own, other = rows.columns, [c for c in intervals.columns if c != by]

    def sweep(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by(at)
        places = a[at].cast(pa.float64()).to_numpy()
        low, high = (np.searchsorted(places, b[c].cast(pa.float64()).to_numpy(), side="left") for c in (start, end))
        count = np.maximum(high - low, 0)
        row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        which = np.repeat(np.arange(len(b)), count)
        return pa.table([*a.select(own).take(row).columns, *b.select(other).take(which).columns], names=out.names)

    found = left.groupBy(by, "_range").cogroup(right.groupBy(by, "_range")).applyInArrow(sweep, out)
    return met.select(*out.names).unionByName(found)


def asof_join(
    left: DataFrame, right: DataFrame, by: str, at: str, direction: str = "last", tolerance: float | None = None, size: int = ROWS,
) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of its key whose ``at`` is the last at or before its own, the next at or after it, or the nearest
    of both (the last of equals), if it is within the tolerance; else nulls.

    The columns are those of ``left``, ``right_<at>`` and the other columns of ``right``. Of right rows at one place that with the largest columns
    counts. Null keys and places meet nothing."""
    if direction not in ("last", "next", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    others = [c for c in right.columns if c not in (by, at)]
    lone = F.col(by).isNull() | F.col(at).isNull()
    given = right.filter(~lone).groupBy(by, at).agg(F.max(F.struct(*others)).alias("_o")) if others else right.filter(~lone).select(by, at).distinct().withColumn("_o", F.lit(None).cast("string"))
    given = given.select(by, at, F.struct(F.col(at).alias("at"), F.col("_o").alias("o")).alias("_given"))
    row = F.struct(*left.columns).alias("_row")
    both = left.filter(~lone).select(by, at, row, F.lit(None).cast(given.schema["_given"].dataType).alias("_given"))
    both = both.unionByName(given.select(by, at, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_given"))
    cuts = Cuts(both.select(by, F.col(at).cast("double").alias("_at")), by, "_at", size)
    both = cuts.deal(both.withColumn("_at", F.col(at).cast("double")), "_at").drop("_at")
    if cuts.held:
        both = settled(both)
    found = {}
    for side in ("last", "next") if direction == "nearest" else (direction,):
        both, found[side] = _handed_on(both, by, at, side, bool(cuts.held)), F.col(f"_{side}")
    apart = lambda x: F.abs(x["at"] - F.col(at))
    near = next(iter(found.values()))
    if direction == "nearest":
        last, following = found["last"], found["next"]
        near = F.when(following.isNull() | (apart(last) <= apart(following)), last).otherwise(following)
    met = both.filter("_row IS NOT NULL").withColumn("_near", near)
    if tolerance is not None:
        met = met.withColumn("_near", F.when(apart(F.col("_near")) <= tolerance, F.col("_near")))
    met = met.select("_row.*", F.col("_near.at").alias(f"right_{at}"), *((F.col(f"_near.o.{c}").alias(c)) for c in others))
    alone = left.filter(lone).select(*left.columns, *(F.lit(None).cast(met.schema[c].dataType).alias(c) for c in met.columns[len(left.columns) :]))
    return met.unionByName(alone)


def _handed_on(both: DataFrame, by: str, at: str, side: str, cut: bool) -> DataFrame:
    """Adds ``_last`` or ``_next``: what the closest given row at or before (after) holds, from the row's own range or handed on by others."""
    order = (lambda c: F.col(c)) if side == "last" else (lambda c: F.col(c).desc())
    here = W.partitionBy(by, "_range").orderBy(order(at), F.col("_given").isNull())  # given rows first among equals
    name = f"_{side}"
    both = both.withColumn(name, F.last("_given", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)))
    if not cut:
        return both
    pick = F.max if side == "last" else F.min
    ends = both.filter("_given IS NOT NULL").groupBy(by, "_range").agg(pick("_given").alias("_end"))
    ends = both.select(by, "_range").distinct().join(ends, [by, "_range"], "left")  # a row for each range
    earlier = W.partitionBy(by).orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(by, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    return both.join(ends, [by, "_range"]).withColumn(name, F.coalesce(name, "_before")).drop("_before")
