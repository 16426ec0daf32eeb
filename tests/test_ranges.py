"""Interval and as-of joins against comparing all rows."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import frames
from stratocloud.operators.ranges import asof_join, interval_join


def _tables(spark):
    rng = np.random.default_rng(21)
    rows = [("long", int(t), k) for k, t in enumerate(rng.integers(0, 5_000, 3_000))] + [("short", 5, 1), ("none", 1, 2), (None, 3, 3), ("long", None, 4)]
    starts = rng.integers(0, 5_000, 200)
    spans = [("long", int(s), int(s + n), f"c{k}") for k, (s, n) in enumerate(zip(starts, rng.integers(0, 400, 200)))]
    spans += [("long", 0, 6_000, "all"), ("short", 5, 6, "one"), ("short", 6, 5, "empty"), (None, 0, 9, "null"), ("long", 17, 18, "same"), ("long", 17, 18, "same")]
    return rows, spans


@pytest.mark.parametrize("size", [100, 10**6])
@pytest.mark.parametrize("pairs", [10, 10**7])
def test_interval_join(spark, size, pairs):
    rows, spans = _tables(spark)
    left = spark.createDataFrame(rows, "k string, at bigint, n int").repartition(3)
    right = spark.createDataFrame(spans, "k string, start bigint, end bigint, name string").repartition(3)
    found = sorted(map(tuple, interval_join(left, right, "k", "at", size=size, pairs=pairs).collect()), key=str)
    want = [(k, t, n, s, e, c) for k, t, n in rows if k and t is not None for k2, s, e, c in spans if k == k2 and s <= t < e]
    assert found == sorted(want, key=str)


def test_overlapping_cuts_of_a_video_of_a_million_frames(spark):
    rows = spark.range(1_000_000).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_index"))
    cuts = spark.range(0, 1_000_000, 1_000).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("start"), (F.col("id") + 1_500).alias("end"))
    found = frames.split_at_cuts(rows, cuts).agg(F.count("*"), F.sum(F.col("frame_index") - F.col("start")), F.countDistinct("frame_index")).first()
    assert found[0] == 999 * 1_500 + 1_000 and found[2] == 1_000_000
    assert found[1] == 999 * sum(range(1_500)) + sum(range(1_000))


def _asof(rows, given, direction, tolerance):
    by = {}
    for k, t, v in given:
        if k is not None and t is not None:
            at = by.setdefault(k, {})
            at[t] = max(at.get(t, (False, "")), (v is not None, v or ""))
    out = []
    for k, t, n in rows:
        best = None
        if k in by and t is not None:
            places = sorted(by[k])
            i, j = bisect.bisect_right(places, t) - 1, bisect.bisect_left(places, t)
            last, following = places[i] if i >= 0 else None, places[j] if j < len(places) else None
            choice = {"last": last, "next": following}.get(direction)
            if direction == "nearest":
                choice = following if last is None or following is not None and following - t < t - last else last
            best = choice if choice is not None and (tolerance is None or abs(choice - t) <= tolerance) else None
        value = None if best is None else by[k][best][1] if by[k][best][0] else None
        out.append((k, t, n, best, value))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 10**6])
@pytest.mark.parametrize("direction, tolerance", [("last", None), ("next", 20), ("nearest", 7), ("nearest", None)])
def test_asof_join(spark, direction, tolerance, size):
    rng = np.random.default_rng(22)
    rows = [("long", int(t), k) for k, t in enumerate(rng.integers(-50, 3_000, 600))] + [("short", 5, 1), ("none", 1, 2), (None, 3, 3), ("long", None, 4), ("short", 5, 1)]
    given = [("long", int(t), f"v{t % 13}") for t in rng.integers(0, 2_900, 80)] + [("long", 100, "a"), ("long", 100, "b"), ("long", 101, None), ("short", 5, "x"), (None, 3, "y"), ("long", None, "z")]
    left = spark.createDataFrame(rows, "k string, at bigint, n int").repartition(3)
    right = spark.createDataFrame(given, "k string, at bigint, v string").repartition(3)
    found = asof_join(left, right, "k", "at", direction, tolerance, size)
    assert found.columns == ["k", "at", "n", "right_at", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == _asof(rows, given, direction, tolerance)
