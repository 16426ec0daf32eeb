"""Filters, crops, samples and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.functions.keyed import key_hash, uniform
from stratocloud.operators.places import CROWD, numbered, ranked_at_random, ranked_by_distance
from stratocloud.operators.scenes import SCENE, beside


def keep_random(points: DataFrame, target: Column, seed: int, name: str, key: str = "pid") -> DataFrame:
    """``target`` random points of each scene."""
    return ranked_at_random(points, seed, name, key, most=target).select(*points.columns)


def random_dropout(
    points: DataFrame, ratio: float = 0.2, application_ratio: float = 0.5, seed: int = 42, key: str = "pid",
    forced: Column | None = None,
) -> DataFrame:
    """Keeps the whole part of n (1 - ratio) points of a share of the scenes; ``forced`` points always stay."""
    on = uniform(seed, "dropout/p", F.col(SCENE)) < application_ratio
    df = ranked_at_random(beside(points, F.count("*").alias("_n")), seed, "dropout", key)
    stay = ~on | (F.col("_r") <= F.floor(F.col("_n") * F.lit(1 - ratio)))
    return df.filter(stay | forced if forced is not None else stay).select(*points.columns)


def squared_distance(*center: Column) -> Column:
    x, y, z = (F.col(c) - v for c, v in zip(("x", "y", "z"), center))
    return x * x + y * y + z * z


def scene_center(points: DataFrame, mode: str, seed: int = 42, key: str = "pid") -> DataFrame:
    """(scene_id, cx, cy, cz): a random point of the scene, or the one in the middle of its key order."""
    if mode == "random":
        best = F.min_by(F.struct("x", "y", "z"), F.struct(key_hash(seed, "crop", F.col(SCENE), F.col(key)), F.col(key)))
        return points.groupBy(SCENE).agg(best.alias("c")).select(SCENE, *(F.col(f"c.{c}").alias(f"c{c}") for c in "xyz"))
    if mode != "center":
        raise ValueError(f"unknown crop mode {mode!r}")
    df = points.select(SCENE, key, *"xyz")
    sizes = df.groupBy(SCENE).agg(F.count("*").alias("_n"))
    if sizes.filter(F.col("_n") > CROWD).isEmpty():  # scenes are sorted one by one
        df = df.withColumn("_r", F.row_number().over(W.partitionBy(SCENE).orderBy(key))).join(sizes, SCENE)
        return df.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(SCENE, *(F.col(c).alias(f"c{c}") for c in "xyz"))
    df = numbered(df, SCENE, key)
    middle = df.groupBy(SCENE).agg((F.min("_place") + F.floor(F.count("*") / 2)).alias("_place"))
    return df.join(middle, [SCENE, "_place"]).select(SCENE, *(F.col(c).alias(f"c{c}") for c in "xyz"))


def sphere_crop(
    points: DataFrame, point_max: int | None = 80_000, sample_rate: float | None = None, mode: str = "random", seed: int = 42,
    key: str = "pid",
) -> DataFrame:
    """The points nearest to a centre, at most ``point_max`` (or a share of the scene)."""
    df = points if sample_rate is None else beside(points, F.count("*").alias("_n"))
    df = df.join(scene_center(points, mode, seed, key), SCENE)
    most = F.floor(F.col("_n") * F.lit(sample_rate)) if sample_rate is not None else F.lit(point_max)
    apart = squared_distance(*(F.col(f"c{c}") for c in "xyz"))
    return ranked_by_distance(df, apart, key, most, among=points).select(*points.columns)


def nearest_to(points: DataFrame, at: Sequence[float], k: int, key: str = "pid") -> DataFrame:
    """The k points of each scene nearest to a place, with their rank."""
    return ranked_by_distance(points, squared_distance(*map(F.lit, map(float, at))), key, F.lit(k)).withColumnRenamed("_r", "rank")


def shuffle_points(points: DataFrame, seed: int = 42, key: str = "pid") -> DataFrame:
    """A random place for each point of a scene."""
    return ranked_at_random(points, seed, "shuffle", key).withColumnRenamed("_r", "place")


def crop_boundary(points: DataFrame, segments: Sequence[int] = (0, 1)) -> DataFrame:
    return points.filter(~F.col("segment").isin(*segments))


def pre_downsample(points: DataFrame, threshold: int, seed: int = 42, key: str = "pid") -> DataFrame:
    """Scenes above the threshold keep exactly that many points."""
    return keep_random(points, F.lit(threshold), seed, "downsample", key)


def adjust_density(
    points: DataFrame, target: float, ratio: float = 1.5, most: int = 200_000, least: int = 40_000, seed: int = 42,
    key: str = "pid",
) -> DataFrame:
    """Brings scenes above ``ratio`` times the target density, or of over ``most`` points, to the target.

    The number aimed at is at least ``least`` and within 30 % of the present one; where it is larger, points appear again
    (``copy`` counts from 0).
    """
    volume = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))
    df = beside(points, F.count("*").alias("_n"), volume.alias("_v"))
    density = F.coalesce(F.try_divide(F.col("_n"), F.col("_v")), F.lit(0.0))
    wanted = F.greatest(F.coalesce(F.col("_n") * F.try_divide(F.lit(target), density), F.col("_n")).cast("long"), F.lit(least))
    wanted = F.least(F.greatest(wanted, F.floor(F.col("_n") * 0.7)), F.floor(F.col("_n") * 1.3))
    goal = F.when((density > target * ratio) | (F.col("_n") > most), wanted).otherwise(F.col("_n"))
    df = ranked_at_random(df.withColumn("_goal", goal), seed, "density", key)
    again = F.when(F.col("_r") <= F.col("_goal") - F.col("_n"), 2).otherwise(1)
    df = df.filter(F.col("_r") <= F.col("_goal")).withColumn("copy", F.explode(F.sequence(F.lit(0), again - 1)))
    return df.select(*points.columns, "copy")


def first_of_each(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each value."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order))).filter("_r = 1").drop("_r")


def manifest_filter(manifest: DataFrame, wanted: DataFrame, order: str = "video_id", n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows asked for, the first ``n`` in order; ids that are missing)."""
    found = manifest.join(wanted.select("video_id"), "video_id", "left_semi")
    missing = wanted.select("video_id").join(manifest, "video_id", "left_anti")
    return (found.orderBy(order).limit(n) if n else found), missing


def skip_existing(work: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def shard(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Round robin: ``shard`` of the i-th row is i mod n."""
    return numbered(rows, order).withColumn("shard", F.pmod("_place", F.lit(n)).cast("long")).drop("_place")


def split_evenly(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Contiguous parts whose sizes differ by one at most, the larger first."""
    df = numbered(rows, order)
    size = df.count()
    each, more = divmod(size, n)  # the first ``more`` parts have one row more
    late = F.lit(more) + F.floor((F.col("_place") - more * (each + 1)) / F.lit(max(1, each)))
    part = F.when(F.col("_place") < more * (each + 1), F.floor(F.col("_place") / F.lit(each + 1))).otherwise(late)
    return df.withColumn("part", part.cast("long")).drop("_place")


def longest(clips: DataFrame, n: int, duration: str = "n_frames", key: str = "clip_id") -> DataFrame:
    return clips.orderBy(F.desc(duration), key).limit(n)


def confident(rows: DataFrame, logit: Column, least: float = 0.1) -> DataFrame:
    """Rows whose logistic confidence is above ``least``."""
    return rows.filter(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) > least)
