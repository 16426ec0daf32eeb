"""Grids: cells of points, one point a cell, means of cells, pooling and unpooling, instances, scene boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.functions.keyed import key_hash
from stratocloud.operators.places import ranked, ranked_at_random
from stratocloud.operators.scenes import SCENE, beside, settled, spread
from stratocloud.operators.select import keep_random

CELL = ("gx", "gy", "gz")
XYZ = ("x", "y", "z")
BLOCK = 8  # cells a side that look at their neighbours together


def with_cells(points: DataFrame, size: float, origin: str = "grid") -> DataFrame:
    """Adds gx, gy, gz, from 0 in each scene.

    ``grid``: the floored coordinate minus the scene's least floored coordinate; ``min``: the floor of the distance from the
    scene's least coordinate.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(size))
    if origin == "grid":
        df = beside(points, *(F.min(cell(c)).alias(f"_g{c}") for c in XYZ))
        return df.withColumns({f"g{c}": cell(c) - F.col(f"_g{c}") for c in XYZ}).select(*points.columns, *CELL)
    df = beside(points, *(F.min(c).alias(f"_lo{c}") for c in XYZ))
    return df.withColumns({f"g{c}": F.floor((F.col(c) - F.col(f"_lo{c}")) / F.lit(size)) for c in XYZ}).select(*points.columns, *CELL)


def voxel_pick(
    points: DataFrame, size: float, seed: int = 42, key: str = "pid", origin: str = "grid", name: str = "voxel",
    displacement: bool = False, project: bool = False, forced: Column | None = None,
) -> DataFrame:
    """One random point of each cell, with the cell, its number of points and, if asked for, the point's place in the cell.

    The pick is an aggregate (the least keyed hash), so cells need no sort. ``displacement`` (-0.5 to 0.5 in each
    direction) is along the normal alone with ``project``. Points that are ``forced`` stay beside the picks.
    """
    df = with_cells(points, size, origin)
    low = {f"_lo{c}": F.min(F.floor(F.col(c) / F.lit(size))).alias(f"_lo{c}") for c in XYZ}
    row = F.struct(*points.columns)
    order = F.struct(key_hash(seed, name, F.col(SCENE), F.col(key)), F.col(key))
    picked = df.groupBy(SCENE, *CELL).agg(F.min_by(row, order).alias("_p"), F.count("*").alias("voxel_points"))
    out = picked.select("_p.*", *CELL, "voxel_points")
    if forced is not None:
        extra = df.filter(forced).withColumn("voxel_points", F.lit(None).cast("long"))
        out = out.unionByName(extra.join(out.select(SCENE, key), [SCENE, key], "left_anti"))
    if displacement:
        out = out.join(points.groupBy(SCENE).agg(*low.values()), SCENE)
        d = {c: F.col(c) / F.lit(size) - F.col(f"_lo{c}") - F.col(f"g{c}") - 0.5 for c in XYZ}
        if project:
            along = sum((d[c] * F.col(f"n{c}") for c in "yz"), d["x"] * F.col("nx"))
            out = out.withColumn("displacement", along)
        else:
            out = out.withColumns({f"d{c}": v for c, v in d.items()})
        out = out.drop(*low)
    return out


def voxel_fragments(points: DataFrame, size: float, key: str = "pid") -> DataFrame:
    """All test fragments: fragment i takes point i mod n of each cell of n points, so that every point is in one."""
    df = with_cells(points, size)
    cell = W.partitionBy(SCENE, *CELL)
    df = df.withColumns({"_k": F.row_number().over(cell.orderBy(key)) - 1, "_n": F.count("*").over(cell)})
    df = beside(df, F.max("_n").alias("_most"))
    each = F.sequence(F.col("_k").cast("long"), F.col("_most") - 1, F.col("_n"))
    return df.withColumn("fragment", F.explode(each)).drop("_k", "_n", "_most")


def voxel_inverse(points: DataFrame, size: float) -> DataFrame:
    """The number of each point's cell, in order of the cells of its scene; the cells are ordered, not the points."""
    df = with_cells(points, size)
    cells = settled(df.select(SCENE, *CELL).distinct())
    cells = ranked(cells, list(CELL), _stretch(*CELL)).withColumn("inverse", F.col("_r") - 1).drop("_r")
    return df.join(cells, [SCENE, *CELL])


def _stretch(x: str, y: str, z: str) -> Column:
    """A range of the order of cells: a slice of x and sixteen of y."""
    return F.struct(F.col(x).alias("x"), F.floor(F.col(y) / 16).alias("y"))


def ravel_key(points: DataFrame, size: float) -> DataFrame:
    """One number for each cell of the scene's box, z fastest."""
    df = beside(with_cells(points, size), F.max("gy").alias("_y"), F.max("gz").alias("_z"))
    return df.withColumn("key", (F.col("gx") * (F.col("_y") + 1) + F.col("gy")) * (F.col("_z") + 1) + F.col("gz")).drop("_y", "_z")


def cell_key(points: DataFrame, size: float) -> DataFrame:
    """A 64-bit hash of each point's cell, as a signed number: the first 16 digits of the md5 of its coordinates."""
    digits = F.substring(F.md5(F.concat_ws(":", *CELL)), 1, 16)
    return with_cells(points, size).withColumn("key", F.conv(digits, 16, -10).cast("long"))


def spatial_sample(points: DataFrame, size: float, target: int, seed: int = 42, key: str = "pid") -> DataFrame:
    """``target`` points of each scene: the first of each cell, cut at random or filled up with others at random."""
    df = with_cells(points, size, "min")
    first = df.groupBy(SCENE, *CELL).agg(F.min(key).alias(key)).select(SCENE, key, F.lit(0).alias("_late"))
    df = points.join(first, [SCENE, key], "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
    return ranked_at_random(df, seed, "spatial", key, late="_late", most=F.lit(target), among=points).select(*points.columns)


def spacing_sample(points: DataFrame, median: float, target: int, seed: int = 42, key: str = "pid") -> DataFrame:
    """Scenes of more than ``target`` points are sampled by cells of 0.7 times the median spacing."""
    df = beside(points, F.count("*").alias("_n"))
    few = df.filter(F.col("_n") <= target).select(*points.columns)
    return few.unionByName(spatial_sample(df.filter(F.col("_n") > target).select(*points.columns), 0.7 * median, target, seed, key))


def voxel_centroids(points: DataFrame, size: float) -> DataFrame:
    cells = spread(with_cells(points.select(SCENE, *XYZ), size, "min"), SCENE, *CELL, n=points.count())
    return cells.groupBy(SCENE, *CELL).agg(*(F.avg(c).alias(c) for c in XYZ), F.count("*").alias("n"))


def spatial_grid(points: DataFrame, size: float) -> DataFrame:
    """Cells of the scene's box, the last of which takes in the far face."""
    df = beside(points, *(F.min(c).alias(f"_lo{c}") for c in XYZ), *(F.max(c).alias(f"_hi{c}") for c in XYZ))
    cells = {f"g{c}": F.least(F.floor((F.col(c) - F.col(f"_lo{c}")) / F.lit(size)), F.greatest(F.ceil((F.col(f"_hi{c}") - F.col(f"_lo{c}")) / F.lit(size)) - 1, F.lit(0))) for c in XYZ}
    return df.withColumns(cells).select(*points.columns, *CELL)


REDUCERS = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}


def grid_pool(cells: DataFrame, stride: int, features: Sequence[str], reduce: str = "max", means: Sequence[str] = XYZ) -> tuple[DataFrame, DataFrame]:
    """(pooled cells, fine rows with their ``cluster``). ``cells`` has gx, gy, gz; coordinates are averaged."""
    coarse = {c: F.floor(F.col(c) / F.lit(stride)) for c in CELL}
    fine = cells.withColumns({f"_{c}": v for c, v in coarse.items()})
    key = [SCENE, *(f"_{c}" for c in CELL)]
    aggregates = [REDUCERS[reduce](f).alias(f) for f in features] + [F.avg(m).alias(m) for m in means if m not in features]
    pooled = fine.groupBy(*key).agg(*aggregates, F.count("*").alias("n"))
    pooled = ranked(settled(pooled), key[1:], _stretch(*key[1:])).withColumn("cluster", F.col("_r") - 1).drop("_r")
    fine = fine.join(pooled.select(*key, "cluster"), key).drop(*key[1:])
    return pooled.withColumnsRenamed({f"_{c}": c for c in CELL}), fine


def grid_unpool(fine: DataFrame, pooled: DataFrame, features: Sequence[str], combine: str = "add") -> DataFrame:
    """Brings pooled features back to the rows of each cluster: added to their own, or as ``up_`` columns."""
    df = fine.join(pooled.select(SCENE, "cluster", *(F.col(f).alias(f"up_{f}") for f in features)), [SCENE, "cluster"])
    if combine == "concat":
        return df
    return df.withColumns({f: F.col(f) + F.col(f"up_{f}") for f in features}).drop(*(f"up_{f}" for f in features))


def neighbour_sum(cells: DataFrame, value: str) -> DataFrame:
    """The sum of ``value`` over each occupied cell and the 26 around it. Cells (a row each) go to the block of ``BLOCK`` cells a side that they are in, and those
    at its faces to the blocks beside it; a block adds up for itself."""
    cells = settled(cells)
    at = lambda c, d: F.floor((F.col(c) + d) / F.lit(BLOCK))
    place = [F.explode(F.array_distinct(F.array(*(at(c, d) for d in (-1, 0, 1))))).alias(f"_b{c}") for c in CELL]
    sent, blocks = cells.select(SCENE, *CELL, value), [f"_b{c}" for c in CELL]
    for p in place:
        sent = sent.select("*", p)
    step = lambda c: F.explode(F.filter(F.sequence(F.col(c) - 1, F.col(c) + 1), lambda v: F.floor(v / F.lit(BLOCK)) == F.col(f"_b{c}"))).alias(f"_to{c}")
    sent = spread(sent, SCENE, *blocks, n=2 * cells.count())
    for c in CELL:
        sent = sent.select("*", step(c))
    own = F.lit(True)
    for c in CELL:
        own = own & (F.col(c) == F.col(f"_to{c}"))
    to = [f"_to{c}" for c in CELL]
    sums = sent.groupBy(SCENE, *blocks, *to).agg(F.sum(value).alias("around"), F.count("*").alias("n_around"), F.count_if(own).alias("_own"), F.max(F.when(own, F.col(value))).alias(value))
    sums = sums.filter("_own > 0").select(SCENE, *(F.col(t).alias(c) for c, t in zip(CELL, to)), value, "around", "n_around")
    if set(cells.columns) == {SCENE, *CELL, value}:
        return sums.select(*cells.columns, "around", "n_around")
    return cells.join(sums.drop(value), [SCENE, *CELL])


def parse_instances(points: DataFrame, ignored: Sequence[int] = (-1,)) -> tuple[DataFrame, DataFrame]:
    """(points with dense ``instance`` and their instance's centre, boxes of instances).

    Points of ignored segments have instance -1 and centre -1. A box has its centre, size, theta 0 and class: the
    segment of its first point less the number of ignored segments below it.
    """
    real = points.filter(~F.col("segment").isin(*ignored))
    ids = real.select(SCENE, "instance").distinct().withColumn("_i", (F.row_number().over(W.partitionBy(SCENE).orderBy("instance")) - 1).cast("int"))
    named = points.join(ids, [SCENE, "instance"], "left")
    named = named.withColumn("instance", F.when(F.col("segment").isin(*ignored), -1).otherwise(F.col("_i"))).drop("_i")
    below = sum((F.when(F.col("segment") > v, 1).otherwise(0) for v in ignored), F.lit(0))
    kind = F.min_by(F.col("segment") - below, F.col("pid"))
    boxes = named.filter("instance >= 0").groupBy(SCENE, "instance").agg(
        *(F.avg(c).alias(f"m{c}") for c in XYZ), *(((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in XYZ),
        *((F.max(c) - F.min(c)).alias(f"s{c}") for c in XYZ), F.lit(0.0).alias("theta"), kind.alias("kind"),
    )
    with_centre = named.join(boxes.select(SCENE, "instance", *(f"m{c}" for c in XYZ)), [SCENE, "instance"], "left")
    return with_centre.withColumns({f"m{c}": F.coalesce(f"m{c}", F.lit(-1.0)) for c in XYZ}), boxes


def scene_boxes(points: DataFrame) -> DataFrame:
    """n, corners, diagonal, volume and density of each scene; without volume the density is n."""
    df = points.groupBy(SCENE).agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo{c}") for c in XYZ), *(F.max(c).alias(f"hi{c}") for c in XYZ))
    side = {c: F.col(f"hi{c}") - F.col(f"lo{c}") for c in XYZ}
    df = df.withColumn("diagonal", F.sqrt(side["x"] * side["x"] + side["y"] * side["y"] + side["z"] * side["z"]))
    df = df.withColumn("volume", side["x"] * side["y"] * side["z"])
    return df.withColumn("density", F.when(F.col("volume") > 0, F.try_divide(F.col("n"), F.col("volume"))).otherwise(F.col("n")))


def random_points(points: DataFrame, n: int, seed: int = 42, name: str = "sample", key: str = "pid") -> DataFrame:
    """At most ``n`` random points of each scene."""
    return keep_random(points, F.lit(n), seed, name, key)
