"""Points in files along a Hilbert curve, and reads of boxes and balls that open only the files they need.

All scenes share one grid. Files hold ranges of (scene, code), so a stretch of the curve, which is a compact piece of space, is a file or a few; a small table says
which codes of which scene a file holds. A box is cut into cubes of the octree behind the curve, each of which is one interval of codes; at most ``INTERVALS`` of
them, so the cover may be a little too large, and the points read are compared with the box itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocloud.operators.curves import MOST_DEPTH, with_hilbert
from stratocloud.operators.scenes import SCENE

XYZ = ("x", "y", "z")
INTERVALS = 64
ROWS_PER_FILE = 1_000_000


@dataclass
class Grid:
    """The grid of a layout: its corner, its cells' size, and the bits of a coordinate."""

    x: float
    y: float
    z: float
    size: float
    depth: int

    def cells(self) -> dict[str, Column]:
        top = (1 << self.depth) - 1
        at = {c: F.floor((F.col(c) - F.lit(o)) / F.lit(self.size)) for c, o in zip(XYZ, (self.x, self.y, self.z))}
        return {f"_g{c}": F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("long") for c, v in at.items()}


def write_layout(points: DataFrame, path: str, depth: int = 10, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes ``points``, the grid and the table of files below ``path``. Points without coordinates are in no cell and are left out."""
    if not 0 < depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 1 to {MOST_DEPTH}")
    spark = points.sparkSession
    points = points.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ))
    box = points.agg(*(F.min(c).alias(f"low{c}") for c in XYZ), *(F.max(c).alias(f"high{c}") for c in XYZ), F.count("*").alias("n")).first()
    sides = [(box[f"high{c}"] or 0) - (box[f"low{c}"] or 0) for c in XYZ]
    grid = Grid(*(float(box[f"low{c}"] or 0) for c in XYZ), max(*sides, 1e-9) * (1 + 1e-9) / (1 << depth), depth)
    names = [f"_g{c}" for c in XYZ]
    coded = with_hilbert(points.withColumns(grid.cells()), depth, names, "code").drop(*names)
    files = max(1, -(-box["n"] // rows_per_file))
    dealt = coded.repartitionByRange(files, SCENE, "code").sortWithinPartitions(SCENE, "code")
    dealt.write.mode("overwrite").parquet(f"{path}/points")
    held = spark.read.parquet(f"{path}/points").groupBy(F.col("_metadata.file_path").alias("file"), SCENE).agg(
        F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n"),
    )
    held.write.mode("overwrite").parquet(f"{path}/files")
    spark.createDataFrame([tuple(vars(grid).values())], "x double, y double, z double, size double, depth int").write.mode("overwrite").parquet(f"{path}/grid")


def cover(spark: SparkSession, grid: Grid, low: tuple, high: tuple, most: int = INTERVALS) -> list[tuple[int, int]]:
    """Intervals of codes, first and last included, that hold all cells from cell ``low`` to cell ``high``."""
    cubes, done = [(0, 0, 0, 0)], []  # level, and the corner in cubes of that level
    while cubes and len(cubes) + len(done) <= most:
        parts = []
        for level, *corner in cubes:
            side = 1 << (grid.depth - level)
            first, last = [c * side for c in corner], [c * side + side - 1 for c in corner]
            if any(a > h or b < w for a, b, w, h in zip(first, last, low, high)):
                continue
            if level == grid.depth or all(a >= w and b <= h for a, b, w, h in zip(first, last, low, high)):
                done.append((level, *corner))
            else:
                parts += [(level + 1, *(2 * c + (k >> j & 1) for j, c in enumerate(corner))) for k in range(8)]
        if len(parts) + len(done) > most * 4:
            parts, done = [], [*done, *((level, *corner) for level, *corner in cubes if (level, *corner) not in done)]
        cubes = parts
    rows = [(level, *(c << (grid.depth - level) for c in corner)) for level, *corner in [*done, *cubes]]
    if not rows:
        return []
    coded = with_hilbert(spark.createDataFrame(rows, "level int, gx bigint, gy bigint, gz bigint"), grid.depth).select("level", "code").collect()
    found = sorted(((r["code"] >> (s := 3 * (grid.depth - r["level"]))) << s, ((r["code"] >> s) << s) + (1 << s) - 1) for r in coded)
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def _grid(spark: SparkSession, path: str) -> Grid:
    return Grid(**spark.read.parquet(f"{path}/grid").first().asDict())


def files_of(spark: SparkSession, path: str, low: tuple, high: tuple, scenes: list | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """The files that may hold points of a box, and its intervals."""
    grid = _grid(spark, path)
    top = (1 << grid.depth) - 1
    cell = lambda p: tuple(min(max(int((v - o) // grid.size), 0), top) for v, o in zip(p, (grid.x, grid.y, grid.z)))
    intervals = cover(spark, grid, cell(low), cell(high))
    held = spark.read.parquet(f"{path}/files")
    held = held if scenes is None else held.filter(F.col(SCENE).isin(scenes))
    meets = F.lit(False)
    for a, b in intervals:
        meets = meets | ((F.col("low") <= b) & (F.col("high") >= a))
    return sorted(r["file"] for r in held.filter(meets).select("file").distinct().collect()), intervals


def read_box(spark: SparkSession, path: str, low: tuple, high: tuple, scenes: list | None = None) -> DataFrame:
    """Points from corner ``low`` to corner ``high``, both included, of all scenes or of those named."""
    files, intervals = files_of(spark, path, low, high, scenes)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/points").filter("1 = 0")
    codes = F.lit(False)
    for a, b in intervals:
        codes = codes | F.col("code").between(a, b)
    rows = rows.filter(codes)
    rows = rows if scenes is None else rows.filter(F.col(SCENE).isin(scenes))
    for c, a, b in zip(XYZ, low, high):
        rows = rows.filter(F.col(c).between(float(a), float(b)))
    return rows.drop("code")


def read_ball(spark: SparkSession, path: str, centre: tuple, radius: float, scenes: list | None = None) -> DataFrame:
    """Points at most ``radius`` from ``centre``."""
    rows = read_box(spark, path, tuple(c - radius for c in centre), tuple(c + radius for c in centre), scenes)
    square = sum(((F.col(c) - F.lit(float(o))) * (F.col(c) - F.lit(float(o))) for c, o in zip(XYZ[1:], centre[1:])), (F.col("x") - F.lit(float(centre[0]))) * (F.col("x") - F.lit(float(centre[0]))))
    return rows.filter(F.sqrt(square) <= radius)
