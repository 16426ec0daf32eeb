"""Coordinate transforms. Points have x, y, z and may have nx, ny, nz; a missing group is left alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocloud.functions.keyed import normal, uniform
from stratocloud.operators.scenes import SCENE, beside, has

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")


def center_shift(points: DataFrame, apply_z: bool = True) -> DataFrame:
    """The middle of the scene's bounding box goes to 0 in x and y, its floor to 0 in z."""
    df = beside(points, *(f(c).alias(f"_{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))))
    moved = {c: F.col(c) - (F.col(f"_lo{c}") + F.col(f"_hi{c}")) / 2 for c in "xy"}
    moved["z"] = F.col("z") - (F.col("_loz") if apply_z else F.lit(0.0))
    return df.withColumns(moved).select(*points.columns)


def positive_shift(points: DataFrame) -> DataFrame:
    df = beside(points, *(F.min(c).alias(f"_lo{c}") for c in XYZ))
    return df.withColumns({c: F.col(c) - F.col(f"_lo{c}") for c in XYZ}).select(*points.columns)


def normalize_coord(points: DataFrame) -> DataFrame:
    """The mean goes to 0 and the farthest point to distance 1."""
    df = beside(points, *(F.avg(c).alias(f"_m{c}") for c in XYZ)).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in XYZ})
    df = beside(df, F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("_far"))
    return df.withColumns({c: F.try_divide(F.col(c), F.col("_far")) for c in XYZ}).select(*points.columns)


def random_shift(points: DataFrame, shift=((-0.2, 0.2), (-0.2, 0.2), (0.0, 0.0)), seed: int = 42) -> DataFrame:
    """One offset an axis for each scene."""
    return points.withColumns({c: F.col(c) + uniform(seed, f"shift/{c}", F.col(SCENE), low=lo, high=hi) for c, (lo, hi) in zip(XYZ, shift)})


def point_clip(points: DataFrame, box: Sequence[float] = (-80, -80, -3, 80, 80, 1)) -> DataFrame:
    """Coordinates beyond the box are set to its faces; no point is dropped."""
    return points.withColumns({c: F.greatest(F.lit(float(box[k])), F.least(F.col(c), F.lit(float(box[k + 3])))) for k, c in enumerate(XYZ)})


def _turned(names: Sequence[str], angle: Column, axis: str) -> dict[str, Column]:
    """A right-handed turn about an axis."""
    k = XYZ.index(axis)
    a, b = names[(k + 1) % 3], names[(k + 2) % 3]
    return {a: F.col(a) * F.cos(angle) - F.col(b) * F.sin(angle), b: F.col(a) * F.sin(angle) + F.col(b) * F.cos(angle)}


def rotate(points: DataFrame, angle: Column | float, axis: str = "z", center: Sequence[float] | None = None) -> DataFrame:
    """Turns coordinates about ``center`` (the bounding box's if None) and normals about the origin."""
    angle = F.lit(angle) if isinstance(angle, (int, float)) else angle
    if center is None:
        df = beside(points, *(((F.min(c) + F.max(c)) / 2).alias(f"_c{c}") for c in XYZ))
        middle = {c: F.col(f"_c{c}") for c in XYZ}
    else:
        df, middle = points, {c: F.lit(float(v)) for c, v in zip(XYZ, center)}
    df = df.withColumns({c: F.col(c) - middle[c] for c in XYZ}).withColumns(_turned(XYZ, angle, axis))
    df = df.withColumns({c: F.col(c) + middle[c] for c in XYZ})
    if has(points, *NORMAL):
        df = df.withColumns(_turned(NORMAL, angle, axis))
    return df.select(*points.columns)


def random_rotate(points: DataFrame, angle=(-1.0, 1.0), axis: str = "z", center: Sequence[float] | None = None, p: float = 0.5, seed: int = 42) -> DataFrame:
    """A turn by a uniform share of pi for a share ``p`` of the scenes."""
    turn = uniform(seed, f"rotate/{axis}", F.col(SCENE), low=angle[0], high=angle[1]) * math.pi
    return rotate(points, F.when(uniform(seed, f"rotate/{axis}/p", F.col(SCENE)) < p, turn).otherwise(0.0), axis, center)


def random_rotate_target(
    points: DataFrame, angles=(0.5, 1.0, 1.5), axis: str = "z", center: Sequence[float] | None = None, p: float = 0.75,
    seed: int = 42,
) -> DataFrame:
    """A turn by one of the listed shares of pi."""
    pick = F.floor(uniform(seed, f"target/{axis}", F.col(SCENE)) * len(angles)).cast("int")
    turn = F.get(F.array(*(F.lit(a * math.pi) for a in angles)), pick)
    return rotate(points, F.when(uniform(seed, f"target/{axis}/p", F.col(SCENE)) < p, turn).otherwise(0.0), axis, center)


def random_scale(points: DataFrame, scale=(0.95, 1.05), anisotropic: bool = False, seed: int = 42) -> DataFrame:
    """About the origin; normals stay."""
    factor = lambda c: uniform(seed, f"scale/{c if anisotropic else 'all'}", F.col(SCENE), low=scale[0], high=scale[1])
    return points.withColumns({c: F.col(c) * factor(c) for c in XYZ})


def random_flip(points: DataFrame, p: float = 0.5, seed: int = 42) -> DataFrame:
    """Mirrors x, and independently y, of a share ``p`` of the scenes."""
    out = {}
    for c in "xy":
        flip = uniform(seed, f"flip/{c}", F.col(SCENE)) < p
        for name in (c, f"n{c}") if has(points, f"n{c}") else (c,):
            out[name] = F.when(flip, -F.col(name)).otherwise(F.col(name))
    return points.withColumns(out)


def random_jitter(points: DataFrame, sigma: float = 0.01, clip: float = 0.05, seed: int = 42, key: str = "pid") -> DataFrame:
    """Clipped normal noise on every coordinate."""
    bounded = lambda v: F.greatest(F.lit(-clip), F.least(v, F.lit(clip)))
    return points.withColumns({c: F.col(c) + bounded(normal(seed, f"jitter/{c}", F.col(SCENE), F.col(key)) * sigma) for c in XYZ})


def clip_gaussian_jitter(points: DataFrame, scalar: float = 0.02, seed: int = 42, key: str = "pid", store: bool = False) -> DataFrame:
    """Normal noise in which 1.96 deviations count as ``scalar``, clipped there; with ``store`` also as jx, jy, jz."""
    noise = {f"j{c}": F.greatest(F.lit(-1.0), F.least(normal(seed, f"gauss/{c}", F.col(SCENE), F.col(key)) / 1.96, F.lit(1.0))) * scalar for c in XYZ}
    df = points.withColumns(noise)
    df = df.withColumns({c: F.col(c) + F.col(f"j{c}") for c in XYZ})
    return df if store else df.select(*points.columns)


def z_up_rotation(scenes: DataFrame, normal_columns=("a", "b", "c")) -> DataFrame:
    """Adds r00..r22, the turn that takes each scene's floor normal to +z.

    A normal within 0.001 of +z keeps the scene, one within 0.001 of -z turns it about x; between them Rodrigues' formula holds.
    """
    a, b, c = (F.col(n) for n in normal_columns)
    size = F.sqrt(a * a + b * b + c * c)
    df = scenes.withColumns({"_a": a / size, "_b": b / size, "_c": c / size})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    # axis (b, -a, 0), sine^2 = a^2 + b^2, cosine = c
    k = (F.lit(1.0) - c) / (a * a + b * b)
    turn = {
        "r00": 1 - k * a * a, "r01": -k * a * b, "r02": -a, "r10": -k * a * b, "r11": 1 - k * b * b, "r12": -b, "r20": a,
        "r21": b, "r22": 1 - k * (a * a + b * b),
    }
    same = {"r00": 1.0, "r11": 1.0, "r22": 1.0}
    over = {"r00": 1.0, "r11": -1.0, "r22": -1.0}
    rows = {n: F.when(c > 0.999, F.lit(same.get(n, 0.0))).when(c < -0.999, F.lit(over.get(n, 0.0))).otherwise(v) for n, v in turn.items()}
    return df.withColumns(rows).drop("_a", "_b", "_c")


def apply_z_up(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """R (p - t) with r00..r22 and tx, ty, tz from the scene's row; normals are turned."""
    df = points.join(scenes.select(SCENE, *(f"r{i}{j}" for i in range(3) for j in range(3)), "tx", "ty", "tz"), SCENE)
    moved = [F.col(c) - F.col(f"t{c}") for c in XYZ]
    turned = {c: sum((F.col(f"r{i}{j}") * moved[j] for j in range(1, 3)), F.col(f"r{i}0") * moved[0]) for i, c in enumerate(XYZ)}
    if has(points, *NORMAL):
        turned |= {c: sum((F.col(f"r{i}{j}") * F.col(NORMAL[j]) for j in range(1, 3)), F.col(f"r{i}0") * F.col("nx")) for i, c in enumerate(NORMAL)}
    return df.withColumns(turned).select(*points.columns)


def scale_by(points: DataFrame, factor: Column | float) -> DataFrame:
    factor = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return points.withColumns({c: F.col(c) * factor for c in XYZ})


#: The factor that the released preprocessing applies, and the room sizes it would draw from:
#: least, percentiles 10, 25, 50, 75, 90, 95 and 99, and the weights of the intervals between them.
FORCED_FACTOR = 1.753
ROOM_SIZES = (2.835, 5.236, 6.323, 7.791, 9.365, 10.929, 12.139, 15.189)
ROOM_WEIGHTS = (0.01, 0.09, 0.25, 0.30, 0.20, 0.10, 0.05)


def sampled_room_size(seed: int = 42, sizes=ROOM_SIZES, weights=ROOM_WEIGHTS) -> Column:
    """A size for each scene: an interval by weight, then uniform inside."""
    u, v = uniform(seed, "room", F.col(SCENE)), uniform(seed, "room/in", F.col(SCENE))
    inside = [F.lit(lo) + v * F.lit(hi - lo) for lo, hi in zip(sizes, sizes[1:])]
    out = inside[-1]
    for k in reversed(range(len(weights) - 1)):
        out = F.when(u < round(sum(weights[: k + 1]), 10), inside[k]).otherwise(out)
    return out


def adjust_scale(points: DataFrame, factor: float | None = FORCED_FACTOR, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Scaled points and a report a scene: diagonal before, size drawn, factor used.

    With ``factor`` None a scene is scaled so that its diagonal gets the size drawn.
    """
    spread = sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in ("y", "z")), (F.max("x") - F.min("x")) * (F.max("x") - F.min("x")))
    report = points.groupBy(SCENE).agg(F.sqrt(spread).alias("diagonal")).withColumn("drawn", sampled_room_size(seed))
    used = F.lit(factor) if factor is not None else F.coalesce(F.try_divide(F.col("drawn"), F.col("diagonal")), F.lit(1.0))
    report = report.withColumn("factor", used)
    if factor is not None:
        return scale_by(points, factor), report
    return scale_by(points.join(report.select(SCENE, "factor"), SCENE), F.col("factor")).select(*points.columns), report


def scale_to_volume(points: DataFrame, target: float, hull: bool = False) -> DataFrame:
    """Scales each scene so that its bounding box, or its convex hull, has the target volume; flat scenes stay."""
    if hull:
        from stratocloud.operators.hull import hull_volumes

        df = points.join(hull_volumes(points).select(SCENE, F.col("volume").alias("_v")), SCENE)
    else:
        volume = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))
        df = beside(points, volume.alias("_v"))
    return scale_by(df, F.when(F.col("_v") > 0, F.pow(F.try_divide(F.lit(target), F.col("_v")), F.lit(1 / 3))).otherwise(1.0)).select(*points.columns)


def grid_coord(points: DataFrame, size: float, by: str | None = None) -> DataFrame:
    """gx, gy, gz: cells from the least coordinate of the whole batch (or of each ``by``), truncated."""
    if by:
        df = beside(points, *(F.min(c).alias(f"_lo{c}") for c in XYZ), by=by)
    else:
        df = points.withColumns({f"_lo{c}": points.agg(F.min(c)).scalar() for c in XYZ})
    return df.withColumns({f"g{c}": ((F.col(c) - F.col(f"_lo{c}")) / F.lit(size)).cast("long") for c in XYZ}).select(*points.columns, "gx", "gy", "gz")


def layout_offset(points: DataFrame, step: float = 8.0) -> DataFrame:
    """Scenes side by side along x."""
    from stratocloud.operators.schema import batch_index

    return points.join(batch_index(points), SCENE).withColumn("x", F.col("x") + F.col("batch") * step).select(*points.columns)
