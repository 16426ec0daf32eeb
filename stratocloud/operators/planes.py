"""Planes: through three points, by least spread, by random triples, and which of them is a scene's floor.

A scene of bounded size draws and scores its candidate triples in one group; of a larger one the candidates meet slices of its points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.functions.keyed import drawn, drawn_hashes, uniform
from stratocloud.operators.affine import apply_z_up, z_up_rotation
from stratocloud.operators.neighbors import plane_threshold, sampled_median_spacing
from stratocloud.operators.places import ranked_at_random
from stratocloud.operators.scenes import SCENE, beside, settled

XYZ = ("x", "y", "z")
FLAT = 1e-8
#: How much a plane's area, flatness and level weigh against one point of it.
AREA, FLATNESS, LEVEL = 100.0, 1000.0, 500.0
WHOLE = 50_000  # points of a scene that are one group
PAIRS_AT_ONCE = 2_000_000  # of planes and points


def plane_through(p: Column, q: Column, r: Column) -> Column:
    """struct(a, b, c, d) of the unit normal and offset of the plane through three structs x, y, z; null if they lie on a line."""
    u, v = ([t[c] - p[c] for c in XYZ] for t in (q, r))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [F.try_divide(x, size) for x in n]
    d = -(unit[0] * p["x"] + unit[1] * p["y"] + unit[2] * p["z"])
    return F.when(size >= FLAT, F.struct(*(x.alias(c) for x, c in zip((*unit, d), "abcd"))))


def plane_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the row's x, y, z."""
    return F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d) / F.sqrt(a * a + b * b + c * c)


def fit_planes(points: DataFrame, by: list[str] = [SCENE]) -> DataFrame:  # noqa: B006
    """The plane of least squared distance of each group: its six second moments are aggregated, and only those are solved in Python."""
    import numpy as np
    import pandas as pd

    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    moments = points.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in XYZ), *(F.covar_pop(p, q).alias(f"{p}{q}") for p, q in pairs),
    ).filter("n >= 3")

    def solve(batches):
        for t in batches:
            m = np.stack([np.stack([t["".join(sorted(p + q))] for q in XYZ], -1) for p in XYZ], -2)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(t) else np.zeros((0, 3))
            n = n * np.where(n[:, 2:] < 0, -1, 1)
            yield pd.DataFrame({c: t[c] for c in by} | {"a": n[:, 0], "b": n[:, 1], "c": n[:, 2], "d": -(n * t[["mx", "my", "mz"]].to_numpy()).sum(axis=1), "n": t["n"]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return moments.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", a double, b double, c double, d double, n bigint")


def candidate_planes(points: DataFrame, n: int = 500, seed: int = 42, plane: int = 0, key: str = "pid", whole: int = WHOLE) -> DataFrame:
    """(scene_id, candidate, a, b, c, d) of ``n`` random triples of different points of each scene; those on a line are left out.

    Points are numbered in a random order; each triple is three keyed draws of a number, the later ones from those still free.
    Scenes of fewer than three points have none. A scene of at most ``whole`` points is one group, whose draws are never rows.
    """
    small, large, _ = _by_size(points.select(SCENE, F.col(key).cast("string").alias("pid"), *XYZ), whole)

    def draw(group: pa.Table) -> pa.Table:
        number, found = _drawn_planes(group, n, seed, plane)
        return _planes_table(group, number, found)

    schema = T.StructType([points.schema[SCENE], *T.StructType.fromDDL(_PLANE)])
    found = small.groupBy(SCENE).applyInArrow(draw, schema)
    return found if large is None else found.unionByName(_candidates_of_large(large, n, seed, plane))


_PLANE = "candidate int, a double, b double, c double, d double"


def _by_size(points: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Points of scenes of at most ``whole`` points, those of the others, and the others' sizes; None if there is none."""
    sizes = settled(points.groupBy(SCENE).agg(F.count("*").alias("_n")).filter(F.col("_n") > whole))
    if sizes.isEmpty():
        return points, None, None
    return points.join(sizes, SCENE, "left_anti"), points.join(sizes, SCENE, "left_semi"), sizes


def _drawn_planes(group: pa.Table, n: int, seed: int, plane: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and a, b, c, d of the candidates of a scene that fits in a group, as :func:`_candidates_of_large` draws them."""
    size, scene = len(group), group[SCENE][0].as_py()
    if size < 3:
        return np.zeros(0, np.int32), np.zeros((0, 4))
    ids = group["pid"].to_pylist()
    order = np.argsort(drawn_hashes(seed, "triple/order", scene, [i.encode() for i in ids]), kind="stable")
    u = [drawn(seed, f"triple/{plane}", scene, [b"%d:%d" % (c, k) for c in range(n)]) for k in range(3)]
    one, two, three = (np.floor(u[k] * (size - k)).astype(np.int64) for k in range(3))
    two = two + (two >= one)
    three = three + (three >= np.minimum(one, two))
    three = three + (three >= np.maximum(one, two))
    xyz = _xyz(group)[order]
    p, q, r = (xyz[k].T for k in (one, two, three))
    u, v = q - p, r - p
    normal = np.stack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
    long = np.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2])
    real = np.flatnonzero(long >= FLAT)
    unit, p = normal[:, real] / long[real], p[:, real]
    d = -(unit[0] * p[0] + unit[1] * p[1] + unit[2] * p[2])
    return real.astype(np.int32), np.stack([*unit, d], axis=1)


def _planes_table(group: pa.Table, number: np.ndarray, found: np.ndarray, **more: np.ndarray) -> pa.Table:
    scenes = group[SCENE].combine_chunks().take(pa.array(np.zeros(len(number), np.int64)))
    return pa.table({SCENE: scenes, "candidate": pa.array(number, pa.int32())} | {c: found[:, k] for k, c in enumerate("abcd")} | more)


def _xyz(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in XYZ], axis=1).astype(float)


def _inliers(found: np.ndarray, table: pa.Table) -> np.ndarray:
    """How many of the points each plane has within their thresholds."""
    a, b, c, d = found.T[:, :, None]
    size, count, xyz, near = np.sqrt(a * a + b * b + c * c), np.zeros(len(found), np.int64), _xyz(table), table["_t"].to_numpy()
    step = max(1, PAIRS_AT_ONCE // max(1, len(found)))
    for k in range(0, len(xyz), step):
        x, y, z = xyz[k : k + step].T[:, None, :]
        count += np.count_nonzero(np.abs(a * x + b * y + c * z + d) / size < near[None, k : k + step], axis=1)
    return count


def _candidates_of_large(points: DataFrame, n: int, seed: int, plane: int) -> DataFrame:
    rows = ranked_at_random(points, seed, "triple/order")
    draws = points.groupBy(SCENE).agg(F.count("*").alias("n")).filter("n >= 3").withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = [uniform(seed, f"triple/{plane}", F.col(SCENE), F.col("candidate"), F.lit(k)) for k in range(3)]
    draws = draws.withColumns({f"_u{k}": F.floor(u[k] * (F.col("n") - k)).cast("long") for k in range(3)})
    one = F.col("_u0")
    two = F.when(F.col("_u1") >= one, F.col("_u1") + 1).otherwise(F.col("_u1"))
    draws = draws.withColumns({"_one": one, "_two": two})
    low, high = F.least("_one", "_two"), F.greatest("_one", "_two")
    three = F.when(F.col("_u2") >= low, F.col("_u2") + 1).otherwise(F.col("_u2"))
    draws = draws.withColumn("_three", three).withColumn("_three", F.when(F.col("_three") >= high, F.col("_three") + 1).otherwise(F.col("_three")))
    draws = draws.select(SCENE, "candidate", F.posexplode(F.array("_one", "_two", "_three")).alias("k", "_r")).withColumn("_r", F.col("_r") + 1)
    picked = draws.join(rows.select(SCENE, "_r", *XYZ), [SCENE, "_r"])
    triples = picked.groupBy(SCENE, "candidate").agg(*(F.max(F.when(F.col("k") == k, F.struct(*XYZ))).alias(f"p{k}") for k in range(3)))
    return triples.withColumn("_p", plane_through(F.col("p0"), F.col("p1"), F.col("p2"))).filter("_p IS NOT NULL").select(SCENE, "candidate", "_p.*")


def best_plane(
    points: DataFrame, threshold: Column | float, n: int = 500, least: int = 50, seed: int = 42, plane: int = 0, fewest: int = 0, whole: int = WHOLE,
) -> DataFrame:
    """(scene_id, candidate, a, b, c, d, inliers): the candidate with most points within the threshold, the first of equals.

    A scene of at most ``whole`` points is one group that draws its candidates and hands on its best. The points of a larger one are dealt into slices of about so
    many, each of which meets the candidates and hands on a count for each. ``threshold`` may be a column of ``points``; scenes of under ``fewest`` points have none.
    """
    near = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    small, large, sizes = _by_size(points.select(SCENE, F.col("pid").cast("string").alias("pid"), *XYZ, near.alias("_t")), whole)

    def best(group: pa.Table) -> pa.Table:
        number, found = _drawn_planes(group, n, seed, plane) if len(group) >= fewest else (np.zeros(0, np.int32), np.zeros((0, 4)))
        count = _inliers(found, group)
        at = np.argmax(count)[None] if len(count) else np.zeros(0, np.int64)
        at = at[count[at] >= least]
        return _planes_table(group, number[at], found[at], inliers=count[at])

    schema = T.StructType([points.schema[SCENE], *T.StructType.fromDDL(f"{_PLANE}, inliers bigint")])
    top = small.groupBy(SCENE).applyInArrow(best, schema)
    if large is None:
        return top
    sizes = sizes.filter(F.col("_n") >= fewest).select(SCENE, F.ceil(F.col("_n") / whole).cast("int").alias("_slices"))
    candidates = settled(_candidates_of_large(large.drop("_t"), n, seed, plane))
    planes = candidates.join(sizes, SCENE).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    rows = large.join(sizes, SCENE).withColumn("_slice", F.pmod(F.xxhash64("pid"), F.col("_slices")).cast("int")).drop("_slices")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.stack([right[c].to_numpy() for c in "abcd"], axis=1)
        return _planes_table(right, right["candidate"].to_numpy(), found, inliers=_inliers(found, left))

    counted = rows.groupBy(SCENE, "_slice").cogroup(planes.groupBy(SCENE, "_slice")).applyInArrow(count, schema)
    scored = counted.groupBy(SCENE, "candidate").agg(*(F.first(c).alias(c) for c in "abcd"), F.sum("inliers").alias("inliers"))
    first = F.min_by(F.struct("candidate", *"abcd", "inliers"), F.struct(-F.col("inliers"), F.col("candidate"))).alias("_b")
    return top.unionByName(scored.filter(F.col("inliers") >= least).groupBy(SCENE).agg(first).select(SCENE, "_b.*"))


def detect_planes(
    points: DataFrame, threshold: Column | float, planes: int = 2, n: int = 500, least: int = 50, stop: int = 100, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(planes refitted to their points, points with ``plane``: -1 if in none). Planes are taken off one after the other; scenes with under ``stop`` points left are done.

    ``threshold`` may be a column of ``points``. A plane found marks its points in one pass; points are not looked up by their ids.
    """
    state, fits = settled(points.withColumn("plane", F.lit(-1))), None
    free = F.col("plane") == -1
    for k in range(planes):
        best = settled(best_plane(state.filter(free), threshold, n, least, seed, k, stop).select(SCENE, *(F.col(c).alias(f"_{c}") for c in "abcd")))
        near = plane_distance(*(F.col(f"_{c}") for c in "abcd")) < threshold
        state = state.join(best, SCENE, "left").withColumn("plane", F.when(free & near, k).otherwise(F.col("plane")))
        state = settled(state.select(*points.columns, "plane"))
        fit = fit_planes(state.filter(F.col("plane") == k)).withColumn("plane", F.lit(k))
        fits = fit if fits is None else fits.unionByName(fit)
    return fits, state


def ground_scores(members: DataFrame, planes: DataFrame) -> DataFrame:
    """How floor-like each plane is: many points, spread widely in x and y and little in height, facing up."""
    per = members.filter("plane >= 0").groupBy(SCENE, "plane").agg(
        F.count("*").alias("k"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.var_pop("z").alias("vz"),
    )
    df = per.join(planes.select(SCENE, "plane", *"abcd"), [SCENE, "plane"])
    area, flatness = F.sqrt(F.col("vx") * F.col("vy")), F.lit(1.0) / (F.lit(1.0) + F.lit(1000.0) * F.col("vz"))
    score = F.col("k") + F.lit(AREA) * area + F.lit(FLATNESS) * flatness + F.lit(LEVEL) * F.abs("c")
    return df.withColumn("score", score)


def cell_means(points: DataFrame, size: DataFrame) -> DataFrame:
    """The mean of the points of each cell, as scene_id, pid, x, y, z; ``size`` has scene_id and cell. Cells start at the scene's least coordinates."""
    df = beside(points.select(SCENE, *XYZ), *(F.min(c).alias(f"_lo{c}") for c in XYZ)).join(size.select(SCENE, "cell"), SCENE)
    cells = [F.floor((F.col(c) - F.col(f"_lo{c}")) / F.col("cell")).alias(f"g{c}") for c in XYZ]
    means = df.groupBy(SCENE, *cells).agg(*(F.avg(c).alias(c) for c in XYZ))
    return means.select(SCENE, F.concat_ws("-", *(f"g{c}" for c in XYZ)).alias("pid"), *XYZ)


def align_z_up(points: DataFrame, cell: float | None = None, threshold: float | None = None, seed: int = 42, n: int = 500) -> DataFrame:
    """Turns each scene so that its floor is level, below the rest, and its lowest point at height 0; the origin comes to lie on the floor.

    Planes are sought among cell means; without ``cell`` a cell is four times the median spacing (of 10,000 points at most), within 0.01 and
    0.2. Without ``threshold`` it is ``plane_threshold``'s, of the means for the search and of the points for the floor. The best plane's normal
    is turned over if the evidence (the points' middle below the floor's 1, more points below than above 1, normal pointing down 0.5) comes to
    1.5 or more. Scenes without a plane go to their middle, turned by their direction of least spread. Normals are turned too.
    """
    points = settled(points)
    every = points.select(SCENE).distinct()
    if cell is None:
        spacing = every.join(sampled_median_spacing(points, 10_000, seed), SCENE, "left")
        size = spacing.select(SCENE, F.greatest(F.lit(0.01), F.least(F.coalesce(4 * F.col("median"), F.lit(0.01)), F.lit(0.2))).alias("cell"))
    else:
        size = every.withColumn("cell", F.lit(float(cell)))
    means = settled(cell_means(points, settled(size)))
    near = lambda df, seed: every.withColumn("threshold", F.lit(float(threshold))) if threshold is not None else plane_threshold(df, seed=seed)
    planes, members = detect_planes(means.join(near(means, seed), SCENE), F.col("threshold"), n=n, seed=seed)
    scored = ground_scores(members, planes).groupBy(SCENE)
    best = settled(scored.agg(F.max_by(F.struct(*"abcd"), F.struct("score", -F.col("plane"))).alias("f")).select(SCENE, "f.*"))
    side = lambda p: F.col("a") * p[0] + F.col("b") * p[1] + F.col("c") * p[2] + F.col("d")
    own = F.struct(*XYZ)
    on_floor = plane_distance(*map(F.col, "abcd")) < F.col("threshold")
    rows = points.select(SCENE, "pid", *XYZ).join(best, SCENE).join(near(points, seed + 1), SCENE).withColumn("_on", on_floor)
    rows = settled(rows.select(SCENE, "_on", F.signum(side([F.col(c) for c in XYZ])).alias("_side"), own.alias("_p")))
    means_of = [F.avg(F.when(which, F.col(f"_p.{c}"))).alias(f"{m}{c}") for m, which in (("m", F.lit(True)), ("f", F.col("_on"))) for c in XYZ]
    votes = rows.groupBy(SCENE).agg(F.sum("_side").alias("_up"), *means_of).join(best, SCENE)
    lift = sum((F.col(v) * (F.col(f"m{c}") - F.col(f"f{c}")) for v, c in zip("bc", "yz")), F.col("a") * (F.col("mx") - F.col("fx")))
    vote = F.when(lift < 0, 1.0).otherwise(0.0) + F.when(F.col("_up") < 0, 1.0).otherwise(0.0) + F.when(F.col("c") < 0, 0.5).otherwise(0.0)
    sign = F.when(vote >= 1.5, -1.0).otherwise(1.0)
    floors = votes.select(SCENE, *((sign * F.col(v)).alias(v) for v in "abcd"))
    onto = {f"t{c}": -F.col("d") * F.col(v) for v, c in zip("abc", XYZ)}  # the floor's point nearest to the origin
    loose = points.join(best, SCENE, "left_anti")
    flat = fit_planes(loose).select(SCENE, *"abc")
    middle = loose.groupBy(SCENE).agg(*(F.avg(c).alias(f"t{c}") for c in XYZ)).join(flat, SCENE, "left")
    middle = middle.withColumns({v: F.coalesce(F.col(v), F.lit(1.0 if v == "c" else 0.0)) for v in "abc"})
    columns = [SCENE, *"abc", *(f"t{c}" for c in XYZ)]
    turn = settled(z_up_rotation(floors.withColumns(onto).select(*columns).unionByName(middle.select(*columns))))
    lowest = apply_z_up(rows.filter("_on").select(SCENE, "_p.*"), turn).groupBy(SCENE).agg(F.min("z").alias("_lo"))
    return apply_z_up(points, turn).join(lowest, SCENE, "left").withColumn("z", F.col("z") - F.coalesce("_lo", F.lit(0.0))).select(*points.columns)
