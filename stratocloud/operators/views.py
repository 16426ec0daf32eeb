"""Several overlapping crops of each scene for contrastive training."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.functions.keyed import drawn_hashes, key_hash, uniform
from stratocloud.operators.places import ranked_by_distance
from stratocloud.operators.scenes import SCENE, beside, settled
from stratocloud.operators.select import squared_distance


WHOLE = 50_000  # points of a scene whose views are cut in one group
XYZ = ("x", "y", "z")


def _crop(points: DataFrame, centers: DataFrame, scale: tuple[float, float], most: int, name: str, seed: int) -> DataFrame:
    """The points nearest to each scene's centre: a uniform share of the smaller of ``most`` and its points."""
    size = F.floor(uniform(seed, f"{name}/size", F.col(SCENE), low=scale[0], high=scale[1]) * F.least(F.lit(most), F.col("_n")))
    df = beside(points, F.count("*").alias("_n")).join(centers, SCENE)
    apart = squared_distance(*(F.col(f"c{c}") for c in "xyz"))
    return ranked_by_distance(df, apart, most=F.greatest(F.lit(1), size), among=points).select(*points.columns).withColumn("view", F.lit(name))


def _one(points: DataFrame, name: str, seed: int) -> DataFrame:
    """A random point of each scene as (scene_id, cx, cy, cz)."""
    best = F.min_by(F.struct("x", "y", "z"), F.struct(key_hash(seed, f"{name}/center", F.col(SCENE), F.col("pid")), F.col("pid")))
    return points.groupBy(SCENE).agg(best.alias("c")).select(SCENE, *(F.col(f"c.{c}").alias(f"c{c}") for c in "xyz"))


def multi_views(
    points: DataFrame, global_views: int = 2, local_views: int = 4, global_scale=(0.4, 1.0), local_scale=(0.1, 0.4),
    most: int = 65_536, band: tuple[float, float] = (0.0, 1.0), seed: int = 42, global_transform=None, local_transform=None,
    shared_transform=None, whole: int = WHOLE,
) -> DataFrame:
    """All views of all scenes, told apart by ``view``.

    The first global view is centred on a point within the height ``band`` (shares of the scene's height), further ones on points
    of the first. Each local view is centred on a point of the first view that no local view has covered yet; once all are
    covered, on any. ``shared_transform`` (colours, say) is applied to the scene once, before its global views are cut; local views are
    cut from the scene as it was. The other transforms are applied to each view.

    All views of a scene of at most ``whole`` points are cut in one group, so points are shuffled once and not once a view; larger scenes, and those of a
    ``shared_transform``, go view by view.
    """
    names = [f"global{k}" for k in range(global_views)] + [f"local{k}" for k in range(local_views)]
    shape = (global_views, local_views, global_scale, local_scale, most, band, seed)
    if shared_transform:
        found = _view_by_view(points, *shape, shared_transform)
    else:
        known = F.coalesce(sum((F.abs(c).cast("double") for c in XYZ), F.lit(0.0)) < F.lit(float("inf")), F.lit(False))
        large = points.groupBy(SCENE).agg(F.count("*").alias("_n"), F.bool_and(known).alias("_known")).filter((F.col("_n") > whole) | ~F.col("_known")).select(SCENE)
        large = settled(large)
        apart = not large.isEmpty()
        found = _whole_scenes(points.join(large, SCENE, "left_anti") if apart else points, *shape)
        if apart:
            found = found.unionByName(_view_by_view(settled(points.join(large, SCENE, "left_semi")), *shape, None))
    change = dict(zip(names, [global_transform] * global_views + [local_transform] * local_views))
    if not (global_transform or local_transform):
        return found
    found, done = settled(found), None
    for name, step in change.items():
        df = found.filter(F.col("view") == name)
        df = step(df) if step else df
        done = df if done is None else done.unionByName(df)
    return done


def _whole_scenes(points: DataFrame, global_views: int, local_views: int, global_scale, local_scale, most: int, band, seed: int) -> DataFrame:
    """The views of scenes of bounded size."""
    slim = points.select(SCENE, "pid", *XYZ)
    schema = slim.withColumn("view", F.lit("")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["pid"]))
        scene, n = group[SCENE][0].as_py(), len(group)
        ids, xyz = [str(p).encode() for p in group["pid"].to_pylist()], np.stack([group[c].to_numpy() for c in XYZ], axis=1)

        def crop(rows: np.ndarray, name: str, scale: tuple[float, float]) -> np.ndarray:
            """The points nearest to a random one of ``rows``, which are in order of their ids."""
            at = xyz[rows[np.argsort(drawn_hashes(seed, f"{name}/center", scene, [ids[r] for r in rows]), kind="stable")[0]]]
            unit = int(hashlib.md5(f"{seed}:{name}/size:{scene}".encode()).hexdigest()[:13], 16) / (1 << 52)
            size = int((scale[0] + unit * (scale[1] - scale[0])) * min(most, n))
            x, y, z = (xyz - at).T
            return np.sort(np.argsort(x * x + y * y + z * z, kind="stable")[: max(1, size)])

        z = xyz[:, 2]
        low, high = z.min(), z.max()
        inside = np.flatnonzero((z - low - (high - low) * band[0] >= 0) & (z <= low + (high - low) * band[1]))
        found, covered = [], np.zeros(n, bool)
        if len(inside):
            major = crop(inside, "global0", global_scale)
            found = [("global0", major)] + [(f"global{k}", crop(major, f"global{k}", global_scale)) for k in range(1, global_views)]
            for k in range(local_views):
                free = major[~covered[major]]
                local = crop(free if len(free) else major, f"local{k}", local_scale)
                found.append((f"local{k}", local))
                covered[local] = True
        tables = [group.take(pa.array(rows)).append_column("view", pa.array([name] * len(rows), pa.string())) for name, rows in found]
        return pa.concat_tables(tables) if tables else group.slice(0, 0).append_column("view", pa.array([], pa.string()))

    found = slim.groupBy(SCENE).applyInArrow(run, schema)
    if set(points.columns) == set(slim.columns):
        return found.select(*points.columns, "view")
    return points.join(found.select(SCENE, "pid", "view").hint("merge"), [SCENE, "pid"]).select(*points.columns, "view")


def _view_by_view(points: DataFrame, global_views: int, local_views: int, global_scale, local_scale, most: int, band, seed: int, shared_transform) -> DataFrame:
    scene = settled(shared_transform(points)) if shared_transform else points
    df = beside(scene, F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    level = (F.col("z") - F.col("_lo")) - (F.col("_hi") - F.col("_lo")) * F.lit(band[0])
    inside = df.filter((level >= 0) & (F.col("z") <= F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(band[1]))).select(*points.columns)
    major = settled(_crop(scene, _one(inside, "global0", seed), global_scale, most, "global0", seed))
    out = [major]
    for k in range(1, global_views):
        out.append(_crop(scene, _one(major, f"global{k}", seed), global_scale, most, f"global{k}", seed))
    covered = None
    for k in range(local_views):
        free = major if covered is None else major.join(covered, [SCENE, "pid"], "left_anti")
        center = _one(free, f"local{k}", seed)
        again = _one(major, f"local{k}", seed).join(center.select(SCENE), SCENE, "left_anti")
        local = settled(_crop(points, center.unionByName(again), local_scale, most, f"local{k}", seed))
        out.append(local)
        seen = local.select(SCENE, "pid")
        covered = seen if covered is None else covered.unionByName(seen)
    done = out[0]
    for df in out[1:]:
        done = done.unionByName(df)
    return done
