"""Convex hulls of scenes: their volume, and density by it.

The hull of a union is the hull of its parts' hulls. So a scene's points are dealt into chunks, each chunk is reduced to the corners
of its own hull, and what is left is dealt anew into fewer chunks until a scene is one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.operators.scenes import SCENE, settled

XYZ = ("x", "y", "z")
CHUNK = 20_000
TOLERANCE = 1e-10  # of the extent: what is no farther outside counts as inside


def _flat_corners(xyz: np.ndarray) -> np.ndarray:
    """Indices of the corners of points that lie in a plane or on a line (to rounding)."""
    middle = xyz - xyz.mean(axis=0)
    axes = np.linalg.svd(middle, full_matrices=False)[2]
    flat = middle @ axes[:2].T if len(axes) > 1 else np.c_[middle @ axes[0], np.zeros(len(xyz))]
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    corners: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for k in way.tolist():
            while len(chain) > 1:
                (ax, ay), (bx, by) = flat[chain[-1]] - flat[chain[-2]], flat[k] - flat[chain[-2]]
                if ax * by - ay * bx > 0:
                    break
                chain.pop()
            chain.append(k)
        corners.update(chain)
    return np.array(sorted(corners))


def _first_four(xyz: np.ndarray, least: float) -> list[int] | None:
    """Four points that span a volume, or None if all lie in a plane."""
    a = int(xyz[:, 0].argmin())
    b = int(((xyz - xyz[a]) ** 2).sum(axis=1).argmax())
    line = xyz[b] - xyz[a]
    if np.linalg.norm(line) <= least:
        return None
    off_line = np.linalg.norm(np.cross(xyz - xyz[a], line / np.linalg.norm(line)), axis=1)
    c = int(off_line.argmax())
    if off_line[c] <= least:
        return None
    normal = np.cross(line, xyz[c] - xyz[a])
    off_plane = np.abs((xyz - xyz[a]) @ (normal / np.linalg.norm(normal)))
    d = int(off_plane.argmax())
    return [a, b, c, d] if off_plane[d] > least else None


def hull(xyz: np.ndarray) -> tuple[np.ndarray, float]:
    """(indices of the corners, volume) of the convex hull: from a tetrahedron outwards, by the farthest point outside of a face."""
    xyz = np.asarray(xyz, float)
    least = TOLERANCE * max(float(np.ptp(xyz, axis=0).max()), 1e-300) if len(xyz) else 0.0
    first = _first_four(xyz, least) if len(xyz) > 3 else None
    if first is None:
        return (_flat_corners(xyz) if len(xyz) > 1 else np.arange(len(xyz))), 0.0
    inner = xyz[first].mean(axis=0)

    def planes(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        normal = np.cross(xyz[tri[:, 1]] - xyz[tri[:, 0]], xyz[tri[:, 2]] - xyz[tri[:, 0]])
        normal = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
        return normal, (normal * xyz[tri[:, 0]]).sum(axis=1)

    a, b, c, d = first
    faces = np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]])
    normal, offset = planes(faces)
    inward = normal @ inner > offset
    faces[inward] = faces[inward][:, ::-1]
    normal, offset = planes(faces)

    def owners(points: np.ndarray, normal: np.ndarray, offset: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """For each point the face that it is farthest outside of (-1: of none), and how far."""
        far = xyz[points] @ normal.T - offset
        best = far.argmax(axis=1)
        height = far[np.arange(len(points)), best]
        return np.where(height > least, best + base, -1), height

    owner, height = owners(np.arange(len(xyz)), normal, offset, 0)
    alive = np.ones(len(faces), bool)
    while (owner >= 0).any():
        top = int(np.where(owner >= 0, height, -np.inf).argmax())
        seen = alive & (normal @ xyz[top] - offset > least)
        seen[owner[top]] = True
        tri = faces[seen]
        edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
        both = set(map(tuple, edges.tolist()))
        rim = np.array([e for e in edges.tolist() if (e[1], e[0]) not in both])
        new = np.c_[rim, np.full(len(rim), top)]
        n, o = planes(new)
        loose = np.flatnonzero((owner >= 0) & seen[np.maximum(owner, 0)])
        loose = loose[loose != top]
        owner[top] = -1
        if len(loose):
            owner[loose], height[loose] = owners(loose, n, o, len(faces))
        faces, normal, offset = np.concatenate([faces, new]), np.concatenate([normal, n]), np.concatenate([offset, o])
        alive = np.concatenate([alive & ~seen, np.ones(len(new), bool)])
    p, q, r = (xyz[faces[alive][:, k]] - inner for k in range(3))
    return np.unique(faces[alive]), float(np.abs((np.cross(p, q) * r).sum()) / 6)


def hull_volumes(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(scene_id, n, volume): the hull's volume; of scenes whose points lie in a plane, the bounding box's (0 if it is flat too).

    No group holds more than about ``chunk`` points of a scene, but for the corners that are left in the end.
    """
    kind = points.schema[SCENE].dataType.simpleString()
    left = points.select(SCENE, *(F.col(c).cast("double").alias(c) for c in XYZ))

    def corners(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[hull(rows[list(XYZ)].to_numpy())[0]][[SCENE, *XYZ]]

    def volume(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({SCENE: [key[0]], "volume": [hull(rows[list(XYZ)].to_numpy())[1]]})

    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))
    scenes = settled(points.groupBy(SCENE).agg(F.count("*").alias("n"), box.alias("_box")))
    counts = scenes.select(SCENE, "n")
    sizes, before = counts, None
    while True:
        many = sizes.filter(F.col("n") > chunk)
        rows = many.agg(F.sum("n")).first()[0]
        if not rows or rows == before:  # all small, or all corners
            break
        dealt = left.join(sizes.withColumnRenamed("n", "_n"), SCENE)
        part = F.pmod(F.xxhash64(*XYZ), F.ceil(F.col("_n") / F.lit(chunk))).alias("_part")
        left = settled(dealt.select(SCENE, *XYZ, part).groupBy(SCENE, "_part").applyInPandas(corners, f"{SCENE} {kind}, x double, y double, z double"))
        sizes, before = left.groupBy(SCENE).agg(F.count("*").alias("n")), rows
    found = left.groupBy(SCENE).applyInPandas(volume, f"{SCENE} {kind}, volume double")
    solid = F.when(F.col("volume") > 0, F.col("volume")).otherwise(F.col("_box"))
    return scenes.join(found, SCENE).select(SCENE, "n", solid.alias("volume"))


def hull_density(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(scene_id, n, volume, density): points by the hull's volume; density 0 where that is 0."""
    per = hull_volumes(points, chunk)
    return per.withColumn("density", F.coalesce(F.try_divide(F.col("n"), F.col("volume")), F.lit(0.0)))
