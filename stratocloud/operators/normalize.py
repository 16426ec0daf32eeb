"""Iterative normalization of spacing, elastic distortion and gentle upsampling, over all scenes at once.

Each round is a set of joins over the scenes that aren't done; the loop on the driver only counts rounds and holds
no data. What a round needs again is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocloud.functions.keyed import drawn, drawn_hashes, key_hash, uniform
from stratocloud.operators.neighbors import nearest, spacing_scale
from stratocloud.operators.places import ranked, ranked_at_random
from stratocloud.operators.scenes import SCENE, beside, has, settled, spread
from stratocloud.operators.splits import knn

XYZ = ("x", "y", "z")
FALLBACK = 0.01  # the spacing of a scene of one point
WHOLE = 50_000  # points of a scene that is thinned in one group
DRAWS = 10_000  # of a scene, numbered together


def _thin(points: DataFrame, size: str, seed: int, name: str) -> DataFrame:
    """One random point of each cell; the cell's size is a column."""
    df = beside(points, *(F.min(c).alias(f"_lo{c}") for c in XYZ))
    cells = [F.floor((F.col(c) - F.col(f"_lo{c}")) / F.col(size)).alias(f"_g{c}") for c in XYZ]
    best = F.min_by(F.struct(*points.columns), F.struct(key_hash(seed, name, F.col(SCENE), F.col("pid")), F.col("pid")))
    return df.groupBy(SCENE, *cells).agg(best.alias("_p")).select("_p.*")


def _spaced(points: DataFrame) -> DataFrame:
    """The points with their scene's mean spacing."""
    points = settled(points)
    return settled(points.join(spacing_scale(points).select(SCENE, F.col("mean").alias("spacing")), SCENE))


def _best(states: list[DataFrame], target: float) -> DataFrame:
    """Of the states of each scene the one nearest to the target, the first of equals."""
    rows = states[0].withColumn("_at", F.lit(0))
    for k, state in enumerate(states[1:], 1):
        rows = rows.unionByName(state.withColumn("_at", F.lit(k)))
    each = rows.groupBy(SCENE, "_at").agg(F.first("spacing").alias("spacing"))
    at = each.groupBy(SCENE).agg(F.min_by("_at", F.struct(F.abs(F.col("spacing") - target), "_at")).alias("_at"))
    return settled(rows.join(at, [SCENE, "_at"]).drop("_at"))


def _sizes(state: DataFrame, target: float, mark: str) -> DataFrame:
    return state.groupBy(SCENE).agg(F.count("*").alias(f"n{mark}"), F.first(F.abs(F.col("spacing") - target) / F.lit(target)).alias(f"error{mark}"))


def _mean_spacing(xyz: np.ndarray) -> float:
    d = knn(xyz, xyz, np.arange(len(xyz)), 1)[0][:, 0]
    return float(d.mean()) if len(d) > 1 else FALLBACK


def _picked(scene: object, ids: list[bytes], xyz: np.ndarray, size: float, seed: int, name: str) -> np.ndarray:
    """The rows that ``_thin`` picks."""
    cell = np.floor((xyz - xyz.min(axis=0)) / size).astype(np.int64)
    order = np.lexsort((drawn_hashes(seed, name, scene, ids), *cell.T))
    first = np.r_[True, np.any(cell[order[1:]] != cell[order[:-1]], axis=1)]
    return order[first]


def _thinned(scene: object, ids: list[bytes], xyz: np.ndarray, target: float, threshold: float, rounds: int, seed: int) -> tuple[np.ndarray, float, float]:
    """Rows of one scene that stay, and its spacing before and after."""
    off = lambda spacing: abs(spacing - target) / target
    named = lambda rows: [ids[r] for r in rows]
    states = [(np.arange(len(xyz)), _mean_spacing(xyz))]
    for k in range(rounds):
        rows, spacing = states[-1]
        factor = (1.0 / max(1.0 + ((spacing / target) ** 3 - 1) * 0.2, 0.5)) ** (1 / 3)
        if not (off(spacing) > threshold and spacing < target and factor >= 1.02):
            break
        rows = rows[_picked(scene, named(rows), xyz[rows], spacing * factor, seed, f"spacing/{k}")]
        states.append((rows, _mean_spacing(xyz[rows])))
    rows, spacing = min(states, key=lambda s: abs(s[1] - target))
    if off(spacing) > threshold:
        factor = 1.0 + (target / spacing - 1) * 0.3 if spacing < target else 1.0
        laid = rows[_picked(scene, named(rows), xyz[rows], target * factor, seed, "spacing/layout")]
        after = _mean_spacing(xyz[laid])
        if off(after) < off(spacing) and len(rows) - len(laid) < 0.2 * len(rows):
            rows, spacing = laid, after
    return rows, states[0][1], spacing


def _thinned_scenes(points: DataFrame, target: float, threshold: float, rounds: int, seeds: list[int]) -> DataFrame:
    """(scene_id, pid, n_before, n_after, after, before, error) of the points that stay; a scene is one group, thinned once for each seed while its error
    is not under the threshold."""
    schema = points.select(SCENE, "pid", *(F.lit(0).cast("long").alias(c) for c in ("n_before", "n_after")), *(F.lit(0.0).alias(c) for c in ("after", "before", "error"))).schema

    def run(group: pa.Table) -> pa.Table:
        scene, pids = group[SCENE][0].as_py(), group["pid"].to_pylist()
        ids, xyz = [str(p).encode() for p in pids], np.stack([group[c].to_numpy() for c in XYZ], axis=1).astype(float)
        rows, before, after = np.arange(len(xyz)), None, None
        for seed in seeds:
            stay, first, after = _thinned(scene, [ids[r] for r in rows], xyz[rows], target, threshold, rounds, seed)
            rows, before = rows[stay], first if before is None else before
            if not abs(after - target) / target >= threshold:
                break
        n, told = len(rows), (len(xyz), len(rows), after, before, abs(after - target) / target)
        each = {name: pa.array(np.full(n, v)) for name, v in zip(schema.names[2:], told)}
        return pa.table({c: group[c].take(pa.array(rows)) for c in (SCENE, "pid")} | each)

    return points.select(SCENE, "pid", *XYZ).groupBy(SCENE).applyInArrow(run, schema)


def _normalized(points: DataFrame, target: float, threshold: float, rounds: int, seeds: list[int], whole: int) -> tuple[DataFrame, DataFrame]:
    """Scenes of at most ``whole`` points are thinned in a group each, so their points are shuffled once however many rounds they take; larger
    ones, and those with points without coordinates, in rounds of joins. All of it works on ids and coordinates; other columns are joined at the end."""
    slim = points.select(SCENE, "pid", *XYZ)
    known = F.coalesce(sum((F.abs(c).cast("double") for c in XYZ), F.lit(0.0)) < F.lit(float("inf")), F.lit(False))
    large = settled(slim.groupBy(SCENE).agg(F.count("*").alias("_n"), F.bool_and(known).alias("_known")).filter((F.col("_n") > whole) | ~F.col("_known")).select(SCENE))
    apart = not large.isEmpty()
    kept = settled(_thinned_scenes(slim.join(large, SCENE, "left_anti") if apart else slim, target, threshold, rounds, seeds))
    done = kept.select(SCENE, "pid")
    report = kept.groupBy(SCENE).agg(*(F.first(c).alias(c) for c in kept.columns[2:]))
    if apart:
        more, told = _in_rounds(settled(slim.join(large, SCENE, "left_semi")), target, threshold, rounds, seeds)
        done, report = done.unionByName(more.select(SCENE, "pid")), report.unionByName(told)
    # a table of ids may look small as a compressed file; it must not go through the driver
    return points.join(done.hint("merge"), [SCENE, "pid"], "left_semi"), report


def adjust_spacing(
    points: DataFrame, target: float, threshold: float = 0.03, rounds: int = 10, seed: int = 42, whole: int = WHOLE,
) -> tuple[DataFrame, DataFrame]:
    """(points, report). Scenes that are denser than the target are thinned step by step until their mean spacing is within the threshold.

    A step aims at a fifth of the way in number of points. A scene stops when it is within the threshold, too sparse, or its step is under 2 %.
    The best state of each scene is kept. Scenes still off by more than the threshold get a layout pass, one point a cell of about
    the target's size, which is taken if it lessens the error and changes the number of points by under 20 %.
    """
    return _normalized(points, target, threshold, rounds, [seed], whole)


def refine_spacing(
    points: DataFrame, target: float, threshold: float = 0.03, rounds: int = 10, seed: int = 42,
    reruns: int = 5, whole: int = WHOLE,
) -> tuple[DataFrame, DataFrame]:
    """``adjust_spacing``, run again up to ``reruns`` times, with other draws, on the scenes whose error is not under the threshold."""
    return _normalized(points, target, threshold, rounds, [seed + k for k in range(reruns + 1)], whole)


def _adjusted(points: DataFrame, target: float, threshold: float, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    first = settled(spacing_scale(points).select(SCENE, F.col("mean").alias("before")))
    state = settled(points.join(first.withColumn("spacing", F.col("before")), SCENE).drop("before"))
    states = [state]
    error = F.abs(F.col("spacing") - target) / F.lit(target)
    for k in range(rounds):
        step = F.lit(1.0) + (F.pow(F.col("spacing") / F.lit(target), F.lit(3.0)) - 1) * 0.2
        factor = F.pow(F.lit(1.0) / F.greatest(step, F.lit(0.5)), F.lit(1 / 3))
        go = (error > threshold) & (F.col("spacing") < target) & (factor >= 1.02)
        moving = state.filter(go).withColumn("_size", F.col("spacing") * factor)
        if moving.isEmpty():
            break
        state = _spaced(_thin(moving, "_size", seed, f"spacing/{k}").select(*points.columns))
        states.append(state)
    done = _best(states, target)
    off = done.filter(error > threshold)
    if not off.isEmpty():
        factor = F.when(F.col("spacing") < target, F.lit(1.0) + (F.lit(target) / F.col("spacing") - 1) * 0.3).otherwise(1.0)
        laid = _spaced(_thin(off.withColumn("_size", F.lit(target) * factor), "_size", seed, "spacing/layout").select(*points.columns))
        sizes = _sizes(off, target, "_old").join(_sizes(laid, target, "_new"), SCENE)
        better = sizes.filter((F.col("error_new") < F.col("error_old")) & (F.abs(F.col("n_new") - F.col("n_old")) < 0.2 * F.col("n_old"))).select(SCENE)
        done = settled(done.join(better, SCENE, "left_anti").unionByName(laid.join(better, SCENE, "left_semi")))
    n = points.groupBy(SCENE).agg(F.count("*").alias("n_before"))
    after = done.groupBy(SCENE).agg(F.count("*").alias("n_after"), F.first("spacing").alias("after"))
    report = n.join(after, SCENE).join(first, SCENE).withColumn("error", F.abs(F.col("after") - target) / F.lit(target))
    return done.select(*points.columns), report


def _in_rounds(points: DataFrame, target: float, threshold: float, rounds: int, seeds: list[int]) -> tuple[DataFrame, DataFrame]:
    done, report = (settled(df) for df in _adjusted(points, target, threshold, rounds, seeds[0]))
    for seed in seeds[1:]:
        off = report.filter(F.col("error") >= threshold)
        if off.isEmpty():
            break
        again, more = _adjusted(settled(done.join(off, SCENE, "left_semi")), target, threshold, rounds, seed)
        done = settled(done.join(off, SCENE, "left_anti").unionByName(again))
        changed = off.select(SCENE, "n_before", "before").join(more.select(SCENE, "n_after", "after", "error"), SCENE)
        report = settled(report.join(off, SCENE, "left_anti").unionByName(changed))
    return done, report


def iterate_spacing(
    points: DataFrame, target: float, rounds: int = 5, least: float = 0.7, enough: float = 0.02, seed: int = 42,
) -> DataFrame:
    """Off the main path: scenes are thinned in growing cells; a scene stops within ``enough`` of the target, when its error
    does not lessen or when under ``least`` of its points are left. The best state before that is kept.
    """
    ratio = F.col("spacing") / F.lit(target)
    start = F.when(
        ratio < 1, F.least(F.lit(1.25), F.greatest(F.lit(0.95), F.pow(1 / ratio, F.lit(0.25)))),
    ).otherwise(F.least(F.lit(1.05), F.greatest(F.lit(0.8), F.pow(ratio, F.lit(0.25)))))
    sizes = points.groupBy(SCENE).agg(F.floor(F.count("*") * F.lit(least)).alias("_least"))
    state = _spaced(points)
    scenes = settled(state.groupBy(SCENE).agg(F.first("spacing").alias("spacing")).withColumns({"_factor": start, "_error": F.lit(float("inf"))}).drop("spacing").join(sizes, SCENE))
    states = [state]
    for k in range(rounds):
        error = F.abs(ratio - 1)
        now = state.groupBy(SCENE).agg(F.count("*").alias("_n"), F.first("spacing").alias("spacing")).join(scenes, SCENE)
        now = now.filter((F.col("_n") >= F.col("_least")) & (error < F.col("_error")))
        states[-1] = state.join(now, SCENE, "left_semi")  # a state that is too small or no better is not kept
        growth = F.sqrt(F.greatest(ratio, 1 / ratio))
        scenes = settled(now.filter(error >= enough).select(SCENE, (F.col("_factor") * growth).alias("_factor"), error.alias("_error"), "_least"))
        if k == rounds - 1 or scenes.isEmpty():
            break
        moving = state.join(scenes.select(SCENE, (F.col("_factor") * target).alias("_size")), SCENE)
        state = _spaced(_thin(moving, "_size", seed, f"iterate/{k}").select(*points.columns))
        states.append(state)
    return _best(states, target).select(*points.columns)


#: What two box blurs of width three make of a node's neighbours in one direction.
BLUR = {-2: 1 / 9, -1: 2 / 9, 0: 3 / 9, 1: 2 / 9, 2: 1 / 9}


BLOCK = 8  # cells in each direction that are moved together


def _noise(scene: object, low: np.ndarray, high: np.ndarray, most: np.ndarray, seed: int, name: str) -> np.ndarray:
    """Blurred noise at the nodes from ``low`` to ``high``, as [x, y, z, direction]. Beyond the grid (one node before the least cell to two behind the
    corners of the largest, ``most``) noise is 0."""
    first, last = np.maximum(low - 2, -1), np.minimum(high + 2, most + 2)
    field = np.zeros((*(high - low + 5), 3))
    axes = [range(f, t + 1) for f, t in zip(first, last)]
    nodes = [b"%d:%d:%d" % (x, y, z) for x in axes[0] for y in axes[1] for z in axes[2]]
    u, v = (np.stack([drawn(seed, f"{name}/{c}/{w}", scene, nodes) for c in XYZ], axis=1).reshape(*map(len, axes), 3) for w in "uv")
    inner = tuple(slice(f - o + 2, t - o + 3) for f, t, o in zip(first, last, low))
    field[inner] = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * math.pi * v)
    for axis in range(3):
        n = field.shape[axis] - 4
        field = sum(w * np.take(field, range(2 - d, 2 - d + n), axis) for d, w in BLUR.items())
    return field


def _shifts(scene: object, xyz: np.ndarray, low: np.ndarray, most: np.ndarray, size: float, seed: int, name: str) -> np.ndarray:
    """How the noise moves points of one block: by the eight corners of a point's cell, each by how near it is."""
    at = (xyz - low) / size
    cell = np.floor(at).astype(np.int64)
    share, least = at - cell, cell.min(axis=0)
    field = _noise(scene, least, cell.max(axis=0) + 1, most, seed, name)
    out = np.zeros_like(xyz)
    for corner in np.ndindex(2, 2, 2):
        w = np.where(np.array(corner) == 1, share, 1 - share).prod(axis=1)
        out += w[:, None] * field[tuple((cell - least + corner).T)]
    return out


def elastic_distortion(points: DataFrame, steps=((0.2, 0.4), (0.8, 1.6)), p: float = 0.95, seed: int = 42) -> DataFrame:
    """Moves points by smoothed noise on a grid, for each (cell size, magnitude).

    Noise is a function of the grid node, so nothing but points is shuffled, once a step, by blocks of cells; a task draws the nodes around
    those of its blocks that hold points. Blocks of very many points may be split, as any rows of a block can be moved by themselves.
    """
    df = points
    for k, (size, magnitude) in enumerate(steps):
        df = _distorted(df, size, magnitude, p, seed, f"elastic/{k}")
    return df.select(*points.columns)


def _distorted(points: DataFrame, size: float, magnitude: float, p: float, seed: int, name: str) -> DataFrame:
    low, far, block = ([f"_{m}{c}" for c in XYZ] for m in ("lo", "far", "b"))
    floor = lambda c, side: F.floor((F.col(c) - F.col(f"_lo{c}")) / F.lit(side))
    box = points.groupBy(SCENE).agg(*(F.min(c).cast("double").alias(f"_lo{c}") for c in XYZ), *(F.max(c).cast("double").alias(f"_far{c}") for c in XYZ))
    box = box.withColumns({f"_far{c}": F.floor((F.col(f"_far{c}") - F.col(f"_lo{c}")) / F.lit(size)) for c in XYZ})
    rows = points.withColumns({c: F.col(c).cast("double") for c in XYZ}).join(box.withColumn("_on", uniform(seed, "elastic/p", F.col(SCENE)) < p), SCENE)
    rows = rows.withColumns({b: floor(c, size * BLOCK) for b, c in zip(block, XYZ)})
    rows = rows.hint("rebalance", SCENE, *block).sortWithinPartitions(SCENE, *block)
    schema = rows.select(*points.columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = lambda names: np.stack([table[c].to_numpy() for c in names], axis=1)
            xyz = held(XYZ).astype(float)
            scenes = table[SCENE].combine_chunks().dictionary_encode()
            names = scenes.dictionary.to_pylist()
            known = np.isfinite(xyz).all(axis=1) & table["_on"].to_numpy(zero_copy_only=False).astype(bool)
            rows = np.flatnonzero(known)
            lows, most = held(low)[rows], held(far)[rows].astype(np.int64)
            keys = np.column_stack([scenes.indices.to_numpy()[rows], held(block)[rows].astype(np.int64)])
            ends = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for part in np.split(np.arange(len(rows)), ends) if len(rows) else ():
                k = part[0]
                xyz[rows[part]] += magnitude * _shifts(names[keys[k, 0]], xyz[rows[part]], lows[k], most[k], size, seed, name)
            columns = [pa.array(xyz[:, XYZ.index(c)], from_pandas=True) if c in XYZ else batch.column(batch.schema.names.index(c)) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


_ATTRIBUTES = (("r", "g", "b"), ("nx", "ny", "nz"))


def _pair_schema(points: DataFrame) -> T.StructType:
    """A point's columns; the neighbour (``other``) towards which a new one is moved and its place; what is mixed from the nearest point; the draw. Copies have ``_i`` and none of these."""
    kinds = {f.name: f.dataType for f in points.schema}
    mixed = [c for g in _ATTRIBUTES if has(points, *g) for c in g]
    more = [("other", kinds["pid"]), *((f"_b{c}", kinds[c]) for c in XYZ), *((f"_f{c}", kinds[c]) for c in mixed), *((c, T.LongType()) for c in ("_j", "_again", "_i"))]
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in points.schema), *(T.StructField(*m) for m in more)])


def _made(pairs: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """New points. Colours and normals are by ``_t`` between those of the point and of its nearest, whichever neighbour it was moved towards.
    Whole-number colours stay whole numbers, cut off; normals are unit vectors again."""
    new = F.col("_i").isNull()
    pairs = pairs.withColumn("_t", uniform(seed, "up/t", F.col(SCENE), F.col("pid"), F.col("_j"), low=0.3, high=0.7))
    colours, normals = (g if has(points, *g) else () for g in _ATTRIBUTES)
    mixed = {c: F.col(c) * (1 - F.col("_t")) + F.col(f"_f{c}") * F.col("_t") for c in (*colours, *normals)}
    pairs = pairs.withColumns({f"_m{c}": mixed[c] for c in normals})
    value = {c: F.col(c) + F.col("_t") * (F.col(f"_b{c}") - F.col(c)) for c in XYZ}
    value |= {c: mixed[c].cast(points.schema[c].dataType) for c in colours}
    if normals:
        length = F.sqrt(sum((F.col(f"_m{c}") * F.col(f"_m{c}") for c in normals[1:]), F.col("_mnx") * F.col("_mnx"))) + 1e-8
        value |= {c: F.col(f"_m{c}") / length for c in normals}
    done = {c: F.when(new, v).otherwise(F.col(c)) for c, v in value.items()}
    again = F.when(F.col("_again") > 0, F.concat(F.lit("+"), "_again")).otherwise("")
    done["pid"] = F.when(new, F.concat("pid", F.lit("+"), "other", again)).otherwise(F.concat("pid", F.lit("#"), "_i"))
    return pairs.select(*(done.get(c, F.col(c)).alias(c) for c in points.columns))


def gentle_upsample(points: DataFrame, share: float = 0.2, k: int = 8, seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """Adds a share of points to each scene, each between a random point and one of its k nearest that isn't too near; ``made`` marks them.

    A point whose neighbours are all too near is drawn in vain; there are three draws for each point to add, and copies of random
    points make up for those still missing. Scenes of at most ``whole`` points find theirs in a group each, so that their points are
    shuffled once and nothing is written; larger ones by joins.
    """
    sizes = points.groupBy(SCENE).agg(F.count("*").alias("_size"))
    n, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    if (most or 0) > whole:
        large = settled(sizes.filter(F.col("_size") > whole).select(SCENE))
        few, many = (points.join(large, SCENE, how).select(*points.columns) for how in ("left_anti", "left_semi"))
    else:
        few, many = points, settled(points.limit(0))
    pairs = _pairs_of_groups(few, share, k, seed, n or 0).unionByName(_pairs_by_joins(many, share, k, seed))
    return points.withColumn("made", F.lit(False)).unionByName(_made(pairs, points, seed).withColumn("made", F.lit(True)))


def _pairs_of_groups(points: DataFrame, share: float, k: int, seed: int, n: int) -> DataFrame:
    """``_pair_schema`` of scenes of bounded size."""
    schema, names = _pair_schema(points), points.columns
    mixed = [f.name[2:] for f in schema if f.name.startswith("_f")]

    def run(group: pa.Table) -> pa.Table:
        scene, n = group[SCENE][0].as_py(), len(group)
        group = group.take(pc.sort_indices(group["pid"]))
        rows, others, nearest_, draws, copies = [], [], [], [], []
        need = math.floor(n * share) if scene is not None else 0
        if need > 0:
            pids = [str(p) for p in group["pid"].to_numpy()]
            order = np.argsort(drawn_hashes(seed, "up", scene, [p.encode() for p in pids]), kind="stable")
            xyz = np.stack([group[c].to_numpy() for c in XYZ], axis=1).astype(float)
            known = np.flatnonzero(~np.isnan(xyz).any(axis=1))
            place = np.full(n, -1)
            place[known] = np.arange(len(known))
            asks = order[: 3 * need][place[order[: 3 * need]] >= 0]
            d, at = knn(xyz[known], xyz[asks], place[asks], k)
            found = at[:, 0] >= 0
            far = (at >= 0) & (d >= 0.3 * (d[found, 0].mean() if found.any() else 0.0))
            near = {row: [o for o, is_far in zip(a, f) if is_far] for row, a, f in zip(asks.tolist(), known[at].tolist(), far.tolist())} if len(known) else {}
            one, places = dict(zip(asks.tolist(), known[at[:, 0]].tolist())) if len(known) else {}, order.tolist()
            for j in range(3 * need):
                row = places[j % n]
                if near.get(row):
                    start = f"{seed}:up/other:{pids[row]}:"
                    rows.append(row)
                    others.append(min(near[row], key=lambda o: hashlib.md5(f"{start}{pids[o]}:{j}".encode()).digest()))
                    nearest_.append(one[row])
                    draws.append(j)
                    if len(rows) == need:
                        break
            copies = list(range(1, need - len(rows) + 1))
            rows += order[np.floor(drawn(seed, "up/copy", scene, [str(i).encode() for i in copies]) * n).astype(int)].tolist() if copies else []
        none = [None] * len(copies)
        other, first = (pa.array(x + none, pa.int64()) for x in (others, nearest_))
        columns = {c: group[c].take(pa.array(rows, pa.int64())) for c in names}
        columns |= {"other": group["pid"].take(other)} | {f"_b{c}": group[c].take(other) for c in XYZ} | {f"_f{c}": group[c].take(first) for c in mixed}
        columns |= {"_j": pa.array(draws + none, pa.int64()), "_again": pa.array([j // n for j in draws] + none, pa.int64()), "_i": pa.array([None] * len(draws) + copies, pa.int64())}
        return pa.table(columns)

    return spread(points, SCENE, n=n).groupBy(SCENE).applyInArrow(run, schema)


def _pairs_by_joins(points: DataFrame, share: float, k: int, seed: int) -> DataFrame:
    """``_pair_schema`` of scenes of any size."""
    schema = _pair_schema(points)
    rows = settled(ranked_at_random(points.select(SCENE, "pid", *XYZ), seed, "up"))
    scenes = settled(rows.groupBy(SCENE).agg(F.count("*").alias("_n")).withColumn("_need", F.floor(F.col("_n") * share)).filter("_need > 0"))
    pick = rows.join(scenes, SCENE).filter(F.col("_r") <= 3 * F.col("_need")).select(SCENE, "pid", *XYZ)
    met = settled(nearest(points, k, queries=pick))
    mean = met.filter("rank = 1").groupBy(SCENE).agg(F.avg("d").alias("_mean"))
    far = met.join(mean, SCENE).filter(F.col("d") >= 0.3 * F.col("_mean")).select(SCENE, "pid", "other")
    draws = scenes.withColumn(
        "_j", F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col("_need") - 1)),
    ).withColumn("_r", (F.col("_j") % F.col("_n") + 1).cast("long"))
    # tables of points may look small as compressed files; they are merged, not sent through the driver
    tried = draws.join(rows.select(SCENE, "pid", "_r").hint("merge"), [SCENE, "_r"]).join(far.hint("merge"), [SCENE, "pid"])
    chosen = tried.groupBy(SCENE, "pid", "_j", "_n", "_need").agg(F.min_by("other", key_hash(seed, "up/other", F.col("pid"), F.col("other"), F.col("_j"))).alias("other"))
    chosen = ranked(settled(chosen), ["_j"], F.floor(F.col("_j") / DRAWS), name="_k", most=F.col("_need")).filter(F.col("_k") <= F.col("_need"))
    chosen = settled(chosen.select(SCENE, "pid", "other", "_j", F.floor(F.col("_j") / F.col("_n")).alias("_again")))
    b = points.select(SCENE, F.col("pid").alias("other"), *(F.col(c).alias(f"_b{c}") for c in XYZ))
    made = points.join(chosen.hint("merge"), [SCENE, "pid"]).join(b.hint("merge"), [SCENE, "other"])
    mixed = [f.name[2:] for f in schema if f.name.startswith("_f")]
    if mixed:
        first = met.filter("rank = 1").select(SCENE, "pid", F.col("other").alias("_first"))
        near = points.select(SCENE, F.col("pid").alias("_first"), *(F.col(c).alias(f"_f{c}") for c in mixed))
        made = made.join(first.hint("merge"), [SCENE, "pid"]).join(near.hint("merge"), [SCENE, "_first"])
    short = scenes.join(
        chosen.groupBy(SCENE).agg(F.count("*").alias("_got")), SCENE, "left",
    ).withColumn("_short", F.col("_need") - F.coalesce("_got", F.lit(0))).filter("_short > 0")
    copies = short.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_short"))).withColumn(
        "_r", (F.floor(uniform(seed, "up/copy", F.col(SCENE), F.col("_i")) * F.col("_n")) + 1).cast("long"),
    )
    copies = copies.join(rows.select(SCENE, "_r", "pid").hint("merge"), [SCENE, "_r"]).select(SCENE, "pid", "_i").join(points.hint("merge"), [SCENE, "pid"])
    return made.unionByName(copies, allowMissingColumns=True).select(*(F.col(f.name).cast(f.dataType) for f in schema))
