"""Operators that SQL can't express, against numpy over whole scenes."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import affine, features, hull, neighbors, normalize, places, planes, splits, views, voxel
from stratocloud.plans import preprocess as steps

SCHEMA = "scene_id bigint, pid string, x double, y double, z double"


def _cloud(spark, *scenes):
    rows = [(s, f"p{k:05d}", *map(float, p)) for s, xyz in enumerate(scenes, 1) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _xyz(df, *columns):
    return np.array([[r[c] for c in columns or "xyz"] for r in df.orderBy("scene_id", "pid").collect()])


def _near(df):
    return sorted((r["scene_id"], r["pid"], r["other"], r["rank"], round(r["d"], 9)) for r in df.collect())


def test_neighbours_stand_a_cluster_and_a_far_point(spark):
    rng = np.random.default_rng(3)
    cluster = np.r_[rng.uniform(0, 1e-3, (1500, 3)), [[1e3, 2e3, 3e3]], rng.uniform(5, 6, (20, 3))]
    df = _cloud(spark, cluster, rng.uniform(0, 1, (50, 3)))
    dealt = splits.Splits(df, leaf=100).deal(df)
    assert dealt.groupBy("scene_id", "leaf").count().agg(F.max("count")).first()[0] < 300  # of 1,521 rows
    assert _near(neighbors.nearest(df, 2, leaf=100)) == _near(neighbors.brute_nearest(df, 2))
    assert _near(neighbors.nearest(df, 2)) == _near(neighbors.brute_nearest(df, 2))


def test_neighbours_at_one_place(spark):
    rng = np.random.default_rng(4)
    df = _cloud(spark, np.r_[np.zeros((200, 3)), rng.uniform(0, 1, (30, 3)), np.ones((40, 3))], np.zeros((3, 3)), [[1, 2, 3]])
    for k in (1, 4):
        assert _near(neighbors.nearest(df, k)) == _near(neighbors.brute_nearest(df, k))


def test_neighbour_counts(spark):
    rng = np.random.default_rng(5)
    scenes = [rng.normal(0, 1, (120, 3)), rng.uniform(-3, 3, (80, 3))]
    found = {(r["scene_id"], r["pid"]): r["neighbours"] for r in neighbors.radius_outliers(_cloud(spark, *scenes), 0.8, 2).collect()}
    for s, xyz in enumerate(scenes, 1):
        d = np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)
        assert [found[s, f"p{k:05d}"] for k in range(len(xyz))] == ((d <= 0.8).sum(1) - 1).tolist()


def test_places_in_orders(spark):
    rng = np.random.default_rng(6)
    df = _cloud(spark, rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(20, 3)), 5, axis=0)).withColumn("v", F.round("x", 1))
    rows = df.collect()
    by_scene = lambda key: {(r["scene_id"], r["pid"]): k for s in (1, 2) for k, r in enumerate(sorted((r for r in rows if r["scene_id"] == s), key=key), 1)}
    got = lambda d, name="_r": {(r["scene_id"], r["pid"]): r[name] for r in d.collect()}
    md5 = lambda r: hashlib.md5(f"7:some:{r['scene_id']}:{r['pid']}".encode()).hexdigest()
    assert got(places.ranked_at_random(df, 7, "some")) == by_scene(md5)
    squared = lambda r: (r["x"] * r["x"] + r["y"] * r["y"], r["pid"])
    assert got(places.ranked_by_distance(df, F.col("x") * F.col("x") + F.col("y") * F.col("y"))) == by_scene(squared)
    few = got(places.ranked_by_distance(df, F.col("x") * F.col("x") + F.col("y") * F.col("y"), most=F.lit(7)))
    assert few == {k: v for k, v in by_scene(squared).items() if v <= 7}
    assert got(places.ranked_by_number(df, "v", ranges=8)) == by_scene(lambda r: (r["v"], r["pid"]))
    order = sorted(rows, key=lambda r: (r["v"], r["scene_id"], r["pid"]))
    assert got(places.numbered(df, "v", "scene_id", "pid"), "_place") == {(r["scene_id"], r["pid"]): k for k, r in enumerate(order)}


def _fit(xyz):
    mean = xyz.mean(0)
    n = np.linalg.svd(xyz - mean)[2][-1]
    n = n * (-1 if n[2] < 0 else 1)
    return np.r_[n, -n @ mean]


def test_plane_fit(spark):
    rng = np.random.default_rng(7)
    scenes = [np.c_[rng.uniform(0, 3, (60, 2)), np.zeros(60)] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + rng.normal(0, 0.01, (60, 3)) + rng.normal(size=3) for _ in range(3)]
    for r in planes.fit_planes(_cloud(spark, *scenes)).collect():
        assert np.allclose([r[c] for c in "abcd"], _fit(scenes[r["scene_id"] - 1]), atol=1e-8)


def _corner(rng):
    """A floor, a wall and clutter."""
    return [
        np.c_[rng.uniform(0, 4, (200, 2)), np.zeros(200)], np.c_[np.zeros(120), rng.uniform(0, 4, 120), rng.uniform(0, 2, 120)],
        rng.uniform((1, 1, 0.5), (3, 3, 2), (60, 3)),
    ]


def test_two_planes_are_taken_off_one_after_the_other(spark):
    floor, wall, rest = _corner(np.random.default_rng(8))
    fits, members = planes.detect_planes(_cloud(spark, np.r_[floor, wall, rest]), 0.01)
    found = {r["plane"]: r for r in fits.collect()}
    assert abs(found[0]["c"]) > 0.999 and abs(found[1]["a"]) > 0.999 and found[0]["n"] >= 200 and found[1]["n"] >= 115
    plane = [r["plane"] for r in members.orderBy("pid").collect()]
    assert len(plane) == 380 and plane[:200] == [0] * 200 and plane.count(1) >= 115 and plane.count(-1) >= 40


@pytest.mark.parametrize("auto", [False, True])
def test_floors_are_levelled(spark, auto):
    rng = np.random.default_rng(9)
    floor, wall, rest = _corner(rng)
    floor = np.r_[floor, np.c_[rng.uniform(0, 4, (400, 2)), np.zeros(400)]] + rng.normal(0, 0.001, (600, 3))
    rest = np.r_[rest, rng.uniform((1, 1, 0.5), (3, 3, 2), (900, 3))]  # more than on the floor, or it would not be seen that they are above
    below = [[2.0, 2.0, -0.7]]  # noise under the floor
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    turn = turn * np.linalg.det(turn)
    turn = np.array([[1, 0, 0], [0, np.cos(2.5), -np.sin(2.5)], [0, np.sin(2.5), np.cos(2.5)]]) if auto else turn
    xyz = np.r_[floor, wall, rest, below] @ turn.T + 5
    df = _cloud(spark, xyz).withColumns({"nx": F.lit(float(turn[0, 2])), "ny": F.lit(float(turn[1, 2])), "nz": F.lit(float(turn[2, 2]))})
    found = planes.align_z_up(df) if auto else planes.align_z_up(df, 0.05, 0.02)
    z = _xyz(found)[:, 2]
    assert abs(z[:600].min()) < 1e-9 and z[:600].max() < 0.05 and z[-1] == pytest.approx(-0.7, abs=0.02) and z[720:-1].min() > 0.4
    assert np.allclose(_xyz(found, "nx", "ny", "nz"), [0, 0, 1], atol=0.02)
    moved = _xyz(found)
    assert np.allclose(np.linalg.norm(moved[:50] - moved[50:100], axis=1), np.linalg.norm(xyz[:50] - xyz[50:100], axis=1))


def test_normals_by_neighbours(spark):
    xyz = np.random.default_rng(10).normal(size=(90, 3))
    found = _xyz(neighbors.normals_by_neighbours(_cloud(spark, xyz), 9), "nx", "ny", "nz")
    for p, n in zip(xyz, found):
        near = xyz[np.argsort(np.linalg.norm(xyz - p, axis=1))[:9]]
        brute = np.linalg.svd(near - near.mean(0))[2][-1]
        brute = brute * np.sign(brute @ (xyz.mean(0) - p))
        assert np.allclose(n, brute, atol=1e-6)


def _unit(seed, name, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, name, *keys))).encode()).hexdigest()[:13], 16) / (1 << 52)


def _normal(seed, name, *keys):
    u, v = _unit(seed, name + "/u", *keys), _unit(seed, name + "/v", *keys)
    return math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * v)


def test_elastic_distortion(spark):
    rng = np.random.default_rng(11)
    xyz = rng.uniform(0, 1.2, (25, 3))
    found = _xyz(normalize.elastic_distortion(_cloud(spark, xyz), ((0.5, 0.2),), p=1.0))
    low, cells = xyz.min(0), np.floor((xyz - xyz.min(0)) / 0.5).astype(int)
    most, weights = cells.max(0), (1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9)

    def corner(g):
        total = np.zeros(3)
        for d in itertools.product(range(-2, 3), repeat=3):
            node = np.add(g, d)
            if (node >= -1).all() and (node <= most + 2).all():
                w = np.prod([weights[i + 2] for i in d])
                total += w * np.array([_normal(42, f"elastic/0/{c}", 1, *node) for c in "xyz"])
        return total

    known = {}
    for k, (p, g) in enumerate(zip(xyz, cells)):
        share, move = (p - low) / 0.5 - g, np.zeros(3)
        for s in itertools.product((0, 1), repeat=3):
            at = tuple(np.add(g, s))
            known[at] = known[at] if at in known else corner(at)
            move += np.prod(np.where(s, share, 1 - share)) * known[at]
        assert np.allclose(found[k], p + 0.2 * move, atol=1e-9)


def test_pca_colors(spark):
    v = np.random.default_rng(12).normal(size=(80, 8)) * np.arange(1, 9)
    df = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "vec_id int, embedding array<double>")
    found = np.array([[r[c] for c in "rgb"] for r in features.pca_colors(df).orderBy("vec_id").collect()])
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :6]
    free = 0
    for k in range(3):  # an axis may point either way
        options = []
        for a, b in itertools.product((1, -1), repeat=2):
            c = 0.6 * a * (v @ axes[:, k]) + 0.4 * b * (v @ axes[:, k + 3])
            options.append(np.clip((c - c.min()) / (c.max() - c.min()) * 1.2, 0, 1))
        free += any(np.allclose(found[:, k], o, atol=1e-6) for o in options)
    assert free == 3


def test_views_are_the_nearest_points_and_cover_the_first(spark):
    xyz = np.random.default_rng(13).uniform(0, 4, (200, 3))
    df = _cloud(spark, xyz).withColumn("r", F.lit(1))
    found = views.multi_views(df, most=120, band=(0.25, 0.75), shared_transform=lambda d: d.withColumn("r", F.lit(9))).collect()
    members = {}
    for r in found:
        members.setdefault(r["view"], []).append(r)
    assert sorted(members) == ["global0", "global1", "local0", "local1", "local2", "local3"]
    for name, rows in members.items():
        low, high = (0.4, 1.0) if name.startswith("global") else (0.1, 0.4)
        assert int(low * 120) <= len(rows) <= high * 120 and {r["r"] for r in rows} == ({9} if name.startswith("global") else {1})
        own = {int(r["pid"][1:]) for r in rows}
        balls = [set(np.lexsort((np.arange(200), ((xyz - p) ** 2).sum(1)))[: len(own)].tolist()) for p in xyz]
        assert own in balls
        if name == "global0":
            height = lambda k: (xyz[k, 2] - xyz[:, 2].min()) / np.ptp(xyz[:, 2])
            assert any(own == b and 0.25 <= height(k) <= 0.75 for k, b in enumerate(balls))
    covered = set().union(*({r["pid"] for r in rows} for name, rows in members.items() if name.startswith("local")))
    assert len(covered & {r["pid"] for r in members["global0"]}) > max(len(rows) for name, rows in members.items() if name.startswith("local")) / 2


@pytest.mark.parametrize("axis", ["x", "y", "z"])
def test_rotation_about_each_axis(spark, axis):
    xyz = np.random.default_rng(14).normal(size=(10, 3))
    found = _xyz(affine.rotate(_cloud(spark, xyz), F.lit(0.3), axis, center=(0.0, 0.0, 0.0)))
    c, s, (i, j) = math.cos(0.3), math.sin(0.3), {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(3)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    assert np.allclose(found, xyz @ m.T)


@pytest.mark.parametrize("reduce", ["max", "min", "mean", "sum"])
def test_pooling(spark, reduce):
    rng = np.random.default_rng(15)
    g, v = rng.integers(0, 8, (100, 3)), rng.normal(size=100)
    rows = [(1, f"p{k}", *map(int, c), *map(float, c), float(x)) for k, (c, x) in enumerate(zip(g, v))]
    df = spark.createDataFrame(rows, "scene_id int, pid string, gx int, gy int, gz int, x double, y double, z double, f double")
    pooled = {(r["gx"], r["gy"], r["gz"]): r["f"] for r in voxel.grid_pool(df, 2, ["f"], reduce)[0].collect()}
    fold = {"max": max, "min": min, "mean": lambda x: sum(x) / len(x), "sum": sum}[reduce]
    groups = {}
    for c, x in zip(g // 2, v):
        groups.setdefault(tuple(map(int, c)), []).append(float(x))
    assert pooled.keys() == groups.keys() and all(abs(pooled[c] - fold(x)) < 1e-9 for c, x in groups.items())


def _hull_volume(xyz):
    """Over all triples of points: those with every other point on one side are faces."""
    middle, total = xyz.mean(0), 0.0
    for t in itertools.combinations(range(len(xyz)), 3):
        a, b, c = xyz[list(t)]
        side = (xyz - a) @ np.cross(b - a, c - a)
        if (side <= 1e-12).all() or (side >= -1e-12).all():
            total += abs(np.cross(a - middle, b - middle) @ (c - middle)) / 6
    return total


def test_hull_volumes(spark):
    rng = np.random.default_rng(17)
    flat = np.c_[rng.uniform(0, 1, (12, 2)), np.zeros(12)]
    scenes = [rng.normal(size=(24, 3)), rng.uniform(size=(20, 3)), flat, np.c_[flat[:, :2], flat[:, 0]], np.ones((3, 3))]
    df = _cloud(spark, *scenes)
    expected = [_hull_volume(scenes[0]), _hull_volume(scenes[1]), 0.0, float(np.ptp(scenes[3], axis=0).prod()), 0.0]
    for chunk in (8, 20_000):
        found = {r["scene_id"]: r for r in hull.hull_density(df, chunk).collect()}
        assert np.allclose([found[s]["volume"] for s in range(1, 6)], expected)
        assert [found[s]["n"] for s in range(1, 6)] == [24, 20, 12, 12, 3] and found[3]["density"] == 0
        assert found[1]["density"] == pytest.approx(24 / expected[0])
    scaled = affine.scale_to_volume(df, 7.0, hull=True)
    assert np.allclose([r["volume"] for r in hull.hull_volumes(scaled).orderBy("scene_id").collect()], [7, 7, 0, 7, 0])


def test_a_failing_step_is_left_out(spark, tmp_path, monkeypatch):
    df = _cloud(spark, np.random.default_rng(16).uniform(0, 1, (40, 3)))

    def fail(*_):
        raise ArithmeticError("no floor\nat all")

    monkeypatch.setattr(steps.planes, "align_z_up", fail)
    config = steps.Config(steps=("downsample", "align", "scale"), scale=2.0, intermediates=str(tmp_path))
    with pytest.warns(UserWarning, match="align"):
        done, reports = steps.preprocess(df, config)
    assert {r["step"]: r["error"] for r in reports.collect()} == {"input": None, "downsample": None, "align": "ArithmeticError: no floor", "scale": None}
    assert np.allclose(_xyz(done), 2 * _xyz(df)) and sorted(p.name for p in tmp_path.iterdir()) == ["step1_downsample", "step3_scale"]
    with pytest.raises(ArithmeticError):
        steps.preprocess(df, steps.Config(steps=("align",), go_on=False))
