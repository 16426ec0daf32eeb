"""Operators on small hand-made clouds and sequences."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import affine, color, curves, features, frames, neighbors, select, voxel
from stratocloud.plans import presets
from stratocloud.sources import clouds
from stratocloud.streaming import ingest

SCHEMA = "scene_id bigint, pid string, x double, y double, z double"


def _cloud(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [(k % 2, f"p{k:03d}", *map(float, rng.normal(size=3))) for k in range(n)]
    rows += [(3, "only", 1.0, 2.0, 3.0), (4, "a", 0.0, 0.0, 0.0), (4, "b", 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_nearest_matches_brute_force(spark):
    df = _cloud(spark)
    key = lambda d: sorted((r["scene_id"], r["pid"], r["other"], round(r["d"], 12)) for r in d.collect())
    assert key(neighbors.nearest(df, 3)) == key(neighbors.brute_nearest(df, 3))


def test_fragments_cover_all_points(spark):
    df = _cloud(spark)
    assert voxel.voxel_fragments(df, 1.0).select("pid").distinct().count() == df.count()


def test_hilbert_neighbours_are_one_step_apart(spark):
    side = spark.range(8)
    cells = side.select(F.col("id").alias("gx")).join(side.select(F.col("id").alias("gy"))).join(side.select(F.col("id").alias("gz")))
    rows = curves.with_hilbert(cells, 3).orderBy("code").collect()
    assert [r["code"] for r in rows] == list(range(512))
    steps = [sum(abs(a[c] - b[c]) for c in ("gx", "gy", "gz")) for a, b in zip(rows, rows[1:])]
    assert set(steps) == {1}


def test_rotation_is_orthonormal(spark):
    scenes = spark.createDataFrame([(1, 0.3, -0.5, 0.8), (2, 0.0, 0.0, -1.0), (3, 0.0, 0.0, 2.0)], "scene_id int, a double, b double, c double")
    for r in affine.z_up_rotation(scenes).collect():
        m = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        n = np.array([r["a"], r["b"], r["c"]])
        assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m @ n / np.linalg.norm(n), [0, 0, 1])


def test_ply_round_trip():
    data = {c: np.arange(4) + k for k, c in enumerate("xyz")} | {c: np.array([0, 1, 128, 255]) for c in "rgb"}
    back = clouds.read_ply(clouds.ply_bytes(data))
    assert all(np.allclose(back[c], v) for c, v in data.items()) and "nx" not in back
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert clouds.read_ply(text)["z"].tolist() == [3.0, 6.0]


def test_short_segments_merge(spark):
    rows = [(1, 0, 100, "a"), (1, 100, 104, "b"), (1, 104, 160, "a"), (2, 0, 3, "c"), (3, 0, 50, "a"), (3, 50, 55, "b"), (3, 55, 100, "c")]
    found = frames.merge_short_segments(spark.createDataFrame(rows, "video_id int, start bigint, end bigint, label string"), 10)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 104, "a"), (1, 104, 160, "a"), (2, 0, 3, "c"), (3, 0, 55, "a"), (3, 55, 100, "c")]


def test_registry_and_plans(spark):
    with pytest.raises(KeyError):
        presets.OPERATORS.get("no such operator")
    with pytest.raises(KeyError):
        presets.OPERATORS.register(affine.center_shift)
    with pytest.raises(TypeError, match="random_scale"):
        presets.Plan([{"type": "random_scale", "no": 1}]).apply(_cloud(spark))
    done = presets.Plan([{"type": "center_shift"}, {"type": "operators.voxel_pick", "size": 5.0}]).apply(_cloud(spark))
    assert done.count() >= 4


def test_variants_and_widths(spark):
    assert features.test_variants(_cloud(spark, 2)).count() == 5 * 13
    with pytest.raises(ValueError):
        features.resolve_width(spark.createDataFrame([([1.0],)], "v array<double>"), ["v"], 2)


def _colored(spark, n=80):
    rng = np.random.default_rng(8)
    rows = [(k % 2, f"p{k:03d}", *map(float, rng.uniform(0, 2, 3)), *map(int, rng.integers(0, 256, 3)), 0.0, 0.6, 0.8, k % 4) for k in range(n)]
    return spark.createDataFrame(
        rows,
        "scene_id bigint, pid string, x double, y double, z double, r int, g int, b int, nx double, ny double, nz double, segment int",
    )


def test_pretraining_and_training_presets(spark):
    df = _colored(spark)
    views = presets.pretraining(0.2, 30).apply(df)
    assert {r["view"] for r in views.select("view").distinct().collect()} == {"global0", "global1", "local0", "local1", "local2", "local3"}
    assert views.filter("grid_size <> 0.2").isEmpty() and views.groupBy("scene_id", "view").count().filter("count > 30").isEmpty()
    done = presets.training(0.2, 25).apply(df)
    assert done.groupBy("scene_id").count().filter("count > 25").isEmpty() and not done.isEmpty()
    colors = done.agg(*(f(c) for c in "rgb" for f in (F.min, F.max))).first()
    assert min(colors) >= 0 and max(colors) <= 1


@pytest.mark.parametrize("project", [False, True])
def test_voxel_pick_displacement_and_forced_points(spark, project):
    df = _colored(spark)
    size, rows = 0.5, {r["pid"]: r for r in df.collect()}
    found = voxel.voxel_pick(df, size, displacement=True, project=project, forced=F.col("segment") == 0).collect()
    assert {p for p, r in rows.items() if r["segment"] == 0} <= {r["pid"] for r in found}
    assert len({(r["scene_id"], r["gx"], r["gy"], r["gz"]) for r in found}) == sum(r["voxel_points"] is not None for r in found)
    for r in found:
        d = np.array([r[c] / size - np.floor(r[c] / size) - 0.5 for c in "xyz"])
        if project:
            assert r["displacement"] == pytest.approx(float(d @ (0.0, 0.6, 0.8)), abs=1e-9)
        else:
            assert np.allclose([r["dx"], r["dy"], r["dz"]], d)


def test_serialization_in_all_orders(spark):
    df = voxel.with_cells(_colored(spark), 0.25)
    rows = curves.serialize(df, 4).collect()
    swapped = {(r["scene_id"], r["pid"]): r["code"] for r in curves.with_hilbert(df, 4, ("gy", "gx", "gz"), "code").collect()}
    for order in curves.ORDERS:
        name = order.replace("-", "_")
        for scene in (0, 1):
            own = sorted((r for r in rows if r["scene_id"] == scene), key=lambda r: (r[f"code_{name}"], r["pid"]))
            assert [r[f"place_{name}"] for r in own] == list(range(len(own)))
    assert all(r["code_hilbert_trans"] == swapped[r["scene_id"], r["pid"]] for r in rows)


def test_manifest_ids_that_are_missing(spark):
    manifest = spark.createDataFrame([("a", "u"), ("b", "v"), ("c", "w")], "video_id string, url string")
    found, missing = select.manifest_filter(manifest, spark.createDataFrame([("c",), ("a",), ("x",)], "video_id string"))
    assert sorted(r["video_id"] for r in found.collect()) == ["a", "c"] and [r["video_id"] for r in missing.collect()] == ["x"]


def test_odd_frame_sizes(spark):
    rows = [(10_000, 6), (6, 10_000), (1920, 1080), (1, 1), (0, 5), (640, 480)]
    df = spark.createDataFrame(rows, "w int, h int")
    width, height = frames.fit_size(F.col("w"), F.col("h"), 255_000)
    for r in df.select("w", "h", width.alias("a"), height.alias("b")).collect():
        scale = (255_000 / (r["w"] * r["h"])) ** 0.5 if r["w"] * r["h"] else 1
        wide, high = r["w"] * scale, r["h"] * scale
        k, m = round(wide / 14), round(high / 14)
        while k * m * 196 > 255_000:
            k, m = (k - 1, m) if k / m > wide / high else (k, m - 1)
        assert (r["a"], r["b"]) == (max(1, k) * 14, max(1, m) * 14)


def test_ingestion_with_a_key(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "video_id string, n int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], schema).coalesce(1).write.parquet(source)
    for key, n in (("video_id", 2), (None, 3)):
        out, state = str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}")
        ingest.ingest(ingest.watch(spark, source, schema), out, state, key=key).awaitTermination(60)
        assert spark.read.parquet(out).count() == n


def _unit(*keys):
    return int(hashlib.md5(":".join(map(str, (42, *keys))).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_color_jitter_is_the_single_steps_in_each_scenes_order(spark):
    df = _colored(spark, 60).withColumn("scene_id", F.pmod(F.xxhash64("pid"), F.lit(4)))
    spans = ((0.6, 1.4), (0.5, 1.5), (0.6, 1.4), (-0.1, 0.1))
    found = color.color_jitter(df, *spans, p=0.8)
    orders, single = list(itertools.permutations(range(4))), (color.brightness, color.contrast, color.saturation, color.hue)
    tried = set()
    for scene in range(4):
        one = df.filter(F.col("scene_id") == scene)
        order = orders[int(_unit("jitter/order", scene) * len(orders))]
        tried.add(order)
        for k in order:
            if _unit(f"jitter/p{k}", scene) < 0.8:
                low, high = spans[k]
                one = single[k](one, low + _unit(f"jitter/{k}", scene) * (high - low))
        key = lambda d: sorted((r["pid"], r["r"], r["g"], r["b"]) for r in d.collect())
        assert key(found.filter(F.col("scene_id") == scene)) == key(one)
    assert len(tried) > 2
