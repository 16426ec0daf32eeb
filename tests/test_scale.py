"""What is shuffled, written or held grows with the points and no faster."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from stratocloud.operators import color, curves, frames, neighbors, normalize, planes, pyramid, scenes, select, splits, views, voxel


def _cloud(spark, xyz, scene=1):
    return spark.createDataFrame([(scene, f"p{k:05}", *map(float, p)) for k, p in enumerate(xyz)], "scene_id int, pid string, x double, y double, z double")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distortion_shuffles_points_only(spark):
    df = _cloud(spark, np.random.default_rng(1).uniform(0, 30, (3_000, 3)))
    moved = normalize.elastic_distortion(df, ((0.5, 0.2),), p=1.0)
    assert "Generate" not in _plan(moved)  # neither corners nor nodes are rows
    together = {r["pid"]: (r["x"], r["y"], r["z"]) for r in moved.collect()}
    apart = normalize.elastic_distortion(df.repartition(7, "z"), ((0.5, 0.2),), p=1.0).collect()
    assert all(np.allclose(together[r["pid"]], (r["x"], r["y"], r["z"]), atol=1e-12) for r in apart) and len(apart) == 3_000


def test_points_without_coordinates_stay(spark):
    df = _cloud(spark, [[0, 0, 0], [1, 1, 1]]).unionByName(_cloud(spark, [[5, 5, 5]]).withColumns({"pid": F.lit("none"), "x": F.lit(None).cast("double")}))
    moved = {r["pid"]: r for r in normalize.elastic_distortion(df, ((0.5, 0.2),), p=1.0).collect()}
    assert len(moved) == 3 and moved["none"]["x"] is None and moved["none"]["y"] == 5


def test_planes_of_whole_and_of_cut_scenes_are_the_same(spark):
    rng = np.random.default_rng(2)
    flat = np.c_[rng.uniform(0, 4, (300, 2)), rng.normal(0, 0.004, 300)]
    df = _cloud(spark, np.r_[flat, rng.uniform(0, 4, (100, 3))]).unionByName(_cloud(spark, rng.uniform(0, 1, (40, 3)), 2)).unionByName(_cloud(spark, [[1, 2, 3]] * 2, 3))
    key = lambda d: sorted(tuple(round(v, 9) for v in r) for r in d.collect())
    for operator in (lambda **more: planes.candidate_planes(df, 60, **more), lambda **more: planes.best_plane(df, 0.01, 60, 5, **more)):
        assert len(key(operator())) > 1 and key(operator()) == key(operator(whole=30)) == key(operator(whole=150))
    assert "Generate" not in _plan(planes.best_plane(df, 0.01)) and "Join" not in _plan(planes.best_plane(df, 0.01))  # small scenes: points go to their group


def test_sums_and_moments_of_neighbours(spark):
    rng = np.random.default_rng(3)
    df = _cloud(spark, np.r_[rng.normal(0, 1, (400, 3)), np.zeros((5, 3))]).unionByName(_cloud(spark, [[1, 2, 3]], 2)).unionByName(_cloud(spark, [[1, 2, 3], [2, 2, 5]], 3))
    key = lambda d: sorted((r[0], r[1], *(round(v, 9) + 0.0 for v in r[2:])) for r in d.collect())
    near = neighbors.brute_nearest(df, 6)
    sums = near.groupBy("scene_id", "pid").agg(F.sum("d"), F.count("*").cast("double"))
    places = near.join(df.withColumnRenamed("pid", "other"), ["scene_id", "other"]).select(*df.columns).unionByName(df)
    moments = places.groupBy("scene_id", "pid").agg(*(F.covar_pop(*ab) for ab in splits.SUMMARIES["moments"]))
    alone = [(2, "p00000", 0.0, 0.0)]
    for leaf in (50, 50_000):
        assert key(splits.summaries(df, 6, "sums", leaf)) == sorted(key(sums) + alone)
        assert key(splits.summaries(df, 6, "moments", leaf)) == key(moments)
    normals = neighbors.normals_by_neighbours(df, 8)
    assert "Generate" not in _plan(normals) and normals.count() == 408  # a row a point, none a neighbour


def test_probabilities_are_printed_as_c_does(spark):
    values = [0.0000005, 0.0000015, 0.1234565, 0.5, 0.0078125, 0.9999995, 2.0] + [k / 1000 + 0.0000005 for k in range(1, 400, 7)]
    df = spark.createDataFrame([(1, k, v, 8.0) for k, v in enumerate(values)], "video_id int, frame_index bigint, prob_inside double, fps double")
    for r in frames.probability_rows(df).collect():
        assert r["prob_inside"] == f"{values[r['frame_index']]:.6f}" and r["time_sec"] == f"{r['frame_index'] / 8:.3f}"


def test_added_points_are_merged_not_broadcast(spark):
    made = normalize.gentle_upsample(_cloud(spark, np.random.default_rng(4).uniform(0, 1, (60, 3))), 0.2, 4)
    assert _plan(made).count("strategy=merge") >= 4


def test_spacing_is_adjusted_in_one_shuffle_a_scene(spark, monkeypatch):
    rng, written = np.random.default_rng(5), []
    kept = normalize.settled
    monkeypatch.setattr(normalize, "settled", lambda df, *more: written.append(1) or kept(df, *more))
    df = _cloud(spark, rng.uniform(0, 1, (300, 3))).unionByName(_cloud(spark, rng.uniform(0, 2, (150, 3)), 2)).unionByName(_cloud(spark, [[1, 2, 3]], 3))
    none = _cloud(spark, [[5, 5, 5]]).withColumns({"scene_id": F.lit(2), "pid": F.lit("none"), "x": F.lit(None).cast("double")})
    key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    done, report = normalize.refine_spacing(df, 0.12, rounds=2, reruns=1)
    assert len(written) <= 2  # no table a round
    slow = normalize.refine_spacing(df, 0.12, rounds=2, reruns=1, whole=0)
    assert key(report) == key(slow[1].select(report.columns)) and key(done) == key(slow[0])
    assert len(key(report)) == 3 and done.count() < df.count()
    assert normalize.adjust_spacing(df.unionByName(none), 0.12, rounds=1)[1].count() == 3


def test_views_of_whole_scenes_are_cut_in_one_group(spark):
    rng = np.random.default_rng(6)
    df = _cloud(spark, rng.uniform(0, 1, (200, 3)).round(1)).unionByName(_cloud(spark, rng.uniform(0, 1, (30, 3)), 2)).withColumn("r", F.lit(7))
    key = lambda d: sorted(map(tuple, d.collect()))
    cut = lambda whole: views.multi_views(df, local_views=2, most=150, band=(0.1, 0.8), whole=whole)
    assert key(cut(50_000)) == key(cut(0)) and cut(50_000).columns == [*df.columns, "view"]
    assert "Window" not in _plan(cut(50_000))


def test_scenes_that_are_not_crowded_are_sorted_once(spark):
    df = _cloud(spark, np.random.default_rng(7).uniform(0, 1, (90, 3)))
    for found in (select.sphere_crop(df, 20, mode="center"), voxel.spatial_sample(df, 0.3, 40)):
        assert "_range" not in _plan(found)
    assert select.sphere_crop(df, 20, mode="center").count() == 20


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scenes, "TASK_ROWS", 50)
    df = _cloud(spark, np.random.default_rng(8).uniform(0, 3, (1_000, 3)).round(2)).withColumn("r", F.lit(1))
    cells = voxel.with_cells(df, 0.5)
    sums = voxel.neighbour_sum(cells.groupBy("scene_id", *voxel.CELL).agg(F.sum("r").alias("v")), "v")
    for found in (voxel.voxel_centroids(df, 0.5), pyramid.pyramid(cells, 2, ["r"]), curves.serialize(cells, 4, ("z",)), sums):
        assert found.rdd.getNumPartitions() >= 7
    v = {(r["gx"], r["gy"], r["gz"]): r for r in sums.collect()}
    for (x, y, z), r in v.items():
        near = [v[x + a, y + b, z + c]["v"] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (x + a, y + b, z + c) in v]
        assert (r["around"], r["n_around"]) == (sum(near), len(near))


def test_hilbert_codes_are_one_short_column(spark):
    cells = spark.range(64).selectExpr("id % 4 AS gx", "(id DIV 4) % 4 AS gy", "id DIV 16 AS gz").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS gx, 1L AS gy, 1L AS gz"))
    coded = curves.with_hilbert(cells, 10)
    assert len(_plan(coded)) < 3_000  # an expression a bit plane was too long to be compiled
    back = curves.with_hilbert_cell(coded.select("code", *(F.col(c).alias(f"o{c}") for c in ("gx", "gy", "gz"))), 10).collect()
    assert sum(r["code"] is None for r in back) == 1 and all(r["code"] is None or (r["gx"], r["gy"], r["gz"]) == (r["ogx"], r["ogy"], r["ogz"]) for r in back)


def test_color_jitter_on_arrays_is_the_single_steps(spark):
    colors = np.random.default_rng(21).uniform(0, 255, (60, 3)).round(2).tolist()
    colors += [[None, 10.0, 20.0], [7.0, None, 7.0], [30.0, 40.0, None], [None, None, 9.0], [None] * 3, [0.0] * 3, [255.0] * 3, [80.0] * 3, [float("nan"), 1.0, 2.0]]
    rows = [(scene, k, *c) for scene in range(2) for k, c in enumerate(colors)] + [(2, 0, None, None, None)]
    doubles = spark.createDataFrame(rows, "scene_id int, pid int, r double, g double, b double")
    real = doubles.filter("r IS NULL OR NOT isnan(r)")
    unit = lambda *keys: int(hashlib.md5(":".join(map(str, (42, *keys))).encode()).hexdigest()[:13], 16) / (1 << 52)
    spans, single = ((0.6, 1.4), (0.5, 1.5), (0.6, 1.4), (-0.1, 0.1)), (color.brightness, color.contrast, color.saturation, color.hue)
    key = lambda d: [[r["pid"], *(None if r[c] is None else float(r[c]) for c in "rgb")] for r in d.orderBy("pid").collect()]
    for kind in ("decimal(6,2)", "int", "double", "float"):
        df = (doubles if kind in ("double", "float") else real).withColumns({c: F.col(c).cast(kind) for c in "rgb"})
        moved = color.color_jitter(df, *spans, p=0.8)
        assert _plan(moved).count("strategy=merge") == 2
        assert moved.dtypes == df.dtypes
        found = moved.cache()
        for scene in range(3):
            one = df.filter(F.col("scene_id") == scene)
            for k in color._ORDERS[int(unit("jitter/order", scene) * len(color._ORDERS))]:
                if unit(f"jitter/p{k}", scene) < 0.8:
                    low, high = spans[k]
                    one = single[k](one, low + unit(f"jitter/{k}", scene) * (high - low))
            got, want = key(found.filter(F.col("scene_id") == scene)), key(one)
            assert [[v is None for v in r] for r in got] == [[v is None for v in r] for r in want]
            assert np.allclose(np.array(got, float), np.array(want, float), rtol=0 if kind == "int" else 1e-6, atol=0, equal_nan=True), (kind, scene)
        found.unpersist()


def test_small_scenes_are_upsampled_in_one_shuffle(spark, monkeypatch):
    rng, written = np.random.default_rng(22), []
    clumps = np.repeat(rng.uniform(0, 20, (6, 3)), 10, axis=0) + rng.uniform(0, 1e-4, (60, 3))  # many draws in vain, so there are copies
    df = _cloud(spark, np.r_[clumps, rng.uniform(0, 20, (20, 3))]).unionByName(_cloud(spark, rng.uniform(0, 1, (150, 3)), 2)).unionByName(_cloud(spark, [[1, 2, 3]] * 2, 3))
    df = df.unionByName(_cloud(spark, [[5, 5, 5]], 2).withColumns({"pid": F.lit("none"), "x": F.lit(None).cast("double")}))
    shade = lambda c, k: (F.crc32(F.concat("pid", F.lit(c))) % k)
    df = df.withColumns({c: shade(c, 256).cast("int") for c in "rgb"} | {c: shade(c, 99) / 50 - 1 for c in ("nx", "ny", "nz")}).withColumn("label", shade("l", 5)).cache()
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    kept = normalize.settled
    monkeypatch.setattr(normalize, "settled", lambda d, *more: written.append(d.count()) or kept(d, *more))
    fast = normalize.gentle_upsample(df, 1.5, 3)
    assert sum(written) == 0  # no table of points
    slow = normalize.gentle_upsample(df, 1.5, 3, whole=100)  # one scene of three by joins
    assert sum(written) > 0 and fast.columns == [*df.columns, "made"] and key(fast) == key(slow)
    assert any("#" in r["pid"] for r in fast.collect()) and any(r["pid"].count("+") == 2 for r in fast.collect())
    df.unpersist()


def test_normals_of_small_scenes_take_one_shuffle(spark):
    rng = np.random.default_rng(23)
    df = _cloud(spark, rng.uniform(0, 1, (120, 3))).unionByName(_cloud(spark, rng.uniform(0, 1, (40, 3)), 2)).unionByName(_cloud(spark, [[1, 2, 3]], 3))
    df = df.unionByName(_cloud(spark, [[5, 5, 5]], 2).withColumns({"pid": F.lit("none"), "x": F.lit(None).cast("double")})).unionByName(_cloud(spark, [[0, 0, 0]], 4).withColumn("scene_id", F.lit(None).cast("int")))
    df = df.withColumns({"label": F.crc32("pid"), "nx": F.lit(9.0)})
    key = lambda d: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    found = neighbors.normals_by_neighbours(df, 8)
    assert "Join" not in _plan(found)
    assert found.columns == ["scene_id", "pid", "x", "y", "z", "label", "nx", "ny", "nz"]
    assert len(key(found)) == 162 and key(found) == key(neighbors.normals_by_neighbours(df, 8, whole=50)) == key(neighbors.normals_by_neighbours(df, 8, whole=0))
    empty = neighbors.normals_by_neighbours(df.filter("scene_id > 9"), 8)
    assert empty.count() == 0 and empty.columns == found.columns
