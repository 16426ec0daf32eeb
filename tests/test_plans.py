"""Outlier removal, colour jitter, the seven-step preprocessing and ingestion as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import color, features, neighbors, normalize, planes
from stratocloud.plans.preprocess import Config, preprocess
from stratocloud.streaming import ingest


def _room(spark, n=240, scene=1, tilt=0.0):
    """A flat floor and some furniture above it, and one point far off."""
    rng = np.random.default_rng(7)
    floor = np.c_[rng.uniform(0, 4, (n, 2)), rng.normal(0, 0.002, n)]
    above = rng.uniform((1, 1, 0.3), (2, 2, 1.5), (n // 4, 3))
    xyz = np.r_[floor, above, [[40.0, 40.0, 40.0]]]
    turn = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]])
    rows = [(scene, f"p{k:04d}", *map(float, turn @ p), k % 256, 3 * k % 256, 7 * k % 256) for k, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "scene_id bigint, pid string, x double, y double, z double, r int, g int, b int")


@pytest.mark.parametrize("least", [1, 3])
def test_outlier_removal_matches_brute_force(spark, least):
    df = _room(spark, 80)
    kept, reports = neighbors.remove_outliers(df, 2.0, least, 5, 2.0)
    rows = df.orderBy("pid").collect()
    xyz = np.array([(r["x"], r["y"], r["z"]) for r in rows])
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)
    np.fill_diagonal(d, np.inf)
    first = (d <= 2.0 * np.median(d.min(1))).sum(1) >= least
    near = np.sort(d[np.ix_(first, first)], 1)[:, :4].sum(1) / 5
    second = near <= near.mean() + 2.0 * near.std(ddof=1)
    names = np.array([r["pid"] for r in rows])[first][second]
    assert sorted(r["pid"] for r in kept.collect()) == sorted(names)
    removed = {r["step"]: r["removed"] for r in reports.collect()}
    assert removed == {"radius": int((~first).sum()), "statistical": int((~second).sum())}


def test_flat_and_single_point_scenes(spark):
    rows = [(1, f"a{k}", k % 10 / 10, k // 10 / 10, 0.0) for k in range(100)] + [(2, "b", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scene_id bigint, pid string, x double, y double, z double")
    one = neighbors.nearest(df, 1).collect()
    assert len(one) == 100 and all(r["d"] == pytest.approx(0.1) for r in one)


def test_color_jitter_applies_the_steps_in_each_scenes_order(spark):
    df = _room(spark, 40, 1).unionByName(_room(spark, 40, 2)).unionByName(_room(spark, 40, 5))
    key = lambda d: sorted((r["scene_id"], r["pid"], r["r"], r["g"], r["b"]) for r in d.collect())
    still = color.color_jitter(df, (1, 1), (1, 1), (1, 1), (0, 0), p=0.0)
    assert key(still) == key(df)
    only = color.color_jitter(df, (0.5, 0.5), (1, 1), (1, 1), (0, 0), p=1.0)
    assert all(abs(a[2] - b[2] / 2) <= 3 for a, b in zip(key(only), key(df)))
    gray = color.color_jitter(df, (1, 1), (0, 0), (1, 1), (0, 0), p=1.0).filter("scene_id = 1")
    assert gray.select(F.countDistinct("r")).first()[0] <= 2


def test_seven_steps(spark):
    df = _room(spark, tilt=0.4)
    config = Config(spacing=0.25, spacing_rounds=1, density=10.0, least_points=50, normals_k=6, neighbours=5, cell=0.1, plane_threshold=0.05, scale=2.0)
    done, reports = preprocess(df, config)
    steps = [(r["step"], r["n"]) for r in reports.orderBy("place").collect()]
    assert [s for s, _ in steps] == ["input", *Config().steps]
    assert dict(steps)["outliers"] < dict(steps)["input"] and done.count() == steps[-1][1] > 0
    rows = done.collect()
    assert "p0300" not in {r["pid"] for r in rows}
    assert all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in rows)
    heights = sorted(r["z"] for r in rows)
    assert heights[0] == pytest.approx(0, abs=1e-6) and heights[len(heights) // 2] < 0.3  # most are on a level floor


def test_no_steps_and_unknown_steps(spark):
    df = _room(spark, 20)
    done, reports = preprocess(df, Config(steps=()))
    assert done.count() == df.count() == reports.first()["n"]
    with pytest.raises(ValueError, match="polish"):
        preprocess(df, Config(steps=("polish",)))


def test_ingestion_works_off_new_files_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "video_id string, n int"
    step = lambda df: df.withColumn("n", F.col("n") + 1)
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.watch(spark, source, schema), out, state, step, key="video_id").awaitTermination(60)
        assert sorted((r["video_id"], r["n"]) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 3)]
    spark.createDataFrame([("c", 5)], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(ingest.watch(spark, source, schema), out, state, step, key="video_id").awaitTermination(60)
    assert spark.read.parquet(out).count() == 3


def test_frame_rates_count_windows(spark):
    rows = [(1, "2024-01-01 00:00:10", 0.25), (1, "2024-01-01 00:04:59", 0.75), (1, "2024-01-01 00:05:00", 1.0), (2, "2024-01-01 00:01:00", 0.5)]
    df = spark.createDataFrame(rows, "video_id int, ts string, prob_inside double").withColumn("ts", F.to_timestamp("ts"))
    found = sorted((r["video_id"], r["n"], r["prob"]) for r in ingest.frame_rates(df).collect())
    assert found == [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5)]


def _cloud(spark, xyz):
    return spark.createDataFrame([(1, f"p{k:04d}", *map(float, p)) for k, p in enumerate(xyz)], "scene_id bigint, pid string, x double, y double, z double")


def test_spacing_keeps_the_best_state(spark):
    # pairs 0.1 apart in places 1 apart: a step merges most pairs and overshoots by far
    places = np.array([(x, y, 0) for x in range(10) for y in range(10)], float) * 1.037
    report = normalize.adjust_spacing(_cloud(spark, np.r_[places, places + (0.1, 0, 0)]), 0.12)[1].first()
    assert report["error"] <= abs(report["before"] - 0.12) / 0.12 + 1e-9


def test_spacing_layout_pass_and_reruns(spark):
    xyz = np.c_[np.random.default_rng(3).uniform(0, 10, (400, 2)), np.zeros(400)]
    df = _cloud(spark, xyz)
    before = normalize.adjust_spacing(df, 0.3, rounds=0)[1].first()["before"]
    target = 1.1 * before
    done, report = normalize.adjust_spacing(df, target, rounds=0)
    laid = report.first()
    assert laid["error"] < 1 - before / target and 320 < laid["n_after"] < 400 and done.count() == laid["n_after"]
    more = normalize.refine_spacing(df, target, 0.001, rounds=0, reruns=1)[1].first()
    assert more["error"] <= laid["error"] and more["n_before"] == 400
    kept = normalize.iterate_spacing(df, target)
    found = kept.join(neighbors.spacing_scale(kept), "scene_id").first()["mean"]
    assert abs(found - target) <= abs(before - target) + 1e-9 and kept.count() >= 280


def test_upsampling_reaches_the_exact_number(spark):
    rng = np.random.default_rng(5)
    clumps = np.repeat(rng.uniform(0, 20, (6, 3)), 10, axis=0) + rng.uniform(0, 1e-4, (60, 3))
    df = _cloud(spark, np.r_[clumps, rng.uniform(0, 20, (20, 3))])
    for share in (0.5, 1.5):
        rows = normalize.gentle_upsample(df, share, 2).collect()
        assert sum(r["made"] for r in rows) == 80 * share and len({r["pid"] for r in rows}) == len(rows)


def test_enough_triples_for_a_cluttered_scenes_floor(spark):
    rng = np.random.default_rng(2)
    xyz = [np.r_[np.c_[rng.uniform(0, 4, (75, 2)), np.zeros(75)], rng.uniform(0, 4, (225, 3))] for _ in range(8)]
    rows = [(s, f"p{k:04d}", *map(float, p)) for s, scene in enumerate(xyz) for k, p in enumerate(scene)]
    df = spark.createDataFrame(rows, "scene_id bigint, pid string, x double, y double, z double")
    found = planes.best_plane(df, 0.01).collect()
    assert len(found) == 8 and all(r["inliers"] >= 75 and abs(r["c"]) > 0.999 for r in found)


def test_scenes_without_a_plane_are_turned_by_their_least_spread(spark):
    flat = np.c_[np.random.default_rng(4).uniform(0, 6, (60, 2)), np.zeros(60)]  # too few for a plane
    turn = np.array([[1, 0, 0], [0, np.cos(0.5), -np.sin(0.5)], [0, np.sin(0.5), np.cos(0.5)]])
    rows = planes.align_z_up(_cloud(spark, flat @ turn.T)).collect()
    assert len(rows) == 60 and max(abs(r["z"]) for r in rows) < 1e-6


def test_linear_probe_meets_every_class(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [-1.0]), (3, [2.0])], "vec_id bigint, embedding array<double>")
    head = spark.range(10_500).select(F.col("id").alias("class_id"), F.array(F.col("id").cast("double")).alias("weight"), F.lit(0.5).alias("bias"))
    for most in (10_000, 20_000):
        found = {r["vec_id"]: (r["class_id"], r["logit"]) for r in features.linear_probe(rows, head, most=most).collect()}
        assert found == {1: (10_499, 10_499.5), 2: (0, 0.5), 3: (10_499, 20_998.5)}
