"""Pruned reads, the pyramid of cells and sketches against plain filters, repeated pooling and exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import pyramid, sketches, voxel
from stratocloud.sources import layout

SCHEMA = "scene_id bigint, pid string, x double, y double, z double"


def _points(spark, n=4000):
    rng = np.random.default_rng(41)
    rows = [(k % 3, f"p{k}", *map(float, p)) for k, p in enumerate(rng.uniform(-2, 5, (n, 3)))]
    rows += [(1, "far", 80.0, 5.0, 5.0), (1, "none", None, 0.0, 0.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _ids(df):
    return sorted(r["pid"] for r in df.select("pid").collect())


def test_boxes_and_balls_read_few_files(spark, tmp_path):
    df, path = _points(spark), str(tmp_path / "laid")
    layout.write_layout(df, path, depth=8, rows_per_file=100)
    total = spark.read.parquet(f"{path}/files").select("file").distinct().count()
    assert total > 30 and sum(r["n"] for r in spark.read.parquet(f"{path}/files").collect()) == 4001
    for low, high, scenes in (((0, 0, 0), (1, 1, 1), None), ((-9, -9, -9), (99, 99, 99), [1]), ((4, 4, 4), (5, 5, 5), [0, 2]), ((6, 6, 6), (7, 7, 7), None)):
        want = df.filter(" AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", low, high)))
        want = want if scenes is None else want.filter(F.col("scene_id").isin(scenes))
        found = layout.read_box(spark, path, low, high, scenes)
        assert _ids(found) == _ids(want) and found.columns == df.columns
    files, intervals = layout.files_of(spark, path, (0, 0, 0), (0.5, 0.5, 0.5))
    assert len(files) < total / 3 and len(intervals) <= 4 * layout.INTERVALS
    ball = layout.read_ball(spark, path, (1.0, 1.0, 1.0), 0.9)
    assert _ids(ball) == _ids(df.filter("sqrt((y - 1) * (y - 1) + (z - 1) * (z - 1) + (x - 1) * (x - 1)) <= 0.9"))


def test_cover_holds_every_cell_of_the_box(spark):
    grid = layout.Grid(0, 0, 0, 1, 4)
    cells = spark.createDataFrame([(x, y, z) for x in range(16) for y in range(16) for z in range(16)], "gx bigint, gy bigint, gz bigint")
    coded = layout.with_hilbert(cells, 4).collect()
    for low, high in (((3, 0, 7), (9, 2, 15)), ((0, 0, 0), (15, 15, 15)), ((5, 5, 5), (5, 5, 5))):
        for most in (8, 64):
            held = layout.cover(spark, grid, low, high, most)
            inside = [r["code"] for r in coded if all(a <= r[f"g{c}"] <= b for c, a, b in zip("xyz", low, high))]
            assert all(any(a <= c <= b for a, b in held) for c in inside)
    assert layout.cover(spark, grid, (5, 5, 5), (5, 5, 5)) == [(c := next(r["code"] for r in coded if (r["gx"], r["gy"], r["gz"]) == (5, 5, 5)), c)]


def test_empty_layout(spark, tmp_path):
    path = str(tmp_path / "laid")
    layout.write_layout(_points(spark).filter("1 = 0"), path)
    assert layout.read_box(spark, path, (0, 0, 0), (1, 1, 1)).count() == 0


@pytest.mark.parametrize("reduce", ["max", "sum"])
def test_pyramid_equals_repeated_pooling(spark, reduce):
    df = voxel.with_cells(_points(spark).filter("x < 10"), 0.4).withColumn("w", F.col("x") * 3)
    found = pyramid.pyramid(df, 3, ["w"], reduce)
    for level in range(4):
        pooled, _ = voxel.grid_pool(df, 1 << level, ["w"], reduce)
        key = lambda d: sorted((r["scene_id"], r["gx"], r["gy"], r["gz"], r["n"], round(r["w"], 6), round(r["x"], 6)) for r in d.collect())
        assert key(found.filter(F.col("level") == level)) == key(pooled)
    up = found.select("scene_id", (F.col("level") - 1).alias("level"), F.col("code").alias("parent")).distinct()
    assert found.filter("level < 3").join(up, ["scene_id", "level", "parent"], "left_anti").isEmpty()


def test_sketches_of_unions(spark):
    df = _points(spark, 9000).filter("x IS NOT NULL")
    per = sketches.scene_sketches(df, "z", 0.3)
    row = sketches.read_sketches(sketches.merged(per), {"low": 0.1, "mid": 0.5}).first()
    z = np.array([r["z"] for r in df.select("z").collect()])
    assert row["n"] == len(z)
    for name, share in (("low", 0.1), ("mid", 0.5)):
        assert abs((z <= row[name]).mean() - share) < 0.02  # three standard errors
    exact = voxel.with_cells(df, 0.3).select("scene_id", *voxel.CELL).distinct().count()
    assert abs(row["n_cells"] / exact - 1) < 0.05
    by = sketches.read_sketches(sketches.merged(per.withColumn("half", F.col("scene_id") % 2), ["half"]), {"mid": 0.5}).collect()
    assert sorted(r["half"] for r in by) == [0, 1] and sum(r["n"] for r in by) == len(z)
