"""Split trees and exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.operators import curves, neighbors, splits
from stratocloud.operators.quantiles import quantiles

SCHEMA = "scene_id bigint, pid string, x double, y double, z double"


def _cloud(spark, *scenes):
    rows = [(s, f"p{k:05d}", *map(float, p)) for s, xyz in enumerate(scenes, 1) for k, p in enumerate(xyz)]
    rows += [(1, "none", None, 0.0, 0.0), (1, "nan", 0.0, float("nan"), 0.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def _scenes():
    rng = np.random.default_rng(11)
    grid = np.stack(np.meshgrid(*[np.arange(9.0)] * 3), -1).reshape(-1, 3)  # every distance is a tie
    return [rng.normal(size=(700, 3)), grid, np.r_[rng.uniform(0, 1e-3, (400, 3)), [[1e3, -2e3, 3e3]]], rng.uniform(size=(30, 3)), np.zeros((1, 3))]


def _brute(scenes, k):
    out = []
    for s, xyz in enumerate(scenes, 1):
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for i, row in enumerate(d):
            order = np.lexsort((np.arange(len(row)), row))[:k]
            out += [(s, f"p{i:05d}", f"p{j:05d}", r + 1, round(row[j], 9)) for r, j in enumerate(order) if np.isfinite(row[j])]
    return sorted(out)


def _found(df):
    return sorted((r["scene_id"], r["pid"], r["other"], r["rank"], round(r["d"], 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("nodes", [splits.BROADCAST_NODES, 0])  # trees broadcast, and trees met in a join
def test_nearest_over_many_leaves(spark, k, nodes):
    scenes = _scenes()
    df = _cloud(spark, *scenes)
    assert _found(splits.nearest(df, k, leaf=60, broadcast_nodes=nodes)) == _brute(scenes, k)


def test_some_queries_only(spark):
    scenes = _scenes()
    df = _cloud(spark, *scenes)
    asked = df.filter("pid LIKE '%7'")
    want = [r for r in _brute(scenes, 3) if r[1].endswith("7")]
    assert _found(splits.nearest(df, 3, asked, leaf=60)) == want == _found(splits.nearest(df, 3, asked))


@pytest.mark.parametrize("leaf", [40, 100_000])
def test_a_place_with_most_points(spark, leaf):
    rng = np.random.default_rng(12)
    scenes = [np.r_[np.zeros((500, 3)), rng.uniform(-1, 1, (200, 3))], np.ones((130, 3))]
    df = _cloud(spark, *scenes)
    assert _found(splits.nearest(df, 3, leaf=leaf)) == _brute(scenes, 3)
    _counts_agree(df, scenes, 0.5, leaf)


def _counts_agree(df, scenes, radius, leaf):
    found = {(r["scene_id"], r["pid"]): r["neighbours"] for r in splits.counts_within(df, radius, leaf=leaf).collect()}
    assert len(found) == sum(map(len, scenes))
    for s, xyz in enumerate(scenes, 1):
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
        assert [found[s, f"p{k:05d}"] for k in range(len(xyz))] == ((d <= radius).sum(1) - 1).tolist()


@pytest.mark.parametrize("radius", [0.3, 1.0, 5.0])
def test_counts_within(spark, radius):
    scenes = _scenes()
    _counts_agree(_cloud(spark, *scenes), scenes, radius, 60)


def test_few_points_leave_their_leaf(spark):
    rng = np.random.default_rng(13)
    df = _cloud(spark, rng.uniform(size=(8000, 3)))
    search = splits.Search(df.schema["scene_id"].dataType, df.schema["pid"].dataType, 1, None)
    found, packed, trees = splits._first_answers(search, splits._finite(df), None, 1, 2000, splits.BROADCAST_NODES)
    assert packed.count() == 4 and found.filter("open").count() < 1200  # of 8,000


def test_knn_in_one_leaf():
    rng = np.random.default_rng(14)
    points = rng.normal(size=(3000, 3))
    d, at = splits.knn(points, points, np.arange(3000), 4)
    want = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(want, np.inf)
    assert np.allclose(d, np.sort(want, axis=1)[:, :4]) and (at == np.argsort(want, axis=1, kind="stable")[:, :4]).all()
    near, _ = splits.knn(points, points[:50], np.full(50, -1), 2, np.full(50, 0.1))
    assert (near[:, 0] == 0).all() and (near[:, 1][np.isfinite(near[:, 1])] <= 0.1).all()


@pytest.mark.parametrize("n", [1, 3, 600, 1024, 1500])
def test_knn_of_small_scenes_needs_no_blocks(monkeypatch, n):
    xyz = np.random.default_rng(18).integers(0, 12, (n, 3)) / 4  # many ties
    want = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(want, np.inf)
    order = np.argsort(want, axis=1, kind="stable")
    if n <= splits.WHOLE:
        monkeypatch.setattr(splits, "blocks", None)
    for k in (1, 4, 50):
        d, at = splits.knn(xyz, xyz, np.arange(n), k)
        near = min(k, n - 1)
        assert (at[:, :near] == order[:, :near]).all() and (at[:, near:] == -1).all()
        assert np.allclose(d[:, :near], np.take_along_axis(want, order[:, :near], 1)) and np.isinf(d[:, near:]).all()
    d, at = splits.knn(xyz, xyz[:7], np.full(min(n, 7), -1), 2, np.full(min(n, 7), 0.1))
    assert (d[:, 0] == 0).all() and (d[np.isfinite(d)] <= 0.1).all() and (at[np.isinf(d)] == -1).all()


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(15)
    groups = {
        1: rng.normal(size=30_000), 2: np.repeat([1.0, 2.0], 15_000), 3: np.r_[np.zeros(20_001), rng.exponential(1e6, 5_000)], 4: rng.uniform(size=7),
        5: np.full(20_000, 3.5), 6: np.r_[rng.uniform(0, 1e-9, 20_000), [1e300, -1e300]],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(1, None), (7, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "g bigint, v double").repartition(6)
    shares = {"least": 0.0, "low": 0.25, "mid": 0.5, "high": 0.999, "most": 1.0}
    for few in (100, 10_000, 10**6):
        found = {r["g"]: r for r in quantiles(df, ["g"], "v", shares, few=few).collect()}
        assert sorted(found) == [1, 2, 3, 4, 5, 6]
        for g, values in groups.items():
            assert [found[g][n] for n in shares] == pytest.approx([np.quantile(values, s) for s in shares.values()], rel=1e-12)


def test_quantiles_of_a_million_with_ties(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.floor(F.pow(F.col("id") % 1000, F.lit(2.0)) / 100).cast("double").alias("v"))
    values = np.floor((np.arange(1_000_000) % 1000) ** 2.0 / 100)
    found = quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    assert [found["a"], found["b"], found["c"]] == [np.quantile(values, q) for q in (0.1, 0.5, 0.95)]


def test_spacing_of_a_scene_in_leaves(spark, monkeypatch):
    rng = np.random.default_rng(16)
    xyz = rng.uniform(size=(900, 3))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    one = d.min(1)
    row = neighbors.spacing_stats(_cloud(spark, xyz)).first()
    assert row["n"] == 900 and row["median"] == pytest.approx(np.median(one)) and row["p95"] == pytest.approx(np.quantile(one, 0.95))


@pytest.mark.parametrize("crowd", [20, 10**6])
def test_places_along_curves_in_ranges(spark, crowd):
    rng = np.random.default_rng(17)
    scenes = [np.r_[rng.integers(0, 4, (300, 3)), rng.integers(0, 64, (100, 3))], rng.integers(0, 64, (5, 3))]
    rows = [(s, f"p{k:04d}", *map(int, g)) for s, cells in enumerate(scenes, 1) for k, g in enumerate(cells)]
    df = spark.createDataFrame(rows, "scene_id bigint, pid string, gx bigint, gy bigint, gz bigint").repartition(3)
    found = curves.serialize(df, 6, crowd=crowd).collect()
    for name in ("z", "z_trans", "hilbert", "hilbert_trans"):
        for s in (1, 2):
            own = sorted((r for r in found if r["scene_id"] == s), key=lambda r: (r[f"code_{name}"], r["pid"]))
            assert [r[f"place_{name}"] for r in own] == list(range(len(scenes[s - 1])))
    drawn = curves.serialize(df, 6, shuffle=5, crowd=crowd).collect()
    by = {(r["scene_id"], r["pid"]): r for r in found}
    orders = [drawn[0][f"order_{k}"] for k in range(4)]
    assert sorted(orders) == sorted(curves.ORDERS) and orders == curves.shuffled(curves.ORDERS, 5)
    for r in drawn:
        for k, o in enumerate(orders):
            name = o.replace("-", "_")
            assert (r[f"code_{k}"], r[f"place_{k}"]) == (by[r["scene_id"], r["pid"]][f"code_{name}"], by[r["scene_id"], r["pid"]][f"place_{name}"])
