"""Queries of grid and neighbour operators over the points view."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocloud.operators import hull, neighbors, voxel
from stratocloud.queries.base import key_sql, over, query, r6, rounded
from stratocloud.queries.clouds import ID, SCENES, XYZ, points

CELL = "gx, gy, gz"
#: Cells by the floored grid and by the distance from the scene's least coordinate.
GRID = """g AS (SELECT *, floor(x / 0.5::DOUBLE)::BIGINT - min(floor(x / 0.5::DOUBLE)::BIGINT) OVER s AS gx, floor(y / 0.5::DOUBLE)::BIGINT - min(floor(y / 0.5::DOUBLE)::BIGINT) OVER s AS gy,
  floor(z / 0.5::DOUBLE)::BIGINT - min(floor(z / 0.5::DOUBLE)::BIGINT) OVER s AS gz FROM points WINDOW s AS (PARTITION BY scene_id))"""
MIN_GRID = "g AS (SELECT *, floor((x - min(x) OVER s) / 0.5::DOUBLE)::BIGINT AS gx, floor((y - min(y) OVER s) / 0.5::DOUBLE)::BIGINT AS gy, floor((z - min(z) OVER s) / 0.5::DOUBLE)::BIGINT AS gz FROM points WINDOW s AS (PARTITION BY scene_id))"
CELL_BY = lambda name: f"row_number() OVER (PARTITION BY scene_id, {CELL} ORDER BY {key_sql(name, 'scene_id', 'pid')}, pid)"


@query(over(f"""-- {GRID}, k AS (SELECT *, {CELL_BY('voxel')} AS k, count(*) OVER (PARTITION BY scene_id, {CELL}) AS voxel_points, min(floor(x / 0.5::DOUBLE)) OVER (PARTITION BY scene_id) AS lx FROM g)
SELECT {ID}, {CELL}, voxel_points, {r6('x / 0.5::DOUBLE - lx - gx - 0.5::DOUBLE AS dx')} FROM k WHERE k = 1"""))
def v1_grid_sample_train(spark, sf_dir):
    df = voxel.voxel_pick(points(spark, sf_dir), 0.5, displacement=True)
    return rounded(df.select("scene_id", "pid", "gx", "gy", "gz", "voxel_points", "dx"), "dx")


@query(over(f"""-- {GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, {CELL} ORDER BY pid) - 1 AS k, count(*) OVER (PARTITION BY scene_id, {CELL}) AS n FROM g),
m AS (SELECT *, max(n) OVER (PARTITION BY scene_id) AS most FROM k) SELECT {ID}, f AS fragment FROM m, LATERAL (SELECT unnest(range(k, most, n)) AS f)"""))
def v2_grid_sample_test(spark, sf_dir):
    return voxel.voxel_fragments(points(spark, sf_dir), 0.5).select("scene_id", "pid", "fragment")


@query(over(f"-- {GRID} SELECT {ID}, dense_rank() OVER (PARTITION BY scene_id ORDER BY {CELL}) - 1 AS inverse FROM g"))
def v3_inverse(spark, sf_dir):
    return voxel.voxel_inverse(points(spark, sf_dir), 0.5).select("scene_id", "pid", "inverse")


@query(over(f"-- {GRID} SELECT {ID}, (gx * (max(gy) OVER (PARTITION BY scene_id) + 1) + gy) * (max(gz) OVER (PARTITION BY scene_id) + 1) + gz AS key FROM g"))
def v4_ravel_key(spark, sf_dir):
    return voxel.ravel_key(points(spark, sf_dir), 0.5).select("scene_id", "pid", "key")


@query(over(f"""-- {GRID}, u AS (SELECT {ID}, ('0x' || substr(md5(concat_ws(':', gx, gy, gz)), 1, 16))::UBIGINT::HUGEINT AS h FROM g)
SELECT {ID}, CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT AS key FROM u"""))
def v5_cell_hash(spark, sf_dir):
    return voxel.cell_key(points(spark, sf_dir), 0.5).select("scene_id", "pid", "key")


@query(over(f"-- {MIN_GRID} SELECT {ID}, {CELL} FROM (SELECT *, {CELL_BY('spacing')} AS k FROM g) WHERE k = 1"))
def v6_spacing_grid_sample(spark, sf_dir):
    return voxel.voxel_pick(points(spark, sf_dir), 0.5, name="spacing", origin="min").select("scene_id", "pid", "gx", "gy", "gz")


def _spatial_sql(size: str, target: int, keep_small: bool = False) -> str:
    return over(f"""-- {MIN_GRID.replace('0.5::DOUBLE', size)}, l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scene_id, {CELL} ORDER BY pid) = 1 THEN 0 ELSE 1 END AS late, count(*) OVER (PARTITION BY scene_id) AS n FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY late, {key_sql('spatial', 'scene_id', 'pid')}, pid) AS k FROM l) SELECT {ID} FROM k WHERE k <= {target}{f' OR n <= {target}' if keep_small else ''}""")


@query(_spatial_sql("0.5::DOUBLE", 450))
def v7_spatial_sample(spark, sf_dir):
    return voxel.spatial_sample(points(spark, sf_dir), 0.5, 450).select("scene_id", "pid")


@query(_spatial_sql("(0.7::DOUBLE * 0.35::DOUBLE)", 590, keep_small=True))
def v8_spacing_sample(spark, sf_dir):
    return voxel.spacing_sample(points(spark, sf_dir), 0.35, 590).select("scene_id", "pid")


@query(over(f"-- {MIN_GRID} SELECT scene_id, {CELL}, {r6('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')}, count(*) AS n FROM g GROUP BY ALL"))
def v9_voxel_centroids(spark, sf_dir):
    return rounded(voxel.voxel_centroids(points(spark, sf_dir), 0.5), *XYZ)


@query(over(f"-- s AS ({SCENES}) SELECT {ID}, {', '.join(f'least(floor(({c} - l{c}) / 0.7::DOUBLE)::BIGINT, greatest(ceil((h{c} - l{c}) / 0.7::DOUBLE)::BIGINT - 1, 0)) AS g{c}' for c in XYZ)} FROM points JOIN s USING (scene_id)"))
def v10_spatial_grid(spark, sf_dir):
    return voxel.spatial_grid(points(spark, sf_dir), 0.7).select("scene_id", "pid", "gx", "gy", "gz")


_POOL = f"""{GRID}, p AS (SELECT scene_id, gx // 2 AS px, gy // 2 AS py, gz // 2 AS pz, max(r) AS r, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY px, py, pz) - 1 AS cluster FROM p)"""


def _pooled(spark, sf_dir):
    return voxel.grid_pool(voxel.with_cells(points(spark, sf_dir), 0.5), 2, ["r"])


@query(over(f"-- {_POOL} SELECT scene_id, px AS gx, py AS gy, pz AS gz, r, {r6('x', 'y', 'z')}, n, cluster FROM c"))
def v11_grid_pooling(spark, sf_dir):
    return rounded(_pooled(spark, sf_dir)[0], *XYZ)


@query(over(f"-- {_POOL} SELECT g.scene_id, pid, cluster, g.r + c.r AS r FROM g JOIN c ON g.scene_id = c.scene_id AND gx // 2 = px AND gy // 2 = py AND gz // 2 = pz"))
def v12_grid_unpooling(spark, sf_dir):
    pooled, fine = _pooled(spark, sf_dir)
    return voxel.grid_unpool(fine, pooled, ["r"]).select("scene_id", "pid", "cluster", "r")


@query(over(f"""-- {_POOL}, q AS (SELECT scene_id, px // 2 AS qx, py // 2 AS qy, pz // 2 AS qz, max(r) AS r FROM c GROUP BY ALL)
SELECT g.scene_id, pid, [g.r::DOUBLE, c.r::DOUBLE, q.r::DOUBLE] AS feat FROM g JOIN c ON g.scene_id = c.scene_id AND gx // 2 = px AND gy // 2 = py AND gz // 2 = pz
JOIN q ON q.scene_id = c.scene_id AND px // 2 = qx AND py // 2 = qy AND pz // 2 = qz"""))
def v13_feature_upcast(spark, sf_dir):
    pooled, fine = _pooled(spark, sf_dir)
    top, middle = voxel.grid_pool(pooled.select("scene_id", "gx", "gy", "gz", "r", F.col("cluster").alias("own"), *XYZ), 2, ["r"])
    middle = voxel.grid_unpool(middle, top, ["r"], "concat").select("scene_id", F.col("own").alias("cluster"), "r", F.col("up_r").alias("top_r"))
    df = fine.withColumnRenamed("r", "fine_r").join(middle, ["scene_id", "cluster"])
    return df.select("scene_id", "pid", F.array(*(F.col(c).cast("double") for c in ("fine_r", "r", "top_r"))).alias("feat"))


@query(over(f"""-- {GRID}, o AS (SELECT scene_id, {CELL}, sum(r)::BIGINT AS v FROM g GROUP BY ALL)
SELECT a.scene_id, a.gx, a.gy, a.gz, a.v, sum(b.v)::BIGINT AS around, count(*) AS n_around FROM o AS a JOIN o AS b ON a.scene_id = b.scene_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND abs(a.gz - b.gz) <= 1 GROUP BY ALL"""))
def v14_neighbour_sum(spark, sf_dir):
    cells = voxel.with_cells(points(spark, sf_dir), 0.5).groupBy("scene_id", "gx", "gy", "gz").agg(F.sum("r").alias("v"))
    return voxel.neighbour_sum(cells, "v")


_INSTANCES = """n AS (SELECT *, CASE WHEN segment IN (-1, 0) THEN NULL ELSE instance END AS own FROM points),
i AS (SELECT * EXCLUDE (instance), CASE WHEN own IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY scene_id ORDER BY own NULLS LAST) - 1 END::INT AS instance FROM n)"""


@query(over(f"-- {_INSTANCES}, m AS (SELECT scene_id, instance, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM i WHERE instance >= 0 GROUP BY ALL) SELECT {ID}, instance, {r6('coalesce(mx, -1) AS mx', 'coalesce(my, -1) AS my', 'coalesce(mz, -1) AS mz', digits=12)} FROM i LEFT JOIN m USING (scene_id, instance)"))
def v15_instance_points(spark, sf_dir):
    return rounded(voxel.parse_instances(points(spark, sf_dir), (-1, 0))[0].select("scene_id", "pid", "instance", "mx", "my", "mz"), "mx", "my", "mz", digits=12)


@query(over(f"""-- {_INSTANCES} SELECT scene_id, instance, {r6('(min(x) + max(x)) / 2 AS cx', '(min(y) + max(y)) / 2 AS cy', '(min(z) + max(z)) / 2 AS cz', 'max(x) - min(x) AS sx', 'max(y) - min(y) AS sy', 'max(z) - min(z) AS sz')}, 0::DOUBLE AS theta,
arg_min(segment, pid) - 2 AS kind FROM i WHERE instance >= 0 GROUP BY ALL"""))
def v15_instance_boxes(spark, sf_dir):
    df = voxel.parse_instances(points(spark, sf_dir), (-1, 0))[1].drop("mx", "my", "mz")
    return rounded(df, "cx", "cy", "cz", "sx", "sy", "sz")


@query(over(f"-- s AS ({SCENES}), v AS (SELECT *, (hx - lx) * (hy - ly) * (hz - lz) AS v FROM s) SELECT scene_id, n, {r6('sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly) + (hz - lz) * (hz - lz)) AS diagonal', 'v AS volume', 'CASE WHEN v > 0 THEN n / v ELSE n END AS density')} FROM v"))
def v16_v17_scene_boxes(spark, sf_dir):
    return rounded(voxel.scene_boxes(points(spark, sf_dir)).select("scene_id", "n", "diagonal", "volume", "density"), "diagonal", "volume", "density")


# ---------------------------------------------------------------- neighbours

_PAIRS = """p AS (SELECT a.scene_id, a.pid, b.pid AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM points AS a JOIN points AS b ON a.scene_id = b.scene_id AND a.pid <> b.pid)"""
_ONE = f"{_PAIRS}, one AS (SELECT scene_id, pid, min(d) AS d FROM p GROUP BY ALL)"


def _stats_sql(*percents: int) -> str:
    cut = [f"quantile_cont(d, {p / 100}) AS p{p}" for p in percents]
    whole = ["avg(d) AS mean", "quantile_cont(d, 0.5) AS median", "stddev_pop(d) AS std", "min(d) AS min", "max(d) AS max"]
    return over(f"-- {_ONE} SELECT scene_id, count(*) AS n, {r6(*whole, *cut)} FROM one GROUP BY scene_id")


@query()
def v18_hull_density(spark, sf_dir):
    return hull.hull_density(points(spark, sf_dir))


@query(_stats_sql(25, 75, 90, 95))
def n1_spacing_stats(spark, sf_dir):
    df = neighbors.spacing_stats(points(spark, sf_dir))
    return rounded(df, *(c for c in df.columns if c not in ("scene_id", "n")))


@query(_stats_sql(10, 25, 50, 75, 90, 95, 99))
def n2_spacing_distribution(spark, sf_dir):
    df = neighbors.spacing_stats(points(spark, sf_dir), (10, 25, 50, 75, 90, 95, 99))
    return rounded(df, *(c for c in df.columns if c not in ("scene_id", "n")))


@query(over(f"-- {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, pid ORDER BY d, other) AS rank FROM p) SELECT scene_id, pid, other, {r6('d')}, rank FROM k WHERE rank <= 4"))
def n_nearest_four(spark, sf_dir):
    return rounded(neighbors.nearest(points(spark, sf_dir), 4), "d").withColumn("rank", F.col("rank").cast("long"))


_SAMPLE = lambda name, n: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {key_sql(name, 'scene_id', 'pid')}, pid) AS k FROM points) WHERE k <= {n}"


@query(over(f"""-- s AS ({_SAMPLE('spacing', 200)}), {_ONE.replace('FROM points AS a JOIN points AS b', 'FROM s AS a JOIN s AS b')} SELECT scene_id, {r6('quantile_cont(d, 0.5) AS median')} FROM one GROUP BY scene_id"""))
def n3_sampled_median_spacing(spark, sf_dir):
    return rounded(neighbors.sampled_median_spacing(points(spark, sf_dir), 200), "median")


@query(over(f"-- {_ONE} SELECT scene_id, {r6('quantile_cont(d, 0.5) AS median', 'avg(d) AS mean')} FROM one GROUP BY scene_id"))
def n4_spacing_scale(spark, sf_dir):
    return rounded(neighbors.spacing_scale(points(spark, sf_dir)), "median", "mean")


@query(over(f"""-- s AS ({_SAMPLE('plane/sample', 300)}), q AS ({_SAMPLE('plane/query', 100)}),
d AS (SELECT q.scene_id, q.pid, min(sqrt((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) + (q.z - s.z) * (q.z - s.z))) AS d FROM q JOIN s ON q.scene_id = s.scene_id AND (q.x <> s.x OR q.y <> s.y OR q.z <> s.z) GROUP BY ALL)
SELECT scene_id, {r6('greatest(0.001::DOUBLE, least(0.5::DOUBLE * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 0.1::DOUBLE)) AS threshold')} FROM d GROUP BY scene_id"""))
def n5_plane_threshold(spark, sf_dir):
    return rounded(neighbors.plane_threshold(points(spark, sf_dir), 100, 300), "threshold")


_RADIUS = f"-- {_PAIRS}, c AS (SELECT scene_id, pid, count(*) FILTER (d <= 0.4::DOUBLE) AS neighbours FROM p GROUP BY ALL), m AS (SELECT {ID}, coalesce(neighbours, 0) AS neighbours, coalesce(neighbours, 0) + 1 > 2 AS stays FROM points LEFT JOIN c USING (scene_id, pid))"


@query(over(f"{_RADIUS} SELECT {ID}, neighbours, stays FROM m"))
def n6_radius_outliers(spark, sf_dir):
    return neighbors.radius_outliers(points(spark, sf_dir), 0.4, 2).select("scene_id", "pid", "neighbours", "stays")


@query(over(f"""-- {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, pid ORDER BY d, other) AS k FROM p), m AS (SELECT scene_id, pid, sum(d) / (count(*) + 1) AS mean_d FROM k WHERE k <= 7 GROUP BY ALL),
s AS (SELECT scene_id, avg(mean_d) AS m, stddev_samp(mean_d) AS sd FROM m GROUP BY ALL) SELECT {ID}, {r6('mean_d')}, mean_d <= m + 2::DOUBLE * sd AS stays FROM m JOIN s USING (scene_id)"""))
def n7_statistical_outliers(spark, sf_dir):
    return rounded(neighbors.statistical_outliers(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 8, 2.0).select("scene_id", "pid", "mean_d", "stays"), "mean_d")


@query(over(f"{_RADIUS} SELECT scene_id, count(*) AS n, count(*) FILTER (NOT stays) AS removed, {r6('count(*) FILTER (NOT stays) / count(*)::DOUBLE AS ratio')}, count(*) FILTER (NOT stays) / count(*)::DOUBLE > 0.01 AS over_cap FROM m GROUP BY scene_id"))
def n8_removal_report(spark, sf_dir):
    return rounded(neighbors.removal_report(neighbors.radius_outliers(points(spark, sf_dir), 0.4, 2), 0.01), "ratio")


@query()
def n9_n10_remove_outliers(spark, sf_dir):
    """Both passes over all scenes, of any size: the cell joins need no second plan for large ones."""
    return neighbors.remove_outliers(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 2.0, 1, 4, 2.0)[0].select("scene_id", "pid")


@query()
def n11_normals(spark, sf_dir):
    df = neighbors.normals_by_neighbours(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 8)
    return df.select("scene_id", "pid", "nx", "ny", "nz")


@query(over(f"-- s AS (SELECT scene_id, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM points) SELECT scene_id, count(*) AS n, count(*) FILTER (s < 1e-6::DOUBLE) AS zero, count(*) FILTER (isnan(s)) AS nan, {r6('avg(s) AS mean_norm')}, 100::DOUBLE AS score FROM s GROUP BY scene_id"))
def n12_normal_quality(spark, sf_dir):
    return rounded(neighbors.normal_quality(points(spark, sf_dir)), "mean_norm")
