"""Queries of plane, normalization, feature, view, source and preset operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocloud.operators import features, normalize, planes, views
from stratocloud.plans import presets
from stratocloud.queries.base import key_sql, over, query, r6, rounded, uniform_sql
from stratocloud.queries.clouds import ID, SCENES, XYZ, points
from stratocloud.queries.grids import GRID
from stratocloud.sources import clouds as cloud_files
from stratocloud.sources import manifests
from stratocloud.sources.fixtures import view


def _features(spark, sf_dir):
    return view(spark, sf_dir, "features")


# ---------------------------------------------------------------- planes

_U3 = lambda j: f"floor({uniform_sql('triple/0', 'scene_id', 'c', str(j))} * (n - {j}))::BIGINT"
_CAND = f"""o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {key_sql('triple/order', 'scene_id', 'pid')}, pid) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points),
w0 AS (SELECT scene_id, c AS candidate, {_U3(0)} AS a, {_U3(1)} AS b, {_U3(2)} AS d FROM (SELECT DISTINCT scene_id, n FROM o WHERE n >= 3), range(0, 500) AS a(c)),
w1 AS (SELECT * EXCLUDE (b), CASE WHEN b >= a THEN b + 1 ELSE b END AS b FROM w0), w2 AS (SELECT * EXCLUDE (d), CASE WHEN d >= least(a, b) THEN d + 1 ELSE d END AS d FROM w1),
w3 AS (SELECT * EXCLUDE (d), CASE WHEN d >= greatest(a, b) THEN d + 1 ELSE d END AS d FROM w2), w AS (SELECT scene_id, candidate, j, [a, b, d][j + 1] AS k FROM w3, range(0, 3) AS b(j)),
t AS (SELECT w.scene_id, candidate, max(CASE WHEN j = 0 THEN x END) AS px, max(CASE WHEN j = 0 THEN y END) AS py, max(CASE WHEN j = 0 THEN z END) AS pz,
  max(CASE WHEN j = 1 THEN x END) - px AS ux, max(CASE WHEN j = 1 THEN y END) - py AS uy, max(CASE WHEN j = 1 THEN z END) - pz AS uz,
  max(CASE WHEN j = 2 THEN x END) - px AS vx, max(CASE WHEN j = 2 THEN y END) - py AS vy, max(CASE WHEN j = 2 THEN z END) - pz AS vz FROM w JOIN o ON w.scene_id = o.scene_id AND w.k = o.k GROUP BY ALL),
n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM t), m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n),
c AS (SELECT scene_id, candidate, nx / s AS a, ny / s AS b, nz / s AS c, -(nx / s * px + ny / s * py + nz / s * pz) AS d FROM m WHERE s >= 1e-8::DOUBLE)"""


@query(over(f"-- {_CAND} SELECT scene_id, candidate::INT AS candidate, {r6('a', 'b', 'c', 'd')} FROM c"))
def l1_candidate_planes(spark, sf_dir):
    return rounded(planes.candidate_planes(points(spark, sf_dir)), *"abcd")


@query(over(f"SELECT {ID}, {r6('abs(0.1::DOUBLE * x - 0.2::DOUBLE * y + 0.9::DOUBLE * z - 1::DOUBLE) / sqrt(0.01::DOUBLE + 0.04::DOUBLE + 0.81::DOUBLE) AS d')} FROM points"))
def l2_plane_distance(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("scene_id", "pid", planes.plane_distance(*map(F.lit, (0.1, -0.2, 0.9, -1.0))).alias("d")), "d")


@query()
def l3_plane_fit(spark, sf_dir):
    return planes.fit_planes(points(spark, sf_dir))


@query(over(f"""-- {_CAND}, i AS (SELECT scene_id, candidate, count(*) FILTER (abs(c.a * x + c.b * y + c.c * z + c.d) / sqrt(c.a * c.a + c.b * c.b + c.c * c.c) < 0.3::DOUBLE) AS inliers FROM points JOIN c USING (scene_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY inliers DESC, candidate) AS k FROM i WHERE inliers >= 50) SELECT scene_id, inliers FROM r WHERE k = 1"""))
def l4_ransac_plane(spark, sf_dir):
    """The number of inliers; of candidates whose triples lie in the same plane, rounding decides which is named."""
    return planes.best_plane(points(spark, sf_dir), 0.3).select("scene_id", "inliers")


@query()
def l5_detect_planes(spark, sf_dir):
    return planes.detect_planes(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 0.3)[0]


@query(over(f"""-- p AS (SELECT *, instance % 3 AS plane FROM points), s AS (SELECT scene_id, plane, count(*) AS k, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz, avg(nz) AS c FROM p GROUP BY ALL)
SELECT scene_id, plane, k, {r6('k + 100 * sqrt(vx * vy) + 1000 / (1 + 1000 * vz) + 500 * abs(c) AS score', digits=6)} FROM s"""))
def l6_ground_scores(spark, sf_dir):
    members = points(spark, sf_dir).withColumn("plane", F.col("instance") % 3)
    fits = members.groupBy("scene_id", "plane").agg(F.avg("nx").alias("a"), F.avg("ny").alias("b"), F.avg("nz").alias("c"), F.lit(0.0).alias("d"))
    return rounded(planes.ground_scores(members, fits).select("scene_id", "plane", "k", "score"), "score", digits=6)


@query()
def l7_align_z_up(spark, sf_dir):
    return planes.align_z_up(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 0.5, 0.3)


# ---------------------------------------------------------------- normalization


@query()
def i1_i3_adjust_spacing(spark, sf_dir):
    """The report of each scene: spacing before and after, and the error left."""
    return normalize.refine_spacing(points(spark, sf_dir), 0.35)[1]


@query()
def g12_elastic_distortion(spark, sf_dir):
    return normalize.elastic_distortion(points(spark, sf_dir).select("scene_id", "pid", *XYZ), ((0.8, 0.16),))


@query()
def n13_gentle_upsample(spark, sf_dir):
    return normalize.gentle_upsample(points(spark, sf_dir).select("scene_id", "pid", *XYZ), 0.1, 4).select("scene_id", "pid", "made")


# ---------------------------------------------------------------- features

_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = f"""c AS (SELECT a.vec_id AS query, b.vec_id AS other, {_DOT('a.embedding', 'b.embedding')} / (sqrt({_DOT('a.embedding', 'a.embedding')}) * sqrt({_DOT('b.embedding', 'b.embedding')})) AS similarity FROM features AS a, features AS b)"""


@query(over(f"-- {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, other) AS k FROM c WHERE query % 20 = 0 AND other <> query) SELECT query, other, {r6('similarity')} FROM r WHERE k = 1", "features"))
def n14_best_match(spark, sf_dir):
    """Every row whose id is divisible by 20 against all rows but itself."""
    rows = _features(spark, sf_dir)
    return rounded(features.best_match(rows, rows.filter("vec_id % 20 = 0"), itself=False), "similarity")


@query(over(f"""-- {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, other) AS k FROM c WHERE other <> query)
SELECT query, other, {r6('similarity')} FROM r WHERE k = 1""", "features"))
def x_pruned_match(spark, sf_dir):
    """Every row against all rows but itself, by groups of which most are not looked at."""
    rows = _features(spark, sf_dir)
    return rounded(features.pruned_match(rows, rows, itself=False), "similarity")


@query(over(f"""-- {_COS}, s AS (SELECT other AS vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, other) - 1 AS r, count(*) OVER () AS n FROM c WHERE query = (SELECT min(vec_id) FROM features)),
m AS (SELECT max(similarity) FILTER (r = floor(n * 0.02::DOUBLE)) AS hi, max(similarity) FILTER (r = floor(n * 0.1::DOUBLE)) AS mid, max(similarity) FILTER (r = floor(n * 0.5::DOUBLE)) AS lo FROM s)
SELECT vec_id, {r6('CASE WHEN similarity >= mid THEN 1 / (1 + exp(-(similarity - mid) / (hi - mid))) ELSE 0.9::DOUBLE / (1 + exp(-(similarity - mid) / (mid - lo))) END AS heat')} FROM s, m""", "features"))
def n15_similarity_heat(spark, sf_dir):
    rows = _features(spark, sf_dir)
    scored = features.similarity_to(rows, rows.orderBy("vec_id").limit(1))
    return rounded(features.heat(scored).select("vec_id", "heat"), "heat")


@query()
def e1_pca_colors(spark, sf_dir):
    return features.pca_colors(_features(spark, sf_dir)).select("vec_id", *"rgb")


_HEAD = f"h AS (SELECT label AS class_id, list_transform(range(1, 65), lambda i: CASE WHEN i % 10 = label THEN 1::DOUBLE ELSE -0.1::DOUBLE END) AS weight, label / 100::DOUBLE AS bias FROM features GROUP BY label)"


@query(over(f"-- {_HEAD}, s AS (SELECT vec_id, class_id, {_DOT('weight', 'embedding')} + bias AS logit FROM features, h), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class_id) AS k FROM s) SELECT vec_id, class_id, class_name, {r6('logit')} FROM r JOIN palette USING (class_id) WHERE k = 1", "features", "palette"))
def e2_e3_linear_probe(spark, sf_dir):
    rows = _features(spark, sf_dir)
    features.resolve_width(rows, ["embedding"], 64)
    weight = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i % 10 == F.col("label"), 1.0).otherwise(-0.1))
    head = rows.select("label").distinct().select(F.col("label").alias("class_id"), weight.alias("weight"), (F.col("label") / 100).alias("bias"))
    found = features.linear_probe(rows, head).join(view(spark, sf_dir, "palette"), "class_id")
    return rounded(found.select("vec_id", "class_id", "class_name", "logit"), "logit")


_VARIANTS = "v AS (SELECT ((s - 1) * 4 + t)::INT AS variant, [1, 0, -1, 0][t + 1]::DOUBLE AS c, [0, 1, 0, -1][t + 1]::DOUBLE AS n, [1, 0.95, 1.05][s]::DOUBLE AS k, 1::DOUBLE AS m FROM range(1, 4) AS a(s), range(0, 4) AS b(t) UNION ALL SELECT 12, 1, 0, 1, -1)"


@query(over(f"-- {_VARIANTS} SELECT {ID}, variant, {r6('(x * c - y * n) * k * m AS x', '(x * n + y * c) * k * m AS y', 'z * k AS z')} FROM points, v"))
def e9_test_variants(spark, sf_dir):
    return rounded(features.test_variants(points(spark, sf_dir)).select("scene_id", "pid", "variant", *XYZ), *XYZ)


@query(over("SELECT clip_id, n_frames, split FROM (SELECT *, CASE clip_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM clips) WHERE split IN ('train', 'val')", "clips"))
def e10_dataset_splits(spark, sf_dir):
    split = F.when(F.col("clip_id") % 3 == 0, "train").when(F.col("clip_id") % 3 == 1, "val").otherwise("test")
    return features.split_of(view(spark, sf_dir, "clips").withColumn("split", split), ("train", "val"))


# ---------------------------------------------------------------- views and presets


@query()
def f7_multi_views(spark, sf_dir):
    return views.multi_views(points(spark, sf_dir).select("scene_id", "pid", *XYZ), most=300).select("scene_id", "pid", "view")


@query(over(f"""-- s AS ({SCENES}), p AS (SELECT {ID}, x - (lx + hx) / 2 AS x, y - (ly + hy) / 2 AS y, z - lz AS z, r, g, b, segment FROM points JOIN s USING (scene_id)),
{GRID.replace('FROM points', 'FROM p')}, k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, gx, gy, gz ORDER BY {key_sql('voxel', 'scene_id', 'pid')}, pid) AS k FROM g),
f AS (SELECT * FROM k WHERE k = 1), n AS (SELECT scene_id, count(*) AS n FROM f GROUP BY scene_id)
SELECT {ID}, gx, gy, gz, segment::BIGINT AS segment, n AS "offset", x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, (r / 255::DOUBLE)::FLOAT AS r, (g / 255::DOUBLE)::FLOAT AS g, (b / 255::DOUBLE)::FLOAT AS b FROM f JOIN n USING (scene_id)"""))
def u5_default_preset(spark, sf_dir):
    return presets.default(0.5).apply(points(spark, sf_dir))


# ---------------------------------------------------------------- files


@query(over(f"SELECT {ID.split(',')[0]}, count(*) AS n, {r6('sum(x::FLOAT::DOUBLE) AS x', 'sum(nz::FLOAT::DOUBLE) AS nz', digits=6)}, sum(r)::BIGINT AS r FROM points GROUP BY scene_id"))
def s2_s3_k1_ply_round_trip(spark, sf_dir):
    """Every scene as a PLY file's bytes and back."""
    df = cloud_files.decode_ply(cloud_files.encode_ply(points(spark, sf_dir)))
    return rounded(df.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("nz").alias("nz"), F.sum("r").cast("long").alias("r")), "x", "nz", digits=6)


@query(over(f"SELECT scene_id, count(*) AS n, {r6('sum(y::FLOAT::DOUBLE) AS y', digits=6)}, sum(segment)::BIGINT AS segment FROM points GROUP BY scene_id"))
def s1_k3_npz_round_trip(spark, sf_dir):
    df = cloud_files.decode_npz(cloud_files.encode_npz(points(spark, sf_dir)))
    return rounded(df.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("segment").cast("long").alias("segment")), "y", digits=6)


_PATHS = "f AS (SELECT page_id AS pos, 'root/ch' || (page_id % 7) || CASE WHEN page_id % 2 = 0 THEN '/video' ELSE '' END || '/scenes/s' || (page_id % 50) || CASE WHEN page_id % 5 = 0 THEN '.ply' WHEN page_id % 5 = 1 THEN '.MKV' WHEN page_id % 5 = 2 THEN '.jpg' ELSE '.mp4' END AS path FROM pages)"


def _paths(spark, sf_dir):
    n = F.col("page_id")
    tail = F.when(n % 5 == 0, ".ply").when(n % 5 == 1, ".MKV").when(n % 5 == 2, ".jpg").otherwise(".mp4")
    path = F.concat(F.lit("root/ch"), n % 7, F.when(n % 2 == 0, "/video").otherwise(""), F.lit("/scenes/s"), n % 50, tail)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(n.alias("pos"), path.alias("path"))


@query(f"WITH {_PATHS} SELECT pos, 's' || (pos % 50) AS video_id, regexp_replace(regexp_replace(path, '^root/', ''), '[.][^.]*$', '') AS name FROM f WHERE pos % 5 IN (1, 3, 4) AND NOT (path LIKE 'root/ch3/%' AND (pos % 50) % 4 = 0)")
def s7_discover_videos(spark, sf_dir):
    """A fourth of the clips of one folder are done; files of the same name in other folders aren't."""
    done = spark.range(0, 50, 4).select(F.explode(F.array(*(F.concat(F.lit(f"ch3/{v}scenes/s"), "id") for v in ("", "video/")))).alias("name"))
    return manifests.discover_videos(_paths(spark, sf_dir), done, "root").select("pos", "video_id", "name")


@query(f"WITH {_PATHS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n, 'scenes' AS name FROM f WHERE pos % 5 = 2 GROUP BY ALL")
def s8_image_folders(spark, sf_dir):
    return manifests.discover_image_folders(_paths(spark, sf_dir))


@query(f"WITH {_PATHS} SELECT pos, regexp_extract(path, '([^/]+)/scenes/', 1) AS video, 's' || (pos % 50) AS scene FROM f WHERE pos % 5 IN (3, 4)")
def s9_discover_scenes(spark, sf_dir):
    return manifests.discover_scenes(_paths(spark, sf_dir)).select("pos", "video", "scene")


@query(f"""WITH {_PATHS}, c AS (SELECT path, min(pos) AS pos FROM f WHERE pos % 5 = 0 GROUP BY path), o AS (SELECT *, regexp_extract(path, '([^/]+)/scenes/', 1) || '_scenes' AS output FROM c)
SELECT path, pos, output FROM o WHERE output <> 'ch3_scenes' ORDER BY pos LIMIT 30""")
def s10_k9_discover_clouds(spark, sf_dir):
    done = spark.createDataFrame([("ch3_scenes",)], "output string")
    return manifests.discover_clouds(_paths(spark, sf_dir), done, 30).select("path", "pos", "output")


@query(f"WITH {_PATHS} SELECT pos, regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/scenes$', '') || '/s' || (pos % 50) AS output FROM f")
def k10_scene_output(spark, sf_dir):
    return _paths(spark, sf_dir).select("pos", manifests.scene_output(F.col("path")).alias("output"))


@query(f"WITH {_PATHS} SELECT path AS input, 'out/' || pos AS output, pos::VARCHAR AS video_id, NULL::VARCHAR AS scene FROM f WHERE pos % 3 > 0")
def s6_work_list(spark, sf_dir):
    rows = _paths(spark, sf_dir).select(F.when(F.col("pos") % 3 == 1, F.col("path")).alias("input_path"), F.when(F.col("pos") % 3 == 2, F.col("path")).alias("scene_mp4"), F.concat(F.lit("out/"), "pos").alias("output_path"), F.col("pos").cast("string").alias("video_id"))
    return manifests.work_list(rows)


@query(over("-- x AS (SELECT scene_id, segment, grouping(scene_id)::INT AS every_scene, grouping(segment)::INT AS every_segment, count(*) AS n FROM points GROUP BY ROLLUP (scene_id, segment)) SELECT coalesce(scene_id, -1) AS scene_id, coalesce(segment, -99) AS segment, every_scene, every_segment, n FROM x"))
def x_scene_class_rollup(spark, sf_dir):
    """An extension: sizes of classes, scenes and everything."""
    df = points(spark, sf_dir).rollup("scene_id", "segment").agg(*(F.grouping(c).cast("int").alias(n) for c, n in (("scene_id", "every_scene"), ("segment", "every_segment"))), F.count("*").alias("n"))
    return df.withColumns({"scene_id": F.coalesce("scene_id", F.lit(-1).cast("long")), "segment": F.coalesce("segment", F.lit(-99))})


