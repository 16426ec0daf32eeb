"""Queries of coordinate, colour, schema and selection operators over the points view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocloud.operators import affine, color, schema, select
from stratocloud.queries.base import key_sql, normal_sql, over, query, r6, rounded, uniform_sql
from stratocloud.sources.fixtures import view

XYZ = ("x", "y", "z")
ID = "scene_id, pid"
SCENES = "SELECT scene_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, count(*) AS n FROM points GROUP BY scene_id"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points")


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select("scene_id", "pid", *XYZ, *more), *XYZ, *(c for c in more if c in affine.NORMAL))


def _rgb(df: DataFrame, digits: int = 10) -> DataFrame:
    df = df.select("scene_id", "pid", *(F.col(c).cast("double") for c in color.RGB))
    return rounded(df, *color.RGB, digits=digits)


# ---------------------------------------------------------------- coordinates


@query(over(f"-- s AS ({SCENES}) SELECT {ID}, {r6('x - (lx + hx) / 2 AS x', 'y - (ly + hy) / 2 AS y', 'z - lz AS z')} FROM points JOIN s USING (scene_id)"))
def g1_center_shift(spark, sf_dir):
    return _xyz(affine.center_shift(points(spark, sf_dir)))


@query(over(f"-- s AS ({SCENES}) SELECT {ID}, {r6('x - lx AS x', 'y - ly AS y', 'z - lz AS z')} FROM points JOIN s USING (scene_id)"))
def g2_positive_shift(spark, sf_dir):
    return _xyz(affine.positive_shift(points(spark, sf_dir)))


@query(over(f"""-- m AS (SELECT scene_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY scene_id),
d AS (SELECT {ID}, x - mx AS x, y - my AS y, z - mz AS z FROM points JOIN m USING (scene_id)),
f AS (SELECT scene_id, max(sqrt(x * x + y * y + z * z)) AS far FROM d GROUP BY scene_id)
SELECT {ID}, {r6('x / far AS x', 'y / far AS y', 'z / far AS z')} FROM d JOIN f USING (scene_id)"""))
def g3_normalize_coord(spark, sf_dir):
    return _xyz(affine.normalize_coord(points(spark, sf_dir)))


_U = lambda name: uniform_sql(name, "scene_id")


@query(over(f"SELECT {ID}, {r6(*(f'{c} + (-0.2::DOUBLE + {_U(f"shift/{c}")} * 0.4::DOUBLE) AS {c}' for c in 'xy'), 'z')} FROM points"))
def g4_random_shift(spark, sf_dir):
    return _xyz(affine.random_shift(points(spark, sf_dir)))


@query(over(f"SELECT {ID}, {r6('greatest(1::DOUBLE, least(x, 4::DOUBLE)) AS x', 'greatest(1::DOUBLE, least(y, 4::DOUBLE)) AS y', 'greatest(0::DOUBLE, least(z, 1::DOUBLE)) AS z')} FROM points"))
def g5_point_clip(spark, sf_dir):
    return _xyz(affine.point_clip(points(spark, sf_dir), (1, 1, 0, 4, 4, 1)))


def _rotation_sql(angle: str, center: bool = True) -> str:
    mx, my = ("(lx + hx) / 2", "(ly + hy) / 2") if center else ("0::DOUBLE", "0::DOUBLE")
    return over(f"""-- s AS ({SCENES}), d AS (SELECT *, {angle} AS a, {mx} AS mx, {my} AS my FROM points JOIN s USING (scene_id))
SELECT {ID}, {r6('(x - mx) * cos(a) - (y - my) * sin(a) + mx AS x', '(x - mx) * sin(a) + (y - my) * cos(a) + my AS y', 'z', 'nx * cos(a) - ny * sin(a) AS nx', 'nx * sin(a) + ny * cos(a) AS ny', 'nz')} FROM d""")


@query(_rotation_sql("pi() / 6"))
def g6_rotate_fixed(spark, sf_dir):
    return _xyz(affine.rotate(points(spark, sf_dir), math.pi / 6), *affine.NORMAL)


@query(_rotation_sql(f"CASE WHEN {_U('rotate/z/p')} < 0.5 THEN (-1::DOUBLE + {_U('rotate/z')} * 2::DOUBLE) * pi() ELSE 0 END"))
def g6_random_rotate(spark, sf_dir):
    return _xyz(affine.random_rotate(points(spark, sf_dir)), *affine.NORMAL)


@query(_rotation_sql(f"CASE WHEN {_U('target/z/p')} < 0.75 THEN [0.5::DOUBLE, 1::DOUBLE, 1.5::DOUBLE][floor({_U('target/z')} * 3)::INT + 1] * pi() ELSE 0 END", center=False))
def g7_random_rotate_target(spark, sf_dir):
    return _xyz(affine.random_rotate_target(points(spark, sf_dir), center=(0, 0, 0)), *affine.NORMAL)


@query(over(f"SELECT {ID}, {r6(*(f'{c} * (0.95::DOUBLE + {_U("scale/all")} * (1.05::DOUBLE - 0.95::DOUBLE)) AS {c}' for c in XYZ))} FROM points"))
def g8_random_scale(spark, sf_dir):
    return _xyz(affine.random_scale(points(spark, sf_dir)))


@query(over(f"SELECT {ID}, {r6(*(f'{c} * (0.95::DOUBLE + {_U(f"scale/{c}")} * (1.05::DOUBLE - 0.95::DOUBLE)) AS {c}' for c in XYZ))} FROM points"))
def g8_random_scale_anisotropic(spark, sf_dir):
    return _xyz(affine.random_scale(points(spark, sf_dir), anisotropic=True))


@query(over(f"SELECT {ID}, {r6(*(f'CASE WHEN {_U(f"flip/{c[-1]}")} < 0.5 THEN -{c} ELSE {c} END AS {c}' for c in ('x', 'y', 'nx', 'ny')), 'z', 'nz')} FROM points"))
def g9_random_flip(spark, sf_dir):
    return _xyz(affine.random_flip(points(spark, sf_dir)), *affine.NORMAL)


@query(over(f"SELECT {ID}, {r6(*(f'{c} + greatest(-0.05::DOUBLE, least({normal_sql(f"jitter/{c}", "scene_id", "pid")} * 0.01::DOUBLE, 0.05::DOUBLE)) AS {c}' for c in XYZ))} FROM points"))
def g10_random_jitter(spark, sf_dir):
    return _xyz(affine.random_jitter(points(spark, sf_dir)))


@query(over(f"SELECT {ID}, {r6(*(f'{c} + greatest(-1::DOUBLE, least({normal_sql(f"gauss/{c}", "scene_id", "pid")} / 1.96::DOUBLE, 1::DOUBLE)) * 0.02::DOUBLE AS {c}' for c in XYZ))} FROM points"))
def g11_clip_gaussian_jitter(spark, sf_dir):
    return _xyz(affine.clip_gaussian_jitter(points(spark, sf_dir)))


def _floors(spark, sf_dir) -> DataFrame:
    """A floor normal for each scene: the mean of its points' normals, for every third scene turned over."""
    per = points(spark, sf_dir).groupBy("scene_id").agg(*(F.avg(f"n{c}").alias(f"m{c}") for c in XYZ), *(F.min(c).alias(f"t{c}") for c in XYZ))
    sign = F.when(F.col("scene_id") % 3 == 0, -1.0).otherwise(1.0)
    return per.withColumns({"a": sign * F.round("mx", 6), "b": sign * F.round("my", 6), "c": sign * F.round("mz", 6)})


_R = """-- m AS (SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN -1 ELSE 1 END * round(avg(nx), 6) AS ma, CASE WHEN scene_id % 3 = 0 THEN -1 ELSE 1 END * round(avg(ny), 6) AS mb,
  CASE WHEN scene_id % 3 = 0 THEN -1 ELSE 1 END * round(avg(nz), 6) AS mc, min(x) AS tx, min(y) AS ty, min(z) AS tz FROM points GROUP BY scene_id),
u AS (SELECT scene_id, tx, ty, tz, ma / sqrt(ma * ma + mb * mb + mc * mc) AS a, mb / sqrt(ma * ma + mb * mb + mc * mc) AS b, mc / sqrt(ma * ma + mb * mb + mc * mc) AS c FROM m),
k AS (SELECT *, (1 - c) / (a * a + b * b) AS k FROM u),
r AS (SELECT scene_id, tx, ty, tz, CASE WHEN abs(c) > 0.999 THEN 1 ELSE 1 - k * a * a END AS r00, CASE WHEN abs(c) > 0.999 THEN 0 ELSE -k * a * b END AS r01, CASE WHEN abs(c) > 0.999 THEN 0 ELSE -a END AS r02,
  CASE WHEN c > 0.999 THEN 1 WHEN c < -0.999 THEN -1 ELSE 1 - k * b * b END AS r11, CASE WHEN abs(c) > 0.999 THEN 0 ELSE -b END AS r12, CASE WHEN c > 0.999 THEN 1 WHEN c < -0.999 THEN -1 ELSE c END AS r22 FROM k)"""


@query(over(f"{_R} SELECT scene_id, {r6(*(f'{c}::DOUBLE AS {c}' for c in ('r00', 'r01', 'r02', 'r11', 'r12', 'r22')))} FROM r"))
def g14_z_up_rotation(spark, sf_dir):
    df = affine.z_up_rotation(_floors(spark, sf_dir)).select("scene_id", "r00", "r01", "r02", "r11", "r12", "r22")
    return rounded(df, "r00", "r01", "r02", "r11", "r12", "r22")


@query(over(f"""{_R} SELECT {ID}, {r6('r00 * (x - tx) + r01 * (y - ty) + r02 * (z - tz) AS x', 'r01 * (x - tx) + r11 * (y - ty) + r12 * (z - tz) AS y', '-r02 * (x - tx) - r12 * (y - ty) + r22 * (z - tz) AS z')}
FROM points JOIN r USING (scene_id)"""))
def g13_apply_z_up(spark, sf_dir):
    return _xyz(affine.apply_z_up(points(spark, sf_dir), affine.z_up_rotation(_floors(spark, sf_dir))))


@query(over(f"SELECT {ID}, {r6(*(f'{c} * 1.753::DOUBLE AS {c}' for c in XYZ))} FROM points"))
def g15_adjust_scale(spark, sf_dir):
    return _xyz(affine.adjust_scale(points(spark, sf_dir))[0])


_SIZES, _WEIGHTS = affine.ROOM_SIZES, affine.ROOM_WEIGHTS
_DRAWN = "CASE " + " ".join(f"WHEN {_U('room')} < {round(sum(_WEIGHTS[: k + 1]), 10)}::DOUBLE THEN {_SIZES[k]}::DOUBLE + {_U('room/in')} * {_SIZES[k + 1] - _SIZES[k]!r}::DOUBLE" for k in range(6)) + f" ELSE {_SIZES[6]}::DOUBLE + {_U('room/in')} * {_SIZES[7] - _SIZES[6]!r}::DOUBLE END"


@query(over(f"-- s AS ({SCENES}) SELECT scene_id, {r6('sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly) + (hz - lz) * (hz - lz)) AS diagonal', f'{_DRAWN} AS drawn')}, 1.753::DOUBLE AS factor FROM s"))
def g16_room_size_report(spark, sf_dir):
    return rounded(affine.adjust_scale(points(spark, sf_dir))[1], "diagonal", "drawn")


@query(over(f"-- s AS ({SCENES}), v AS (SELECT scene_id, pow(60 / ((hx - lx) * (hy - ly) * (hz - lz)), 1::DOUBLE / 3) AS f FROM s) SELECT {ID}, {r6('x * f AS x', 'y * f AS y', 'z * f AS z')} FROM points JOIN v USING (scene_id)"))
def g17_scale_to_volume(spark, sf_dir):
    return _xyz(affine.scale_to_volume(points(spark, sf_dir), 60.0))


@query(over(f"-- m AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM points) SELECT {ID}, trunc((x - lx) / 0.5::DOUBLE)::BIGINT AS gx, trunc((y - ly) / 0.5::DOUBLE)::BIGINT AS gy, trunc((z - lz) / 0.5::DOUBLE)::BIGINT AS gz FROM points, m"))
def g18_grid_coord(spark, sf_dir):
    return affine.grid_coord(points(spark, sf_dir), 0.5).select("scene_id", "pid", "gx", "gy", "gz")


@query(over(f"-- b AS (SELECT scene_id, row_number() OVER (ORDER BY scene_id) - 1 AS batch FROM points GROUP BY scene_id) SELECT {ID}, {r6('x + batch * 8::DOUBLE AS x', 'y', 'z')} FROM points JOIN b USING (scene_id)"))
def e4_layout_offset(spark, sf_dir):
    return _xyz(affine.layout_offset(points(spark, sf_dir)))


# ---------------------------------------------------------------- colours


def _c6(*columns: str) -> str:
    return r6(*(c.replace(" AS ", "::DOUBLE AS ") if " AS " in c else f"{c}::DOUBLE AS {c}" for c in columns))


@query(over(f"SELECT {ID}, {_c6(*(f'({c} / 255::DOUBLE) AS {c}' for c in 'rgb'))} FROM points"))
def c1_normalize_color(spark, sf_dir):
    return _rgb(color.normalize_color(points(spark, sf_dir)))


_RANGES = "SELECT scene_id, min(r) AS lr, max(r) AS hr, min(g) AS lg, max(g) AS hg, min(b) AS lb, max(b) AS hb FROM points GROUP BY scene_id"


@query(over(f"-- s AS ({_RANGES}) SELECT {ID}, {_c6(*(f'(0.5::DOUBLE * {c} + 0.5::DOUBLE * coalesce(({c} - l{c}) * 255::DOUBLE / nullif(h{c} - l{c}, 0), {c})) AS {c}' for c in 'rgb'))} FROM points JOIN s USING (scene_id)"))
def c2_auto_contrast(spark, sf_dir):
    return _rgb(color.auto_contrast(points(spark, sf_dir), blend=0.5, p=1.0))


def _clip_sql(x: str) -> str:
    return f"greatest(0::DOUBLE, least({x}, 255::DOUBLE))"


@query(over(f"SELECT {ID}, {_c6(*(f'CASE WHEN {_U("translate/p")} < 0.95 THEN {_clip_sql(f"{c} + ({_U(f'translate/{c}')} - 0.5::DOUBLE) * 25.5::DOUBLE")} ELSE {c} END AS {c}' for c in 'rgb'))} FROM points"))
def c3_color_translation(spark, sf_dir):
    return _rgb(color.color_translation(points(spark, sf_dir)))


@query(over(f"SELECT {ID}, {_c6(*(f'CASE WHEN {_U("noise/p")} < 0.95 THEN {_clip_sql(f"{c} + {normal_sql(f'noise/{c}', 'scene_id', 'pid')} * 1.275::DOUBLE")} ELSE {c} END AS {c}' for c in 'rgb'))} FROM points"))
def c4_color_jitter(spark, sf_dir):
    return _rgb(color.color_jitter_noise(points(spark, sf_dir)))


_GRAY = "trunc(r * 0.2989::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"


@query(over(f"SELECT {ID}, {_c6(*(f'{_GRAY} AS {c}' for c in 'rgb'))} FROM points"))
def c5_grayscale(spark, sf_dir):
    return _rgb(color.grayscale(points(spark, sf_dir)))


@query(over(f"SELECT {ID}, {_c6(*(f'trunc({_clip_sql(f"1.3::DOUBLE * {c}")}) AS {c}' for c in 'rgb'))} FROM points"))
def c6_brightness(spark, sf_dir):
    return _rgb(color.brightness(points(spark, sf_dir), 1.3))


@query(over(f"-- m AS (SELECT scene_id, avg({_GRAY}) AS m FROM points GROUP BY scene_id) SELECT {ID}, {_c6(*(f'trunc({_clip_sql(f"0.75::DOUBLE * {c} + 0.25::DOUBLE * m")}) AS {c}' for c in 'rgb'))} FROM points JOIN m USING (scene_id)"))
def c6_contrast(spark, sf_dir):
    return _rgb(color.contrast(points(spark, sf_dir), 0.75))


@query(over(f"SELECT {ID}, {_c6(*(f'trunc({_clip_sql(f"1.5::DOUBLE * {c} + -0.5::DOUBLE * {_GRAY}")}) AS {c}' for c in 'rgb'))} FROM points"))
def c6_saturation(spark, sf_dir):
    return _rgb(color.saturation(points(spark, sf_dir), 1.5))


def _hsv_sql(unit: str, turn: str, saturation: str, cut: str) -> str:
    pick = lambda *x: f"[{', '.join(x)}][(i % 6)::INT + 1]"
    return over(f"""-- a AS (SELECT {ID}, r / {unit} AS r, g / {unit} AS g, b / {unit} AS b FROM points),
v AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM a),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d WHEN v = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END / 6::DOUBLE AS h6, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s0 FROM v),
t AS (SELECT *, {turn} AS t, {saturation} AS s FROM h), u AS (SELECT *, t - floor(t) AS h FROM t),
i AS (SELECT *, floor(h * 6) AS i, h * 6 - floor(h * 6) AS f FROM u),
p AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS w FROM i)
SELECT {ID}, {_c6(f"trunc({cut % pick('v', 'q', 'p', 'p', 'w', 'v')}) AS r", f"trunc({cut % pick('w', 'v', 'v', 'q', 'p', 'p')}) AS g", f"trunc({cut % pick('p', 'p', 'w', 'v', 'v', 'q')}) AS b")} FROM p""")


@query(_hsv_sql("255::DOUBLE", "h6 - floor(h6) + 0.1::DOUBLE", "s0", "%s * 255::DOUBLE"))
def c7_hue(spark, sf_dir):
    return _rgb(color.hue(points(spark, sf_dir), 0.1))


@query()
def c8_random_color_jitter(spark, sf_dir):
    return _rgb(color.color_jitter(points(spark, sf_dir)))


@query(_hsv_sql("1::DOUBLE", "0.25::DOUBLE + (h6 - floor(h6)) + 1::DOUBLE", "greatest(0::DOUBLE, least(0.8::DOUBLE * s0, 1::DOUBLE))", "greatest(0::DOUBLE, least(%s, 255::DOUBLE))"))
def c9_hue_saturation_translation(spark, sf_dir):
    return _rgb(color.hue_saturation_translation(points(spark, sf_dir), shift=(0.25, 0.8)))


@query(over(f"SELECT {ID}, {_c6(*(f'CASE WHEN {_U("drop/p")} < 0.2 THEN 0 ELSE {c} END AS {c}' for c in 'rgb'))} FROM points"))
def c10_color_drop(spark, sf_dir):
    return _rgb(color.color_drop(points(spark, sf_dir)))


# ---------------------------------------------------------------- schema


@query(over("-- n AS (SELECT scene_id, count(*) AS o FROM points GROUP BY scene_id) SELECT scene_id, pid, o AS \"offset\", x::FLOAT AS f0, (r / 255::DOUBLE)::FLOAT AS f1 FROM points JOIN n USING (scene_id)"))
def p1_collect(spark, sf_dir):
    df = schema.collect(color.normalize_color(points(spark, sf_dir)), ["scene_id", "pid"], feat=["x", "r"])
    return df.select("scene_id", "pid", "offset", F.get("feat", F.lit(0)).alias("f0"), F.get("feat", F.lit(1)).alias("f1"))


@query(over(f"SELECT {ID}, x AS origin_x, y AS origin_y, z AS origin_z, segment AS origin_segment FROM points"))
def p2_copy(spark, sf_dir):
    return schema.copy(points(spark, sf_dir)).select("scene_id", "pid", "origin_x", "origin_y", "origin_z", "origin_segment")


@query(over(f"SELECT {ID}, 'ScanNet' AS condition, 0.02::DOUBLE AS grid_size FROM points"))
def p3_update(spark, sf_dir):
    return schema.update(points(spark, sf_dir), {"condition": "ScanNet", "grid_size": 0.02}).select("scene_id", "pid", "condition", "grid_size")


@query(over(f"SELECT {ID}, x::FLOAT AS x, segment::BIGINT AS segment FROM points"))
def p4_to_tensor(spark, sf_dir):
    return schema.to_tensor_types(points(spark, sf_dir)).select("scene_id", "pid", "x", "segment")


@query(over(f"-- i AS (SELECT scene_id, pid FROM points WHERE segment = 1 UNION ALL SELECT scene_id, pid FROM points WHERE segment = 1 AND instance < 5) SELECT {ID}, segment, instance FROM points JOIN i USING (scene_id, pid)"))
def p5_index(spark, sf_dir):
    df = points(spark, sf_dir)
    some = df.filter("segment = 1")
    return schema.take(df, some.unionByName(some.filter("instance < 5"))).select("scene_id", "pid", "segment", "instance")


@query(over(" UNION ALL ".join(f"SELECT '{v}' AS view, {ID}, {r6(*(f'{c} * (0.95::DOUBLE + {uniform_sql("scale/all", "scene_id", seed=s)} * (1.05::DOUBLE - 0.95::DOUBLE)) AS {c}' for c in XYZ))} FROM points" for v, s in (("view1", 1), ("view2", 2)))))
def p6_contrastive_views(spark, sf_dir):
    return _xyz(schema.contrastive_views(points(spark, sf_dir), lambda df, v: affine.random_scale(df, seed=int(v[-1]))), "view")


_BATCH = "SELECT scene_id, row_number() OVER (ORDER BY scene_id) - 1 AS batch, n, sum(n) OVER (ORDER BY scene_id)::BIGINT AS \"offset\" FROM (SELECT scene_id, count(*) AS n FROM points GROUP BY scene_id)"


@query(over(f"-- b AS ({_BATCH}) SELECT {ID}, batch, \"offset\" FROM points JOIN b USING (scene_id)"))
def p7_collate(spark, sf_dir):
    df = points(spark, sf_dir)
    return schema.collate([df.filter("scene_id % 2 = 0"), df.filter("scene_id % 2 = 1").drop("nx", "ny", "nz")]).select("scene_id", "pid", "batch", "offset")


@query(over(f"-- b AS ({_BATCH}) SELECT batch, n, \"offset\" FROM b"))
def p8_offset_bincount(spark, sf_dir):
    offsets = schema.batch_index(points(spark, sf_dir)).select("batch", "offset")
    counts = schema.offset_to_bincount(offsets)
    return counts.join(schema.bincount_to_offset(counts), "batch").select("batch", "n", "offset")


@query(over(f"-- b AS ({_BATCH}) SELECT batch, count(*) AS n, min(r) AS first, max(r) AS last FROM b, LATERAL (SELECT unnest(range(\"offset\" - n, \"offset\")) AS r) GROUP BY batch"))
def p8_offset_batch(spark, sf_dir):
    rows = schema.offset_to_batch(schema.batch_index(points(spark, sf_dir)).select("batch", "offset"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))


# ---------------------------------------------------------------- selection

_BY = lambda name: f"row_number() OVER (PARTITION BY scene_id ORDER BY {key_sql(name, 'scene_id', 'pid')}, pid)"


@query(over(f"-- n AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n, {_BY('dropout')} AS k FROM points) SELECT {ID} FROM n WHERE NOT ({_U('dropout/p')} < 0.5) OR k <= floor(n * 0.8::DOUBLE) OR segment = 0"))
def f1_random_dropout(spark, sf_dir):
    return select.random_dropout(points(spark, sf_dir), forced=F.col("segment") == 0).select("scene_id", "pid")


_D2 = "(x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)"


@query(over(f"""-- o AS (SELECT scene_id, x AS cx, y AS cy, z AS cz, row_number() OVER (PARTITION BY scene_id ORDER BY pid) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points),
c AS (SELECT * FROM o WHERE k = n // 2), d AS (SELECT {ID}, row_number() OVER (PARTITION BY scene_id ORDER BY {_D2}, pid) AS k FROM points JOIN c USING (scene_id)) SELECT {ID} FROM d WHERE k <= 100"""))
def f2_sphere_crop_center(spark, sf_dir):
    return select.sphere_crop(points(spark, sf_dir), 100, mode="center").select("scene_id", "pid")


@query(over(f"""-- o AS (SELECT scene_id, x AS cx, y AS cy, z AS cz, {_BY('crop')} AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points),
c AS (SELECT * FROM o WHERE k = 1), d AS (SELECT {ID}, n, row_number() OVER (PARTITION BY scene_id ORDER BY {_D2}, pid) AS k FROM points JOIN c USING (scene_id)) SELECT {ID} FROM d WHERE k <= floor(n * 0.6::DOUBLE)"""))
def f2_sphere_crop_random(spark, sf_dir):
    return select.sphere_crop(points(spark, sf_dir), sample_rate=0.6).select("scene_id", "pid")


@query(over(f"SELECT {ID}, {_BY('shuffle')} AS place FROM points"))
def f3_shuffle_points(spark, sf_dir):
    return select.shuffle_points(points(spark, sf_dir)).select("scene_id", "pid", "place")


@query(over(f"SELECT {ID}, segment FROM points WHERE segment NOT IN (0, 1)"))
def f4_crop_boundary(spark, sf_dir):
    return select.crop_boundary(points(spark, sf_dir)).select("scene_id", "pid", "segment")


@query(over(f"SELECT {ID} FROM (SELECT *, {_BY('downsample')} AS k FROM points) WHERE k <= 500"))
def f5_pre_downsample(spark, sf_dir):
    return select.pre_downsample(points(spark, sf_dir), 500).select("scene_id", "pid")


@query(over(f"SELECT {ID}, rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {_D2}, pid) AS rank FROM (SELECT *, 2.5::DOUBLE AS cx, 2.5::DOUBLE AS cy, 1::DOUBLE AS cz FROM points)) WHERE rank <= 50"))
def f6_nearest_to(spark, sf_dir):
    return select.nearest_to(points(spark, sf_dir), (2.5, 2.5, 1.0), 50).select("scene_id", "pid", "rank")


@query(over(f"""-- s AS ({SCENES}), w AS (SELECT scene_id, n, n / ((hx - lx) * (hy - ly) * (hz - lz)) AS density FROM s),
a AS (SELECT scene_id, n, CASE WHEN density > 7.5 OR n > 650 THEN least(greatest(greatest(trunc(n * (5::DOUBLE / density))::BIGINT, 100), floor(n * 0.7::DOUBLE)::BIGINT), floor(n * 1.3::DOUBLE)::BIGINT) ELSE n END AS goal FROM w),
k AS (SELECT {ID}, n, goal, {_BY('density')} AS k FROM points JOIN a USING (scene_id))
SELECT {ID}, copy::INT AS copy FROM k, LATERAL (SELECT unnest(range(0, CASE WHEN k <= goal - n THEN 2 ELSE 1 END)) AS copy) WHERE k <= goal"""))
def f8_adjust_density(spark, sf_dir):
    return select.adjust_density(points(spark, sf_dir), 5.0, most=650, least=100).select("scene_id", "pid", "copy")


@query(over(f"SELECT {ID} FROM points WHERE 1::DOUBLE / (1::DOUBLE + exp(-(z - 4))) > 0.1"))
def f9_confidence_mask(spark, sf_dir):
    return select.confident(points(spark, sf_dir), F.col("z") - 4.0).select("scene_id", "pid")
