"""Queries of frame, work-list and curve operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocloud.operators import curves, frames, ranges, select, voxel
from stratocloud.queries.base import over, query, r6, rounded
from stratocloud.queries.clouds import ID, points
from stratocloud.queries.grids import GRID
from stratocloud.sources.fixtures import view

V = "PARTITION BY video_id ORDER BY frame_index"
FID = "video_id, frame_index"


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "frames")


def _fsql(sql: str) -> str:
    return over(sql, "frames")


@query(_fsql(f"SELECT {FID} FROM frames WHERE frame_index >= 5 AND (frame_index - 5) % 3 = 0"))
def s11_decimate(spark, sf_dir):
    return frames.decimate(_frames(spark, sf_dir), 5, 3).select("video_id", "frame_index")


@query(_fsql(f"-- n AS (SELECT video_id, CASE WHEN count(*) - 5 > 20 THEN greatest(1, round_even((count(*) - 5) / 20::DOUBLE, 0)::INT) ELSE 1 END AS interval FROM frames GROUP BY video_id) SELECT {FID}, interval FROM frames JOIN n USING (video_id) WHERE frame_index >= 5 AND (frame_index - 5) % interval = 0"))
def s11_decimate_to_target(spark, sf_dir):
    return frames.decimate_to(_frames(spark, sf_dir), 20, 5).select("video_id", "frame_index", "interval")


@query(_fsql(f"SELECT {FID} FROM (SELECT *, row_number() OVER ({V}) - 1 AS p FROM frames) WHERE p >= 10 AND p < 40 AND (p - 10) % 4 = 0"))
def s12_slice_range(spark, sf_dir):
    return frames.slice_range(_frames(spark, sf_dir), 10, 40, 4, "video_id", "frame_index").select("video_id", "frame_index")


@query(_fsql(f"-- f AS (SELECT *, CASE WHEN video_id % 4 = 0 THEN NULL WHEN video_id % 4 = 1 THEN 'NaN'::DOUBLE WHEN video_id % 4 = 2 THEN -1 ELSE fps END AS rate FROM frames) SELECT {FID}, CASE WHEN rate IS NULL OR isnan(rate) OR rate <= 0 THEN 30 ELSE rate END::DOUBLE AS fps FROM f"))
def s13_fps_fallback(spark, sf_dir):
    rate = F.when(F.col("video_id") % 4 == 0, None).when(F.col("video_id") % 4 == 1, float("nan")).when(F.col("video_id") % 4 == 2, -1.0).otherwise(F.col("fps"))
    return _frames(spark, sf_dir).select("video_id", "frame_index", frames.frame_rate(rate).alias("fps"))


@query(_fsql("SELECT video_id, CASE WHEN video_id % 2 = 0 THEN count(*)::DOUBLE ELSE count(*) / 5::DOUBLE END AS seconds FROM frames GROUP BY video_id"))
def s14_duration(spark, sf_dir):
    per = _frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"), F.first("fps").alias("fps"))
    return per.select("video_id", frames.duration(F.col("n"), F.when(F.col("video_id") % 2 == 0, 0.0).otherwise(F.col("fps"))).alias("seconds"))


_EMB = lambda s: f"[{', '.join(f'embedding[{i}]::DOUBLE' for i in s)}]"


@query(over(f"SELECT vec_id, {r6(f'1::DOUBLE / (1::DOUBLE + exp(list_max({_EMB(range(5, 9))}) * 10 - list_max({_EMB(range(1, 5))}) * 10)) AS p')} FROM features", "features"))
def q1_inside_probability(spark, sf_dir):
    pick = lambda lo, hi: F.transform(F.slice("embedding", lo, hi - lo), lambda x: x.cast("double"))
    return rounded(view(spark, sf_dir, "features").select("vec_id", frames.inside_probability(pick(1, 5), pick(5, 9), 10.0).alias("p")), "p")


@query(_fsql(f"SELECT {FID}, last_value(CASE WHEN frame_index % 4 = 0 THEN prob_inside END IGNORE NULLS) OVER ({V}) AS prob_inside FROM frames"))
def q2_stride_expansion(spark, sf_dir):
    return frames.fill_stride(_frames(spark, sf_dir), 4, "prob_inside").select("video_id", "frame_index", "prob_inside")


_SMOOTH = lambda w: f"k AS (SELECT *, 2 * sum((prob_inside >= 0.5)::INT) OVER ({V} ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) >= {w} AS keep FROM frames)"


@query(_fsql(f"-- {_SMOOTH(4)} SELECT {FID}, keep FROM k"))
def q3_smoothing(spark, sf_dir):
    return frames.smooth_mask(_frames(spark, sf_dir), 4).select("video_id", "frame_index", "keep")


_ISLAND = f"""{_SMOOTH(3)}, i AS (SELECT *, row_number() OVER ({V}) - row_number() OVER (PARTITION BY video_id, keep ORDER BY frame_index) AS i FROM k),
l AS (SELECT * EXCLUDE (keep), keep AND count(*) OVER (PARTITION BY video_id, keep, i) >= 3 AS keep FROM i)"""


@query(_fsql(f"-- {_ISLAND} SELECT {FID}, keep FROM l"))
def q4_suppress_short_runs(spark, sf_dir):
    return frames.suppress_short_runs(frames.smooth_mask(_frames(spark, sf_dir), 3), 3).select("video_id", "frame_index", "keep")


_MARGIN = f"{_ISLAND}, m AS (SELECT * EXCLUDE (keep), min(keep) OVER ({V} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep FROM l)"


def _masked(spark, sf_dir):
    return frames.outside_margin(frames.suppress_short_runs(frames.smooth_mask(_frames(spark, sf_dir), 3), 3), 1)


@query(_fsql(f"-- {_MARGIN} SELECT {FID}, keep FROM m"))
def q5_outside_margin(spark, sf_dir):
    return _masked(spark, sf_dir).select("video_id", "frame_index", "keep")


@query(_fsql(f"-- {_MARGIN} SELECT video_id, count(*) AS n, count(*) FILTER (keep) AS kept, {r6('count(*) FILTER (keep) / count(*)::DOUBLE AS ratio')}, CASE WHEN count(*) FILTER (keep) = 0 THEN 'SKIP' ELSE 'OK' END AS status FROM m GROUP BY video_id"))
def q6_kept_ratio(spark, sf_dir):
    return rounded(frames.kept_ratio(_masked(spark, sf_dir)), "ratio")


@query(over("""-- s AS (SELECT vec_id, (i - 1) // 4 AS label_index, embedding[i]::DOUBLE AS score FROM features, range(1, 25) AS t(i)),
b AS (SELECT vec_id, label_index, max(score) AS score FROM s GROUP BY ALL) SELECT vec_id, arg_min(label_index, (-score, label_index))::BIGINT AS label, max(score) AS score FROM b GROUP BY vec_id""", "features"))
def q7_best_label(spark, sf_dir):
    rows = view(spark, sf_dir, "features").select("vec_id", F.posexplode(F.slice("embedding", 1, 24)).alias("i", "score"))
    scores = rows.select("vec_id", F.floor(F.col("i") / 4).alias("label_index"), F.col("score").cast("double").alias("score")).withColumn("label", F.col("label_index"))
    return frames.best_label(scores, ["vec_id"])


_RUNS = f"""c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER ({V}) AND row_number() OVER ({V}) > 1 THEN 1 ELSE 0 END AS new FROM frames),
r AS (SELECT *, sum(new) OVER ({V})::BIGINT AS run FROM c), u AS (SELECT video_id, run, any_value(label) AS label, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n FROM r GROUP BY ALL)"""


@query(_fsql(f"-- {_RUNS} SELECT * FROM u"))
def q8_runs(spark, sf_dir):
    return frames.runs(_frames(spark, sf_dir))


_ABSORB = f"""{_RUNS}, a AS (SELECT * EXCLUDE (label), last_value(CASE WHEN n >= 2 OR run = 0 THEN label END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY run) AS label FROM u),
d AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY video_id ORDER BY run) AND row_number() OVER (PARTITION BY video_id ORDER BY run) > 1 THEN 1 ELSE 0 END AS new FROM a),
e AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY run)::BIGINT AS joined FROM d),
j AS (SELECT video_id, joined AS run, any_value(label) AS label, min(first) AS first, max(last) AS last, sum(n)::BIGINT AS n FROM e GROUP BY ALL)"""


@query(_fsql(f"-- {_ABSORB} SELECT * FROM j"))
def q9_absorb_short_runs(spark, sf_dir):
    return frames.absorb_short_runs(_frames(spark, sf_dir), 2)


def _segments(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    totals = rows.groupBy("video_id").agg((F.count("*") * 3 + 1).alias("total"))
    sampled = frames.absorb_short_runs(rows, 2).withColumns({"first": F.col("first") * 3, "last": F.col("last") * 3})
    return frames.boundaries(sampled, totals, 3)


_BOUNDS = f"""{_ABSORB}, t AS (SELECT video_id, count(*) * 3 + 1 AS total FROM frames GROUP BY video_id), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY run) AS k, count(*) OVER (PARTITION BY video_id) AS m FROM j JOIN t USING (video_id)),
b AS (SELECT video_id, run, label, total, CASE WHEN k = 1 THEN 0 ELSE first * 3 END::BIGINT AS start, CASE WHEN k = m THEN total ELSE least(last * 3 + 3, total) END::BIGINT AS "end" FROM k)"""


@query(_fsql(f"-- {_BOUNDS} SELECT * FROM b"))
def q10_boundaries(spark, sf_dir):
    return _segments(spark, sf_dir)


#: A video's segments as a list, merged one step at a time: the first short one, with its left or its right neighbour.
_MERGED = f"""{_BOUNDS}, rec AS (
  SELECT video_id, list(struct_pack(a := start, b := "end", label := label) ORDER BY start) AS s FROM b GROUP BY video_id
  UNION ALL SELECT video_id, s[:j - 1] || [struct_pack(a := s[j].a, b := s[j + 1].b, label := CASE WHEN j < k THEN s[j].label ELSE s[j + 1].label END)] || s[j + 2:] FROM (
    SELECT *, CASE WHEN k > 1 AND s[k - 1].label = s[k].label OR k = len(s) THEN k - 1 WHEN k = 1 OR s[k + 1].label = s[k].label THEN k
      WHEN s[k - 1].b - s[k - 1].a >= s[k + 1].b - s[k + 1].a THEN k - 1 ELSE k END AS j FROM (
      SELECT *, list_position(list_transform(s, lambda x: x.b - x.a < 12), true) AS k FROM rec) WHERE k > 0 AND len(s) > 1)),
f AS (SELECT video_id, unnest(s) AS x FROM rec WHERE len(s) = 1 OR NOT list_contains(list_transform(s, lambda x: x.b - x.a < 12), true))"""


@query(_fsql(f'-- {_MERGED} SELECT video_id, x.a AS start, x.b AS "end", x.label AS label FROM f').replace("WITH ", "WITH RECURSIVE ", 1))
def q11_merge_short_segments(spark, sf_dir):
    return frames.merge_short_segments(_segments(spark, sf_dir), 12)


@query(_fsql(f"-- c AS (SELECT video_id, i * 10 AS start, CASE WHEN i = 2 THEN 20 ELSE i * 10 + 10 END AS \"end\" FROM (SELECT DISTINCT video_id FROM frames), range(0, 6) AS t(i)) SELECT {FID}, start FROM frames JOIN c USING (video_id) WHERE frame_index >= start AND frame_index < \"end\""))
def q12_split_at_cuts(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    cuts = rows.select("video_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("start", (F.col("i") * 10).cast("long"))
    cuts = cuts.withColumn("end", F.when(F.col("i") == 2, 20).otherwise(F.col("start") + 10))
    return frames.split_at_cuts(rows, cuts).select("video_id", "frame_index", "start")


_MARKS = "m AS (SELECT video_id, frame_index + 1 AS frame_index, prob_inside AS mark FROM frames WHERE frame_index % 7 = 2 AND video_id % 5 > 0)"


@query(_fsql(f"-- {_MARKS} SELECT f.video_id, f.frame_index, m.frame_index AS right_frame_index, m.mark FROM frames AS f ASOF LEFT JOIN m ON f.video_id = m.video_id AND f.frame_index >= m.frame_index"))
def x_asof_last(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("video_id", "frame_index", "prob_inside")
    marks = rows.filter("frame_index % 7 = 2 AND video_id % 5 > 0").select("video_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("prob_inside").alias("mark"))
    return ranges.asof_join(rows.drop("prob_inside"), marks, "video_id", "frame_index")


@query(_fsql(f"""-- {_MARKS}, r AS (SELECT f.video_id, f.frame_index, m.frame_index AS right_frame_index, m.mark,
  row_number() OVER (PARTITION BY f.video_id, f.frame_index ORDER BY abs(f.frame_index - m.frame_index), m.frame_index) AS k
  FROM frames AS f LEFT JOIN m ON f.video_id = m.video_id AND abs(f.frame_index - m.frame_index) <= 2) SELECT * EXCLUDE (k) FROM r WHERE k = 1"""))
def x_asof_nearest(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("video_id", "frame_index", "prob_inside")
    marks = rows.filter("frame_index % 7 = 2 AND video_id % 5 > 0").select("video_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("prob_inside").alias("mark"))
    return ranges.asof_join(rows.drop("prob_inside"), marks, "video_id", "frame_index", "nearest", tolerance=2)


#: Clips of 12 frames that begin every 5 frames, so that most frames are in several.
_CLIPS = "c AS (SELECT video_id, frame_index AS start, frame_index + 12 AS \"end\", label AS clip FROM frames WHERE frame_index % 5 = 0)"


@query(_fsql(f"-- {_CLIPS} SELECT f.video_id, f.frame_index, c.start, c.clip FROM frames AS f JOIN c ON f.video_id = c.video_id AND f.frame_index >= c.start AND f.frame_index < c.\"end\""))
def x_overlapping_clips(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    clips = rows.filter("frame_index % 5 = 0").select("video_id", F.col("frame_index").alias("start"), (F.col("frame_index") + 12).alias("end"), F.col("label").alias("clip"))
    return ranges.interval_join(rows.select("video_id", "frame_index"), clips, "video_id", "frame_index").select("video_id", "frame_index", "start", "clip")


#: Every tenth frame is long and thin, so that a number of steps is rounded to none.
_SIZES = """s AS (SELECT video_id, frame_index, (video_id % 1280 + 640) * CASE WHEN frame_index % 10 = 5 THEN 15 ELSE 1 END AS w, CASE WHEN frame_index % 10 = 5 THEN frame_index // 10 + 3 ELSE frame_index * 7 + 360 END AS h FROM frames),
a AS (SELECT *, w * sqrt(255000::DOUBLE / (w * h)) AS x, h * sqrt(255000::DOUBLE / (w * h)) AS y FROM s), k0 AS (SELECT *, round_even(x / 14, 0)::BIGINT AS k, round_even(y / 14, 0)::BIGINT AS m FROM a),"""
_TURN = "(SELECT * EXCLUDE (k, m), CASE WHEN o AND k / m > x / y THEN k - 1 ELSE k END AS k, CASE WHEN o AND NOT k / m > x / y THEN m - 1 ELSE m END AS m FROM (SELECT * EXCLUDE (o), k * m * 196 > 255000 AS o FROM {0}))"
_SIZES += f" k1 AS {_TURN.format('(SELECT *, true AS o FROM k0)')}, k2 AS {_TURN.format('k1')}"


@query(_fsql(f"-- {_SIZES} SELECT video_id, frame_index, greatest(k, 1) * 14 AS width, greatest(m, 1) * 14 AS height FROM k2"))
def q13_fit_size(spark, sf_dir):
    thin = F.col("frame_index") % 10 == 5
    w, h = (F.col("video_id") % 1280 + 640) * F.when(thin, 15).otherwise(1), F.when(thin, F.floor(F.col("frame_index") / 10) + 3).otherwise(F.col("frame_index") * 7 + 360)
    df = _frames(spark, sf_dir).select("video_id", "frame_index", w.alias("w"), h.alias("h"))
    w, h = frames.fit_size(F.col("w"), F.col("h"), 255_000)
    return df.select("video_id", "frame_index", w.alias("width"), h.alias("height"))


@query(_fsql(f"SELECT video_id, frame_index // 2 AS sample_index, frame_index, printf('%.3f', frame_index / 5::DOUBLE) AS time_sec, printf('%.6f', prob_inside) AS prob_inside FROM frames WHERE frame_index % 2 = 0"))
def k7_probability_rows(spark, sf_dir):
    return frames.probability_rows(_frames(spark, sf_dir), 2)


@query(_fsql(f"-- {_RUNS} SELECT video_id, run, printf('scene-%03d_%s', (run + 1)::INT, regexp_replace(label, '[^0-9A-Za-z_-]', '_', 'g')) AS name FROM u"))
def k8_clip_names(spark, sf_dir):
    return frames.runs(_frames(spark, sf_dir)).select("video_id", "run", frames.clip_name(F.col("run") + 1, F.col("label")).alias("name"))


# ---------------------------------------------------------------- work lists


@query(over("SELECT video_id, url FROM (SELECT trim(video_id) AS video_id, trim(url) AS url FROM manifest) WHERE length(video_id) > 0 AND length(url) > 0", "manifest"))
def s4_manifest(spark, sf_dir):
    from stratocloud.sources.manifests import clean_manifest

    return clean_manifest(view(spark, sf_dir, "manifest"))


@query(over("SELECT video_id FROM manifest ORDER BY video_id LIMIT 40", "manifest"))
def s5_first_ids(spark, sf_dir):
    from stratocloud.sources.manifests import first_ids

    return first_ids(view(spark, sf_dir, "manifest"), 40)


@query(over("-- w AS (SELECT video_id FROM manifest WHERE video_id::INT % 5 = 0) SELECT video_id, url FROM manifest SEMI JOIN w USING (video_id) ORDER BY video_id LIMIT 25", "manifest"))
def f10_manifest_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "manifest")
    return select.manifest_filter(rows, rows.filter("CAST(video_id AS INT) % 5 = 0"), n=25)[0]


@query(over("SELECT video_id, url FROM manifest ANTI JOIN finished USING (video_id)", "manifest", "finished"))
def f11_skip_existing(spark, sf_dir):
    return select.skip_existing(view(spark, sf_dir, "manifest"), view(spark, sf_dir, "finished"))


@query(_fsql("SELECT label, video_id, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY frame_index, video_id) AS k FROM frames) WHERE k = 1"))
def f12_first_of_each(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumn("at", F.struct("frame_index", "video_id"))
    return select.first_of_each(rows, "label", "at").select("label", "video_id", "frame_index")


@query(over("SELECT clip_id, n_frames, (row_number() OVER (ORDER BY clip_id) - 1) % 8 AS shard FROM clips", "clips"))
def f13_shards(spark, sf_dir):
    return select.shard(view(spark, sf_dir, "clips"), 8, "clip_id")


@query(over("SELECT clip_id, n_frames, ntile(7) OVER (ORDER BY clip_id) - 1 AS part FROM clips", "clips"))
def f14_contiguous_split(spark, sf_dir):
    return select.split_evenly(view(spark, sf_dir, "clips"), 7, "clip_id")


@query(over("SELECT clip_id, n_frames FROM clips ORDER BY n_frames DESC, clip_id LIMIT 20", "clips"))
def f15_s9_longest_clips(spark, sf_dir):
    return select.longest(view(spark, sf_dir, "clips"), 20)


# ---------------------------------------------------------------- curves


def _cells(spark, sf_dir):
    return voxel.with_cells(points(spark, sf_dir), 0.05)


_FINE = GRID.replace("0.5::DOUBLE", "0.05::DOUBLE")
_MORTON_SQL = lambda x, y, z: "(" + " + ".join(f"((({v} >> {i}) & 1)::BIGINT << {3 * i + k})" for v, k in ((x, 2), (y, 1), (z, 0)) for i in range(8)) + ")"


@query(over(f"-- {_FINE} SELECT {ID}, {_MORTON_SQL('gx', 'gy', 'gz')} AS code FROM g"))
def z1_morton_code(spark, sf_dir):
    return _cells(spark, sf_dir).select("scene_id", "pid", curves.morton_code(*map(F.col, ("gx", "gy", "gz"))).alias("code"))


@query(over(f"-- {_FINE} SELECT {ID}, gx, gy, gz FROM g"))
def z2_morton_round_trip(spark, sf_dir):
    x, y, z = curves.morton_cell(curves.morton_code(*map(F.col, ("gx", "gy", "gz"))))
    return _cells(spark, sf_dir).select("scene_id", "pid", x.alias("gx"), y.alias("gy"), z.alias("gz"))


@query(over(f"-- {_FINE} SELECT {ID}, gx, gy, gz FROM g"))
def z3_z4_hilbert_round_trip(spark, sf_dir):
    coded = curves.with_hilbert(_cells(spark, sf_dir), 8).select("scene_id", "pid", "code")
    return curves.with_hilbert_cell(coded, 8).select("scene_id", "pid", "gx", "gy", "gz")


@query(over(f"-- {_FINE} SELECT {ID}, xor(gx, gx >> 1) AS gray, gx AS back FROM g"))
def z5_gray_code(spark, sf_dir):
    df = _cells(spark, sf_dir).select("scene_id", "pid", curves.to_gray(F.col("gx")).alias("gray"))
    return df.withColumn("back", curves.from_gray(F.col("gray")))


@query(over(f"-- {_FINE}, m AS (SELECT scene_id, greatest(max(gx), max(gy), max(gz)) AS m FROM g GROUP BY scene_id) SELECT scene_id, length(bin(m + 1))::INT AS depth FROM m"))
def z8_adaptive_depth(spark, sf_dir):
    most = _cells(spark, sf_dir).groupBy("scene_id").agg(F.greatest(F.max("gx"), F.max("gy"), F.max("gz")).alias("m"))
    return most.select("scene_id", curves.depth_of(F.col("m")).cast("int").alias("depth"))


@query(over(f"-- {_FINE}, c AS (SELECT {ID}, {_MORTON_SQL('gx', 'gy', 'gz')} AS code_z, {_MORTON_SQL('gy', 'gx', 'gz')} AS code_z_trans FROM g) SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY code_z, pid) - 1 AS place_z, row_number() OVER (PARTITION BY scene_id ORDER BY code_z_trans, pid) - 1 AS place_z_trans, scene_id * (1::BIGINT << 24) + code_z AS batch_code FROM c"))
def z6_z7_z9_serialize(spark, sf_dir):
    df = curves.serialize(_cells(spark, sf_dir), 8, ("z", "z-trans"))
    return df.select("scene_id", "pid", "code_z", "code_z_trans", "place_z", "place_z_trans", curves.batch_code(F.col("scene_id"), F.col("code_z"), 8).alias("batch_code"))


_DRAWN = {f"{part}_{k}": f"CASE WHEN md5('42:order:z') {'<' if k == 0 else '>'} md5('42:order:z-trans') THEN {a} ELSE {b} END" for k in (0, 1)
          for part, a, b in (("order", "'z'", "'z-trans'"), ("code", "code_z", "code_z_trans"), ("place", "place_z", "place_z_trans"))}


@query(over(f"""-- {_FINE},
c AS (SELECT {ID}, {_MORTON_SQL('gx', 'gy', 'gz')} AS code_z, {_MORTON_SQL('gy', 'gx', 'gz')} AS code_z_trans FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY code_z, pid) - 1 AS place_z,
  row_number() OVER (PARTITION BY scene_id ORDER BY code_z_trans, pid) - 1 AS place_z_trans FROM c)
SELECT scene_id, pid, {', '.join(f'{v} AS {c}' for c, v in _DRAWN.items())} FROM r"""))
def z9_shuffled_orders(spark, sf_dir):
    return curves.serialize(_cells(spark, sf_dir), 8, ("z", "z-trans"), shuffle=42).select("scene_id", "pid", *_DRAWN)


_PLACES = f"""{_FINE}, c AS (SELECT scene_id, pid, gx, gy, gz, row_number() OVER (PARTITION BY scene_id ORDER BY {_MORTON_SQL('gx', 'gy', 'gz')}, pid) - 1 AS place, count(*) OVER (PARTITION BY scene_id) AS n FROM g),
s AS (SELECT scene_id, pid, gx, gy, gz, place AS slot, false AS padded FROM c UNION ALL SELECT scene_id, pid, gx, gy, gz, place + 64, true FROM c WHERE n > 64 AND n % 64 <> 0 AND place >= n - 64 AND place < n - n % 64),
p AS (SELECT *, slot // 64 AS patch FROM s)"""


def _patches(spark, sf_dir):
    df = curves.serialize(_cells(spark, sf_dir), 8, ("z",)).withColumnRenamed("place_z", "place")
    return curves.patches(df, 64)


@query(over(f"-- {_PLACES} SELECT {ID}, patch, slot, padded FROM p"))
def z10_patch_padding(spark, sf_dir):
    return _patches(spark, sf_dir).select("scene_id", "pid", "patch", "slot", "padded")


@query(over(f"""-- {_PLACES}, b AS (SELECT a.scene_id, a.patch, greatest(-12, least(a.gx - b.gx, 12)) + 12 AS dx FROM p AS a JOIN p AS b ON a.scene_id = b.scene_id AND a.patch = b.patch)
SELECT scene_id, patch, count(*) AS n, sum(dx)::BIGINT AS dx FROM b GROUP BY ALL"""))
def z11_relative_bins(spark, sf_dir):
    bins = curves.relative_bins(_patches(spark, sf_dir), 64)
    return bins.groupBy("scene_id", "patch").agg(F.count("*").alias("n"), F.sum("dx").alias("dx"))
