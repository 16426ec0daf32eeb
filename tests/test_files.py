"""Files for real: written to a temporary folder and read back through Spark."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocloud.sources import clouds, manifests, reports


def _points(spark):
    rng = np.random.default_rng(1)
    rows = [(s, f"p{k:03d}", *map(float, np.float32(rng.normal(size=3))), *map(int, rng.integers(0, 256, 3)), 0.0, 0.6, 0.8, k % 3) for s in (1, 2) for k in range(20)]
    return spark.createDataFrame(
        rows,
        "scene_id int, pid string, x double, y double, z double, r int, g int, b int, nx double, ny double, nz double, segment int",
    )


def _key(df, *columns):
    return sorted(tuple(np.round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("normals_first", [False, True])
def test_ply_files(spark, tmp_path, normals_first):
    df = _points(spark)
    files = clouds.encode_ply(df, normals_first).withColumn("path", F.concat(F.lit("s"), "scene_id", F.lit("/cloud.ply")))
    clouds.write_files(files, str(tmp_path))
    head = (tmp_path / "s1/cloud.ply").read_bytes().split(b"end_header")[0].decode()
    assert (head.index("nx") < head.index("red")) == normals_first
    back = clouds.decode_ply(clouds.load_files(spark, str(tmp_path)))
    cut = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz")
    assert _key(back, "scene_id", *cut) == _key(
        df.withColumn("scene_id", F.concat(F.lit("s"), "scene_id")).withColumns({c: F.col(c).cast("float").cast("double") for c in ("ny", "nz")}),
        "scene_id", *cut,
    )


def test_npz_and_npy_files(spark, tmp_path):
    df = _points(spark)
    clouds.write_files(clouds.encode_npz(df).withColumn("path", F.concat(F.lit("s"), "scene_id", F.lit("/a.npz"))), str(tmp_path))
    back = clouds.decode_npz(clouds.load_files(spark, str(tmp_path), "*.npz"))
    assert _key(back, "x", "y", "z", "r", "segment") == _key(df, "x", "y", "z", "r", "segment")
    clouds.write_files(clouds.encode_npy(df.drop("nx")).withColumn("path", F.concat(F.lit("n"), "scene_id", F.lit("/"), "name")), str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "n1").iterdir()) == ["color.npy", "coord.npy"]
    first = df.filter("scene_id = 1").orderBy("pid").collect()
    assert np.allclose(np.load(tmp_path / "n1/coord.npy"), [[r["x"], r["y"], r["z"]] for r in first])
    assert np.load(tmp_path / "n1/color.npy").tolist() == [[r["r"], r["g"], r["b"]] for r in first]


def test_scenes_as_parquet(spark, tmp_path):
    df, out = _points(spark), str(tmp_path / "scenes")
    clouds.write_scenes(df, out)
    assert sorted(p.name for p in Path(out).glob("scene_id=*")) == ["scene_id=1", "scene_id=2"]
    assert _key(spark.read.parquet(out), "scene_id", "pid", "x") == _key(df, "scene_id", "pid", "x")


def test_manifest_and_its_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video_id,url,more\n a ,http://x ,1\n,http://y,2\nb,,3\nc,http://z,4\n")
    assert sorted(map(tuple, manifests.read_manifest(spark, str(tmp_path / "m.csv")).collect())) == [("a", "http://x"), ("c", "http://z")]
    (tmp_path / "bad.csv").write_text("id,url\na,http://x\n")
    with pytest.raises(ValueError, match="video_id"):
        manifests.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_work_list_of_mixed_elements(spark, tmp_path):
    rows = [
        {"input_path": "a", "output_path": "b", "video_id": 7}, 3, "text", None, ["x"],
        {"scene_mp4": "c", "source_ply": "d", "scene_dir": "e"}, {"input_path": "only"},
    ]
    (tmp_path / "w.json").write_text(json.dumps(rows, indent=1))
    found = sorted(map(tuple, manifests.read_work_list(spark, str(tmp_path / "w.json")).collect()))
    assert found == [("a", "b", "7", None), ("c", "d", None, "e")]


def test_discovery_of_files(spark, tmp_path):
    for name in ("a/x.mp4", "b/x.MP4", "b/y.txt", ".rsync-partial/z.mp4", "c.rsync-partial.d/w.mkv", "room/images/1.jpg", "room/images/2.PNG", "other/3.jpeg"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x")
    files = manifests.list_files(spark, str(tmp_path))
    root = f"file:{tmp_path}"
    done = spark.createDataFrame([("a/x",)], "name string")
    found = manifests.discover("videos", files, done=done, root=root)
    assert sorted((r["name"], r["video_id"]) for r in found.collect()) == [("b/x", "x"), ("c.rsync-partial.d/w", "w")]
    folders = manifests.discover("image folders", files)
    assert sorted((r["name"], r["n"]) for r in folders.collect()) == [("other", 1), ("room", 2)]
    with pytest.raises(ValueError, match="no such"):
        manifests.discover("no such", files)


def test_reports_and_failures(spark, tmp_path):
    out = str(tmp_path / "reports")
    reports.write_reports(spark.createDataFrame([(1, "align")], "scene_id int, step string"), out)
    assert [r.asDict() for r in spark.read.json(out).collect()] == [{"scene_id": 1, "step": "align"}]
    log, none = str(tmp_path / "failures"), spark.createDataFrame([], "video_id string, url string, error string")
    assert reports.write_failures(spark.createDataFrame([("a", "http://x", "gone")], none.schema).coalesce(1), log)
    text = "".join(p.read_text() for p in Path(log).glob("part-*"))
    assert text == "video_id\turl\terror\na\thttp://x\tgone\n"
    assert not reports.write_failures(none, log) and not Path(log).exists()
