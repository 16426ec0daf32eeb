"""Manifests, work lists and the discovery of files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO_SUFFIXES = ("mp4", "mkv", "webm", "mov", "avi", "m4v")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header must hold video_id and url."""
    rows = spark.read.csv(path, header=True)
    missing = {"video_id", "url"} - set(rows.columns)
    if missing:
        raise ValueError(f"manifest lacks {', '.join(sorted(missing))}")
    return clean_manifest(rows)


def clean_manifest(rows: DataFrame) -> DataFrame:
    """Trimmed; rows without id or URL go."""
    df = rows.select(F.trim("video_id").alias("video_id"), F.trim("url").alias("url"))
    return df.filter((F.length("video_id") > 0) & (F.length("url") > 0))


def first_ids(rows: DataFrame, n: int, order: str = "video_id") -> DataFrame:
    """The first ``n`` ids that are neither blank nor the header's word; repeated ids count each."""
    ids = rows.select(F.trim("video_id").alias("video_id")).filter("video_id <> '' AND video_id <> 'video_id'")
    return ids.orderBy(order).limit(n)


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects (or a single one); elements that are no objects go."""
    lists = spark.read.text(path, wholetext=True)
    kind = "array<string>"
    text = F.trim("value")
    each = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), kind)
    keys = ("input_path", "scene_mp4", "output_path", "source_ply", "video_id", "scene_dir", "scene_name")
    rows = lists.select(F.explode(each).alias("row")).filter(F.col("row").startswith("{"))
    return work_list(rows.select(F.from_json("row", ", ".join(f"{k} string" for k in keys)).alias("row")).select("row.*"))


def work_list(rows: DataFrame) -> DataFrame:
    """(input, output, video_id, scene); older and newer names of the keys serve alike; rows without input or output go."""
    at = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    df = rows.select(
        at("input_path", "scene_mp4").alias("input"), at("output_path", "source_ply").alias("output"),
        at("video_id").alias("video_id"), at("scene_dir", "scene_name").alias("scene"),
    )
    return df.filter("input IS NOT NULL AND output IS NOT NULL")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modificationTime and length of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "modificationTime", "length")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def relative_name(path: Column, root: str = "") -> Column:
    """The path below ``root``, without the file's suffix; the whole path where it is not below it."""
    root = root.rstrip("/") + "/" if root else ""
    inside = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    return F.regexp_replace(inside, r"(?<=[^/])\.[^./]*$", "")


def discover_videos(files: DataFrame, done: DataFrame | None = None, root: str = "") -> DataFrame:
    """Video files with ``name`` (path below ``root`` without suffix) and ``video_id`` (the file's stem), without partial transfers
    (a folder or file called .rsync-partial) and without those whose name is among ``done`` (name). Files of one stem in different folders are different videos."""
    partial = F.array_contains(F.split("path", "/"), ".rsync-partial")
    df = files.filter(suffix_of(F.col("path")).isin(*VIDEO_SUFFIXES) & ~partial)
    df = df.withColumns({"name": relative_name(F.col("path"), root), "video_id": stem_of(F.col("path"))})
    return df.join(done.select("name").distinct(), "name", "left_anti") if done is not None else df


def discover_image_folders(files: DataFrame) -> DataFrame:
    """Folders with images, their number, and a name: a folder called ``images`` has its parent's."""
    df = files.filter(suffix_of(F.col("path")).isin(*IMAGE_SUFFIXES)).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    parts = F.split("folder", "/")
    name = F.when(F.element_at(parts, -1) == "images", F.try_element_at(parts, F.lit(-2))).otherwise(F.element_at(parts, -1))
    return df.groupBy("folder").agg(F.count("*").alias("n")).withColumn("name", name)


def discover_scenes(files: DataFrame) -> DataFrame:
    """channel/scenes/x.mp4, channel/video/scenes/x.mp4 or loose x.mp4: path, video (null if loose) and scene."""
    df = files.filter(suffix_of(F.col("path")) == "mp4")
    return df.withColumn("video", F.nullif(F.regexp_extract("path", r"([^/]+)/scenes/[^/]+$", 1), F.lit(""))).withColumn("scene", stem_of(F.col("path")))


def discover(layout: str, files: DataFrame, **options) -> DataFrame:
    """What the named layout finds among the files."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; known are {', '.join(LAYOUTS)}")
    return LAYOUTS[layout](files, **options)


def discover_clouds(paths: DataFrame, finished: DataFrame, n: int | None = None) -> DataFrame:
    """``.ply`` paths in order of ``pos``, each once, without those whose output folder has its coordinates, at most ``n``."""
    df = paths.filter(suffix_of(F.col("path")) == "ply").groupBy("path").agg(F.min("pos").alias("pos"))
    df = df.withColumn("output", output_name(F.col("path"))).join(finished.select("output"), "output", "left_anti")
    return df.orderBy("pos").limit(n) if n else df


#: How files lie in their folders.
LAYOUTS = {"videos": discover_videos, "image folders": discover_image_folders, "scenes": discover_scenes, "clouds": discover_clouds}


def output_name(path: Column, root: str | None = None) -> Column:
    """video_scene from the last two folders, one folder's name alone, or the file's stem; outside ``root`` the parent's name."""
    inside = path if root is None else F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")
    folders = F.filter(F.split(F.regexp_extract(inside, r"^(.*?)[^/]*$", 1), "/"), lambda x: x != "")
    n = F.size(folders)
    last = lambda k: F.try_element_at(folders, F.lit(-k))
    name = F.when(n >= 2, F.concat_ws("_", last(2), last(1))).when(n == 1, last(1)).otherwise(stem_of(path))
    if root is None:
        return name
    return F.when(path.startswith(root.rstrip("/") + "/"), name).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))


def scene_output(path: Column) -> Column:
    """The folder of a clip's results: its own without a trailing ``scenes``, and the clip's name."""
    return F.concat_ws("/", F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/scenes$", ""), stem_of(path))
