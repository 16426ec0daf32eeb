"""Statistics of scenes beside their points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

SCENE = "scene_id"
TASK_ROWS = 500_000
_own_folder: dict[str, str] = {}


def beside(points: DataFrame, *aggregates: Column, by: str | list[str] = SCENE) -> DataFrame:
    """``points`` with aggregates of their scene as further columns.

    The aggregates have a row a scene and are joined back, which needs no sort of the points; adaptive
    execution broadcasts them only if they turn out small.
    """
    by = [by] if isinstance(by, str) else by
    return points.join(points.groupBy(*by).agg(*aggregates), by)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local session (tests); a cluster's
    executors would write to their own disks, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="stratocloud-")
    return _own_folder[app]


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, or to a folder of its own, and read back.

    Loops and searches in passes would otherwise nest every pass in the plan of the next, and what a lost executor held
    would be computed again from the start. The tables stay in the shared folder until whoever runs the cluster clears it.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *by: str | Column, n: int | None = None) -> DataFrame:
    """``rows`` dealt by columns into as many partitions as hold about ``TASK_ROWS`` rows each, so that what a task sorts or aggregates does not grow with
    the table; aggregates by these columns and more follow without another shuffle. ``n``, the number of rows, is counted if not given."""
    parts = -(-(rows.count() if n is None else n) // TASK_ROWS)
    if parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(*by)
    return rows.repartition(parts, *by)


def has(points: DataFrame, *names: str) -> bool:
    return set(names) <= set(points.columns)
