"""Reports and failure logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON object a row."""
    reports.write.mode("overwrite").json(path)


def write_failures(failures: DataFrame, path: str) -> bool:
    """Tab-separated video_id, url and error with a header; nothing is left at the path if there are none."""
    spark = failures.sparkSession
    rows = failures.select("video_id", "url", "error")
    if rows.isEmpty():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return False
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)
    return True
