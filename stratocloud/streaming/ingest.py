"""New files of a folder, once each, through a step and into a table, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Rows of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest(rows: DataFrame, output: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None):
    """Starts a query that works off what is there. A batch that is run again replaces its own part of the output, so that no row doubles.

    With ``key``, of the rows of a batch that share it one stays, an arbitrary one; rows of different batches are not compared.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = step(batch) if step else batch
        done = done.dropDuplicates([key]) if key else done
        done.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_rates(frames: DataFrame, late: str = "10 minutes", width: str = "5 minutes", at: str = "ts") -> DataFrame:
    """Frames and mean probability of each video in windows of event time; rows later than ``late`` are dropped."""
    return frames.withWatermark(at, late).groupBy("video_id", F.window(at, width)).agg(F.count("*").alias("n"), F.avg("prob_inside").alias("prob"))
