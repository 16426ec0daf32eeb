"""The seven steps that make raw reconstructions into training scenes, over all scenes at once, with a report of each."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.operators import affine, neighbors, normalize, planes, select
from stratocloud.operators.scenes import SCENE, settled


@dataclass
class Config:
    """What each step does; ``steps`` are those that run."""

    steps: tuple[str, ...] = ("downsample", "outliers", "align", "scale", "spacing", "density", "normals")
    threshold: int = 2_000_000
    radius_factor: float = 10.0
    least_neighbours: int = 1
    neighbours: int = 50
    deviations: float = 4.0
    cell: float | None = None  # of the means that the floor is sought among; None: from each scene's spacing
    plane_threshold: float | None = None
    scale: float | None = affine.FORCED_FACTOR
    spacing: float = 0.01333
    spacing_threshold: float = 0.03
    spacing_rounds: int = 10
    spacing_reruns: int = 5
    density: float = 1734.4
    least_points: int = 40_000
    normals_k: int = 32
    seed: int = 42
    intermediates: str | None = None  # folder for each step's result, as step1_downsample and so on
    go_on: bool = True  # after a step that fails, with a warning and the points as they were


def preprocess(points: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, reports). A report has scene_id, step, the scene's number of points after it and, where the step failed, its error; a scene
    that a step empties has no later rows."""
    c = config or Config()
    steps = {
        "downsample": lambda df: select.pre_downsample(df, c.threshold, c.seed),
        "outliers": lambda df: neighbors.remove_outliers(df, c.radius_factor, c.least_neighbours, c.neighbours, c.deviations)[0],
        "align": lambda df: planes.align_z_up(df, c.cell, c.plane_threshold, c.seed),
        "scale": lambda df: affine.adjust_scale(df, c.scale, c.seed)[0],
        "spacing": lambda df: normalize.refine_spacing(df, c.spacing, c.spacing_threshold, c.spacing_rounds, c.seed, c.spacing_reruns)[0],
        "density": lambda df: select.adjust_density(df, c.density, least=c.least_points, seed=c.seed).withColumn(
            "pid", F.when(F.col("copy") > 0, F.concat_ws("#", "pid", "copy")).otherwise(F.col("pid")),
        ).drop("copy"),
        "normals": lambda df: neighbors.normals_by_neighbours(df, c.normals_k),
    }
    unknown = set(c.steps) - set(steps)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")

    def count(df: DataFrame, k: int, step: str, error: str | None = None) -> DataFrame:
        sizes = df.groupBy(SCENE).agg(F.count("*").alias("n"))
        return sizes.select(SCENE, F.lit(k).alias("place"), F.lit(step).alias("step"), "n", F.lit(error).cast("string").alias("error"))

    reports = count(points, 0, "input")
    df = points
    for k, step in enumerate((s for s in steps if s in c.steps), 1):
        error = None
        try:
            df = settled(steps[step](df), f"{c.intermediates}/step{k}_{step}" if c.intermediates else None)
        except Exception as e:  # whatever a step's data may do; the next steps work on what it was given
            if not c.go_on:
                raise
            error = f"{type(e).__name__}: {e}".splitlines()[0]
            warnings.warn(f"step {step} failed and is left out: {error}", stacklevel=2)
        reports = reports.unionByName(count(df, k, step, error))
    return df, reports
