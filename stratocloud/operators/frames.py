"""Frame sequences: filling, smoothing, runs, margins and segments of each video.

Rows have video_id, frame_index and fps. A video's frames are one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.operators.ranges import interval_join

VIDEO, AT = "video_id", "frame_index"


def _video():
    return W.partitionBy(VIDEO).orderBy(AT)


def frame_rate(fps: Column, fallback: float = 30.0) -> Column:
    """A rate that is missing, not a number or not positive counts as the fallback."""
    return F.when(fps.isNull() | F.isnan(fps) | (fps <= 0), F.lit(fallback)).otherwise(fps)


def duration(frames: Column, fps: Column) -> Column:
    """Seconds; without a rate, the number of frames."""
    return F.when(fps > 0, F.try_divide(frames, fps)).otherwise(frames.cast("double"))


def inside_probability(inside: Column, outside: Column, temperature: float = 100.0) -> Column:
    """Softmax of the best similarity to each of two sets of prompts."""
    best = lambda x: F.array_max(x) * F.lit(temperature)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(best(outside) - best(inside)))


def sampling_interval(available: Column, target: int) -> Column:
    """Every how many frames are taken so that about ``target`` remain; 1 if there are no more."""
    return F.when(available > target, F.greatest(F.lit(1), F.bround(available / F.lit(float(target))).cast("int"))).otherwise(1)


def decimate(frames: DataFrame, skip: Column | int = 0, interval: Column | int = 1) -> DataFrame:
    """Frames from ``skip`` on, each ``interval``-th."""
    skip, interval = (F.lit(v) if isinstance(v, int) else v for v in (skip, interval))
    return frames.filter((F.col(AT) >= skip) & (F.pmod(F.col(AT) - skip, interval) == 0))


def decimate_to(frames: DataFrame, target: int, skip: int = 0) -> DataFrame:
    """Each video thinned to about ``target`` frames."""
    per = frames.groupBy(VIDEO).agg((F.count("*") - skip).alias("_n")).select(VIDEO, sampling_interval(F.col("_n"), target).alias("interval"))
    return decimate(frames.join(per, VIDEO), skip, F.col("interval"))


def slice_range(rows: DataFrame, start: int, end: int, interval: int, by: str, order: str) -> DataFrame:
    """Of each group in order, positions start to before end, each ``interval``-th."""
    df = rows.withColumn("_p", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1)
    return df.filter((F.col("_p") >= start) & (F.col("_p") < end) & (F.pmod(F.col("_p") - start, F.lit(interval)) == 0)).drop("_p")


def fill_stride(frames: DataFrame, stride: int, value: str) -> DataFrame:
    """Only each ``stride``-th frame has a value; the frames behind it take it over."""
    sampled = F.when(F.pmod(F.col(AT), F.lit(stride)) == 0, F.col(value))
    return frames.withColumn(value, F.last(sampled, ignorenulls=True).over(_video().rowsBetween(W.unboundedPreceding, 0)))


def smooth_mask(frames: DataFrame, width: int, probability: str = "prob_inside", least: float = 0.5) -> DataFrame:
    """``keep``: at least half of a centred window of ``width`` places is over the threshold; places beyond the ends are not."""
    on = (F.col(probability) >= least).cast("int")
    around = _video().rowsBetween(-(width // 2), (width - 1) // 2)
    return frames.withColumn("keep", F.lit(2) * F.sum(on).over(around) >= width)


def smoothing_width(seconds: float, fps: float) -> int:
    return max(1, round(seconds * fps))


def islands(frames: DataFrame, value: str, name: str = "island") -> DataFrame:
    """Numbers the runs of equal neighbouring values of each video, from 0."""
    new = ~F.col(value).eqNullSafe(F.lag(value).over(_video()))
    return frames.withColumn(
        name,
        F.sum(F.when(F.row_number().over(_video()) == 1, 0).otherwise(new.cast("int"))).over(_video().rowsBetween(W.unboundedPreceding, 0)),
    )


def suppress_short_runs(frames: DataFrame, least: int, value: str = "keep") -> DataFrame:
    """Runs of true that are shorter than ``least`` become false."""
    df = islands(frames, value, "_i")
    n = F.count("*").over(W.partitionBy(VIDEO, "_i"))
    return df.withColumn(value, F.col(value) & (n >= least)).drop("_i")


def outside_margin(frames: DataFrame, margin: int, value: str = "keep") -> DataFrame:
    """False where any frame within ``margin`` is."""
    return frames.withColumn(value, F.min(value).over(_video().rowsBetween(-margin, margin)))


def kept_ratio(frames: DataFrame, value: str = "keep") -> DataFrame:
    df = frames.groupBy(VIDEO).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("long")).alias("kept"))
    return df.withColumn("ratio", F.col("kept") / F.col("n")).withColumn("status", F.when(F.col("kept") == 0, "SKIP").otherwise("OK"))


def best_label(scores: DataFrame, by: list[str], label: str = "label", order: str = "label_index", score: str = "score") -> DataFrame:
    """A label's score is its best prompt's; the best label wins, of equals the first."""
    per = scores.groupBy(*by, label, order).agg(F.max(score).alias(score))
    return per.groupBy(*by).agg(F.min_by(label, F.struct(-F.col(score), F.col(order))).alias(label), F.max(score).alias(score))


def runs(frames: DataFrame, value: str = "label") -> DataFrame:
    """(video_id, run, value, first, last, n) of each run."""
    return islands(frames, value, "run").groupBy(VIDEO, "run").agg(
        F.first(value).alias(value), F.min(AT).alias("first"), F.max(AT).alias("last"), F.count("*").alias("n"),
    )


def shortest_run(room_seconds: float, fps: float, stride: int) -> int:
    """Samples that a label must last: a fifth of the shortest room, between half a second and two."""
    return max(1, round(min(2.0, max(0.5, room_seconds / 5)) * fps / stride))


def absorb_short_runs(frames: DataFrame, least: int, value: str = "label") -> DataFrame:
    """Runs shorter than ``least`` take the label of the run before; the first run of a video stays. Neighbours that are alike then join."""
    per = runs(frames, value)
    order = W.partitionBy(VIDEO).orderBy("run")
    solid = F.when((F.col("n") >= least) | (F.col("run") == 0), F.col(value))
    per = per.withColumn(value, F.last(solid, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = islands(per.withColumnRenamed("run", AT), value, "run")
    return joined.groupBy(VIDEO, "run").agg(F.first(value).alias(value), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def boundaries(segments: DataFrame, totals: DataFrame, stride: int) -> DataFrame:
    """Half-open frame ranges: a segment ends ``stride`` behind its last sample; the first starts at 0, the last ends at the video's end."""
    order = W.partitionBy(VIDEO).orderBy("run")
    df = segments.join(totals, VIDEO).withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(W.partitionBy(VIDEO))})
    start = F.when(F.col("_k") == 1, 0).otherwise(F.col("first"))
    end = F.when(F.col("_k") == F.col("_n"), F.col("total")).otherwise(F.least(F.col("last") + stride, F.col("total")))
    return df.withColumns({"start": start.cast("long"), "end": end.cast("long")}).drop("_k", "_n", "first", "last", "n")


def merge_short_segments(segments: DataFrame, least: int) -> DataFrame:
    """Merges segments shorter than ``least`` until there are none: the first such with a like-named left neighbour, else such a right one, else the longer (left if equal).

    Each step depends on the one before, so a video's few segments are merged in one group.
    """
    import pandas as pd

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        rows = df.sort_values("start")[["start", "end", "label"]].values.tolist()
        while len(rows) > 1:
            k = next((i for i, (a, b, _) in enumerate(rows) if b - a < least), None)
            if k is None:
                break
            left, right = rows[k - 1] if k else None, rows[k + 1] if k + 1 < len(rows) else None
            if left and left[2] == rows[k][2] or not right:
                to_left = True
            elif right[2] == rows[k][2] or not left:
                to_left = False
            else:
                to_left = left[1] - left[0] >= right[1] - right[0]
            other = left if to_left else right
            rows[k - 1 if to_left else k : k + 1 if to_left else k + 2] = [[min(other[0], rows[k][0]), max(other[1], rows[k][1]), other[2]]]
        return pd.DataFrame(rows, columns=["start", "end", "label"]).assign(video_id=df[VIDEO].iloc[0])[[VIDEO, "start", "end", "label"]]

    kind = segments.schema[VIDEO].dataType.simpleString()
    return segments.select(VIDEO, "start", "end", "label").groupBy(VIDEO).applyInPandas(merge, f"{VIDEO} {kind}, start bigint, end bigint, label string")


def split_at_cuts(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """Frames with the intervals of ``cuts`` (video_id, start, end; empty ones dropped) that hold them."""
    return interval_join(frames, cuts.select(VIDEO, "start", "end"), VIDEO, AT)


def fit_size(width: Column, height: Column, limit: int, step: int = 14) -> tuple[Column, Column]:
    """The width and height, in multiples of ``step``, of about the same shape and at most ``limit`` pixels.

    Both numbers of steps are rounded; while their area is over the limit, the one that is too large for the shape gives way by one.
    At least one step is left of each, so a very long and thin frame stays over the limit. Rounding adds half a step at most,
    so each number gives way at most once, and two turns are all there can be.
    """
    scale = F.when(width * height > 0, F.sqrt(F.try_divide(F.lit(float(limit)), width * height))).otherwise(1.0)
    wide, high = width * scale, height * scale
    k, m = (F.bround(x / step).cast("long") for x in (wide, high))
    for _ in range(2):
        over = k * m * F.lit(step * step) > limit
        by_width = F.try_divide(k, m) > F.try_divide(wide, high)
        k, m = F.when(over & by_width, k - 1).otherwise(k), F.when(over & ~by_width, m - 1).otherwise(m)
    return F.greatest(k, F.lit(1)) * step, F.greatest(m, F.lit(1)) * step


def clip_name(number: Column, label: Column) -> Column:
    """scene-001_label; characters that a file name shouldn't have become underscores."""
    return F.format_string("scene-%03d_%s", number.cast("int"), F.regexp_replace(label, r"[^0-9A-Za-z_-]", "_"))


def _printed(value: Column, digits: int) -> Column:
    """As C's printf writes it: the number's exact binary value is rounded. ``format_string`` rounds its shortest decimal form instead, so 0.0000005, which is a
    little less as a binary number, would become 0.000001."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def probability_rows(frames: DataFrame, stride: int = 1) -> DataFrame:
    """The debugging table of probabilities: sample, frame, time and probability as text."""
    df = decimate(frames, 0, stride)
    return df.select(
        VIDEO, F.floor(F.col(AT) / F.lit(stride)).alias("sample_index"), AT,
        _printed(F.col(AT) / frame_rate(F.col("fps")), 3).alias("time_sec"), _printed(F.col("prob_inside"), 6).alias("prob_inside"),
    )
