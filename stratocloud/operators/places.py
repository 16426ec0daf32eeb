"""Places of rows in an order, without sorting a whole scene or a whole table in one task.

Rows are dealt into ranges of the order; the sizes of the ranges are added up over the (short) table of ranges, and each
range numbers only its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.functions.keyed import key_hash
from stratocloud.operators.scenes import SCENE, settled

HASH_DIGITS = 2  # 256 ranges of each scene's random order
CROWD = 50_000  # rows of a group that are sorted as one range
RANGES = 64  # of each scene's order by a number
TINY = 1e-300


def ranked(
    rows: DataFrame, order: Sequence[str | Column], place: Column, by: Sequence[str] = (SCENE,), name: str = "_r",
    most: Column | None = None, crowd: int = CROWD, among: DataFrame | None = None,
) -> DataFrame:
    """``name``: each row's place (from 1) in the order within its group. If no group has over ``crowd`` rows, each is one range, and rows are shuffled once;
    ``among``, a table that holds as many rows of each group or more, serves to tell it cheaply.

    ``place`` must never fall as the order rises; rows that share it are a range. With ``most`` only the rows up to that place
    are wanted; ranges behind it are left out before anything is sorted.
    """
    if (rows if among is None else among).groupBy(*by).agg(F.count("*").alias("_size")).filter(F.col("_size") > crowd).isEmpty():
        df = rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        df = df if most is None else df.filter(F.col(name) <= most)
        return df.withColumn(name, F.col(name).cast("long"))
    df = rows.withColumn("_range", place)
    sizes = df.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    up_to = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_before"))
    df = df.join(sizes, [*by, "_range"])
    if most is not None:
        df = df.filter(F.col("_before") < most)
    own = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    df = df.withColumn(name, (F.col("_before") + own).cast("long")).select(*rows.columns, name)
    return df if most is None else df.filter(F.col(name) <= most)


def ranked_at_random(points: DataFrame, seed: int, name: str, key: str = "pid", late: str | None = None, most: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """``_r``: places in the random order of each scene's points that the keyed hash gives; rows with ``late`` (0 or 1) 1 come behind the others."""
    df = points.withColumn("_h", key_hash(seed, name, F.col(SCENE), F.col(key)))
    start = F.substring("_h", 1, HASH_DIGITS)
    first = [late] if late else []
    found = ranked(df, [*first, "_h", key], F.concat(F.col(late), start) if late else start, most=most, among=among)
    return found.drop("_h")


def ranked_by_distance(points: DataFrame, squared: Column, key: str = "pid", most: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """``_r``: places in order of a squared distance; each range is as wide as a 64th of a doubling of it."""
    df = points.withColumn("_d", squared)
    place = F.floor(F.log2(F.greatest(F.col("_d"), F.lit(TINY))) * 64)
    return ranked(df, ["_d", key], place, most=most, among=among).drop("_d")


def ranked_by_number(points: DataFrame, number: str, key: str = "pid", name: str = "_r", ranges: int = RANGES) -> DataFrame:
    """``name``: places in order of a number, in ranges of about equal size (from approximate percentiles of each scene)."""
    cuts = points.groupBy(SCENE).agg(F.percentile_approx(number, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(1000)).alias("_cuts"))
    df = points.join(cuts, SCENE)
    place = F.size(F.filter("_cuts", lambda c: c < F.col(number)))
    return ranked(df, [number, key], place, name=name).drop("_cuts")


def numbered(rows: DataFrame, *order: str | Column, name: str = "_place", ranges: int | None = None) -> DataFrame:
    """``name``: the place (from 0) of each row among all rows in the order. The ranges are Spark's own range partitions, written down
    because the numbers refer to them."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = settled(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = df.groupBy("_part").agg(F.count("*").alias("_size"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return df.join(sizes, "_part").withColumn(name, (F.col("_before") + own).cast("long")).select(*rows.columns, name)
