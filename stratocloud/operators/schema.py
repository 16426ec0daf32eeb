"""Projections: which columns there are, of what type, and how scenes are numbered and put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, DoubleType, FloatType, IntegerType, ShortType

from stratocloud.operators.scenes import SCENE, beside


def collect(points: DataFrame, keys: Sequence[str], offset: str | None = "offset", **groups: Sequence[str]) -> DataFrame:
    """Only ``keys``; the scene's number of points as ``offset``; ``feat=[...]`` joins columns to one float array ``feat``."""
    df = beside(points, F.count("*").alias(offset)) if offset else points
    arrays = [F.array(*(F.col(c).cast("float") for c in cs)).alias(n) for n, cs in groups.items()]
    return df.select(*keys, *([offset] if offset else []), *arrays)


def copy(points: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    names = names if names is not None else {c: f"origin_{c}" for c in ("x", "y", "z", "segment") if c in points.columns}
    return points.withColumns({new: F.col(old) for old, new in names.items()})


def update(points: DataFrame, values: dict) -> DataFrame:
    return points.withColumns({c: F.lit(v) for c, v in values.items()})


def to_tensor_types(points: DataFrame) -> DataFrame:
    """Integers become long, floating numbers float; booleans and strings stay; others are an error."""
    out = []
    for f in points.schema:
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            out.append(F.col(f.name).cast("float").alias(f.name))
        elif f.dataType.typeName() in ("long", "boolean", "string"):
            out.append(F.col(f.name))
        elif f.dataType.typeName() == "array":
            kind = "bigint" if f.dataType.elementType.typeName() in ("integer", "long", "short", "byte") else "float"
            out.append(F.col(f.name).cast(f"array<{kind}>").alias(f.name))
        else:
            raise TypeError(f"column {f.name} of type {f.dataType.simpleString()} can't be converted")
    return points.select(*out)


def take(points: DataFrame, index: DataFrame, key: str = "pid") -> DataFrame:
    """The rows whose key is in ``index``; as often as it is there."""
    return points.join(index.select(SCENE, key), [SCENE, key])


def contrastive_views(points: DataFrame, augment, names: Sequence[str] = ("view1", "view2")) -> DataFrame:
    """Independently changed copies, one below the other, told apart by ``view``; ``augment(df, view)`` changes one."""
    out = None
    for name in names:
        df = augment(points, name).withColumn("view", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def batch_index(points: DataFrame) -> DataFrame:
    """scene_id, batch (from 0), n, offset (end of the scene in the batch). One row a scene is ordered, never the points."""
    per = points.groupBy(SCENE).agg(F.count("*").alias("n"))
    order = W.orderBy(SCENE)
    return per.select(SCENE, (F.row_number().over(order) - 1).cast("long").alias("batch"), "n", F.sum("n").over(order).alias("offset"))


def collate(clouds: Sequence[DataFrame]) -> DataFrame:
    """All scenes of all inputs, with their batch number and offset."""
    df = clouds[0]
    for other in clouds[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df.join(batch_index(df).select(SCENE, "batch", "offset"), SCENE)


def offset_to_bincount(offsets: DataFrame) -> DataFrame:
    """From (batch, offset) to (batch, n)."""
    before = F.lag("offset", 1, 0).over(W.orderBy("batch"))
    return offsets.select("batch", (F.col("offset") - before).alias("n"))


def bincount_to_offset(counts: DataFrame) -> DataFrame:
    return counts.select("batch", F.sum("n").over(W.orderBy("batch")).alias("offset"))


def offset_to_batch(offsets: DataFrame) -> DataFrame:
    """(row, batch) for each row of the batch, in order."""
    df = offsets.withColumn("start", F.lag("offset", 1, 0).over(W.orderBy("batch")))
    return df.filter("offset > start").select(F.explode(F.sequence("start", F.col("offset") - 1)).alias("row"), "batch")


def batch_to_offset(rows: DataFrame) -> DataFrame:
    return bincount_to_offset(rows.groupBy("batch").agg(F.count("*").alias("n")))
