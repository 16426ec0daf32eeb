"""A pyramid of ever coarser cells of each scene, made by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.operators.curves import morton_code
from stratocloud.operators.scenes import SCENE, spread
from stratocloud.operators.voxel import XYZ

REDUCERS = {"max": F.max, "min": F.min, "sum": F.sum}


def pyramid(cells: DataFrame, levels: int, features: Sequence[str], reduce: str = "max", means: Sequence[str] = XYZ) -> DataFrame:
    """(scene_id, level, code, parent, gx, gy, gz, features, means, n): the cells of levels 0 (one stride of 1) to ``levels`` (a stride of 2^levels).

    ``cells`` has gx, gy and gz. A cell's ``code`` is its Morton code at its level, ``parent`` that of the cell above, the code without its last three bits.
    Rows are first reduced to the finest cells; from these all levels come in one pass. Rows are shuffled once, by the cell of the coarsest level that they are in,
    and no level is read back. Reducers must be sums, least or greatest values; means are kept as sums and counts till the end.
    """
    code = morton_code(*map(F.col, ("gx", "gy", "gz")))
    kept = [REDUCERS[reduce](f).alias(f) for f in features]
    kinds = {c: REDUCERS[reduce] for c in features} | {f"_s{m}": F.sum for m in means} | {"n": F.sum}
    rows = cells.select(SCENE, code.alias("_0"), F.shiftright(code, 3 * levels).alias("_top"), *(F.col(f) for f in features), *(F.col(m).alias(f"_s{m}") for m in means), F.lit(1).cast("long").alias("n"))
    fine = spread(rows, SCENE, "_top").groupBy(SCENE, "_top", "_0").agg(*(f(c).alias(c) for c, f in kinds.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("_0", 3 * k).alias("code")) for k in range(levels + 1)))).alias("_l")
    out = fine.select("*", each).select(SCENE, "_top", "_l.*", *kinds).groupBy(SCENE, "_top", "level", "code").agg(*(f(c).alias(c) for c, f in kinds.items()))
    out = out.withColumn("parent", F.shiftright("code", 3))
    axis = lambda k: sum((F.shiftleft(F.shiftright("code", 3 * b + k).bitwiseAND(F.lit(1)), b) for b in range(1, 21)), F.shiftright("code", k).bitwiseAND(F.lit(1)))
    out = out.withColumns({"gx": axis(2), "gy": axis(1), "gz": axis(0)}).withColumns({m: F.col(f"_s{m}") / F.col("n") for m in means})
    return out.select(SCENE, "level", "code", "parent", "gx", "gy", "gz", *features, *means, "n")
