"""Exact quantiles of groups of any size.

No group is sorted in one task or held in one buffer, unless it is small. For each quantile of a large group a mergeable sketch
brackets the value; rows below and inside the bracket are counted, and the bracket is drawn again from the rows inside, until few are left (or all of them are equal). Only these
are sorted. All groups and quantiles are treated at once, and a sketch leaves about a hundredth, so even huge groups need few rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocloud.operators.scenes import settled

FEW = 10_000
ACCURACY = 1_000  # of the sketch: ranks are known to a thousandth of the rows


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """``by`` and a column for each name of ``shares`` with that quantile of ``value``, interpolated between neighbours. Nulls and NaN do not count;
    a group without values is left out."""
    by = list(by)
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    sizes = settled(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    small = rows.join(sizes.filter(F.col("_n") <= few), by)
    places = [F.lit(s) * (F.col("_n") - 1) for s in shares.values()]
    numbered = small.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_v")) - 1)  # groups of at most ``few`` rows
    value_at = lambda place: F.max(F.when(F.col("_r") == place, F.col("_v")))
    columns = []
    for name, place in zip(shares, places):
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        share = F.max(place) - F.floor(F.max(place))
        columns.append(_between(low, high, share).alias(name))
    found = numbered.groupBy(*by).agg(*columns)
    large = sizes.filter(F.col("_n") > few)
    if large.isEmpty():
        return found
    return found.unionByName(_of_large(rows, large, by, shares, few, accuracy))


def _between(low, high, share):
    return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)


def _of_large(rows: DataFrame, large: DataFrame, by: list[str], shares: dict[str, float], few: int, accuracy: int) -> DataFrame:
    rows = rows.join(large.select(*by), by, "left_semi")
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.lit(float(s)).alias("_share")) for n, s in shares.items()))).alias("_q")
    state = large.select(*by, "_n", asked).select(*by, "_q._name", (F.col("_q._share") * (F.col("_n") - 1)).alias("_place"), "_n")
    endless = F.lit(float("inf"))
    state = state.withColumns({"_low": -endless, "_high": endless, "_below": F.lit(0).cast("long"), "_inside": F.col("_n"), "_wide": F.lit(3.0)})
    keys, ready = [*by, "_name"], None
    while True:
        state = settled(state)
        open_ = (F.col("_inside") > few) & (F.col("_low") < F.col("_high"))
        done = state.filter(~open_)
        ready = done if ready is None else ready.unionByName(done)
        state = state.filter(open_)
        if state.isEmpty():
            break
        inside = _inside(rows, state, by)
        rank = (F.col("_place") - F.col("_below")) / F.col("_inside")
        margin = F.col("_wide") / accuracy
        cuts = [F.lit(k / 256) for k in range(257)]
        sketch = inside.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*cuts), F.lit(accuracy)).alias("_cuts"))
        state = state.join(sketch, keys)
        at = lambda place: F.element_at("_cuts", (F.least(F.greatest(place, F.lit(0)), F.lit(256)) + 1).cast("int"))
        state = state.withColumns({"_from": at(F.floor((rank - margin) * 256)), "_to": at(F.ceil((rank + margin) * 256))}).drop("_cuts")
        counted = _inside(rows, state, by).groupBy(*keys).agg(
            F.count_if(F.col("_v") < F.col("_from")).alias("_less"), F.count_if((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))).alias("_now"),
        )
        state = state.join(counted, keys)
        below = F.col("_below") + F.col("_less")
        held = (below <= F.floor("_place")) & (F.ceil("_place") < below + F.col("_now")) & (F.col("_now") < F.col("_inside"))
        new = {"_low": "_from", "_high": "_to", "_inside": "_now"}
        narrowed = {c: F.when(held, F.col(n)).otherwise(F.col(c)) for c, n in new.items()} | {"_below": F.when(held, below).otherwise(F.col("_below"))}
        # a bracket that missed, or left all rows inside, is drawn wider; where values stand so thick that none can be left out, they are few or equal
        stuck = ~held & (F.col("_wide") * 4 > accuracy)
        state = state.withColumns(narrowed | {"_wide": F.when(held, F.lit(3.0)).otherwise(F.col("_wide") * 4)})
        state = state.withColumn("_inside", F.when(stuck, F.lit(0)).otherwise(F.col("_inside"))).select(*keys, "_place", "_n", "_low", "_high", "_below", "_inside", "_wide")
    ready = settled(ready)
    same = ready.filter(F.col("_low") == F.col("_high")).select(*keys, F.col("_low").alias("_value"))
    rest = _inside(rows, ready.filter(F.col("_low") < F.col("_high")), by)
    # rows that are equal are counted, not sorted
    rest = rest.groupBy(*keys, "_place", "_below", "_v").agg(F.count("*").alias("_c"))
    rest = rest.withColumn("_end", F.col("_below") + F.sum("_c").over(W.partitionBy(*keys).orderBy("_v")))
    at = lambda place: F.max(F.when((F.col("_end") - F.col("_c") <= place) & (place < F.col("_end")), F.col("_v")))
    share = F.max("_place") - F.floor(F.max("_place"))
    told = rest.groupBy(*keys).agg(_between(at(F.floor("_place")), at(F.ceil("_place")), share).alias("_value")).unionByName(same)
    return told.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in shares))


def _inside(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows within their group's brackets, once for each; brackets are a row for each group and quantile."""
    met = rows.join(state, by)
    return met.filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
