"""Connected components of a graph given by its edges, by alternating large and small stars.

Each round joins the edges with the least neighbour of each node; no node's neighbours are ever
gathered, so one node or component with a third of all edges only makes a skewed join, which
adaptive execution splits. Rounds grow with the logarithm of the graph's diameter, and each is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocloud.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that is not the least of its component; ``edges`` has u and v.

    Loops and repeated edges do no harm. Nodes that are their component's least do not appear.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = kept(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, seen = None, mark(now)
    while seen[0] and seen != before:
        now = kept(_small_star(_large_star(now)))
        before, seen = seen, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
