"""Views over relational tables that stand in for point clouds, frame sequences and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (table, SQL over it that Spark and DuckDB read alike). The plane (0, 0, 0.05) keeps normals off zero.
VIEWS = {
    "points": ("lineitem", """
SELECT l_suppkey AS scene_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100.0) AS BIGINT)) AS pid,
  l_quantity / 10.0 AS x, l_extendedprice / 20000.0 AS y, l_discount * 30.0 AS z,
  CAST(round(l_quantity * 5.0) AS INT) AS r, CAST(round(l_tax * 3000.0) AS INT) AS g, CAST(round(l_discount * 2500.0) AS INT) AS b,
  (l_tax - 0.04) / sqrt((l_tax - 0.04) * (l_tax - 0.04) + (l_discount - 0.05) * (l_discount - 0.05) + 0.0025) AS nx,
  (l_discount - 0.05) / sqrt((l_tax - 0.04) * (l_tax - 0.04) + (l_discount - 0.05) * (l_discount - 0.05) + 0.0025) AS ny,
  0.05 / sqrt((l_tax - 0.04) * (l_tax - 0.04) + (l_discount - 0.05) * (l_discount - 0.05) + 0.0025) AS nz,
  CAST(l_linenumber - 2 AS INT) AS segment, CAST(l_partkey % 20 AS INT) AS instance FROM lineitem"""),
    "frames": ("events", """
SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_index,
  value / (value + 34.59) AS prob_inside, event_type AS label, CAST(5.0 AS DOUBLE) AS fps FROM events"""),
    "manifest": ("pages", "SELECT CAST(page_id AS VARCHAR(20)) AS video_id, url FROM pages"),
    "finished": ("pages", "SELECT CAST(page_id AS VARCHAR(20)) AS video_id FROM pages WHERE page_id % 3 = 0"),
    "clips": ("conversations", "SELECT conv_id AS clip_id, count(*) AS n_frames FROM conversations GROUP BY conv_id"),
    "palette": ("nation", "SELECT CAST(n_nationkey AS INT) AS class_id, n_name AS class_name FROM nation"),
    "features": ("embeddings", "SELECT vec_id, label, embedding FROM embeddings"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, without registering anything in the session."""
    source, sql = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {rows}"), rows=rows)
