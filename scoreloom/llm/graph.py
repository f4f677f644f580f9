"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove


def _min_near(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each u; partial aggregation, so a hub costs a row per task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _min_near(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _min_near(down)
    hung = down.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs, in any order, repeats allowed -> (node, label): label is the smallest node reachable.

    Nodes without an edge don't occur in the result. Every round is a table in the shared folder (no lineage
    grows, lost executors re-read it); only a count and a checksum come to the driver. The rounds needed grow
    with the logarithm of the longest chain."""
    spark = edges.sparkSession
    now = edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    path, seen = None, None
    while True:
        target = new_path(spark, "links")
        now.write.parquet(target)
        if path:
            remove(spark, path)
        path, stored = target, spark.read.schema("u long, v long").parquet(target)
        state = tuple(stored.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            return stored.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stored.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = state
        now = _small_star(_large_star(stored))
