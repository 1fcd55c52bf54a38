"""Connected components of a graph given as edges, by alternating star contractions on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.staging import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id``, ``component``: every id on an edge, with the smallest id of its component. Nulls and self-loops are left
    out. Each round hooks every node to the smallest of its neighbourhood (large star, then small star); the number
    of rounds grows with the logarithm of a component's size. No component is gathered anywhere."""
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = stage(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        links = stage(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.join(links.select(F.col("u").alias("id")), "id", "left_anti"))


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every node's larger neighbours to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
