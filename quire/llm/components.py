"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _towards_least(pairs: DataFrame) -> DataFrame:
    """For rows (u, v): each v and u itself, pointed at the least vertex seen around u.

    The least one comes from an aggregate that combines before the shuffle and is joined back, so a vertex with very
    many neighbours is split by the skew join and never held in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    edges: two columns u, v of long. Loops and repeated edges do no harm; with no edges the result is empty.
    Each round points larger neighbours at the least neighbour (large star), then smaller ones (small star); when a
    round changes nothing, the edges form stars. The rounds grow with the logarithm of the longest path.
    """
    stars = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _towards_least(large)
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        stars = cut(small)
        state = tuple(
            stars.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if state == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
