"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, drop_scratch


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of ``a``-``b``
    edges.  The edges of a hub are rewired to smaller hubs round by round; every round is
    checkpointed and the one before dropped, so neither lineage, disk nor any task grows with
    the number of rounds."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .filter("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        # Each star needs its edges by node once, for the least neighbour and the rewiring.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(F.col("u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .repartition(F.col("u")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        old, edges = edges, checkpointed(small.filter("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop_scratch(old.sparkSession, old._staged_path)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
