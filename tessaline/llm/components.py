"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node) for every node of ``links(a, b)``.

    Alternates large-star and small-star steps, each a group-by on a node with
    only a minimum kept per group, until nothing changes; neither links nor nodes
    are gathered in one place.  Null ends, loops and repeated links are harmless,
    and no links give no rows.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "cc-edges")
    mark = None
    while True:
        # Large-star: every larger neighbour of u points to u's smallest neighbour or u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: u and its smaller neighbours point to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "cc-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)
