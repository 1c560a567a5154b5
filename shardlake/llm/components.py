"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scalars


def _state(edges: DataFrame) -> tuple:
    return scalars(edges, F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node that isn't its own root.

    ``edges`` has long columns u and v; loops and repeats don't matter. Each round joins edges
    with one minimum for each node, pre-aggregated, and cuts its lineage; rounds grow with the
    logarithm of the longest chain. Nothing but a count and a checksum reaches the driver.
    """
    big, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = cut(edges.where("u <> v").select(big, low).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).select(big, low).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
