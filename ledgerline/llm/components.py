"""Connected components of an edge list, by alternating large and small stars.

Each round is a fixed number of joins and grouped minima over the edges; rounds are written to the shared folder,
so that lineage stays short. The number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mark, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: neighbours above u go to u's smallest neighbour; small: neighbours below, and u itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (u, v: long) with another root."""
    before = mark()
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    seen = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == seen or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
        now = written(_stars(_stars(now, True), False), "component-edges")
        forget(edges.sparkSession, before, mark() - 1)  # the round before
