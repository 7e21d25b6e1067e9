"""Connected components of a graph given by its edges, by alternating large and small stars.

Edges are joined and regrouped in the cluster until every component is a star around its smallest
node; each round's edges are written to the shared folder. A node with very many neighbours only
meets its minimum, computed with partial aggregation, in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Is every u at one v that is no u itself?"""
    n, distinct = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == distinct and edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node that isn't the smallest of its component, and that smallest node. Edges have columns u, v of any type with an order; loops and nulls are ignored."""
    now = stored(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
    return now
