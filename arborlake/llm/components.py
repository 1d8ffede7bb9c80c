"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014).

Every step is a partial aggregate and an equi-join, so a node with very many links is spread like any
other; rounds grow with the logarithm of the longest chain. Each round is cut by a table in the
shared folder, which the next round's replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.session import Scratch


def _least(links: DataFrame) -> DataFrame:
    """links: u, v. For each u the least of itself and its v."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every larger neighbour of u is linked to the least node around u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. u and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: a, b, any order. Returns node, root: the least node of its component, for nodes other than roots."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen, k = None, 0
    while True:
        k += 1
        after = scratch.save(small_star(large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        sign = after.agg(F.count("*"), mark).first()
        if sign == seen or not sign[0]:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, seen = after, sign
