"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one minimum per node, combined before the shuffle, and one join; nothing holds a component
in one place. Steps are written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowbench.sources.tables import write_table

MAX_STEPS = 60


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    two = both_ways(edges)
    least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return two.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them.

    A node's own edge comes once, the others as often as before: repeated edges go without a shuffle of
    their own, as each step leaves fewer of the others.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b")


def stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells one set of edges from another, counted while it is written."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20)"))
    table = write_table(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "components")
    return table, (seen.get["n"], seen.get["total"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches, itself included."""
    larger = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, before = stored(larger.filter("a <> b"))
    for _ in range(MAX_STEPS):
        stars, seen = stored(small_star(large_star(stars)))
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
