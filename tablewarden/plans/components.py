"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps: every node's larger neighbours are linked to the least node it knows,
then its smaller ones. A step replaces links by links, so the table never grows, and a logarithmic number of steps
leaves each node linked to the least node of its component. A step is one aggregate (the least neighbour, combined
on the map side, so a hub is one row a task) and one join; nothing is gathered by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import cut_lineage

MOST_STEPS = 60


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(neighbours: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Each neighbour ``b`` of ``a`` that ``keep`` lets through, linked to the least of ``a`` and its neighbours."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = neighbours.where(keep).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked, least


def print_of(links: DataFrame) -> tuple:
    """Count and order-free checksum, to see that a step changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least node) for all nodes of links ``a``, ``b`` of one orderable type.

    Links may repeat, run either way or join a node to itself; links with a null end are left out.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    nodes = cut_lineage(both_ways(links).select(F.col("a").alias("node")).distinct())
    now = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = print_of(now)
    for _ in range(MOST_STEPS):
        large, _ = star(both_ways(now), "b > a")
        large = cut_lineage(large.where("a <> b").distinct())
        # here every link points from the larger node to the smaller one
        small, least = star(large, "true")
        now = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        last, seen = seen, print_of(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components still change after {MOST_STEPS} steps")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
