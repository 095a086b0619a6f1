"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut_lineage


def _directed(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: each node's neighbours on one side, itself included, are tied to the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if larger else both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = around.join(least, "a")
    if larger:  # the neighbours above the node move to the least
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the least node it can reach.

    Large-star and small-star steps by turns (Kiveris et al., Connected Components in MapReduce and Beyond): a node
    hands on only its minimum, so no step gathers a neighbourhood, and the number of edges never grows. Each round is
    written to the shared folder. Repeated edges and loops do no harm; nulls are not edges; an empty table has no nodes.
    """
    current = cut_lineage(edges.select(F.col("a"), F.col("b")).filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    for _ in range(max_rounds):
        stars = _directed(_directed(current, True).filter("a <> b").distinct(), False).filter("a <> b").distinct()
        current = cut_lineage(stars.select("a", "b"))
        # every change of a star lowers a root or drops an edge, so both numbers standing still means the end
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == known:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        known = tuple(seen)
    raise RuntimeError("components did not settle")
