"""Connected components by alternating star contractions, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node that is reachable.

    Each round sends every node's larger neighbours to its least one, then its smaller ones; a star of any size costs its
    links, and the least neighbour of a node is pre-aggregated before it is exchanged.  A round is one job and one checkpoint.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    n = edges.count()  # no step makes more links than these
    edges = settled(edges, n)
    before = None
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
        edges = settled(small.where("a <> b").distinct(), n)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (a, component) with further links (a, b) between its nodes, or between others: only what the links join of whole components is contracted again."""
    side = label.withColumnRenamed("component", "_c")
    ends = links.select("a", "b").join(side, "a", "left").select("b", F.coalesce("_c", "a").alias("_a"))
    ends = ends.join(side.withColumnRenamed("a", "b"), "b", "left").select(F.col("_a").alias("a"), F.coalesce("_c", "b").alias("b"))
    up = components(ends)
    if up.isEmpty():
        return label
    up = up.select(F.col("node").alias("component"), F.col("component").alias("_up"))
    known = label.join(up, "component", "left").select("a", F.coalesce("_up", "component").alias("component"))
    fresh = up.select(F.col("component").alias("a"), F.col("_up").alias("component")).join(label, "a", "left_anti")
    both = known.unionByName(fresh)
    return settled(both, label.count() + fresh.count())
