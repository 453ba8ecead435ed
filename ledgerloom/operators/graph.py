"""Graphs as edge tables: components and reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import written


#: Edges at a node from which on it is a hub, whose edges stay where they are.
HUB = 10_000


def _at_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """``both`` (a, b) with the ``m`` of its a in ``least`` (a, m, n): the few nodes with ``HUB`` edges or more (at most one for as
    many edges) go to the edges, so that no task sorts all edges of one; the others meet by a shuffle."""
    least = written(least)
    hubs = F.broadcast(least.filter(F.col("n") >= HUB).select("a", F.col("m").alias("__hub")))
    marked = both.join(hubs, "a", "left")
    others = marked.filter("__hub is null").select("a", "b").join(least.filter(F.col("n") < HUB).select("a", "m").hint("merge"), "a")
    return marked.filter("__hub is not null").select("a", "b", F.col("__hub").alias("m")).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node of its component, roots themselves left out.

    Large-star and small-star rounds: each node links its larger neighbours, then all of its smaller ones, to its smallest;
    a logarithmic number of rounds, each two joins that leave the edges of hubs in place, until every edge leads to a root.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count("*").alias("n"))
        edges = _at_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = written(edges)
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        edges = written(_at_least(edges, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        # Done once all are stars: no node hangs under two, or under one that hangs itself.
        sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def reach(edges: DataFrame, most: int = 64) -> DataFrame:
    """(a, b) of every node b that a reaches along ``edges`` (a, b), each once; cycles end, for only new pairs go on."""
    edges = edges.select("a", "b").distinct()
    found = frontier = written(edges)
    for _ in range(most):
        step = frontier.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")).hint("merge"), "b").select("a", F.col("c").alias("b")).distinct()
        frontier = written(step.join(found.hint("merge"), ["a", "b"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise ValueError(f"paths longer than {most}")
