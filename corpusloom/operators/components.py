"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import spread_lookup
from corpusloom.session import cut_lineage


def hooked(edges: DataFrame) -> DataFrame:
    """``node, parent``: every node hooks onto the smallest node among its neighbours and itself."""
    ends = edges.select(F.col("a").alias("node"), F.col("a").alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    return ends.groupBy("node").agg(F.min("parent").alias("parent"))


def shortcut(parents: DataFrame) -> DataFrame:
    """``node, parent`` with every parent replaced by its root; doubles the jump until nothing changes.

    Each jump is one join of the table with itself and a checkpoint; a path of n nodes needs log2(n) jumps.
    """
    while True:
        lookup = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = cut_lineage(spread_lookup(parents, lookup, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``edges (a, b)``; a component is named by its smallest node.

    Rounds of hooking, shortcutting and contraction; the rounds' parent tables are chained at the end. Self
    loops, repeated edges and both directions are allowed; nulls link nothing; without edges the result is empty.
    """
    edges = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut_lineage(edges.where("a < b").distinct())
    rounds = []
    while not edges.isEmpty():
        parents = shortcut(cut_lineage(hooked(edges)))
        rounds.append(parents)
        low = spread_lookup(edges, parents.select(F.col("node").alias("a"), F.col("parent").alias("low")), "a").select("low", "b")
        both = spread_lookup(low, parents.select(F.col("node").alias("b"), F.col("parent").alias("high")), "b")
        edges = cut_lineage(both.select(F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")).where("a < b").distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def chained(later: DataFrame, earlier: DataFrame) -> DataFrame:
        lookup = later.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        return spread_lookup(earlier, lookup, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))

    return functools.reduce(chained, reversed(rounds)).withColumnRenamed("parent", "component")
