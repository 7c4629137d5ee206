"""Shortest paths of edge tables ``(g, i, j, w)`` and the measures that follow from them.

A step costs 1 (hops) or 1 / w.  Distances are relaxed by joins: each round carries the
pairs that became shorter one arc further, until no pair does, so that paths of any
length are found and nothing but the graph's arcs and its pairs is ever held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.graph import arcs
from cohortweave.session import cut


def _steps(edges: DataFrame, weighted: bool) -> DataFrame:
    cost = 1.0 / F.max("w") if weighted else F.lit(1.0)
    return arcs(edges).filter("w > 0 and i <> j").groupBy("g", "i", "j").agg(cost.alias("d"))


def lengths(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``g, i, j, d``: the shortest length of each ordered pair of different nodes that a path joins."""
    a = cut(_steps(edges, weighted))
    on = a.select("g", F.col("i").alias("j"), F.col("j").alias("k"), F.col("d").alias("s"))
    known = front = a
    while True:
        reached = front.join(on, ["g", "j"]).filter("i <> k").groupBy("g", "i", "k").agg(F.min(F.col("d") + F.col("s")).alias("d"))
        old = known.select("g", "i", F.col("j").alias("k"), F.col("d").alias("old"))
        shorter = reached.join(old, ["g", "i", "k"], "left").filter(F.col("old").isNull() | (F.col("d") < F.col("old") * (1 - 1e-12)))
        front = cut(shorter.select("g", "i", F.col("k").alias("j"), "d"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front).groupBy("g", "i", "j").agg(F.min("d").alias("d")))


def _nodes(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy("g").agg(F.count_distinct("i").alias("nodes"))


def closeness(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``g, node, closeness``: nodes reached over their total length, scaled by the share of nodes reached."""
    d = lengths(edges, weighted).groupBy("g", F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("reached"), F.sum("d").alias("total"))
    return d.join(_nodes(edges), "g").select("g", "node", (F.col("reached") / F.col("total") * F.col("reached") / (F.col("nodes") - 1)).alias("closeness"))


def nodal_efficiency(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``g, node, efficiency``: mean of 1 / length to all other nodes; unreachable ones count 0."""
    d = lengths(edges, weighted).groupBy("g", F.col("i").alias("node")).agg(F.sum(1.0 / F.col("d")).alias("s"))
    return d.join(_nodes(edges), "g").select("g", "node", (F.col("s") / (F.col("nodes") - 1)).alias("efficiency"))


def path_summary(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``g, path_length, efficiency, diameter, reached``: over ordered pairs; pairs without a path count 0 in the efficiency alone."""
    d = lengths(edges, weighted).groupBy("g").agg(F.avg("d").alias("path_length"), F.sum(1.0 / F.col("d")).alias("s"), F.max("d").alias("diameter"), F.count(F.lit(1)).alias("reached"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return d.join(_nodes(edges), "g").select("g", "path_length", (F.col("s") / pairs).alias("efficiency"), "diameter", "reached")
