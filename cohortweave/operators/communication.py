"""Communication between the nodes of weighted graphs ``(g, i, j, w)``, and what it explains of another graph.

Everything is a join of arcs with vectors or pairs and a sum: a round moves values one arc
further.  Pairs of nodes are the output (the measures are dense matrices), nothing larger is made.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.graph import arcs
from cohortweave.operators.paths import lengths
from cohortweave.operators.regression import least_squares
from cohortweave.session import cut


def _arcs(edges: DataFrame) -> DataFrame:
    return arcs(edges).filter("w > 0 and i <> j").groupBy("g", "i", "j").agg(F.max("w").cast("double").alias("w"))


def spectral_radius(edges: DataFrame, tolerance: float = 1e-13, step: int = 8, most: int = 1000) -> DataFrame:
    """``g, radius``: the largest eigenvalue of each graph's weights (positive ones; loops are left out).

    Power iteration of all graphs at once from a vector of ones.  The ratio of the norms of two rounds grows towards the
    radius, also where the smallest eigenvalue is as large (bipartite graphs); every ``step`` rounds it is looked at, until no
    graph's ratio rose by more than ``tolerance`` of itself, or ``most`` rounds.
    """
    a = cut(_arcs(edges))
    bound = a.groupBy("g", "i").agg(F.sum("w").alias("s")).groupBy("g").agg(F.max("s").alias("bound"))
    scaled = cut(a.join(bound, "g").select("g", "i", F.col("j").alias("node"), (F.col("w") / F.col("bound")).alias("w"), "bound"))
    x = scaled.select("g", "node").distinct().withColumn("x", F.lit(1.0))
    once = lambda x: scaled.join(x, ["g", "node"]).groupBy("g", F.col("i").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.first("bound").alias("bound"))
    norm = lambda x, name: x.groupBy("g").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias(name))
    last = None
    for _ in range(0, most, step):
        for _ in range(step - 2):
            x = once(x.select("g", "node", "x"))
        x = cut(x)
        size = norm(x, "size")
        x = cut(x.join(size, "g").select("g", "node", (F.col("x") / F.col("size")).alias("x")))
        y = cut(once(x))
        now = cut(norm(y, "ratio").join(bound, "g").select("g", (F.col("ratio") * F.col("bound")).alias("radius")))
        if last is not None:
            old = last.withColumnRenamed("radius", "old")
            if now.join(old, "g").filter(F.abs(F.col("radius") - F.col("old")) > tolerance * F.col("radius")).isEmpty():
                break
        last, x = now, y.select("g", "node", "x")
    return now


def communicability(edges: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """``g, i, j, c``: the exponential of each graph's weights over their spectral radius, where it is not zero (the diagonal included).

    The power series by Horner's scheme: after the scaling all eigenvalues are at most 1 in size, so the terms left
    out are proven to sum to less than ``tolerance``.
    """
    terms = next(k for k in range(1, 200) if 2 / math.factorial(k + 1) < tolerance)
    a = _arcs(edges).join(spectral_radius(edges), "g")
    a = cut(a.select("g", "i", F.col("j").alias("k"), (F.col("w") / F.col("radius")).alias("w")))
    one = cut(a.select("g", "i").distinct().select("g", "i", F.col("i").alias("j"), F.lit(1.0).alias("c")))
    s = one
    for k in range(terms, 0, -1):
        moved = a.join(s.withColumnRenamed("i", "k"), ["g", "k"]).select("g", "i", "j", (F.col("w") * F.col("c") / k).alias("c"))
        s = moved.union(one).groupBy("g", "i", "j").agg(F.sum("c").alias("c"))
        if k % 3 == 1:
            s = cut(s)
    return s


def communication_features(edges: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``g, i, j, shortest_path, communicability`` and, with ``places``, ``euclidean`` of all ordered pairs of different nodes.

    Steps of a path cost 1 / w; pairs without a path have twice the graph's longest, and communicability 0.  Nodes are
    those of positive edges, or with ``places`` (``g, node, x, y, z``) all of its nodes; a null place gives a null distance.
    """
    if places is None:
        nodes = _arcs(edges).select("g", F.col("i").alias("node")).distinct()
    else:
        nodes = places.select("g", "node", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    a, b = ([F.col(c).alias({"node": k}.get(c, c + k)) for c in nodes.columns if c != "g"] for k in "ij")
    pairs = nodes.select("g", *a).join(nodes.select("g", *b), "g").filter("i <> j")
    path = lengths(edges, True)
    far = path.groupBy("g").agg((2 * F.max("d")).alias("far"))
    out = pairs.join(path, ["g", "i", "j"], "left").join(far, "g", "left").join(communicability(edges), ["g", "i", "j"], "left")
    cols = [F.coalesce("d", "far", F.lit(0.0)).alias("shortest_path"), F.coalesce("c", F.lit(0.0)).alias("communicability")]
    if places is not None:
        cols.append(F.sqrt(sum((F.col(f"{c}i") - F.col(f"{c}j")) * (F.col(f"{c}i") - F.col(f"{c}j")) for c in "xyz")).alias("euclidean"))
    return out.select("g", "i", "j", *cols)


def regional_coupling(features: DataFrame, target: DataFrame, min_connections: int = 3) -> DataFrame:
    """``g, node, n, coupling, betas``: how far the features of a node's pairs explain their ``y`` (adjusted R²).

    ``features`` has ``g, i, j`` and a column a predictor, ``target`` ``g, i, j, y`` with each pair once.  Pairs with a null or
    a value that is not finite are left out; nodes with fewer than ``min_connections`` pairs more than predictors, and
    those whose ``y`` is constant, have a null coupling.
    """
    xs = [c for c in features.columns if c not in ("g", "i", "j")]
    both = target.select("g", "i", "j", "y").union(target.select("g", "j", "i", "y"))
    finite = lambda c: F.when(F.abs(c) < math.inf, F.col(c).cast("double")).alias(c)
    rows = features.join(both, ["g", "i", "j"]).select("g", F.col("i").alias("node"), *(finite(c) for c in [*xs, "y"]))
    fit = least_squares(rows, "y", xs, "g", "node").withColumn("_on", F.col("n") >= min_connections + len(xs))
    return fit.select("g", "node", "n", F.when(F.col("_on"), F.col("r2_adjusted")).alias("coupling"), F.when(F.col("_on"), F.col("slopes")).alias("betas"))
