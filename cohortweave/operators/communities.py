"""Communities by the Leiden method as joins and aggregates, for any number of graphs at once.

A level moves nodes to the neighbouring community of the largest gain, all graphs and runs
side by side; a coin of each node and round lets about half of those that want to move do so, which keeps neighbours from changing
places for ever.  Each community is then refined from single nodes: a node that is still alone may join a
part of its own community that stays put in that round, so parts are connected.  Parts are the nodes of the next level.
At the end a community that fell apart is split, which can only raise modularity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.graph import arcs, components
from cohortweave.session import written as cut

_KEY = ["g", "run"]
_EPS = 1e-10


def _coin(salt: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(2)) == 0


def _links(pairs: DataFrame, label: DataFrame, zero: DataFrame) -> DataFrame:
    """``g, run, i, c, kin``: weight of each node's arcs into each label; ``zero`` gives labels that are there without an arc."""
    met = pairs.join(label, [*_KEY, "j"]).select(*_KEY, "i", "c", "w")
    return met.union(zero.select(*_KEY, "i", "c", F.lit(0.0).alias("w"))).groupBy(*_KEY, "i", "c").agg(F.sum("w").alias("kin"))


def _moved(pairs: DataFrame, nodes: DataFrame, resolution: float, salt: int) -> DataFrame:
    """``nodes`` after one round; ``wants`` marks nodes that had a better community, moved or not.

    A node may also leave for the community of its own name, which gains nothing where nobody is in it.
    """
    label = nodes.select(*_KEY, F.col("node").alias("j"), F.col("comm").alias("c"))
    own = nodes.select(*_KEY, F.col("node").alias("i"), "k", "m2", "comm")
    total = nodes.groupBy(*_KEY, F.col("comm").alias("c")).agg(F.sum("k").alias("total"))
    zero = own.withColumn("c", F.explode(F.array("comm", "i")))
    met = _links(pairs, label, zero).join(own, [*_KEY, "i"]).join(total, [*_KEY, "c"], "left").na.fill(0.0, ["total"])
    stays = F.col("c") == F.col("comm")
    gain = F.round((F.col("kin") - resolution * F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2")) / F.col("m2"), 12)
    best = met.select(*_KEY, "i", "k", "m2", "comm", "c", gain.alias("gain"), stays.alias("stays")).groupBy(*_KEY, "i", "k", "m2", "comm")
    best = best.agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("here"))
    wants = -F.col("best.loss") > F.col("here") + _EPS
    comm = F.when(wants & _coin(salt, *_KEY, "i"), F.col("best.c")).otherwise(F.col("comm"))
    return best.select(*_KEY, F.col("i").alias("node"), "k", "m2", comm.alias("comm"), wants.alias("wants"))


def _refined(pairs: DataFrame, nodes: DataFrame, resolution: float, rounds: int, salt: int) -> DataFrame:
    """``nodes`` with ``part``: connected parts of each community, each node joined only where modularity does not fall."""
    comm = nodes.select(*_KEY, F.col("node").alias("i"), "comm")
    inner = cut(pairs.join(comm, [*_KEY, "i"]).join(comm.withColumnsRenamed({"i": "j", "comm": "other"}), [*_KEY, "j"]).filter("comm = other").select(*_KEY, "i", "j", "w"))
    parts = nodes.select(*_KEY, "node", "k", "m2", "comm", F.col("node").alias("part"))
    for r in range(rounds):
        size = parts.groupBy(*_KEY, F.col("part").alias("c")).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
        # parts of one node whose coin falls on tails may leave; all others stay and may be joined
        size = size.withColumn("leaves", (F.col("size") == 1) & _coin(salt + r, *_KEY, "c"))
        alone = parts.join(size.filter("leaves").select(*_KEY, F.col("c").alias("part")), [*_KEY, "part"], "left_semi")
        label = parts.select(*_KEY, F.col("node").alias("j"), F.col("part").alias("c"))
        movers = alone.select(*_KEY, F.col("node").alias("i"), "k", "m2")
        met = inner.join(movers.select(*_KEY, "i"), [*_KEY, "i"], "left_semi").join(label, [*_KEY, "j"]).groupBy(*_KEY, "i", "c").agg(F.sum("w").alias("kin"))
        met = met.join(size.filter(~F.col("leaves")), [*_KEY, "c"]).join(movers, [*_KEY, "i"])
        gain = F.round((F.col("kin") - resolution * F.col("k") * F.col("total") / F.col("m2")) / F.col("m2"), 12)
        joined = met.select(*_KEY, F.col("i").alias("node"), "c", gain.alias("gain")).filter("gain > 0").groupBy(*_KEY, "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("to"))
        parts = cut(parts.join(joined, [*_KEY, "node"], "left").select(*_KEY, "node", "k", "m2", "comm", F.coalesce("to.c", "part").alias("part")))
    return parts


def modularity_of(pairs: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``g, run, modularity`` of the labels ``comm`` of ``nodes``; ``pairs`` are arcs, both ways."""
    label = nodes.select(*_KEY, F.col("node").alias("i"), "comm")
    inside = pairs.join(label, [*_KEY, "i"]).join(label.withColumnsRenamed({"i": "j", "comm": "other"}), [*_KEY, "j"]).filter("comm = other").groupBy(*_KEY).agg(F.sum("w").alias("inside"))
    spread = nodes.groupBy(*_KEY, "comm", "m2").agg(F.sum("k").alias("total")).groupBy(*_KEY, "m2").agg(F.sum(F.pow(F.col("total") / F.col("m2"), F.lit(2.0))).alias("expected"))
    return spread.join(inside, _KEY, "left").select(*_KEY, (F.coalesce("inside", F.lit(0.0)) / F.col("m2") - resolution * F.col("expected")).alias("modularity"))


def leiden(edges: DataFrame, resolution: float = 1.0, runs: int = 4, levels: int = 6, rounds: int = 8, refine_rounds: int = 3, seed: int = 1) -> DataFrame:
    """``g, node, community, modularity``: the best of ``runs`` Leiden partitions of each graph ``(g, i, j, w)``.

    A community is named by its smallest node; each is connected.  Nodes without an edge of positive weight are not listed.
    """
    one = edges.filter("i <> j and w > 0").select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("w").cast("double").alias("w")).groupBy("g", "i", "j").agg(F.sum("w").alias("w"))
    first = cut(arcs(one).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select(*_KEY, "i", "j", "w"))
    twice = first.groupBy(*_KEY).agg(F.sum("w").alias("m2"))
    strength = first.groupBy(*_KEY, F.col("i").alias("node")).agg(F.sum("w").alias("k"))
    start = cut(strength.join(twice, _KEY).select(*_KEY, "node", "k", "m2", F.col("node").alias("comm")))
    pairs, nodes = first, start
    member = start.select(*_KEY, F.col("node").alias("origin"), "node")
    for level in range(levels):
        for r in range(rounds):
            nodes = cut(_moved(pairs.filter("i <> j"), nodes, resolution, seed * 1000 + level * 100 + r))
            if nodes.filter("wants").isEmpty():
                break
        parts = _refined(pairs.filter("i <> j"), nodes, resolution, refine_rounds, seed * 1000 + level * 100 + 50)
        to = parts.select(*_KEY, "node", "part")
        done = parts.filter("part <> node").isEmpty()
        member = cut(member.join(to, [*_KEY, "node"]).select(*_KEY, "origin", F.col("part").alias("node")))
        nodes = cut(parts.groupBy(*_KEY, "part", "m2", "comm").agg(F.sum("k").alias("k")).select(*_KEY, F.col("part").alias("node"), "k", "m2", "comm"))
        if done:
            break
        at = lambda end: to.select(*_KEY, F.col("node").alias(end), F.col("part").alias(f"p{end}"))  # noqa: E731, B023
        pairs = cut(pairs.join(at("i"), [*_KEY, "i"]).join(at("j"), [*_KEY, "j"]).groupBy(*_KEY, F.col("pi").alias("i"), F.col("pj").alias("j")).agg(F.sum("w").alias("w")))
    final = member.join(nodes.select(*_KEY, "node", "comm"), [*_KEY, "node"]).select(*_KEY, F.col("origin").alias("node"), "comm")
    label = final.select(*_KEY, F.col("node").alias("i"), "comm")
    inner = first.filter("i < j").join(label, [*_KEY, "i"]).join(label.withColumnsRenamed({"i": "j", "comm": "other"}), [*_KEY, "j"]).filter("comm = other")
    whole = components(cut(inner.select(F.struct(*_KEY).alias("g"), "i", "j", "w"))).select("g.g", "g.run", "node", "component")
    split = final.join(whole, [*_KEY, "node"], "left").select(*_KEY, "node", F.coalesce("component", "node").alias("comm"))
    split = cut(split.join(start.select(*_KEY, "node", "k", "m2"), [*_KEY, "node"]))
    q = modularity_of(first, split, resolution).groupBy("g").agg(F.min(F.struct((-F.round("modularity", 12)).alias("loss"), "run")).alias("best"))
    chosen = split.join(q.select("g", F.col("best.run").alias("run"), (-F.col("best.loss")).alias("modularity")), _KEY)
    return chosen.select("g", "node", F.col("comm").alias("community"), "modularity")
