"""Graph metrics as joins and aggregates over edges ``(i, j, w)`` with i < j and w > 0; ``g`` keys independent graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import cut


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: ``g, i, j, w``."""
    e = edges.select("g", "i", "j", "w")
    return e.union(e.select("g", "j", "i", "w"))


def degree_strength(edges: DataFrame) -> DataFrame:
    """Degree and strength of each node that has an edge."""
    return arcs(edges).groupBy("g", F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, with its three weights."""
    a = edges.select("g", F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").alias("w1"))
    b = edges.select("g", F.col("i").alias("b"), F.col("j").alias("c"), F.col("w").alias("w2"))
    c = edges.select("g", F.col("i").alias("a"), F.col("j").alias("c"), F.col("w").alias("w3"))
    return a.join(b, ["g", "b"]).join(c, ["g", "a", "c"])


def clustering(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Clustering of each node: triangles over pairs of neighbours, or Onnela's geometric mean of weights over the largest."""
    top = edges.groupBy("g").agg(F.max("w").alias("top"))
    t = triangles(edges).join(top, "g")
    value = F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")) / F.col("top") if weighted else F.lit(1.0)
    per = t.select("g", value.alias("x"), F.explode(F.array("a", "b", "c")).alias("node")).groupBy("g", "node").agg(F.sum("x").alias("x"))
    d = degree_strength(edges)
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.join(per, ["g", "node"], "left").select("g", "node", F.when(F.col("degree") < 2, 0.0).otherwise(F.coalesce("x", F.lit(0.0)) / pairs).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples."""
    t = triangles(edges).groupBy("g").agg(F.count(F.lit(1)).alias("t"))
    d = degree_strength(edges).groupBy("g").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    return d.join(t, "g", "left").select("g", F.coalesce(3.0 * F.coalesce("t", F.lit(0)) / F.nullif("triples", F.lit(0.0)), F.lit(0.0)).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at the two ends of the arcs."""
    d = degree_strength(edges).select("g", "node", "degree")
    a = arcs(edges).join(d.select("g", F.col("node").alias("i"), F.col("degree").alias("x")), ["g", "i"]).join(d.select("g", F.col("node").alias("j"), F.col("degree").alias("y")), ["g", "j"])
    return a.groupBy("g").agg(F.corr("x", "y").alias("assortativity"))


def rich_club(edges: DataFrame) -> DataFrame:
    """phi(k): density among nodes of degree over k, for each k below the largest degree."""
    d = degree_strength(edges).select("g", "node", "degree")
    ks = d.groupBy("g").agg(F.max("degree").alias("top")).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).alias("k"))
    nodes = ks.join(d, "g").filter("degree > k").groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    e = edges.join(d.select("g", F.col("node").alias("i"), F.col("degree").alias("x")), ["g", "i"]).join(d.select("g", F.col("node").alias("j"), F.col("degree").alias("y")), ["g", "j"])
    m = e.select("g", F.least("x", "y").alias("low")).join(ks, "g").filter("low > k").groupBy("g", "k").agg(F.count(F.lit(1)).alias("m"))
    phi = F.when(F.col("n") < 2, 0.0).otherwise(2.0 * F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1)))
    return nodes.join(m, ["g", "k"], "left").select("g", "k", "n", phi.alias("phi"))


def participation(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """1 - sum over modules of (strength into the module / strength) squared; ``modules`` is ``(node, module)``."""
    to = arcs(edges).join(modules.select(F.col("node").alias("j"), "module"), "j").groupBy("g", F.col("i").alias("node"), "module").agg(F.sum("w").alias("w"))
    return to.groupBy("g", "node").agg((1 - F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2.0))).alias("participation"))


def within_module_z(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """z (population deviation) of a node's strength within its module among the module's nodes; 0 where there is no spread."""
    m = modules.select("node", "module")
    graphs = edges.select("g").distinct()
    own = arcs(edges).join(m.select(F.col("node").alias("i"), F.col("module").alias("mi")), "i").join(m.select(F.col("node").alias("j"), F.col("module").alias("mj")), "j").filter("mi = mj")
    inside = own.groupBy("g", F.col("i").alias("node")).agg(F.sum("w").alias("k"))
    full = graphs.join(m, how="cross").join(inside, ["g", "node"], "left").select("g", "node", "module", F.coalesce("k", F.lit(0.0)).alias("k"))
    w = Window.partitionBy("g", "module")
    sd = F.stddev_pop("k").over(w)
    return full.select("g", "node", "module", F.when(sd > 0, (F.col("k") - F.avg("k").over(w)) / sd).otherwise(0.0).alias("z"))


def node_roles(edges: DataFrame, modules: DataFrame, z_hub: float = 1.0, p_connector: float = 0.3) -> DataFrame:
    """Connector or provincial, hub or not, from within-module z and participation (strictly above the limits)."""
    r = within_module_z(edges, modules).join(participation(edges, modules), ["g", "node"], "left").withColumn("participation", F.coalesce("participation", F.lit(0.0)))
    role = F.concat_ws("_", F.when(F.col("participation") > p_connector, "connector").otherwise("provincial"), F.when(F.col("z") > z_hub, "hub").otherwise("non_hub"))
    return r.withColumn("role", role)


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Q = sum over modules of w_in / 2m - (k / 2m)^2."""
    m = modules.select("node", "module")
    a = arcs(edges).join(m.select(F.col("node").alias("i"), F.col("module").alias("mi")), "i").join(m.select(F.col("node").alias("j"), F.col("module").alias("mj")), "j")
    per = a.groupBy("g", "mi").agg(F.sum(F.when(F.col("mi") == F.col("mj"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("k"))
    two_m = F.sum("k").over(Window.partitionBy("g"))
    return per.withColumn("two_m", two_m).groupBy("g").agg(F.sum(F.col("inside") / F.col("two_m") - F.pow(F.col("k") / F.col("two_m"), F.lit(2.0))).alias("modularity"))


def inter_module(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Number, total and mean weight of edges between (or within) two modules."""
    m = modules.select("node", "module")
    e = edges.join(m.select(F.col("node").alias("i"), F.col("module").alias("a")), "i").join(m.select(F.col("node").alias("j"), F.col("module").alias("b")), "j")
    return e.groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.avg("w").alias("mean_w"))


def agreement(partitions: DataFrame) -> DataFrame:
    """Share of runs in which two nodes are in one community; ``partitions`` is ``(run, node, community)``."""
    runs = partitions.agg(F.count_distinct("run").alias("runs"))
    a = partitions.select("run", "community", F.col("node").alias("i"))
    b = partitions.select("run", "community", F.col("node").alias("j"))
    together = a.join(b, ["run", "community"]).filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return together.join(F.broadcast(runs), how="cross").select("i", "j", (F.col("n") / F.col("runs")).alias("agreement"))


def layer_hubs(edges: DataFrame, deviations: float = 1.0) -> DataFrame:
    """Nodes whose strength exceeds their layer's mean by over ``deviations`` population deviations."""
    d = degree_strength(edges)
    w = Window.partitionBy("g")
    return d.withColumn("z", (F.col("strength") - F.avg("strength").over(w)) / F.nullif(F.stddev_pop("strength").over(w), F.lit(0.0))).select("g", "node", "strength", F.coalesce("z", F.lit(0.0)).alias("z"), (F.coalesce("z", F.lit(0.0)) > deviations).alias("is_hub"))


def multiplex_participation(edges: DataFrame) -> DataFrame:
    """L / (L - 1) (1 - sum over layers of (strength / total strength) squared) of each node."""
    layers = edges.agg(F.count_distinct("g").alias("layers"))
    d = degree_strength(edges)
    p = d.groupBy("node").agg((1 - F.sum(F.col("strength") * F.col("strength")) / F.pow(F.sum("strength"), F.lit(2.0))).alias("p"))
    return p.join(F.broadcast(layers), how="cross").select("node", (F.col("layers") / (F.col("layers") - 1) * F.col("p")).alias("participation"))


def coupling_global(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pearson correlation and number of the pairs' weights in two modalities (``g, i, j, w`` each)."""
    return first.join(second.withColumnRenamed("w", "u"), ["g", "i", "j"]).groupBy("g").agg(F.corr("w", "u").alias("r"), F.count(F.lit(1)).alias("n"))


def coupling_regional(first: DataFrame, second: DataFrame, positive_only: bool = False, least: int = 3) -> DataFrame:
    """The same for each node's row, without itself; ``positive_only`` leaves out pairs the first modality lacks."""
    x = arcs(first).join(arcs(second).withColumnRenamed("w", "u"), ["g", "i", "j"])
    if positive_only:
        x = x.filter("w > 0")
    return x.groupBy("g", F.col("i").alias("node")).agg(F.corr("w", "u").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def decoupling_index(first: DataFrame, second: DataFrame) -> DataFrame:
    """|f - s| / (|f| + |s| + 1e-10) of each node's strength, normalised by each modality's largest."""
    s = degree_strength(first).select("g", "node", F.col("strength").alias("s"))
    f = degree_strength(second).select("g", "node", F.col("strength").alias("f"))
    w = Window.partitionBy("g")
    x = s.join(f, ["g", "node"]).select("g", "node", (F.col("s") / F.max("s").over(w)).alias("s"), (F.col("f") / F.max("f").over(w)).alias("f"))
    return x.select("g", "node", (F.abs(F.col("f") - F.col("s")) / (F.abs("f") + F.abs("s") + 1e-10)).alias("decoupling"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    Each round takes the least label among the neighbours, then the label's own label,
    until nothing changes.
    """
    a = cut(arcs(edges).select("g", "i", "j").distinct())
    label = a.select("g", F.col("i").alias("node")).distinct().withColumn("c", F.col("node"))
    for _ in range(max_rounds):
        near = a.join(label.select("g", F.col("node").alias("j"), "c"), ["g", "j"]).groupBy("g", F.col("i").alias("node")).agg(F.min("c").alias("m"))
        low = label.join(near, ["g", "node"]).select("g", "node", "c", F.least("c", "m").alias("m"))
        jump = label.select("g", F.col("node").alias("m"), F.col("c").alias("further"))
        new = cut(low.join(jump, ["g", "m"], "left").select("g", "node", F.col("c").alias("old"), F.least("m", "further").alias("c")))
        label = new.select("g", "node", "c")
        if new.filter("old <> c").isEmpty():
            return label.withColumnRenamed("c", "component")
    raise RuntimeError("components did not converge")
