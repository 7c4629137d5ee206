"""Operators on symmetric matrices stored as edges ``(subject, i, j, w)`` with i < j."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.functions.ranks import average_rank

def _subject():  # noqa: ANN202
    return Window.partitionBy("subject")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.unionByName(edges.select("subject", F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in edges.columns if c not in ("subject", "i", "j")]))


def fisher_z(edges: DataFrame) -> DataFrame:
    """atanh of the weights, clipped to +-0.9999."""
    return edges.withColumn("w", F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col("w")))))


def inverse_fisher_z(edges: DataFrame) -> DataFrame:
    """tanh of the weights."""
    return edges.withColumn("w", F.tanh("w"))


def symmetrize(entries: DataFrame, how: str = "avg") -> DataFrame:
    """Unordered pairs from ordered entries: the mean, largest or smallest of the two (one alone counts with 0)."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    one = F.sum(F.when(F.col("i") < F.col("j"), F.col("w")).otherwise(0.0))
    two = F.sum(F.when(F.col("i") > F.col("j"), F.col("w")).otherwise(0.0))
    value = {"avg": (one + two) / 2, "max": F.greatest(one, two), "min": F.least(one, two)}[how]
    return entries.filter("i <> j").groupBy("subject", low.alias("i"), high.alias("j")).agg(value.alias("w"))


def normalize(edges: DataFrame, how: str = "max") -> DataFrame:
    """Weights by the largest absolute one, scaled to [0, 1], or as log1p."""
    if how == "log":
        return edges.withColumn("w", F.log1p("w"))
    if how == "minmax":
        lo, hi = F.min("w").over(_subject()), F.max("w").over(_subject())
        return edges.withColumn("w", F.coalesce((F.col("w") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)))
    top = F.max(F.abs("w")).over(_subject())
    return edges.withColumn("w", F.coalesce(F.col("w") / F.nullif(top, F.lit(0.0)), F.lit(0.0)))


def normalize_rows(edges: DataFrame) -> DataFrame:
    """Both directions with weights divided by the row's sum."""
    d = both_ways(edges)
    return d.withColumn("w", F.coalesce(F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy("subject", "i")), F.lit(0.0)), F.lit(0.0)))


def threshold_density(edges: DataFrame, density: float, nodes: int) -> DataFrame:
    """The strongest max(1, ceil(density * N (N - 1) / 2)) edges, and all that tie with the last; absent pairs count as 0."""
    keep = max(1, math.ceil(density * nodes * (nodes - 1) / 2))
    rank = F.rank().over(_subject().orderBy(F.desc("w")))
    return edges.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def threshold_absolute(edges: DataFrame, least: float) -> DataFrame:
    """Edges of absolute weight ``least`` or more."""
    return edges.filter(F.abs("w") >= least)


def threshold_percentile(edges: DataFrame, density: float) -> DataFrame:
    """Edges of absolute weight at or above the percentile 100 (1 - density)."""
    cut = edges.groupBy("subject").agg(F.percentile(F.abs("w"), 1 - density).alias("cut"))
    return edges.join(cut, "subject").filter(F.abs("w") >= F.col("cut")).drop("cut")


def negatives(edges: DataFrame, how: str = "zero") -> DataFrame:
    """Negative weights as 0 or as their absolute value."""
    return edges.withColumn("w", F.abs("w") if how == "abs" else F.greatest("w", F.lit(0.0)))


def density(edges: DataFrame, nodes: int) -> DataFrame:
    """Share of the N (N - 1) / 2 pairs with a weight other than 0."""
    return edges.groupBy("subject").agg((F.sum((F.col("w") != 0).cast("double")) / (nodes * (nodes - 1) / 2)).alias("density"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes, median, and shares of positive and negative weights."""
    return edges.groupBy("subject").agg(
        F.avg("w").alias("mean_w"), F.stddev_pop("w").alias("sd_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.median("w").alias("median_w"),
        F.avg((F.col("w") > 0).cast("double")).alias("positive"), F.avg((F.col("w") < 0).cast("double")).alias("negative"),
    )


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` edges of largest absolute weight of each subject."""
    return edges.withColumn("place", F.row_number().over(_subject().orderBy(F.desc(F.abs("w")), "i", "j"))).filter(F.col("place") <= k)


def similarity(edges: DataFrame, method: str = "pearson") -> DataFrame:
    """Similarity of two subjects' weights over their common pairs, ``(a, b, similarity)`` with a < b."""
    rows = edges
    if method == "spearman":
        rows = edges.withColumn("w", average_rank("w", "subject"))
    x = rows.select(F.col("subject").alias("a"), "i", "j", F.col("w").alias("x"))
    y = rows.select(F.col("subject").alias("b"), "i", "j", F.col("w").alias("y"))
    pairs = x.join(y, ["i", "j"]).filter("a < b").groupBy("a", "b")
    if method == "cosine":
        return pairs.agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), F.lit(0.0))).alias("similarity"))
    return pairs.agg(F.corr("x", "y").alias("similarity"))


def fingerprint(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each subject of one session, the most correlated subject of the other (ties: the smallest), and whether it is itself."""
    x = first.select(F.col("subject").alias("a"), "i", "j", F.col("w").alias("x"))
    y = second.select(F.col("subject").alias("b"), "i", "j", F.col("w").alias("y"))
    r = x.join(y, ["i", "j"]).groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    best = r.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "b"))).filter("n = 1")
    return best.select(F.col("a").alias("subject"), F.col("b").alias("match"), "r", (F.col("a") == F.col("b")).alias("identified"))


def group_statistics(edges: DataFrame) -> DataFrame:
    """Mean, deviation (ddof 1) and number of subjects of each pair."""
    return edges.groupBy("i", "j").agg(F.avg("w").alias("mean_w"), F.stddev_samp("w").alias("sd_w"), F.count("w").alias("n"))


def outlier_subjects(edges: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Subjects whose mean correlation with the others lies ``threshold`` deviations or more below the usual."""
    s = similarity(edges)
    d = s.select("a", "similarity").union(s.select("b", "similarity")).toDF("subject", "similarity")
    m = d.groupBy("subject").agg(F.avg("similarity").alias("mean_similarity"))
    lim = m.agg(F.avg("mean_similarity").alias("mu"), F.stddev_samp("mean_similarity").alias("sd"))
    z = (F.col("mean_similarity") - F.col("mu")) / F.nullif("sd", F.lit(0.0))
    return m.join(F.broadcast(lim), how="cross").select("subject", "mean_similarity", F.coalesce(z, F.lit(0.0)).alias("z"), F.coalesce(z <= -threshold, F.lit(False)).alias("is_outlier"))


def drop_nodes(edges: DataFrame, nodes: list) -> DataFrame:
    """Edges that touch none of the nodes."""
    return edges.filter(~F.col("i").isin(nodes) & ~F.col("j").isin(nodes))


def sanitized(edges: DataFrame) -> DataFrame:
    """NaN and infinite weights as 0, and how many there were of each subject's."""
    bad = F.isnan("w") | (F.abs("w") == float("inf")) | F.col("w").isNull()
    return edges.withColumn("cleaned", bad.cast("int")).withColumn("w", F.when(bad, 0.0).otherwise(F.col("w")))


def validation(edges: DataFrame, nodes: int) -> DataFrame:
    """Per subject: missing pairs, invalid weights, weights out of [-1, 1], and whether none of these occur."""
    bad = F.sum((F.isnan("w") | F.col("w").isNull()).cast("int"))
    out = F.sum((F.abs("w") > 1 + 1e-9).cast("int"))
    got = edges.groupBy("subject").agg((F.lit(nodes * (nodes - 1) // 2) - F.count(F.lit(1))).alias("missing"), bad.alias("invalid"), out.alias("out_of_range"))
    return got.withColumn("is_valid", (F.col("missing") == 0) & (F.col("invalid") == 0) & (F.col("out_of_range") == 0))
