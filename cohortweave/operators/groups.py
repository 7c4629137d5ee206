"""Group statistics over ``(grp, metric, value)``-like tables: one pass of aggregates, or average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.functions.ranks import average_rank, magnitude


def two_groups(df: DataFrame, value: str, group: str, a: str, b: str, *by: str) -> DataFrame:
    """Counts, means and sample variances of groups ``a`` and ``b`` within ``by``, as one row each."""
    pick = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    cols = [c for g, k in ((a, 1), (b, 2)) for c in (pick(g, F.count).alias(f"n{k}"), pick(g, F.avg).alias(f"m{k}"), pick(g, F.var_samp).alias(f"v{k}"))]
    return df.filter(F.col(group).isin(a, b)).groupBy(*by).agg(*cols)


def effect_sizes(stats: DataFrame) -> DataFrame:
    """Cohen's d (pooled, ddof 1), Hedges' g (1 - 3 / (4 df - 1)) and d's magnitude."""
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df)
    out = stats.withColumn("d", (F.col("m1") - F.col("m2")) / F.nullif(pooled, F.lit(0.0)))
    return out.withColumn("hedges_g", F.col("d") * (1 - 3.0 / (4 * df - 1))).withColumn("effect", magnitude(F.col("d")))


def t_statistics(stats: DataFrame) -> DataFrame:
    """Student's pooled and Welch's t, and Welch's degrees of freedom."""
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df
    gap, e1, e2 = F.col("m1") - F.col("m2"), F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    nu = F.pow(e1 + e2, F.lit(2.0)) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return stats.withColumn("t_student", gap / F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2")))).withColumn("t_welch", gap / F.sqrt(e1 + e2)).withColumn("df_welch", nu)


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str, *by: str) -> DataFrame:
    """U of group ``a`` by average ranks, and the rank-biserial correlation 2 U / (n1 n2) - 1."""
    rows = df.filter(F.col(group).isin(a, b)).select(*by, F.col(group).alias("grp"), average_rank(value, *by).alias("r"))
    first = F.col("grp") == a
    s = rows.groupBy(*by).agg(F.sum(F.when(first, F.col("r"))).alias("r1"), F.sum(first.cast("int")).alias("n1"), F.sum((~first).cast("int")).alias("n2"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return s.select(*by, u.alias("u"), (2.0 * u / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"))


def kruskal(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Kruskal-Wallis H without tie correction."""
    r = df.select(*by, F.col(group).alias("grp"), average_rank(value, *by).alias("r"))
    g = r.groupBy(*by, "grp").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return g.groupBy(*by).agg((12.0 / (total * (total + 1)) * F.sum(F.col("s") * F.col("s") / F.col("n")) - 3 * (total + 1)).alias("h"), F.count(F.lit(1)).alias("groups"))


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Largest gap of the two groups' cumulative shares; the running sums are over distinct values."""
    x = df.filter(F.col(group).isin(a, b)).groupBy(F.col(value).alias("x")).agg(F.sum((F.col(group) == a).cast("long")).alias("n1"), F.sum((F.col(group) == b).cast("long")).alias("n2"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.abs(F.sum("n1").over(w) / F.sum("n1").over(everything) - F.sum("n2").over(w) / F.sum("n2").over(everything))
    return x.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's W about the group means."""
    w = Window.partitionBy(group)
    z = df.withColumn("_m", F.avg(value).over(w)).select(F.col(group).alias("grp"), F.abs(F.col(value) - F.col("_m")).alias("z"))
    g = z.groupBy("grp").agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    total = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * grand * grand
    return g.agg(((total - F.count(F.lit(1))) / (F.count(F.lit(1)) - 1) * between / F.sum(F.col("n") * F.col("v"))).alias("levene"))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of the sum of squares between groups, and the F ratio."""
    g = df.groupBy(F.col(group).alias("grp")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2.0)) / total
    within = F.sum(F.col("n") * F.col("v"))
    k = F.count(F.lit(1))
    return g.agg((between / (between + within)).alias("eta_squared"), ((between / (k - 1)) / (within / (total - k))).alias("f_ratio"))


def icc(df: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """ICC(1,1), ICC(2,1) and ICC(3,1) of a complete targets by raters table, from the mean squares."""
    t = df.groupBy(target).agg(F.avg(value).alias("m"))
    r = df.groupBy(rater).agg(F.avg(value).alias("m"))
    one = df.agg(F.count_distinct(target).cast("double").alias("n"), F.count_distinct(rater).cast("double").alias("k"), F.var_pop(value).alias("v"), F.count(value).alias("c"))
    x = one.join(t.agg(F.var_pop("m").alias("vt")), how="cross").join(r.agg(F.var_pop("m").alias("vr")), how="cross")
    n, k = F.col("n"), F.col("k")
    sst, ssr, total = F.col("vt") * n * k, F.col("vr") * n * k, F.col("v") * F.col("c")
    msb, msr = sst / (n - 1), ssr / (k - 1)
    msw, mse = (total - sst) / (n * (k - 1)), (total - sst - ssr) / ((n - 1) * (k - 1))
    return x.select(((msb - msw) / (msb + (k - 1) * msw)).alias("icc_11"), ((msb - mse) / (msb + (k - 1) * mse + k * (msr - mse) / n)).alias("icc_21"), ((msb - mse) / (msb + (k - 1) * mse)).alias("icc_31"))


def robust_z(df: DataFrame, value: str, *by: str) -> DataFrame:
    """0.6745 (x - median) / MAD within ``by``; 0 where the MAD is 0."""
    mid = df.groupBy(*by).agg(F.median(value).alias("_mid"))
    gap = df.join(mid, list(by)).withColumn("_gap", F.abs(F.col(value) - F.col("_mid")))
    mad = gap.groupBy(*by).agg(F.median("_gap").alias("_mad"))
    z = 0.6745 * (F.col(value) - F.col("_mid")) / F.nullif("_mad", F.lit(0.0))
    return gap.join(mad, list(by)).withColumn("robust_z", F.coalesce(z, F.lit(0.0))).drop("_mid", "_gap", "_mad")


def reference_z(df: DataFrame, value: str, is_reference: Column, *by: str) -> DataFrame:
    """z of every row against the reference rows' mean and deviation (ddof 1) within ``by``."""
    ref = df.filter(is_reference).groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(ref, list(by), "left").withColumn("z", F.coalesce((F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0))).drop("_m", "_s")


def harmonize(df: DataFrame, value: str, site: str) -> DataFrame:
    """Per-site z (ddof 1) brought to the overall deviation and mean (removes any group difference confounded with site)."""
    w = Window.partitionBy(site)
    whole = df.agg(F.avg(value).alias("_gm"), F.stddev_samp(value).alias("_gs"))
    sd = F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    z = F.coalesce((F.col(value) - F.avg(value).over(w)) / sd, F.lit(0.0))
    return df.withColumn("_z", z).join(F.broadcast(whole), how="cross").withColumn("harmonized", F.col("_z") * F.col("_gs") + F.col("_gm")).drop("_z", "_gm", "_gs")


def weak_percentile(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Percent of the values within ``by`` that are at most the row's."""
    return df.withColumn("percentile", 100 * F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def batch_diagnosis(df: DataFrame, value: str, site: str) -> DataFrame:
    """Count, mean, deviation, skewness and excess kurtosis (population) of each site."""
    return df.groupBy(F.col(site).alias("site")).agg(F.count(value).alias("n"), F.avg(value).alias("mean_v"), F.stddev_samp(value).alias("sd_v"), F.skewness(value).alias("skew_v"), F.kurtosis(value).alias("kurt_v"))


def trapezoid(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Area under ``y`` over ``x`` within ``by``."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_a", part).groupBy(*by).agg(F.sum("_a").alias("auc"))
