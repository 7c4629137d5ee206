"""Rank, p-value and effect-size columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank of ``value`` within ``by``, ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


#: Harmonic numbers of up to so many terms are added up in order, as SQL does, so that small groups round alike.
_TERMS = 100


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, beyond ``_TERMS`` by Euler's series to the precision of a double."""
    x = n.cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(_TERMS)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    return F.when(n <= _TERMS, few).otherwise(F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6))


def adjust_p(df: DataFrame, p: str, *by: str, method: str = "bh", tie: str = "id") -> DataFrame:  # noqa: ARG001
    """``df`` with ``p_adjusted`` by ``bh``, ``by``, ``holm`` or ``bonferroni`` within ``by``.

    Equal p share their adjusted value whatever the order that ``tie`` gives them, so ranks and running extremes are made over
    counts of distinct p, and every window runs from its start: frames that reach to the end are scanned anew for each row.
    """
    if method == "bonferroni":
        return df.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*by))))
    keys = [f"_k{k}" for k in range(len(by))]
    counts = df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    up = Window.partitionBy(*keys).orderBy(F.col("_p").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = counts.withColumn("_r", F.sum("_m").over(up)).withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys)))
    if method == "holm":
        best = F.max(F.col("_p") * (F.col("_n") - (F.col("_r") - F.col("_m")))).over(up)
    else:
        down = Window.partitionBy(*keys).orderBy(F.col("_p").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        best = F.min(F.col("_p") * F.col("_n") / F.col("_r")).over(down)
        best = best * harmonic(F.col("_n")) if method == "by" else best
    adjusted = last.select(*keys, "_p", F.least(F.lit(1.0), best).alias("p_adjusted"))
    same = F.col(p).eqNullSafe(F.col("_p"))
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.join(adjusted, same).drop(*keys, "_p")


def magnitude(d: Column) -> Column:
    """Label of an effect size: negligible, small (.2), medium (.5) or large (.8)."""
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")
