"""Queries of Bayesian regression, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.operators import bayes as by
from cohortweave.plans.bindings import table
from cohortweave.plans.catalogue import query, rounded
from cohortweave.plans.models import _COVARIED, covaried


def standard(df: DataFrame, *cols: str, over: list[str]) -> DataFrame:
    """Columns less their mean, by their deviation, within ``over``; null without any."""
    w = Window.partitionBy(*over)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in cols})


_LINEAR = _COVARIED + f""",
zs AS (SELECT metric, site, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS y, (orders - avg(orders) OVER w) / nullif(stddev_pop(orders) OVER w, 0) AS x FROM lc WINDOW w AS (PARTITION BY metric)),
su AS (SELECT metric, site, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, var_pop(y) - pow(covar_pop(x, y), 2) / var_pop(x) AS rest FROM zs GROUP BY ALL),
pt AS (SELECT *, ln(rest) / 2 + (k - 200) / 200.0 * 12 / sqrt(2.0 * n) AS u FROM su, (SELECT unnest(range({by.POINTS})) AS k)),
tt AS (SELECT *, exp(-2 * u) AS t FROM pt),
pq AS (SELECT *, n * t + 0.25 AS p, sx * t AS q, sxx * t + 0.25 AS r FROM tt),
dt AS (SELECT *, p * r - q * q AS det FROM pq),
ab AS (SELECT *, t * (r * sy - q * sxy) / det AS a, t * (p * sxy - q * sy) / det AS b FROM dt),
lg AS (SELECT *, u * (1 - n) - t * (syy - a * sy - b * sxy) / 2 - ln(det) / 2 - ln(1 + exp(2 * u)) AS l FROM ab),
wt AS (SELECT *, exp(l - max(l) OVER (PARTITION BY metric, site)) AS w FROM lg),
po AS (SELECT metric, site, n, sum(w * a) / sum(w) AS alpha, sum(w * (a * a + r / det)) / sum(w) AS aa, sum(w * b) / sum(w) AS beta, sum(w * (b * b + p / det)) / sum(w) AS bb, sum(w * exp(u)) / sum(w) AS sigma, sum(w * exp(2 * u)) / sum(w) AS ss FROM wt GROUP BY ALL)"""
_PARTS = ["alpha", "alpha_sd", "beta", "beta_sd", "sigma", "sigma_sd"]

query(
    "SELECT metric, site, n, round(alpha, 5) + 0.0 AS alpha, round(sqrt(aa - alpha * alpha), 5) + 0.0 AS alpha_sd, round(beta, 5) + 0.0 AS beta, round(sqrt(bb - beta * beta), 5) + 0.0 AS beta_sd, round(sigma, 5) + 0.0 AS sigma, round(sqrt(ss - sigma * sigma), 5) + 0.0 AS sigma_sd FROM po",
    _LINEAR,
    "bayes_linear",
)(lambda spark, d: rounded(by.linear(standard(covaried(spark, d), "value", "orders", over=["metric"]), "value", "orders", "metric", "site"), *_PARTS, digits=5))


def flows(spark: SparkSession, d: str) -> DataFrame:
    """``year, subject, place, grp, x, y``: mean discount and mean quantity of the lines from a supplier's nation to a customer's."""
    o, c, s, li, n = (table(spark, d, t) for t in ("orders", "customer", "supplier", "lineitem", "nation"))
    lines = li.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("e"))
    x = lines.join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", F.col("c_nationkey").alias("subject")), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", F.col("s_nationkey").alias("place")), F.col("l_suppkey") == F.col("s_suppkey"))
    m = x.groupBy("year", "subject", "place").agg(F.avg("q").alias("x"), F.avg("e").alias("y"))
    return standard(m, "x", "y", over=["year", "place"]).join(n.select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("grp")), "place")


@query(name="bayes_hierarchical")
def _hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Mean slope of each region's nations in each year, four chains of 2000 draws after 2000 (the reference's counts)."""
    draws = by.chains(flows(spark, d), "year", "subject", "place", "grp", "y", "x", 2000, 2000)
    return rounded(by.summary(draws, "key", "grp"), "mean", "sd", "low", "high", "rhat").withColumnRenamed("key", "year")
