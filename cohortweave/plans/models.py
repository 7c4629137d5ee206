"""Queries of multi-scale shape, scaling breaks and models with covariates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators import communities as cm
from cohortweave.operators import regression as rg
from cohortweave.operators import resampled as rs
from cohortweave.operators import scaling as sc
from cohortweave.operators import surface as su
from cohortweave.plans import catalogue
from cohortweave.plans.bindings import series, table, trade_graph
from cohortweave.plans.catalogue import TS, query, rounded

RADII = [0.3, 0.5, 0.8, 1.2]
SCALES = [4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160]

# ------------------------------------------------------------------ shape of point clouds


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """``id, x, y, z``: the sums of every third component of each embedding."""
    e = table(spark, d, "embeddings")
    part = lambda k: F.round(F.aggregate(F.filter("embedding", lambda v, i: i % 3 == k), F.lit(0.0), lambda s, v: s + v.cast("double")), 6)
    return e.select(F.col("vec_id").alias("id"), *(part(k).alias(c) for k, c in enumerate("xyz")))


_CLOUD = """
pts AS (SELECT vec_id AS id, round(list_sum(list_transform(list_filter(embedding, lambda v, i: i % 3 = 1), lambda v: CAST(v AS DOUBLE))), 6) AS x,
    round(list_sum(list_transform(list_filter(embedding, lambda v, i: i % 3 = 2), lambda v: CAST(v AS DOUBLE))), 6) AS y,
    round(list_sum(list_transform(list_filter(embedding, lambda v, i: i % 3 = 0), lambda v: CAST(v AS DOUBLE))), 6) AS z FROM embeddings),
radii AS (SELECT unnest([0.3, 0.5, 0.8, 1.2]::DOUBLE[]) AS radius),
near AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM pts a, pts b),
mom AS (SELECT id, radius, count(*) AS n, covar_pop(dx, dx) AS xx, covar_pop(dx, dy) AS xy, covar_pop(dx, dz) AS xz, covar_pop(dy, dy) AS yy, covar_pop(dy, dz) AS yz, covar_pop(dz, dz) AS zz
    FROM near, radii WHERE dx * dx + dy * dy + dz * dz <= radius * radius GROUP BY ALL),
dev AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mom),
siz AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM dev),
ang AS (SELECT *, acos(greatest(-1.0, least(1.0, coalesce(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / nullif(2 * p * p * p, 0), 1.0)))) / 3 AS phi FROM siz),
eig AS (SELECT id, radius, n, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3, q FROM ang),
lam AS (SELECT id, radius, n, CASE WHEN n >= 6 THEN greatest(e1, 0.0) END AS l1, CASE WHEN n >= 6 THEN greatest(3 * q - e1 - e3, 0.0) END AS l2, CASE WHEN n >= 6 THEN greatest(e3, 0.0) END AS l3 FROM eig),
pr AS (SELECT *, l1 + l2 + l3 AS s FROM lam),
shape AS (SELECT id, radius, n, l1, l2, l3, CASE WHEN l1 >= 1e-12 THEN (l1 - l2) / l1 END AS linearity, CASE WHEN l1 >= 1e-12 THEN (l2 - l3) / l1 END AS planarity, CASE WHEN l1 >= 1e-12 THEN l3 / l1 END AS sphericity,
    CASE WHEN l1 >= 1e-12 THEN cbrt(l1 * l2 * l3) END AS omnivariance, CASE WHEN l1 >= 1e-12 THEN (l1 - l3) / l1 END AS anisotropy,
    CASE WHEN l1 >= 1e-12 THEN -list_sum(list_transform(list_filter([l1 / s, l2 / s, l3 / s], lambda v: v > 1e-12), lambda v: v * ln(v))) END AS eigenentropy, CASE WHEN l1 >= 1e-12 THEN l3 / s END AS surface_variation FROM pr)"""
_SHAPE = ["l1", "l2", "l3", *su.FEATURES]

query(f"SELECT id, radius, n, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _SHAPE)} FROM shape", _CLOUD, "multiscale_eigenfeatures")(
    lambda spark, d: rounded(su.multiscale_eigenfeatures(cloud(spark, d), RADII), *_SHAPE, digits=5)
)

# ------------------------------------------------------------------ scaling breaks

_FLUCT = TS + f""",
pf AS (SELECT subject, roi, row_number() OVER (PARTITION BY subject, roi ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY subject, roi) AS n, sum(d) OVER (PARTITION BY subject, roi ORDER BY t) AS y
    FROM (SELECT subject, roi, t, v - avg(v) OVER (PARTITION BY subject, roi) AS d FROM ts)),
sg AS (SELECT subject, roi, scale, i // scale AS part, i % scale AS u, y FROM pf, (SELECT unnest({SCALES}) AS scale) WHERE n // scale >= 4 AND i // scale < n // scale),
ft AS (SELECT subject, roi, scale, part, greatest(0.0, var_pop(y) - coalesce(pow(covar_pop(u, y), 2) / nullif(var_pop(u), 0), 0)) AS rest FROM sg GROUP BY ALL),
fl AS (SELECT subject, roi, scale, sqrt(avg(rest)) AS f FROM ft GROUP BY ALL)"""
_CROSS = _FLUCT + """,
lg AS (SELECT subject, roi, log10(scale) AS x, log10(f) AS y FROM fl WHERE f > 1e-12),
nb AS (SELECT *, row_number() OVER (PARTITION BY subject, roi ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY subject, roi) AS n FROM lg),
sp AS (SELECT a.subject, a.roi, a.k AS split, a.x AS x0, regr_syy(b.y, b.x) FILTER (b.k < a.k) - coalesce(pow(regr_sxy(b.y, b.x) FILTER (b.k < a.k), 2) / regr_sxx(b.y, b.x) FILTER (b.k < a.k), 0) AS low,
    regr_syy(b.y, b.x) FILTER (b.k >= a.k) - coalesce(pow(regr_sxy(b.y, b.x) FILTER (b.k >= a.k), 2) / regr_sxx(b.y, b.x) FILTER (b.k >= a.k), 0) AS high,
    regr_syy(b.y, b.x) - pow(regr_sxy(b.y, b.x), 2) / regr_sxx(b.y, b.x) AS one, regr_slope(b.y, b.x) FILTER (b.k < a.k) AS slope_low, regr_slope(b.y, b.x) FILTER (b.k >= a.k) AS slope_high
    FROM nb a JOIN nb b ON a.subject = b.subject AND a.roi = b.roi WHERE a.k >= 3 AND a.k < a.n - 3 AND a.n >= 7 GROUP BY ALL),
gn AS (SELECT *, 1 - (low + high) / one AS improvement FROM sp WHERE one > 0),
bs AS (SELECT * FROM gn WHERE improvement > 0.1 QUALIFY row_number() OVER (PARTITION BY subject, roi ORDER BY improvement DESC, split) = 1),
al AS (SELECT subject, roi, regr_slope(y, x) AS slope FROM lg GROUP BY ALL)"""

query("SELECT subject, roi, scale, round(f, 6) + 0.0 AS f FROM fl", _FLUCT, "dfa_fluctuations")(lambda spark, d: rounded(sc.fluctuations(series(spark, d), SCALES), "f"))


def _crossover(spark: SparkSession, d: str) -> DataFrame:
    f = sc.fluctuations(series(spark, d), SCALES).filter("f > 1e-12").select("subject", "roi", F.log10("scale").alias("x"), F.log10("f").alias("y"))
    out = sc.crossover(f, "subject", "roi").withColumn("crossover_scale", F.pow(F.lit(10.0), "crossover_x")).drop("crossover_x")
    return rounded(out, "slope", "crossover_scale", "slope_low", "slope_high", "improvement", digits=5)


query(
    "SELECT al.subject, al.roi, round(slope, 5) + 0.0 AS slope, round(pow(10, x0), 5) + 0.0 AS crossover_scale, round(slope_low, 5) + 0.0 AS slope_low, round(slope_high, 5) + 0.0 AS slope_high, round(improvement, 5) + 0.0 AS improvement, split FROM al LEFT JOIN bs ON bs.subject = al.subject AND bs.roi = al.roi",
    _CROSS, "dfa_crossover",
)(_crossover)

# ------------------------------------------------------------------ covariates


def covaried(spark: SparkSession, d: str) -> DataFrame:
    """``subject, site, metric, value, orders, building``: balance and spending of customers with two covariates."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("site"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.sum("o_totalprice").alias("spent"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    x = c.select(F.col("c_custkey").alias("subject"), "site", F.coalesce("orders", F.lit(0.0)).alias("orders"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"), F.col("c_acctbal").cast("double").alias("balance"), (F.coalesce("spent", F.lit(0.0)) / 1000).alias("spent"))
    return x.unpivot(["subject", "site", "orders", "building"], ["balance", "spent"], "metric", "value")


_COVARIED = """
xc AS (SELECT c_custkey AS subject, n_regionkey AS site, CAST(coalesce(k, 0) AS DOUBLE) AS orders, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS building, CAST(c_acctbal AS DOUBLE) AS balance, coalesce(s, 0) / 1000 AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey),
lc AS (SELECT subject, site, orders, building, 'balance' AS metric, balance AS value FROM xc UNION ALL SELECT subject, site, orders, building, 'spent', spent FROM xc),
cc AS (SELECT *, value - avg(value) OVER w AS y, orders - avg(orders) OVER w AS a, building - avg(building) OVER w AS b FROM lc WINDOW w AS (PARTITION BY metric, site)),
gm AS (SELECT metric, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM cc GROUP BY 1),
sl AS (SELECT metric, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS u, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM gm),
mn AS (SELECT metric, avg(value) AS mean, avg(orders) AS mo, avg(building) AS mb FROM lc GROUP BY 1)"""

query("SELECT subject, cc.metric, round(y - u * a - v * b + mean, 3) + 0.0 AS residual FROM cc JOIN sl ON sl.metric = cc.metric JOIN mn ON mn.metric = cc.metric", _COVARIED, "residualize_covariates")(
    lambda spark, d: rounded(rg.residualize(covaried(spark, d), "value", ["orders", "building"], "site", "metric"), "residual", digits=3).select("subject", "metric", "residual")
)
_REST = _COVARIED + """,
rs AS (SELECT cc.*, u * (orders - mo) + v * (building - mb) AS part, value - u * (orders - mo) - v * (building - mb) AS rest FROM cc JOIN sl ON sl.metric = cc.metric JOIN mn ON mn.metric = cc.metric),
ctr AS (SELECT metric, site, avg(rest) AS bm FROM rs GROUP BY ALL),
spr AS (SELECT rs.metric, avg(rest) AS a0, sqrt(avg(pow(rest - bm, 2))) AS s0 FROM rs JOIN ctr ON ctr.metric = rs.metric AND ctr.site = rs.site GROUP BY 1),
zr AS (SELECT rs.*, a0, s0, (rest - a0) / s0 AS z FROM rs JOIN spr ON spr.metric = rs.metric),
bt AS (SELECT metric, site, avg(z) AS g, sqrt(var_samp(z)) AS dd FROM zr GROUP BY ALL)"""
query("SELECT subject, zr.metric, round((z - g) / dd * s0 + a0 + part, 3) + 0.0 AS harmonized FROM zr JOIN bt ON bt.metric = zr.metric AND bt.site = zr.site", _REST, "combat_covariates_plain")(
    lambda spark, d: rounded(rg.combat_with(covaried(spark, d), "value", ["orders", "building"], "site", "metric", False), "harmonized", digits=3).select("subject", "metric", "harmonized")
)
query(name="combat_covariates")(lambda spark, d: rounded(rg.combat_with(covaried(spark, d), "value", ["orders", "building"], "site", "metric"), "harmonized", digits=3).select("subject", "metric", "harmonized"))
_ADJ = _COVARIED + """,
fg AS (SELECT metric, site, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy, count(*) AS n FROM cc GROUP BY ALL),
fs AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS u, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM fg)"""


def _regression(spark: SparkSession, d: str) -> DataFrame:
    f = rg.least_squares(covaried(spark, d), "value", ["orders", "building"], "metric", "site")
    return rounded(f.select("metric", "site", "n", F.col("slopes")[0].alias("slope_orders"), F.col("slopes")[1].alias("slope_building"), "r2", "r2_adjusted"), "slope_orders", "slope_building", "r2", "r2_adjusted")


query("SELECT metric, site, n, round(u, 6) + 0.0 AS slope_orders, round(v, 6) + 0.0 AS slope_building, round((u * ay + v * byy) / yy, 6) + 0.0 AS r2, round(1 - (1 - (u * ay + v * byy) / yy) * (n - 1) / (n - 3), 6) + 0.0 AS r2_adjusted FROM fs", _ADJ, "regression_by_site")(_regression)

# ------------------------------------------------------------------ communities


@query(name="leiden")
def _leiden(spark: SparkSession, d: str) -> DataFrame:
    """Leiden communities of the strong edges of the trade graph, the best of four runs."""
    return rounded(cm.leiden(trade_graph(spark, d)), "modularity")


# ------------------------------------------------------------------ tails and uncertain graphs

RUNS, SAMPLES = 100, 200  # the reference's counts


def uncertain_graph(spark: SparkSession, d: str) -> DataFrame:
    """``g, i, j, w, sd``: mean and deviation over the years of the lines between two nations; g is the line status."""
    o, c, s, li = (table(spark, d, n) for n in ("orders", "customer", "supplier", "lineitem"))
    lines = li.groupBy("l_orderkey", "l_suppkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    sides = lines.join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    years = sides.filter("c_nationkey <> s_nationkey").groupBy(F.col("l_linestatus").alias("g"), F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j"), "year").agg(F.sum("n").alias("n"))
    return years.groupBy("g", "i", "j").agg(F.avg("n").alias("w"), F.stddev_pop("n").alias("sd"))


query(name="powerlaw_compare")(lambda spark, d: rs.powerlaw_compare(catalogue._av(spark, d), "subject", "size"))
query(name="probabilistic_communities")(lambda spark, d: rs.coassignment(uncertain_graph(spark, d), RUNS))
query(name="community_stability")(lambda spark, d: rs.stability(rs.coassignment(uncertain_graph(spark, d), RUNS)))
query(name="graph_metrics_ci")(lambda spark, d: rs.metrics_with_ci(uncertain_graph(spark, d), SAMPLES))
