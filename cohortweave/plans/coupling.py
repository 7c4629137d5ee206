"""Queries of communication between nodes, coupling of graphs and joint alignment, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.operators import alignment as al
from cohortweave.operators import communication as co
from cohortweave.operators import kernels as kr
from cohortweave.operators import labels as lb
from cohortweave.plans.bindings import modules, table
from cohortweave.plans.catalogue import query, rounded

# ------------------------------------------------------------------ a graph a year


def yearly_trade(spark: SparkSession, d: str) -> DataFrame:
    """``g, i, j, w``: the lines between two nations; g is the year of the order."""
    o, c, s, li = (table(spark, d, n) for n in ("orders", "customer", "supplier", "lineitem"))
    lines = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    sides = lines.join(o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("g")), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sides.filter("c_nationkey <> s_nationkey").groupBy("g", F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j"))
    return pairs.agg(F.sum("n").cast("double").alias("w"))


def yearly_profiles(spark: SparkSession, d: str) -> DataFrame:
    """``g, node, x, y, z, v``: logs of a nation's orders and their value in a year, its customers' mean balance; v is their 12 monthly order counts."""
    n = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("node"), F.col("c_acctbal").cast("double").alias("balance"))
    balance = n.groupBy("node").agg(F.round(F.avg("balance") / 1000, 6).alias("z"))
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("g"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("double").alias("price"))
    months = [F.count_if(F.col("month") == m).cast("double") for m in range(1, 13)]
    sums = o.join(n, F.col("o_custkey") == F.col("c_custkey")).groupBy("g", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.array(*months).alias("v"))
    return sums.join(balance, "node").select("g", "node", F.round(F.log1p(F.col("n").cast("double")), 6).alias("x"), F.round(F.log1p("price"), 6).alias("y"), "z", "v")


def yearly_likeness(spark: SparkSession, d: str) -> DataFrame:
    """``g, i, j, y``: the correlation of two nations' monthly order counts in a year."""
    long = yearly_profiles(spark, d).select("g", "node", F.posexplode("v").alias("month", "v"))
    a, b = (long.select("g", F.col("node").alias(k), "month", F.col("v").alias(f"v{k}")) for k in "ij")
    both = a.join(b, ["g", "month"]).filter("i < j")
    return both.groupBy("g", "i", "j").agg(F.corr("vi", "vj").alias("y"))


_YEARS = """
yt AS (SELECT year(o_orderdate) AS g, least(c_nationkey, s_nationkey) AS i, greatest(c_nationkey, s_nationkey) AS j, CAST(count(*) AS DOUBLE) AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
ya AS (SELECT g, i, j, w FROM yt UNION ALL SELECT g, j, i, w FROM yt),
ym AS (SELECT g, max(s) AS m FROM (SELECT g, i, sum(w) AS s FROM ya GROUP BY ALL) GROUP BY 1),
yb AS (SELECT ya.g, i, j, w / m AS w FROM ya JOIN ym ON ym.g = ya.g),
pw AS (SELECT DISTINCT g, i, CAST(1 AS DOUBLE) AS x, 0 AS k FROM yb UNION ALL SELECT pw.g, yb.j, sum(pw.x * yb.w), pw.k + 1 FROM pw JOIN yb ON yb.g = pw.g AND yb.i = pw.i WHERE pw.k < 100 GROUP BY pw.g, yb.j, pw.k),
nm AS (SELECT g, k, sqrt(sum(x * x)) AS s FROM pw WHERE k >= 99 GROUP BY ALL),
rho AS (SELECT ym.g, m * max(s) FILTER (k = 100) / max(s) FILTER (k = 99) AS radius FROM nm JOIN ym ON ym.g = nm.g GROUP BY ym.g, m),
yn AS (SELECT ya.g, i, j, w / radius AS w FROM ya JOIN rho ON rho.g = ya.g),
tm AS (SELECT DISTINCT g, i, i AS j, CAST(1 AS DOUBLE) AS c, 0 AS k FROM yn UNION ALL SELECT tm.g, tm.i, yn.j, sum(tm.c * yn.w) / (tm.k + 1), tm.k + 1 FROM tm JOIN yn ON yn.g = tm.g AND yn.i = tm.j WHERE tm.k < 20 GROUP BY tm.g, tm.i, yn.j, tm.k),
cm AS (SELECT g, i, j, sum(c) AS c FROM tm GROUP BY ALL)"""
_FEATURES = _YEARS + """,
pn AS (SELECT year(o_orderdate) AS g, c_nationkey AS node, count(*) AS n, sum(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pl AS (SELECT g, node, round(ln(1 + n), 6) AS x, round(ln(1 + price), 6) AS y, z FROM pn JOIN (SELECT c_nationkey, round(avg(c_acctbal) / 1000, 6) AS z FROM customer GROUP BY 1) ON c_nationkey = node),
st AS (SELECT g, i, j, 1 / w AS d FROM ya),
sp AS (SELECT g, i, j, d, 1 AS k FROM st UNION ALL SELECT sp.g, sp.i, st.j, min(sp.d + st.d), sp.k + 1 FROM sp JOIN st ON st.g = sp.g AND st.i = sp.j WHERE sp.k < 24 AND st.j <> sp.i GROUP BY sp.g, sp.i, st.j, sp.k),
ds AS (SELECT g, i, j, min(d) AS d FROM sp GROUP BY ALL),
fr AS (SELECT g, 2 * max(d) AS far FROM ds GROUP BY 1),
ft AS (SELECT a.g, a.node AS i, b.node AS j, coalesce(d, far, 0) AS shortest_path, coalesce(c, 0) AS communicability, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS euclidean
    FROM pl a JOIN pl b ON b.g = a.g AND a.node <> b.node LEFT JOIN ds ON ds.g = a.g AND ds.i = a.node AND ds.j = b.node LEFT JOIN fr ON fr.g = a.g LEFT JOIN cm ON cm.g = a.g AND cm.i = a.node AND cm.j = b.node)"""
_COUPLED = _FEATURES + """,
mo AS (SELECT p.g, p.node, m.month, count(o_orderkey) AS v FROM pn p, (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN (SELECT o_orderkey, year(o_orderdate) AS g, month(o_orderdate) AS month, c_nationkey AS node FROM orders JOIN customer ON o_custkey = c_custkey) o ON o.g = p.g AND o.node = p.node AND o.month = m.month GROUP BY ALL),
lk AS (SELECT a.g, a.node AS i, b.node AS j, corr(a.v, b.v) AS y FROM mo a JOIN mo b ON b.g = a.g AND b.month = a.month AND a.node <> b.node GROUP BY ALL),
rw AS (SELECT ft.g, ft.i AS node, shortest_path AS a, communicability AS b, euclidean AS c, y FROM ft JOIN lk ON lk.g = ft.g AND lk.i = ft.i AND lk.j = ft.j WHERE y IS NOT NULL AND NOT isnan(y)),
mm AS (SELECT g, node, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy, covar_pop(y, y) AS yy FROM rw GROUP BY ALL),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM mm),
be AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det AS b1, (aa * (byy * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det AS b2,
    (aa * (bb * cy - bc * byy) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS b3 FROM dt)"""

query("SELECT g, round(radius, 6) + 0.0 AS radius FROM rho", _YEARS, "spectral_radius")(lambda spark, d: rounded(co.spectral_radius(yearly_trade(spark, d)), "radius"))
query("SELECT g, i, j, round(c, 9) + 0.0 AS c FROM cm", _YEARS, "communicability")(lambda spark, d: rounded(co.communicability(yearly_trade(spark, d)), "c", digits=9))
_FEATURE_NAMES = ["shortest_path", "communicability", "euclidean"]


def _features(spark: SparkSession, d: str) -> DataFrame:
    return co.communication_features(yearly_trade(spark, d), yearly_profiles(spark, d))


query(f"SELECT g, i, j, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _FEATURE_NAMES)} FROM ft", _FEATURES, "communication_features")(lambda spark, d: rounded(_features(spark, d), *_FEATURE_NAMES))


def _coupling(spark: SparkSession, d: str) -> DataFrame:
    out = co.regional_coupling(_features(spark, d), yearly_likeness(spark, d))
    out = out.select("g", "node", "n", "coupling", *(F.col("betas")[k].alias(f"beta_{c}") for k, c in enumerate(_FEATURE_NAMES)))
    return rounded(out, "coupling", *(f"beta_{c}" for c in _FEATURE_NAMES), digits=4)


_on = lambda e, name: f"CASE WHEN n >= 6 THEN round({e}, 4) + 0.0 END AS {name}"
query(
    f"SELECT g, node, n, {_on('1 - (1 - (b1 * ay + b2 * byy + b3 * cy) / yy) * (n - 1) / (n - 4)', 'coupling')}, {', '.join(_on(f'b{k + 1}', f'beta_{c}') for k, c in enumerate(_FEATURE_NAMES))} FROM be",
    _COUPLED, "regional_coupling",
)(_coupling)

# ------------------------------------------------------------------ joint alignment

ROUNDS = 5


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """``subject, node, v``: two log measures of each nation's orders (node) in each year (subject)."""
    return yearly_profiles(spark, d).select(F.col("g").alias("subject"), "node", F.array("x", "y").alias("v"))


def _round_sql(k: int) -> str:
    """One round in two dimensions: the better of the best rotation and the best reflection, in closed form."""
    return f""",
q{k} AS (SELECT p.g, covar_pop(p.x, t.x) AS c1, covar_pop(p.x, t.y) AS c2, covar_pop(p.y, t.x) AS c3, covar_pop(p.y, t.y) AS c4, avg(p.x) AS px, avg(p.y) AS py, avg(t.x) AS tx, avg(t.y) AS ty FROM pl p JOIN t{k} t ON t.node = p.node GROUP BY 1),
r{k} AS (SELECT *, sqrt(pow(c1 + c4, 2) + pow(c2 - c3, 2)) AS u, sqrt(pow(c1 - c4, 2) + pow(c2 + c3, 2)) AS v FROM q{k}),
a{k} AS (SELECT p.g, p.node, CASE WHEN u >= v THEN ((p.x - px) * (c1 + c4) - (p.y - py) * (c2 - c3)) / u ELSE ((p.x - px) * (c1 - c4) + (p.y - py) * (c2 + c3)) / v END + tx AS x,
    CASE WHEN u >= v THEN ((p.x - px) * (c2 - c3) + (p.y - py) * (c1 + c4)) / u ELSE ((p.x - px) * (c2 + c3) - (p.y - py) * (c1 - c4)) / v END + ty AS y FROM pl p JOIN r{k} r ON r.g = p.g),
t{k + 1} AS (SELECT node, avg(x) AS x, avg(y) AS y FROM a{k} GROUP BY 1)"""


_PLACES = _FEATURES[_FEATURES.index("pn AS") : _FEATURES.index(",\nst AS")]
_ALIGNED = _PLACES + ",\nt0 AS (SELECT node, x, y FROM pl WHERE g = (SELECT min(g) FROM pl))" + "".join(_round_sql(k) for k in range(ROUNDS))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    out, _ = al.align_jointly(profiles(spark, d), 2, "mean", ROUNDS)
    return rounded(out.select("subject", "node", F.col("v")[0].alias("v1"), F.col("v")[1].alias("v2")), "v1", "v2")


query(f"SELECT g AS subject, node, round(x, 6) + 0.0 AS v1, round(y, 6) + 0.0 AS v2 FROM a{ROUNDS - 1}", _ALIGNED, "align_joint")(_aligned)
query(f"SELECT a.g AS subject, round(sqrt(avg(pow(a.x - t.x, 2) + pow(a.y - t.y, 2))), 6) + 0.0 AS rmse FROM a{ROUNDS - 1} a JOIN t{ROUNDS} t ON t.node = a.node GROUP BY 1", _ALIGNED, "align_joint_misfit")(
    lambda spark, d: rounded(al.misfit(*al.align_jointly(profiles(spark, d), 2, "mean", ROUNDS), 2), "rmse").select("subject", "rmse")
)


@query(name="group_gradients")
def _group_gradients(spark: SparkSession, d: str) -> DataFrame:
    """Three diffusion gradients of each year's trade graph, aligned jointly, and their fit to the common template."""
    found = kr.per_node(yearly_trade(spark, d), ["a", "b", "c"], lambda w: nw.diffusion_map(nw.affinity(w, 50), 3)[0])
    found = found.select(F.col("g").alias("subject"), "node", F.array("a", "b", "c").alias("v"))
    return rounded(al.misfit(*al.align_jointly(found, 3), 3), "rmse", "r", digits=4)


# ------------------------------------------------------------------ permuted modules, strengths kept

PERMUTATIONS, NULLS = 1000, 100  # the reference's counts
_PERMUTED = _COUPLED + f""",
pe AS (SELECT yt.g, yt.i, yt.j, w AS x, y FROM yt JOIN lk ON lk.g = yt.g AND lk.i = yt.i AND lk.j = yt.j WHERE y IS NOT NULL AND NOT isnan(y)),
nd AS (SELECT g, node, n_regionkey AS module, row_number() OVER (PARTITION BY g ORDER BY node) AS place FROM (SELECT g, i AS node FROM pe UNION SELECT g, j FROM pe) JOIN nation ON n_nationkey = node),
rp AS (SELECT unnest(range(0, {PERMUTATIONS + 1})) AS replicate),
pm AS (SELECT g, node, replicate, row_number() OVER (PARTITION BY g, replicate ORDER BY CASE WHEN replicate > 0 THEN md5(concat_ws(':', g, node, replicate)) END, node) AS place FROM nd, rp),
lb AS (SELECT pm.g, pm.node, pm.replicate, nd.module FROM pm JOIN nd ON nd.g = pm.g AND nd.place = pm.place),
rr AS (SELECT pe.g, a.replicate, a.module, corr(x, y) AS r FROM pe JOIN lb a ON a.g = pe.g AND a.node = pe.i JOIN lb b ON b.g = pe.g AND b.node = pe.j AND b.replicate = a.replicate AND b.module = a.module GROUP BY ALL HAVING count(*) >= 3 AND var_pop(x) > 1e-12 AND var_pop(y) > 1e-12),
rm AS (SELECT module, replicate, avg(r) AS r, count(*) AS subjects FROM rr GROUP BY ALL),
rs AS (SELECT n.module, o.subjects, o.r, avg(n.r) AS null_mean, stddev_pop(n.r) AS null_sd, avg(CAST(n.r >= o.r - 1e-12 AS DOUBLE)) AS p FROM rm n JOIN rm o ON o.module = n.module AND o.replicate = 0 WHERE n.replicate > 0 GROUP BY n.module, o.subjects, o.r)"""


def _permuted(spark: SparkSession, d: str) -> DataFrame:
    likeness = yearly_likeness(spark, d)
    edges = yearly_trade(spark, d).join(likeness, ["g", "i", "j"]).select(F.col("g").alias("subject"), "i", "j", F.col("w").alias("x"), "y")
    return rounded(lb.coupling_test(edges, modules(spark, d), PERMUTATIONS), "r", "null_mean", "null_sd", "z", "p", digits=5)


query("SELECT module, subjects, round(r, 5) + 0.0 AS r, round(null_mean, 5) + 0.0 AS null_mean, round(null_sd, 5) + 0.0 AS null_sd, round((r - null_mean) / greatest(null_sd, 1e-8), 5) + 0.0 AS z, round(p, 5) + 0.0 AS p FROM rs", _PERMUTED, "coupling_label_permutation")(_permuted)


@query(name="strength_preserving_null")
def _strengths(spark: SparkSession, d: str) -> DataFrame:
    """Radius and spread of weights of each year's trade graph, and of graphs whose weights moved round cycles with all strengths kept."""
    g = yearly_trade(spark, d)
    kernel = lambda w: [(float(np.linalg.eigvalsh(w)[-1]), float(w[w > 0].std()), float(np.ptp(w.sum(0))))]
    own = kr.graph_rows(g, "radius double, spread double, strength_range double", kernel)
    nulls = kr.null_rows(g, NULLS, "null_radius double, null_spread double, null_range double", kernel, nw.strength_preserving, 6)
    summary = nulls.groupBy("g").agg(*(f(c).alias(c + e) for c in ("null_radius", "null_spread") for f, e in ((F.avg, ""), (F.stddev_pop, "_sd"))), F.max("null_range").alias("null_range"), F.count(F.lit(1)).alias("replicates"))
    return own.join(summary, "g")
