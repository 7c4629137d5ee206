"""Queries of paths, point processes, permutations, harmonisation, null models and reservoirs, with SQL where it can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.operators import cohort as co
from cohortweave.operators import criticality as cr
from cohortweave.operators import groups as st
from cohortweave.operators import kernels as kr
from cohortweave.operators import paths as pa
from cohortweave.operators import pointprocess as pp
from cohortweave.operators import series as se
from cohortweave.plans.bindings import METRICS, TRADE, layers, metrics, series, table, trade_graph
from cohortweave.plans.catalogue import FC, TS, query, rounded
from cohortweave.plans.more import _MANY, _many

THR = 1.5
PERMUTATIONS, NBS_PERMUTATIONS, NULLS, GOF = 10_000, 5000, 100, 1000

# ------------------------------------------------------------------------- paths


def _distances_sql(cost: str) -> str:
    """Distances ``dd(i, j, d)`` of the trade graph by repeated min-plus products: paths of up to 32 steps, more than its nodes."""
    steps = [f"sp AS (SELECT i, j, {cost} AS c FROM arcs), d0 AS (SELECT i, j, c AS d FROM sp)"]
    for k in range(1, 6):
        steps.append(f"d{k} AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM d{k - 1} UNION ALL SELECT x.i, y.j, x.d + y.d FROM d{k - 1} x JOIN d{k - 1} y ON x.j = y.i WHERE x.i <> y.j) GROUP BY ALL)")
    return TRADE + ", " + ", ".join(steps) + ", dd AS (SELECT * FROM d5), nn AS (SELECT count(*) AS n FROM deg)"


_HOP, _LONG = _distances_sql("CAST(1 AS DOUBLE)"), _distances_sql("1.0 / w")
_SIGMA = """, sg AS (SELECT sp.i AS s, sp.j AS v, CAST(1 AS DOUBLE) AS k FROM sp JOIN dd ON dd.i = sp.i AND dd.j = sp.j AND abs(dd.d - sp.c) < 1e-9
    UNION ALL SELECT sg.s, sp.j, sum(sg.k) FROM sg JOIN sp ON sp.i = sg.v AND sp.j <> sg.s JOIN dd x ON x.i = sg.s AND x.j = sg.v JOIN dd y ON y.i = sg.s AND y.j = sp.j WHERE abs(x.d + sp.c - y.d) < 1e-9 GROUP BY sg.s, sp.j),
sm AS (SELECT s, v, sum(k) AS k FROM sg GROUP BY ALL),
bt AS (SELECT x.v AS node, sum(x.k * y.k / z.k) AS b FROM sm x JOIN sm y ON y.s = x.v AND y.v <> x.s JOIN sm z ON z.s = x.s AND z.v = y.v JOIN dd p ON p.i = x.s AND p.j = x.v JOIN dd q ON q.i = x.v AND q.j = y.v JOIN dd r ON r.i = x.s AND r.j = y.v WHERE abs(p.d + q.d - r.d) < 1e-9 GROUP BY 1)"""

query("SELECT 0 AS g, i, j, CAST(d AS INTEGER) AS hops FROM dd", _HOP, "hop_path_length")(lambda spark, d: pa.lengths(trade_graph(spark, d)).select("g", "i", "j", F.col("d").cast("int").alias("hops")))
query("SELECT 0 AS g, i, j, round(d, 9) + 0.0 AS d FROM dd", _LONG, "weighted_path_length")(lambda spark, d: rounded(pa.lengths(trade_graph(spark, d), True), "d", digits=9))
for _name, _ctes, _weighted in (("global_efficiency", _HOP, False), ("global_efficiency_weighted", _LONG, True)):
    query("SELECT 0 AS g, round(avg(d), 9) + 0.0 AS path_length, round(sum(1.0 / d) / (SELECT n * (n - 1) FROM nn), 6) + 0.0 AS efficiency, round(max(d), 9) + 0.0 AS diameter, count(*) AS reached FROM dd", _ctes, _name)(lambda spark, d, w=_weighted: rounded(rounded(pa.path_summary(trade_graph(spark, d), w), "efficiency"), "path_length", "diameter", digits=9))
for _name, _ctes, _weighted in (("closeness", _HOP, False), ("closeness_weighted", _LONG, True)):
    query("SELECT 0 AS g, i AS node, round(count(*) / sum(d) * count(*) / (SELECT n - 1 FROM nn), 6) + 0.0 AS closeness FROM dd GROUP BY i", _ctes, _name)(lambda spark, d, w=_weighted: rounded(pa.closeness(trade_graph(spark, d), w), "closeness"))
for _name, _ctes, _weighted in (("nodal_efficiency", _HOP, False), ("nodal_efficiency_weighted", _LONG, True)):
    query("SELECT 0 AS g, i AS node, round(sum(1.0 / d) / (SELECT n - 1 FROM nn), 6) + 0.0 AS efficiency FROM dd GROUP BY i", _ctes, _name)(lambda spark, d, w=_weighted: rounded(pa.nodal_efficiency(trade_graph(spark, d), w), "efficiency"))
for _name, _ctes, _kernel in (("betweenness", _HOP, nw.betweenness), ("betweenness_weighted", _LONG, nw.betweenness_weighted)):
    query("SELECT 0 AS g, deg.node, round(coalesce(b, 0) / (SELECT (n - 1) * (n - 2) FROM nn), 6) + 0.0 AS betweenness FROM deg LEFT JOIN bt ON bt.node = deg.node", _ctes + _SIGMA, _name)(lambda spark, d, f=_kernel: rounded(kr.per_node(trade_graph(spark, d), ["betweenness"], f), "betweenness"))
query(
    "SELECT 0 AS g, node, round(x, 6) + 0.0 AS pagerank FROM pr WHERE step = 100",
    TRADE + ", nn AS (SELECT count(*) AS n FROM deg), pr AS (SELECT 0 AS step, node, 1.0 / n AS x FROM deg, nn UNION ALL SELECT pr.step + 1, a.j, 0.15 / max(n) + 0.85 * sum(pr.x * a.w / s.strength) FROM pr JOIN arcs a ON a.i = pr.node JOIN deg s ON s.node = a.i, nn WHERE pr.step < 100 GROUP BY pr.step, a.j)",
    "pagerank",
)(lambda spark, d: rounded(kr.per_node(trade_graph(spark, d), ["pagerank"], nw.pagerank), "pagerank"))

# --------------------------------------------------------------- point processes

EVENTS = TS + f", ev AS (SELECT *, CASE WHEN abs(z) > {THR} THEN 1 ELSE 0 END AS event FROM z)"


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return cr.raster(series(spark, d), THR)


query(
    "SELECT subject, round(avg(r), 6) + 0.0 AS mean_r, round(stddev_pop(r), 6) + 0.0 AS sd_r, round(max(n) * var_pop(r), 6) + 0.0 AS susceptibility FROM (SELECT subject, t, count(*) AS n, sqrt(pow(avg(cos(pi() * event)), 2) + pow(avg(sin(pi() * event)), 2)) AS r FROM ev GROUP BY ALL) GROUP BY 1",
    EVENTS, "order_kuramoto",
)(lambda spark, d: rounded(pp.kuramoto(_raster(spark, d)), "mean_r", "sd_r", "susceptibility"))
query(
    "SELECT f.subject, f.t, f.density, round(sm.x, 6) + 0.0 AS smoothed, round(f.spread, 4) + 0.0 AS spread FROM f JOIN sm ON sm.subject = f.subject AND sm.t = f.t",
    EVENTS + """, f AS (SELECT subject, t, CAST(sum(event) AS DOUBLE) AS density, var_pop(v) AS spread FROM ev GROUP BY ALL), nt AS (SELECT subject, max(t) + 1 AS n FROM f GROUP BY 1),
ks AS (SELECT k, exp(-k * k / 18.0) / sum(exp(-k * k / 18.0)) OVER () AS w FROM (SELECT unnest(range(-12, 13)) AS k)),
wt AS (SELECT f.subject, f.t, w, (((f.t + k) % (2 * n)) + 2 * n) % (2 * n) AS pos, n FROM f JOIN nt ON nt.subject = f.subject, ks),
sm AS (SELECT wt.subject, wt.t, sum(w * src.density) AS x FROM wt JOIN f src ON src.subject = wt.subject AND src.t = CASE WHEN pos < n THEN pos ELSE 2 * n - 1 - pos END GROUP BY ALL)""",
    "control_parameter",
)(lambda spark, d: rounded(rounded(pp.control_parameter(_raster(spark, d)), "smoothed"), "spread", digits=4))
query(
    "SELECT subject, component, count(*) AS size, min(t) AS start_t, max(t) - min(t) + 1 AS duration FROM (SELECT subject, node, t, min(c) AS component FROM rc GROUP BY ALL) GROUP BY ALL",
    FC + f""", ev AS (SELECT *, CASE WHEN abs(z) > {THR} THEN 1 ELSE 0 END AS event FROM z),
hit AS (SELECT subject, t, roi, lpad(CAST(t AS VARCHAR), 10, '0') || ':' || roi AS node FROM ev WHERE event = 1),
adj AS (SELECT subject, i, j FROM fc WHERE w > 0.02 UNION SELECT subject, j, i FROM fc WHERE w > 0.02),
lk AS (SELECT a.subject, a.node AS a, b.node AS b, b.t FROM hit a JOIN hit b ON a.subject = b.subject AND abs(a.t - b.t) <= 1 AND a.node <> b.node WHERE a.roi = b.roi OR EXISTS (SELECT 1 FROM adj WHERE adj.subject = a.subject AND adj.i = a.roi AND adj.j = b.roi)),
rc AS (SELECT subject, node, t, node AS c FROM hit UNION SELECT lk.subject, lk.b, lk.t, rc.c FROM rc JOIN lk ON lk.subject = rc.subject AND lk.a = rc.node)""",
    "st_clusters",
)(lambda spark, d: pp.st_clusters(_raster(spark, d), se.correlation(series(spark, d)).filter("w > 0.02")))
_SIZES = EVENTS + """, act AS (SELECT subject, t, sum(event) AS act FROM ev GROUP BY ALL), isl AS (SELECT *, t - row_number() OVER (PARTITION BY subject ORDER BY t) AS island FROM act WHERE act > 0),
av AS (SELECT subject, CAST(sum(act) AS DOUBLE) AS x FROM isl GROUP BY subject, island), cn AS (SELECT subject, x, count(*) AS c FROM av GROUP BY ALL),
rk AS (SELECT *, row_number() OVER p AS place, sum(c) OVER p AS tail FROM cn WINDOW p AS (PARTITION BY subject ORDER BY x DESC)),
cd AS (SELECT subject, x AS xmin, tail AS n FROM rk WHERE place > 2 AND tail >= 5),
tl AS (SELECT cd.subject, xmin, n, x, c FROM cd JOIN cn ON cn.subject = cd.subject AND x >= xmin),
al AS (SELECT subject, xmin, 1 + max(n) / sum(c * ln(x / (xmin - 0.5))) AS alpha FROM tl GROUP BY subject, xmin),
kd AS (SELECT subject, xmin, n, alpha, max(greatest(abs(u / n - f), abs((u - c + 1) / n - f))) AS ks FROM (SELECT tl.*, alpha, sum(c) OVER (PARTITION BY tl.subject, tl.xmin ORDER BY x) AS u, greatest(0, least(1, 1 - pow(x / tl.xmin, 1 - alpha))) AS f FROM tl JOIN al ON al.subject = tl.subject AND al.xmin = tl.xmin) GROUP BY ALL)"""


def _fit(spark: SparkSession, d: str) -> DataFrame:
    return pp.powerlaw_xmin(cr.avalanches(cr.activity(_raster(spark, d))), "size", "subject")


query(
    "SELECT subject, xmin, round(alpha, 6) + 0.0 AS alpha, round(ks, 6) + 0.0 AS ks, CAST(n AS BIGINT) AS n_tail, round((alpha - 1) / sqrt(n), 6) + 0.0 AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(ks, 12), xmin) AS r FROM kd) WHERE r = 1",
    _SIZES, "powerlaw_xmin",
)(lambda spark, d: rounded(_fit(spark, d), "alpha", "ks", "sigma"))


def tail_distance(x: np.ndarray, least_tail: int = 5) -> tuple[float, float, float]:
    """``xmin, alpha, ks`` of the same choice of the cut, for one sample."""
    values, counts = np.unique(x, return_counts=True)
    best = (np.nan, np.nan, np.inf)
    for k in range(len(values) - 2):
        v, c = values[k:], counts[k:]
        n = c.sum()
        if n < least_tail:
            continue
        alpha = 1 + n / (c * np.log(v / (v[0] - 0.5))).sum()
        fit, upto = np.clip(1 - (v / v[0]) ** (1 - alpha), 0, 1), np.cumsum(c)
        ks = max(np.abs(upto / n - fit).max(), np.abs((upto - c + 1) / n - fit).max())
        if ks < best[2] - 1e-12:
            best = (float(v[0]), float(alpha), float(ks))
    return best


@query(name="powerlaw_gof")
def _gof(spark: SparkSession, d: str) -> DataFrame:
    """p of the fitted power law: the share of synthetic samples (power-law tail, resampled body) that lie farther from their own fit."""
    av = cr.avalanches(cr.activity(_raster(spark, d)))
    packed = av.groupBy("subject").agg(F.sort_array(F.collect_list(F.col("size").cast("double"))).alias("x")).join(_fit(spark, d), "subject")
    work = kr.replicates(packed, GOF, "subject").repartition("subject", "replicate")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            far = []
            for x, xmin, alpha, ks, seed in zip(b["x"], b["xmin"], b["alpha"], b["ks"], b["seed"], strict=True):
                rng, x = np.random.default_rng(seed), np.asarray(x, float)  # noqa: PLW2901
                body = x[x < xmin]
                tail = rng.random(len(x)) < (x >= xmin).mean()
                fake = np.floor((xmin - 0.5) * (1 - rng.random(len(x))) ** (-1 / (alpha - 1)) + 0.5)
                if len(body):
                    fake = np.where(tail, fake, rng.choice(body, len(x)))
                far.append(tail_distance(np.minimum(fake, 1e12))[2] >= ks)
            yield b[["subject"]].assign(far=np.asarray(far, float))

    kind = packed.schema["subject"].dataType.simpleString()
    hits = work.mapInPandas(run, f"subject {kind}, far double")
    return hits.groupBy("subject").agg(F.avg("far").alias("p"), F.count(F.lit(1)).alias("replicates"))


_REHO = FC + ", bw AS (SELECT subject, i, j, w FROM fc UNION ALL SELECT subject, j, i, w FROM fc), ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, i ORDER BY w DESC, j) AS r FROM bw) WHERE r <= 3)"
query(
    "SELECT subject, i AS roi, round(avg(tau), 6) + 0.0 AS reho FROM (SELECT ch.subject, ch.i, ch.j, sum(sign(x.v - p.v) * sign(y.v - q.v)) / sqrt(sum(abs(sign(x.v - p.v))) * sum(abs(sign(y.v - q.v)))) AS tau FROM ch JOIN ts x ON x.subject = ch.subject AND x.roi = ch.i JOIN ts y ON y.subject = ch.subject AND y.roi = ch.j AND y.t = x.t JOIN ts p ON p.subject = ch.subject AND p.roi = ch.i AND p.t < x.t JOIN ts q ON q.subject = ch.subject AND q.roi = ch.j AND q.t = p.t GROUP BY ALL) GROUP BY ALL",
    _REHO, "reho",
)(lambda spark, d: rounded(co.neighbour_concordance(se.correlation(series(spark, d)), series(spark, d), 3), "reho"))

# ---------------------------------------------------------------- cohort statistics


def _places(ts: DataFrame) -> DataFrame:
    """Places of channels on a curve, by their order (channels are few by design)."""
    k = (F.row_number().over(Window.orderBy("roi")) - 1).cast("double")
    return ts.select("roi").distinct().select("roi", k.alias("x"), (k * k / 10).alias("y"), F.lit(0.0).alias("z"))


def _distance_dependence(spark: SparkSession, d: str) -> DataFrame:
    ts = _many(spark, d)
    motion = ts.groupBy("subject").agg(F.avg("v").alias("motion"))
    r = se.correlation(ts).join(motion, "subject").groupBy("i", "j").agg(F.corr("w", "motion").alias("r"))
    return co.distance_dependence(r, _places(ts), "r")


query(
    "SELECT round(rho, 6) + 0.0 AS rho, n, abs(rho) < 0.1 AS passed FROM (SELECT corr(ra, rb) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS ra, rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS rb FROM er))",
    _MANY + """, pl AS (SELECT roi, k, k * k / 10 AS y FROM (SELECT roi, CAST(row_number() OVER (ORDER BY roi) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT roi FROM ts))),
er AS (SELECT abs(corr(w, motion)) AS r, sqrt(pow(max(a.k) - max(b.k), 2) + pow(max(a.y) - max(b.y), 2)) AS dist FROM fc JOIN (SELECT subject AS s, avg(v) AS motion FROM ts GROUP BY 1) ON s = subject JOIN pl a ON a.roi = i JOIN pl b ON b.roi = j GROUP BY i, j)""",
    "qc_fc_distance",
)(lambda spark, d: rounded(_distance_dependence(spark, d), "rho"))


def _dependent(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_discount").alias("xy"), F.corr("l_quantity", "l_tax").alias("xz"), F.corr("l_discount", "l_tax").alias("yz"), F.count(F.lit(1)).alias("n"))
    return r.select("l_returnflag", "n", co.dependent_z(F.col("xy"), F.col("xz"), F.col("yz"), F.col("n")).alias("z"))


query(
    "SELECT l_returnflag, n, round((atanh(xy) - atanh(xz)) / sqrt(2 * (1 - yz) * ((1 - f * m2) / (1 - m2)) / (n - 3)), 5) + 0.0 AS z FROM (SELECT *, greatest((1 - yz) / (2 * (1 - m2)), 0) AS f FROM (SELECT *, pow((xy + xz) / 2, 2) AS m2 FROM (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_discount) AS xy, corr(l_quantity, l_tax) AS xz, corr(l_discount, l_tax) AS yz FROM lineitem GROUP BY 1)))",
    name="steiger_z",
)(lambda spark, d: rounded(_dependent(spark, d), "z", digits=5))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("y"))
    return c.join(s, "id").select(F.lit("balance").alias("metric"), "id", F.round(F.col("x") - F.col("y"), 6).alias("gap"))


_FLIPS = "gp AS (SELECT c_nationkey AS id, round(x - y, 6) AS gap FROM (SELECT c_nationkey, avg(c_acctbal) AS x FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, avg(s_acctbal) AS y FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey), cu AS (SELECT c_mktsegment AS seg, c_nationkey AS id, round(avg(c_acctbal) - 4500, 6) AS gap FROM customer GROUP BY ALL)"
_FLIP = "SELECT {by}, round(max(o), 6) + 0.0 AS observed, round(greatest(sum(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1 ELSE 0 END) / 10000, 1 / 10001), 6) + 0.0 AS p, count(*) AS replicates FROM (SELECT {key}, r, avg(CASE WHEN substr(md5(CAST(id AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 1) < '8' THEN gap ELSE -gap END) AS m FROM {t}, (SELECT unnest(range(1, 10001)) AS r) GROUP BY ALL) JOIN (SELECT {key} AS k2, avg(gap) AS o FROM {t} GROUP BY ALL) ON k2 = {name} GROUP BY {name}"
query(_FLIP.format(by="'balance' AS metric", key="'balance' AS seg", name="seg", t="gp").replace("'balance' AS seg AS k2", "'balance' AS k2"), _FLIPS, "perm_paired")(lambda spark, d: rounded(co.sign_flips(_gaps(spark, d), "gap", PERMUTATIONS, "metric"), "observed", "p"))
query(_FLIP.format(by="seg", key="seg", name="seg", t="cu"), _FLIPS, "perm_onesample")(
    lambda spark, d: rounded(co.sign_flips(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal") - 4500, 6).alias("gap")), "gap", PERMUTATIONS, "seg"), "observed", "p")
)


@query(name="nbs_perm")
def _nbs_perm(spark: SparkSession, d: str) -> DataFrame:
    ts = _many(spark, d)
    subjects = ts.select("subject").distinct().withColumn("first", F.col("subject") % 2 == 0)
    return co.nbs(se.correlation(ts), subjects, 0.5, NBS_PERMUTATIONS)


def _harmonised(spark: SparkSession, d: str, pooled: bool) -> DataFrame:
    return rounded(co.combat(metrics(spark, d), "value", "site", "metric", pooled), "harmonized", digits=3).select("subject", "metric", "harmonized")


_COMBAT = METRICS + """, bm AS (SELECT *, avg(value) OVER (PARTITION BY metric, site) AS b FROM m), sd AS (SELECT metric, avg(value) AS a, sqrt(avg(pow(value - b, 2))) AS s FROM bm GROUP BY 1),
zz AS (SELECT subject, site, m.metric, value, a, s, (value - a) / s AS z FROM m JOIN sd ON sd.metric = m.metric),
es AS (SELECT metric, site, count(*) AS n, avg(z) AS g, var_samp(z) AS d, sum(z) AS s1, sum(z * z) AS s2 FROM zz GROUP BY ALL)"""
query("SELECT subject, zz.metric, round((z - g) / sqrt(d) * s + a, 3) + 0.0 AS harmonized FROM zz JOIN es ON es.metric = zz.metric AND es.site = zz.site", _COMBAT, "combat_plain")(lambda spark, d: _harmonised(spark, d, False))
query(
    "SELECT subject, zz.metric, round((z - it.g) / sqrt(it.d) * s + a, 3) + 0.0 AS harmonized FROM zz JOIN it ON it.metric = zz.metric AND it.site = zz.site AND step = 100",
    _COMBAT + """, pr AS (SELECT site, gbar, t2, (2 * v + m * m) / v AS a, (m * v + pow(m, 3)) / v AS b FROM (SELECT site, avg(g) AS gbar, var_samp(g) AS t2, avg(d) AS m, var_samp(d) AS v FROM es GROUP BY 1)),
it AS (SELECT 0 AS step, metric, site, g, d FROM es UNION ALL SELECT step + 1, metric, site, gn, (b + 0.5 * (s2 - 2 * gn * s1 + n * gn * gn)) / (n / 2 + a - 1)
    FROM (SELECT it.step, it.metric, it.site, es.n, s1, s2, pr.a, pr.b, (t2 * es.n * es.g + it.d * gbar) / (t2 * es.n + it.d) AS gn FROM it JOIN es ON es.metric = it.metric AND es.site = it.site JOIN pr ON pr.site = it.site WHERE it.step < 100))""",
    "combat",
)(lambda spark, d: _harmonised(spark, d, True))


def _before_after(spark: SparkSession, d: str) -> DataFrame:
    m = st.harmonize(metrics(spark, d).filter("metric = 'balance'"), "value", "site")
    out = None
    for name, column in (("original", "value"), ("harmonized", "harmonized")):
        t = st.t_statistics(st.two_groups(m, column, "grp", "BUILDING", "MACHINERY", "metric")).select("metric", (F.col("m1") - F.col("m2")).alias(f"diff_{name}"), F.col("t_student").alias(f"t_{name}"))
        out = t if out is None else out.join(t, "metric")
    return out.withColumn("preserved", F.signum("diff_original") == F.signum("diff_harmonized"))


_T = "(avg({v}) FILTER (grp = 'BUILDING') - avg({v}) FILTER (grp = 'MACHINERY'))"
_POOL = "sqrt(((count(*) FILTER (grp = 'BUILDING') - 1) * var_samp({v}) FILTER (grp = 'BUILDING') + (count(*) FILTER (grp = 'MACHINERY') - 1) * var_samp({v}) FILTER (grp = 'MACHINERY')) / (count(*) FILTER (grp IN ('BUILDING', 'MACHINERY')) - 2) * (1.0 / count(*) FILTER (grp = 'BUILDING') + 1.0 / count(*) FILTER (grp = 'MACHINERY')))"
query(
    f"SELECT 'balance' AS metric, round({_T.format(v='balance')}, 4) + 0.0 AS diff_original, round({_T.format(v='balance')} / {_POOL.format(v='balance')}, 5) + 0.0 AS t_original, round({_T.format(v='h')}, 4) + 0.0 AS diff_harmonized, round({_T.format(v='h')} / {_POOL.format(v='h')}, 5) + 0.0 AS t_harmonized, sign({_T.format(v='balance')}) = sign({_T.format(v='h')}) AS preserved FROM hm",
    METRICS + ", hm AS (SELECT grp, balance, coalesce((balance - avg(balance) OVER p) / nullif(stddev_samp(balance) OVER p, 0), 0) * (SELECT stddev_samp(balance) FROM x) + (SELECT avg(balance) FROM x) AS h FROM x WINDOW p AS (PARTITION BY site))",
    "before_after",
)(lambda spark, d: rounded(rounded(_before_after(spark, d), "diff_original", "diff_harmonized", digits=4), "t_original", "t_harmonized", digits=5))

_CHECKED = ("c_acctbal", "c_nationkey", "n_orders")


def _controls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return co.validation(table(spark, d, "customer").join(o, "c_custkey", "left"), *_CHECKED)


query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, max({c}) > 1.5 OR min({c}) < -0.5 AS suspicious FROM cc" for c in _CHECKED),
    "cc AS (SELECT * FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey)",
    "control_validation",
)(_controls)


def _shares(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy((F.col("user_id") % 12).alias("subject"), F.col("event_type").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("s"), F.sum("value").alias("f"))
    w = Window.partitionBy("subject")
    x = e.select("subject", "node", (F.col("s") / F.max("s").over(w)).alias("s"), (F.col("f") / F.max("f").over(w)).alias("f"))
    return x.select("subject", "node", F.round(F.abs(F.col("f") - F.col("s")) / (F.col("f") + F.col("s") + 1e-10), 9).alias("d"))


query(
    "SELECT node, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY d DESC, node) AS r FROM (SELECT subject, node, round(abs(f - s) / (f + s + 1e-10), 9) AS d FROM (SELECT subject, node, s / max(s) OVER p AS s, f / max(f) OVER p AS f FROM (SELECT user_id % 12 AS subject, event_type AS node, CAST(count(*) AS DOUBLE) AS s, sum(value) AS f FROM events GROUP BY ALL) WINDOW p AS (PARTITION BY subject)))) WHERE r <= 2 GROUP BY 1",
    name="decoupling_topk_frequency",
)(lambda spark, d: co.top_frequency(_shares(spark, d), "subject", "node", "d", 2))


def _components(spark: SparkSession, d: str, first: int) -> DataFrame:
    """Three components of a node table: here dimensions of the embeddings."""
    parts = F.array(*[F.struct(F.lit(k).alias("component"), F.col("embedding")[first + k].cast("double").alias("v")) for k in range(3)])
    return table(spark, d, "embeddings").select("vec_id", F.explode(parts).alias("x")).select("vec_id", "x.component", "x.v")


_GS = ["mean_v", "sd_v", "min_v", "max_v", "skew_v", "kurt_v", "iqr_v", "range_v", "bimodality"]
_DIMS = "dm AS (SELECT vec_id, k AS component, CAST(embedding[k + 1] AS DOUBLE) AS v, CAST(embedding[k + 4] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(0, 3)) AS k))"
query(
    "SELECT CAST(component AS INTEGER) AS component, n, round(mu, 5) + 0.0 AS mean_v, round(sd, 5) + 0.0 AS sd_v, round(lo, 5) + 0.0 AS min_v, round(hi, 5) + 0.0 AS max_v, round(sk, 5) + 0.0 AS skew_v, round(ku, 5) + 0.0 AS kurt_v, round(iqr, 5) + 0.0 AS iqr_v, round(hi - lo, 5) + 0.0 AS range_v, round((sk * sk + 1) / (ku + 3), 5) + 0.0 AS bimodality FROM (SELECT component, count(*) AS n, any_value(mu) AS mu, any_value(sd) AS sd, min(v) AS lo, max(v) AS hi, avg(pow((v - mu) / sd, 3)) AS sk, avg(pow((v - mu) / sd, 4)) - 3 AS ku, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT *, avg(v) OVER p AS mu, stddev_pop(v) OVER p AS sd FROM dm WINDOW p AS (PARTITION BY component)) GROUP BY component)",
    _DIMS, "gradient_stats",
)(lambda spark, d: rounded(co.component_stats(_components(spark, d, 0), "component", "v"), *_GS, digits=5))
query("SELECT CAST(component AS INTEGER) AS component, round(corr(v, u), 6) + 0.0 AS r, count(*) AS n FROM dm GROUP BY 1", _DIMS, "gradient_correlation")(
    lambda spark, d: rounded(_components(spark, d, 0).join(_components(spark, d, 3).withColumnRenamed("v", "u"), ["vec_id", "component"]).groupBy("component").agg(F.corr("v", "u").alias("r"), F.count(F.lit(1)).alias("n")), "r")
)


def _altered(spark: SparkSession, d: str) -> DataFrame:
    """Mean relative difference of the two layers' normalised weights within each module."""
    x = layers(spark, d)
    top = x.groupBy("g").agg(F.max("w").alias("top"))
    wide = x.join(F.broadcast(top), "g").groupBy("i", "j").pivot("g", [0, 1]).agg(F.first(F.col("w") / F.col("top")))
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("module"))
    inside = wide.join(own.withColumnRenamed("k", "i"), "i").join(own.select(F.col("k").alias("j"), F.col("module").alias("other")), "j").filter("module = other")
    change = inside.groupBy("module").agg(((F.avg("0") - F.avg("1")) / F.avg("1")).alias("change"))
    return change.withColumn("status", F.when(F.col("change") > 0.1, "hyper").when(F.col("change") < -0.1, "hypo").otherwise("normal"))


query(
    "SELECT module, round(change, 6) + 0.0 AS change, CASE WHEN change > 0.1 THEN 'hyper' WHEN change < -0.1 THEN 'hypo' ELSE 'normal' END AS status FROM (SELECT x.module, (avg(n / tn) - avg(revenue / tr)) / avg(revenue / tr) AS change FROM trade, (SELECT max(n) AS tn, max(revenue) AS tr FROM trade), modules x, modules y WHERE x.node = i AND y.node = j AND x.module = y.module GROUP BY 1)",
    TRADE, "altered_networks",
)(lambda spark, d: rounded(_altered(spark, d), "change"))
query("SELECT user_id AS subject FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 100", name="subjects_in_both")(
    lambda spark, d: table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("subject")).intersect(table(spark, d, "events").filter("value > 100").select("user_id"))
)
query("SELECT c_custkey AS subject FROM customer EXCEPT SELECT o_custkey FROM orders", name="subjects_without")(lambda spark, d: table(spark, d, "customer").select(F.col("c_custkey").alias("subject")).subtract(table(spark, d, "orders").select("o_custkey")))
query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS status_f, CAST(o_orderstatus = 'O' AS INTEGER) AS status_o, CAST(o_orderstatus = 'P' AS INTEGER) AS status_p FROM orders", name="one_hot")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == s).cast("int").alias(f"status_{s.lower()}") for s in "FOP"])
)
query(
    "SELECT round(f * (k - 1) / (f * (k - 1) + n - k), 6) + 0.0 AS partial_eta_squared FROM (SELECT k, n, (sb / (k - 1)) / (sw / (n - k)) AS f FROM (SELECT count(*) AS k, sum(c) AS n, sum(c * pow(mg - mm, 2)) AS sb, sum(q) AS sw FROM (SELECT grp, count(*) AS c, avg(balance) AS mg, var_pop(balance) * count(*) AS q FROM x GROUP BY 1), (SELECT avg(balance) AS mm FROM x)))",
    METRICS, "partial_eta_squared",
)(lambda spark, d: rounded(_partial_eta(spark, d), "partial_eta_squared"))


def _partial_eta(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).filter("metric = 'balance'")
    size = m.agg((F.count_distinct("grp") - 1).alias("df1"), (F.count(F.lit(1)) - F.count_distinct("grp")).alias("df2"))
    x = st.eta_squared(m, "value", "grp").join(size, how="cross")
    return x.select((F.col("f_ratio") * F.col("df1") / (F.col("f_ratio") * F.col("df1") + F.col("df2"))).alias("partial_eta_squared"))


# --------------------------------------------------------- null models and reservoirs


@query(name="norm_rich_club")
def _rich(spark: SparkSession, d: str) -> DataFrame:
    """Rich-club density over that of rewired graphs, by degree; p: the share of them that have as much."""
    g = trade_graph(spark, d)
    own = kr.graph_rows(g, "k int, phi double", nw.rich_club)
    null = kr.null_rows(g, NULLS, "k int, value double", nw.rich_club, salt=3)
    x = null.join(own, ["g", "k"]).groupBy("g", "k", "phi").agg(F.avg("value").alias("phi_null"), F.avg((F.col("value") >= F.col("phi")).cast("double")).alias("p"), F.count(F.lit(1)).alias("replicates"))
    return x.withColumn("phi_norm", F.col("phi") / F.nullif("phi_null", F.lit(0.0)))


def _explained(w: np.ndarray) -> list[tuple[int, float]]:
    val = nw.diffusion_map(nw.affinity(w, 50), 3)[1]
    return [(k, float(v / val.sum())) for k, v in enumerate(val)]


@query(name="gradient_null")
def _gradient_null(spark: SparkSession, d: str) -> DataFrame:
    """The first gradients' shares of variance against those of rewired graphs with their weights dealt anew."""
    g = trade_graph(spark, d)
    own = kr.graph_rows(g, "component int, observed double", _explained)
    return kr.null_summary(own, kr.null_rows(g, NULLS, "component int, value double", _explained, nw.weights_shuffled, 4), "g", "component")


@query(name="null_models")
def _models(spark: SparkSession, d: str) -> DataFrame:
    """Clustering and efficiency under four null models."""
    g = trade_graph(spark, d)
    kernel = lambda w: [(float(nw.clustering(w).mean()), nw.efficiency(w))]
    place = lambda w: np.column_stack([np.arange(len(w)) % 5, np.arange(len(w)) // 5])
    models = {"erdos_renyi": nw.erdos_renyi, "configuration": nw.configuration, "weights_shuffled": nw.weights_shuffled, "geometry": lambda w, rng: nw.geometry_rewired(w, place(w), rng)}
    out = [kr.null_rows(g, NULLS, "clustering double, efficiency double", kernel, f, 5).withColumn("model", F.lit(name)) for name, f in models.items()]
    every = out[0].union(out[1]).union(out[2]).union(out[3])
    return every.groupBy("g", "model").agg(F.avg("clustering").alias("clustering"), F.stddev_pop("clustering").alias("clustering_sd"), F.avg("efficiency").alias("efficiency"), F.count(F.lit(1)).alias("replicates"))


@query(name="reservoir_entropy")
def _entropy(spark: SparkSession, d: str) -> DataFrame:
    states = lambda w: nw.reservoir_states(w, np.random.default_rng(3).uniform(-1, 1, (2000, 1)), 0.9, 0.3, 1)
    return kr.graph_rows(layers(spark, d), "entropy double", lambda w: [(nw.state_entropy(states(w)),)])


@query(name="reservoir_character")
def _character(spark: SparkSession, d: str) -> DataFrame:
    """Echo-state index, Lyapunov exponent, spectral gap and condition number of each layer's reservoir."""

    def kernel(w: np.ndarray) -> list[tuple]:
        val = np.sort(np.abs(np.linalg.eigvalsh(nw.scaled(w, 0.9))))[::-1]
        return [(nw.echo_index(w, 0.9, 0.3, 1), nw.lyapunov(w, 0.9, 0.3, 1), float(val[0] - val[1]), float(val[0] / max(val[-1], 1e-12)))]

    return kr.graph_rows(layers(spark, d), "echo_index double, lyapunov double, spectral_gap double, condition double", kernel)


@query(name="compare_classical")
def _classical(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each shape feature with classical measures of the same vertices, and the part of its variance they leave."""
    from cohortweave.plans.catalogue import queries

    e = queries()["eigenfeatures"](spark, d).filter(~F.isnan("linearity"))
    c = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in ((3, "thickness"), (4, "curvature"))])
    x = e.join(c, "vec_id")
    features = ["linearity", "planarity", "sphericity"]
    long = x.select("thickness", "curvature", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("f")).select("thickness", "curvature", "f.*")
    r = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("v", "thickness").alias("r_thickness"), F.corr("v", "curvature").alias("r_curvature"), F.corr("thickness", "curvature").alias("r_between"))
    a, b, c_ = F.col("r_thickness"), F.col("r_curvature"), F.col("r_between")
    explained = (a * a + b * b - 2 * a * b * c_) / F.nullif(1 - c_ * c_, F.lit(0.0))  # R squared of two regressors
    return r.select("feature", "n", "r_thickness", "r_curvature", (1 - explained).alias("unique_variance"))
