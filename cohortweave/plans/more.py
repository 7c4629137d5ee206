"""Further queries: comparisons of correlations, edge-wise tests, quality-control correlations, residuals, p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.functions import signals as sg
from cohortweave.functions import special as sp
from cohortweave.functions.ranks import average_rank
from cohortweave.operators import criticality as cr
from cohortweave.operators import graph as gr
from cohortweave.operators import groups as st
from cohortweave.operators import kernels as kr
from cohortweave.operators import series as se
from cohortweave.plans.bindings import METRICS, TRADE, layers, metrics, series, table, trade
from cohortweave.plans.catalogue import FC, TS, query, rounded

MANY = 12


def _zmatrix(spark: SparkSession, d: str) -> DataFrame:
    fc = se.correlation(series(spark, d))
    w = Window.partitionBy("subject")
    return fc.withColumn("w", (F.col("w") - F.avg("w").over(w)) / F.nullif(F.stddev_pop("w").over(w), F.lit(0.0)))


query("SELECT subject, i, j, round((w - avg(w) OVER p) / nullif(stddev_pop(w) OVER p, 0), 6) + 0.0 AS w FROM fc WINDOW p AS (PARTITION BY subject)", FC, "zscore_matrix")(lambda spark, d: rounded(_zmatrix(spark, d), "w"))


def _layer_corr(spark: SparkSession, d: str) -> DataFrame:
    s = gr.degree_strength(layers(spark, d)).groupBy("node").pivot("g", [0, 1]).agg(F.first("strength"))
    return s.agg(F.corr("0", "1").alias("r"), F.count(F.lit(1)).alias("n"))


query("SELECT round(corr(x.strength, y.strength), 6) + 0.0 AS r, count(*) AS n FROM ldeg x JOIN ldeg y ON x.node = y.node AND x.g = 0 AND y.g = 1", TRADE, "interlayer_corr")(lambda spark, d: rounded(_layer_corr(spark, d), "r"))

# edges by user group: 12 subjects, two groups; channels as before
_MANY = """
b AS (SELECT user_id % 12 AS subject, CAST(floor(epoch(date_trunc('hour', ts)) / 21600) AS BIGINT) AS h, event_type AS roi, value FROM events),
lim AS (SELECT min(h) AS lo, max(h) AS hi FROM b),
g AS (SELECT subject, roi, h - lo AS t, round(sum(value), 6) AS v FROM b, lim GROUP BY ALL),
grid AS (SELECT s.subject, r.roi, k.t FROM (SELECT DISTINCT subject FROM b) s, (SELECT DISTINCT roi FROM b) r, (SELECT unnest(generate_series(0, (SELECT hi - lo FROM lim))) AS t) k),
ts AS (SELECT grid.subject, grid.t, grid.roi, coalesce(g.v, 0.0) AS v FROM grid LEFT JOIN g ON grid.subject = g.subject AND grid.roi = g.roi AND grid.t = g.t),
fc AS (SELECT a.subject, a.roi AS i, b.roi AS j, corr(a.v, b.v) AS w FROM ts a JOIN ts b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY ALL)"""


def _many(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 21600).cast("long")
    rows = e.select((F.col("user_id") % MANY).alias("subject"), hour.alias("h"), F.col("event_type").alias("roi"), "value")
    start = rows.agg(F.min("h").alias("h0"))
    return se.densify(rows.join(F.broadcast(start), how="cross").groupBy("subject", "roi", (F.col("h") - F.col("h0")).alias("t")).agg(F.round(F.sum("value"), 6).alias("v")))


def nbs_edges(edges: DataFrame) -> DataFrame:
    """Welch t of each pair between two groups of subjects (``grp`` 0 and 1)."""
    s = st.two_groups(edges, "w", "grp", 0, 1, "i", "j")
    return st.t_statistics(s).select("i", "j", F.col("t_welch").alias("t"), "df_welch")


def _nbs(spark: SparkSession, d: str) -> DataFrame:
    return nbs_edges(se.correlation(_many(spark, d)).withColumn("grp", (F.col("subject") % 2).cast("int")))


query(
    "SELECT i, j, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) + 0.0 AS t FROM (SELECT i, j, count(w) FILTER (subject % 2 = 0) AS n1, avg(w) FILTER (subject % 2 = 0) AS m1, var_samp(w) FILTER (subject % 2 = 0) AS v1, count(w) FILTER (subject % 2 = 1) AS n2, avg(w) FILTER (subject % 2 = 1) AS m2, var_samp(w) FILTER (subject % 2 = 1) AS v2 FROM fc GROUP BY ALL)",
    _MANY, "nbs_edges",
)(lambda spark, d: rounded(_nbs(spark, d), "t", digits=5).select("i", "j", "t"))


@query(name="nbs_components")
def _components(spark: SparkSession, d: str) -> DataFrame:
    strong = _nbs(spark, d).filter(F.abs("t") > 0.5).select(F.lit(0).alias("g"), "i", "j", F.abs("t").alias("w"))
    c = gr.components(strong)
    return strong.join(c.withColumnRenamed("node", "i"), ["g", "i"]).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("total_t"))


@query(name="nbs_pvalues")
def _nbs_p(spark: SparkSession, d: str) -> DataFrame:
    return _nbs(spark, d).withColumn("p", sp.column(sp.t_two_sided)(F.col("t"), F.col("df_welch")))


def qc_correlation(edges: DataFrame, motion: DataFrame) -> DataFrame:
    """Correlation over subjects of each pair's weight with the subjects' motion."""
    return edges.join(F.broadcast(motion), "subject").groupBy("i", "j").agg(F.corr("w", "motion").alias("r"), F.count(F.lit(1)).alias("n"))


def _qc(spark: SparkSession, d: str) -> DataFrame:
    ts = _many(spark, d)
    return qc_correlation(se.correlation(ts), ts.groupBy("subject").agg(F.avg("v").alias("motion")))


query("SELECT i, j, round(corr(w, motion), 6) + 0.0 AS r, count(*) AS n FROM fc JOIN (SELECT subject AS s, avg(v) AS motion FROM ts GROUP BY 1) ON s = subject GROUP BY ALL", _MANY, "qc_fc_r")(lambda spark, d: rounded(_qc(spark, d), "r"))

_THR = ", tc AS (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS q, unnest(c) AS c FROM (SELECT quantile_cont(n, [0.0, 0.25, 0.5, 0.75]) AS c FROM trade))"


def _across(spark: SparkSession, d: str) -> DataFrame:
    t = trade(spark, d)
    cuts = t.agg(F.percentile("n", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75)])).alias("c")).select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75)]).alias("q"), "c")).alias("x")).select("x.*").toDF("q", "c")
    kept = t.join(F.broadcast(cuts), F.col("n") >= F.col("c"))
    return kept.groupBy("q").agg(F.count(F.lit(1)).alias("edges"), (F.count(F.lit(1)) / 300).alias("density"), F.avg("n").alias("mean_w"))


query("SELECT q, count(*) AS edges, round(count(*) / 300, 6) + 0.0 AS density, round(avg(n), 6) + 0.0 AS mean_w FROM trade JOIN tc ON n >= c GROUP BY q", TRADE + _THR, "metrics_across_thresholds")(lambda spark, d: rounded(_across(spark, d), "density", "mean_w"))


def _build(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    x = li.select("l_orderkey", "l_suppkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.sum("l_quantity").alias("w"), F.count(F.lit(1)).alias("lines"))


query("SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, sum(l_quantity) AS w, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2", name="build_sc")(_build)
query("SELECT label, round(avg(x), 6) + 0.0 AS mean_v, round(stddev_pop(x), 6) + 0.0 AS sd_v, count(*) AS n FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY 1", name="parcellate_features")(
    lambda spark, d: rounded(table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x")).groupBy("label").agg(F.avg("x").alias("mean_v"), F.stddev_pop("x").alias("sd_v"), F.count(F.lit(1)).alias("n")), "mean_v", "sd_v")
)


def compare_correlations(df: DataFrame, r1: str, n1: str, r2: str, n2: str) -> DataFrame:
    """z of the difference of two independent correlations."""
    se_ = F.sqrt(1.0 / (F.col(n1) - 3) + 1.0 / (F.col(n2) - 3))
    return df.withColumn("z", (F.atanh(r1) - F.atanh(r2)) / se_)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).groupBy("subject", "grp").pivot("metric", ["balance", "orders"]).agg(F.first("value"))
    r = m.groupBy("grp").agg(F.corr("balance", "orders").alias("r"), F.count(F.lit(1)).alias("n"))
    a, b = r.toDF("a", "r1", "n1"), r.toDF("b", "r2", "n2")
    return compare_correlations(a.join(b, F.col("a") < F.col("b")), "r1", "n1", "r2", "n2").select("a", "b", "z")


query("SELECT x1.grp AS a, x2.grp AS b, round((atanh(x1.r) - atanh(x2.r)) / sqrt(1.0 / (x1.n - 3) + 1.0 / (x2.n - 3)), 6) + 0.0 AS z FROM rr x1 JOIN rr x2 ON x1.grp < x2.grp", METRICS + ", rr AS (SELECT grp, corr(balance, orders) AS r, count(*) AS n FROM x GROUP BY 1)", "fisher_compare_z")(lambda spark, d: rounded(_pairs(spark, d), "z"))


def kendall(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Kendall's tau-a over all pairs within ``by`` (groups are small by design, such as a subject's channels)."""
    a = df.select(*by, F.col("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    b = df.select(*by, F.col("id").alias("id2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    return a.join(b, list(by)).filter("id < id2").groupBy(*by).agg(F.avg(F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2"))).alias("tau"))


def _tau(spark: SparkSession, d: str) -> DataFrame:
    t = trade(spark, d)
    arcs = t.select("i", "j", "n", "revenue").union(t.select("j", "i", "n", "revenue")).toDF("node", "id", "x", "y")
    return kendall(arcs, "x", "y", "node")


query("SELECT a.i AS node, round(avg(sign(a.n - b.n) * sign(a.revenue - b.revenue)), 6) + 0.0 AS tau FROM (SELECT i, j, n, revenue FROM trade UNION ALL SELECT j, i, n, revenue FROM trade) a JOIN (SELECT i, j, n, revenue FROM trade UNION ALL SELECT j, i, n, revenue FROM trade) b ON a.i = b.i AND a.j < b.j GROUP BY 1", TRADE, "kendall")(lambda spark, d: rounded(_tau(spark, d), "tau"))


def residuals(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """``y`` without its least-squares dependence on ``x`` within ``by``; the covariate stays."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit, list(by)).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).groupBy("subject", "site").pivot("metric", ["balance", "orders"]).agg(F.first("value"))
    return residuals(m, "balance", "orders", "site").select("subject", "residual")


query("SELECT subject, round(balance - a - b * orders, 2) + 0.0 AS residual FROM x JOIN (SELECT site AS s, regr_slope(balance, orders) AS b, regr_intercept(balance, orders) AS a FROM x GROUP BY 1) ON s = site", METRICS, "residualize")(lambda spark, d: rounded(_residuals(spark, d), "residual", digits=2))
query("SELECT metric, grp, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_v, round(stddev_samp(value), 6) + 0.0 AS sd_v, min(value) AS min_v, max(value) AS max_v, round(median(value), 6) + 0.0 AS median_v FROM m GROUP BY ALL", METRICS, "summary_table")(
    lambda spark, d: rounded(metrics(spark, d).groupBy("metric", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("mean_v"), F.stddev_samp("value").alias("sd_v"), F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.median("value").alias("median_v")), "mean_v", "sd_v", "median_v")
)
query("SELECT metric, round(avg(gap) / (stddev_samp(gap) / sqrt(count(*))), 5) + 0.0 AS t, count(*) AS n FROM (SELECT 'balance' AS metric, c_nationkey, avg(c_acctbal) - max(sa) AS gap FROM customer JOIN (SELECT s_nationkey, avg(s_acctbal) AS sa FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey GROUP BY ALL) GROUP BY 1", name="paired_t")(
    lambda spark, d: rounded(
        table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x")).join(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y")), "k")
        .groupBy(F.lit("balance").alias("metric")).agg((F.avg(F.col("x") - F.col("y")) / (F.stddev_samp(F.col("x") - F.col("y")) / F.sqrt(F.count(F.lit(1))))).alias("t"), F.count(F.lit(1)).alias("n")), "t", digits=5)
)


def lattice(spark: SparkSession, nodes: int, k: int) -> DataFrame:
    """A ring on which each node links to its ``k`` next neighbours."""
    n = spark.range(nodes).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s"))
    to = (F.col("x") + F.col("s")) % nodes
    return n.select(F.least("x", to).alias("i"), F.greatest("x", to).alias("j"), F.lit(1.0).cast("double").alias("w"))


query("SELECT least(x, y) AS i, greatest(x, y) AS j, CAST(1 AS DOUBLE) AS w FROM (SELECT CAST(x AS INTEGER) AS x, CAST((x + s) % 30 AS INTEGER) AS y FROM (SELECT unnest(range(0, 30)) AS x), (SELECT unnest(range(1, 3)) AS s))", name="lattice")(lambda spark, d: lattice(spark, 30, 2))
query("SELECT subject, floor(log10(size) * 5 + 1e-9)::BIGINT AS bin, count(*) AS n FROM av GROUP BY ALL", TS + """,
ev AS (SELECT *, CASE WHEN abs(z) > 1.5 THEN 1 ELSE 0 END AS event FROM z), act AS (SELECT subject, t, sum(event) AS act FROM ev GROUP BY ALL), isl AS (SELECT *, t - row_number() OVER (PARTITION BY subject ORDER BY t) AS island FROM act WHERE act > 0), av AS (SELECT subject, sum(act) AS size FROM isl GROUP BY subject, island)""", "size_histogram")(
    lambda spark, d: cr.log_bins(cr.avalanches(cr.activity(cr.raster(series(spark, d), 1.5))), "size")
)


@query(name="rank_normalize")
def _blom(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d)
    x = m.select("subject", "metric", average_rank("value", "metric").alias("r"), F.count(F.lit(1)).over(Window.partitionBy("metric")).cast("double").alias("n"))
    return x.select("subject", "metric", sp.column(sp.blom)(F.col("r"), F.col("n")).alias("score"))


@query(name="test_pvalues")
def _tests(spark: SparkSession, d: str) -> DataFrame:
    t = st.t_statistics(st.two_groups(metrics(spark, d), "value", "grp", "BUILDING", "MACHINERY", "metric"))
    return t.select("metric", "t_welch", sp.column(sp.t_two_sided)(F.col("t_welch"), F.col("df_welch")).alias("p_welch"), sp.column(sp.t_two_sided)(F.col("t_student"), (F.col("n1") + F.col("n2") - 2).cast("double")).alias("p_student"))


@query(name="kruskal_pvalue")
def _kruskal_p(spark: SparkSession, d: str) -> DataFrame:
    h = st.kruskal(metrics(spark, d), "value", "grp", "metric")
    return h.withColumn("p", sp.column(sp.chi2_upper)(F.col("h"), (F.col("groups") - 1).cast("double")))


@query(name="anova_pvalue")
def _anova(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).filter("metric = 'balance'")
    size = m.agg(F.count_distinct("grp").alias("k"), F.count(F.lit(1)).alias("n"))
    f = st.eta_squared(m, "value", "grp").join(size, how="cross")
    return f.select("eta_squared", "f_ratio", sp.column(sp.f_upper)(F.col("f_ratio"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")).alias("p"))


@query(name="kmeans_subgroups")
def _kmeans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=4, seed=1, maxIter=10).fit(x)
    return model.transform(x).select("vec_id", F.col("prediction").alias("subgroup"))
