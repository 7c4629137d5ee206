"""The queries of the analytics operators, bound to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.functions import ranks
from cohortweave.operators import criticality as cr
from cohortweave.operators import graph as gr
from cohortweave.operators import groups as st
from cohortweave.operators import matrix as mx
from cohortweave.operators import series as se
from cohortweave.plans.bindings import METRICS, TRADE, layers, metrics, modules, series, table, trade, trade_graph, ts_sql
from cohortweave.session import importable

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TS = ts_sql()
THR = 1.5
CHANNELS = 5
NATIONS = 25


def query(sql: str | None = None, ctes: str = "", name: str = ""):  # noqa: ANN201
    """Register a query; ``sql`` is its oracle's last select, ``ctes`` what it stands on."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(importable(spark), sf_dir)
        if sql:
            _SQL[key] = (f"WITH RECURSIVE {ctes.strip()}\n" if ctes else "") + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries."""
    from cohortweave.plans import bayes, coupling, extended, kernels, models, more  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have one."""
    from cohortweave.plans import bayes, coupling, extended, kernels, models, more  # noqa: F401  register their own

    return dict(_SQL)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), so that two engines' sums agree."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


# ------------------------------------------------------------------ criticality

EVENTS = TS + f""",
ev AS (SELECT *, CASE WHEN abs(z) > {THR} THEN 1 ELSE 0 END AS event FROM z),
act AS (SELECT subject, t, CAST(sum(event) AS BIGINT) AS act FROM ev GROUP BY ALL),
isl AS (SELECT *, t - row_number() OVER (PARTITION BY subject ORDER BY t) AS island FROM act WHERE act > 0),
av AS (SELECT subject, min(t) AS start_t, max(t) AS end_t, CAST(sum(act) AS BIGINT) AS size, count(*) AS duration FROM isl GROUP BY subject, island)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return cr.raster(series(spark, d), THR)


def _act(spark: SparkSession, d: str) -> DataFrame:
    return cr.activity(_events(spark, d))


def _av(spark: SparkSession, d: str) -> DataFrame:
    return cr.avalanches(_act(spark, d)).drop("profile")


@query("SELECT * FROM av", EVENTS)
def avalanches(spark, d):  # noqa: ANN001, ANN201, D103
    return _av(spark, d)


@query(
    f"""SELECT subject, min(b) AS start_t, max(b) AS end_t, CAST(sum(act) AS BIGINT) AS size, count(*) AS duration FROM
    (SELECT *, b - row_number() OVER (PARTITION BY subject ORDER BY b) AS island FROM (SELECT subject, b, sum(CASE WHEN m > {THR} THEN 1 ELSE 0 END) AS act FROM
        (SELECT subject, roi, t // 2 AS b, max(abs(z)) AS m FROM z GROUP BY ALL) JOIN (SELECT subject AS s, count(DISTINCT t) // 2 AS bins FROM z GROUP BY 1) ON s = subject WHERE b < bins GROUP BY ALL) WHERE act > 0)
    GROUP BY subject, island""",
    TS,
)
def avalanches_binned(spark, d):  # noqa: ANN001, ANN201, D103
    return cr.avalanches(cr.bin_activity(series(spark, d), THR, 2)).drop("profile")


@query(f"SELECT subject, count(*) AS n, {_r('mean_size', 'mean_duration')}, max_size, max_duration FROM (SELECT subject, count(*), avg(size) AS mean_size, avg(duration) AS mean_duration, max(size) AS max_size, max(duration) AS max_duration, count(*) AS n FROM av GROUP BY 1)", EVENTS)
def avalanche_summary(spark, d):  # noqa: ANN001, ANN201, D103
    s = _av(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"), F.avg("duration").alias("mean_duration"), F.max("size").alias("max_size"), F.max("duration").alias("max_duration"))
    return rounded(s, "mean_size", "mean_duration")


_SQL["avalanche_summary"] = f"WITH RECURSIVE {EVENTS.strip()} SELECT subject, count(*) AS n, round(avg(size), 6) + 0.0 AS mean_size, round(avg(duration), 6) + 0.0 AS mean_duration, max(size) AS max_size, max(duration) AS max_duration FROM av GROUP BY 1"


@query("SELECT size, duration, count(*) AS n FROM av GROUP BY ALL", EVENTS)
def avalanche_pooled(spark, d):  # noqa: ANN001, ANN201, D103
    return _av(spark, d).groupBy("size", "duration").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT subject, round(avg(CASE WHEN act = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS silent_fraction FROM act GROUP BY 1", EVENTS)
def silent_fraction(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.silent_fraction(_act(spark, d)), "silent_fraction")


@query(
    "SELECT subject, round(avg(r), 6) + 0.0 AS sigma, round(stddev_pop(r), 6) + 0.0 AS sd, round(median(r), 6) + 0.0 AS median, count(*) AS n FROM (SELECT subject, nxt / act AS r FROM (SELECT *, lead(act) OVER (PARTITION BY subject ORDER BY t) AS nxt FROM act) WHERE act > 0 AND nxt IS NOT NULL) GROUP BY 1",
    EVENTS,
)
def branching_ratio(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.branching(_act(spark, d)), "sigma", "sd", "median")


@query(
    """SELECT subject, round(exp(regr_slope(ln(r), k)), 6) + 0.0 AS m, round(exp(regr_intercept(ln(r), k)), 6) + 0.0 AS b, count(*) AS lags FROM
    (SELECT a.subject, k, avg(a.c * b.c) / nullif(max(a.var), 0) AS r FROM cc a JOIN (SELECT unnest(range(1, 13)) AS k) ON true JOIN cc b ON a.subject = b.subject AND b.t = a.t + k GROUP BY 1, 2) WHERE r > 0 GROUP BY 1 HAVING count(*) >= 3""",
    EVENTS + ", cc AS (SELECT subject, t, act - avg(act) OVER (PARTITION BY subject) AS c, var_pop(act) OVER (PARTITION BY subject) AS var FROM act)",
)
def branching_mr(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.branching_mr(_act(spark, d), 12), "m", "b")


@query("SELECT subject, round(regr_slope(log10(ms), log10(duration)), 6) + 0.0 AS gamma, count(*) AS n FROM (SELECT subject, duration, avg(size) AS ms FROM av GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 2", EVENTS)
def scaling_relation(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.scaling_relation(_av(spark, d)), "gamma")


@query(
    """SELECT subject, n, round(alpha, 6) + 0.0 AS alpha, round((alpha - 1) / sqrt(n), 6) + 0.0 AS sigma, round(least(1.0, max(abs(i / n - (1 - pow(size, 1 - alpha))))), 6) + 0.0 AS ks FROM
    (SELECT av.subject, size, n, alpha, count(*) OVER (PARTITION BY av.subject ORDER BY size ROWS UNBOUNDED PRECEDING) AS i FROM av JOIN (SELECT subject AS s, count(*) AS n, 1 + count(*) / sum(ln(size / 0.5)) AS alpha FROM av GROUP BY 1) ON s = subject) GROUP BY subject, n, alpha""",
    EVENTS,
)
def powerlaw_mle(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.powerlaw_mle(_av(spark, d), "size"), "alpha", "sigma", "ks")


@query(
    """SELECT subject, round(1 + avg((pow(lo, -0.5) - pow(x, -0.5)) / (pow(lo, -0.5) - pow(hi, -0.5)) - f), 6) + 0.0 AS kappa FROM
    (SELECT l.subject, k, x, lo, hi, avg(CASE WHEN size <= x + 1e-9 THEN 1.0 ELSE 0.0 END) AS f FROM (SELECT *, lo * pow(hi / lo, k / 9.0) AS x FROM (SELECT subject, CAST(min(size) AS DOUBLE) AS lo, CAST(max(size) AS DOUBLE) AS hi FROM av GROUP BY 1), (SELECT unnest(range(0, 10)) AS k) WHERE hi > lo) l JOIN av ON av.subject = l.subject GROUP BY ALL) GROUP BY 1""",
    EVENTS,
)
def kappa(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.kappa(_av(spark, d), "size"), "kappa")


@query("SELECT subject, duration, step, round(avg(act), 6) + 0.0 AS mean_act, count(*) AS n FROM (SELECT isl.subject, act, CAST(isl.t - av.start_t AS INTEGER) AS step, duration FROM isl JOIN av ON isl.subject = av.subject AND isl.t BETWEEN av.start_t AND av.end_t) GROUP BY ALL", EVENTS)
def shape_profiles(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.shape_profiles(cr.avalanches(_act(spark, d))), "mean_act")


@query(
    "SELECT subject, round((greatest(0, 1 - abs(sigma - 1)) + greatest(0, 1 - abs(alpha - 1.5) / 1.5)) / 2, 6) + 0.0 AS criticality FROM (SELECT subject, avg(nxt / act) AS sigma FROM (SELECT *, lead(act) OVER (PARTITION BY subject ORDER BY t) AS nxt FROM act) WHERE act > 0 AND nxt IS NOT NULL GROUP BY 1) JOIN (SELECT subject, 1 + count(*) / sum(ln(size / 0.5)) AS alpha FROM av GROUP BY 1) USING (subject)",
    EVENTS,
)
def criticality_index(spark, d):  # noqa: ANN001, ANN201, D103
    x = cr.branching(_act(spark, d)).select("subject", "sigma").join(cr.powerlaw_mle(_av(spark, d), "size").select("subject", "alpha"), "subject")
    score = F.array(cr.criticality_score(F.col("sigma"), 1.0), cr.criticality_score(F.col("alpha"), 1.5))
    known = F.filter(score, lambda v: v.isNotNull())
    return rounded(x.select("subject", (F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)).alias("criticality")), "criticality")


@query(
    """SELECT subject, threshold, count(*) AS n, round(avg(size), 6) + 0.0 AS mean_size FROM (SELECT subject, threshold, island, sum(act) AS size FROM
    (SELECT *, t - row_number() OVER (PARTITION BY subject, threshold ORDER BY t) AS island FROM (SELECT subject, threshold, t, sum(CASE WHEN abs(z) > threshold THEN 1 ELSE 0 END) AS act FROM z, (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS threshold) GROUP BY ALL) WHERE act > 0) GROUP BY ALL) GROUP BY ALL""",
    TS,
)
def avalanche_sensitivity(spark, d):  # noqa: ANN001, ANN201, D103
    z = se.zscore(series(spark, d)).withColumn("threshold", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    act = z.groupBy(F.struct("subject", "threshold").alias("subject"), "t").agg(F.sum((F.abs("z") > F.col("threshold")).cast("long")).alias("act"))
    out = cr.avalanches(act).groupBy("subject.subject", "subject.threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))
    return rounded(out, "mean_size")


@query("SELECT subject, roi, CAST(sum(event) AS BIGINT) AS n FROM ev GROUP BY ALL", EVENTS)
def pp_exceedance(spark, d):  # noqa: ANN001, ANN201, D103
    return _events(spark, d).groupBy("subject", "roi").agg(F.sum("event").alias("n"))


@query(f"SELECT subject, roi, CAST(sum(CASE WHEN z > {THR} AND before <= {THR} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, lag(z) OVER (PARTITION BY subject, roi ORDER BY t) AS before FROM z) GROUP BY ALL", TS)
def pp_crossing(spark, d):  # noqa: ANN001, ANN201, D103
    return cr.raster(series(spark, d), THR, "crossing").groupBy("subject", "roi").agg(F.sum("event").alias("n"))


_PAIRS = "p AS (SELECT a.subject, a.roi AS i, b.roi AS j, sum(a.event * b.event) AS bo, sum(a.event) AS nx, sum(b.event) AS ny, corr(a.event, b.event) AS r FROM ev a JOIN ev b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY ALL)"


@query("SELECT subject, i, j, round(coalesce(bo / nullif(nx + ny - bo, 0), 0), 6) + 0.0 AS jaccard, round(coalesce(bo / nullif(sqrt(nx * ny), 0), 0), 6) + 0.0 AS cosine, round(coalesce(bo / nullif(least(nx, ny), 0), 0), 6) + 0.0 AS coincidence FROM p", EVENTS + ", " + _PAIRS)
def pp_fc_overlap(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.event_overlap(_events(spark, d)), "jaccard", "cosine", "coincidence")


@query("SELECT subject, i, j, round(r, 6) + 0.0 AS w FROM p", EVENTS + ", " + _PAIRS)
def pp_fc_corr(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(se.correlation(_events(spark, d).select("subject", "t", "roi", F.col("event").alias("v"))), "w")


@query('SELECT subject, round(avg(abs(m)), 6) + 0.0 AS "order", round(stddev_pop(m), 6) + 0.0 AS sd, round(var_pop(m), 6) + 0.0 AS susceptibility FROM (SELECT subject, t, avg(z) AS m FROM z GROUP BY ALL) GROUP BY 1', TS)
def order_parameter(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.order_parameter(series(spark, d)), "order", "sd", "susceptibility")


@query("SELECT subject, threshold, round(avg(s), 6) + 0.0 AS mean_share, round(var_pop(s), 6) + 0.0 AS susceptibility FROM (SELECT subject, threshold, t, avg(CASE WHEN abs(z) > threshold THEN 1.0 ELSE 0.0 END) AS s FROM z, (SELECT unnest([0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS threshold) GROUP BY ALL) GROUP BY ALL", TS)
def susceptibility_scan(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(cr.susceptibility_scan(series(spark, d), [0.5, 1.0, 1.5, 2.0]), "mean_share", "susceptibility")


@query(
    "SELECT a.subject, a.roi, k AS lag, round(sum(a.c * b.c) / max(a.ss), 6) + 0.0 AS r FROM cc a JOIN (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS k) ON true JOIN cc b ON a.subject = b.subject AND a.roi = b.roi AND b.t = a.t + k GROUP BY ALL",
    TS + ", c0 AS (SELECT *, v - avg(v) OVER (PARTITION BY subject, roi) AS c FROM ts), cc AS (SELECT *, sum(c * c) OVER (PARTITION BY subject, roi) AS ss FROM c0)",
)
def acf_decay(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(se.autocorrelation(series(spark, d), 8), "r")


# ------------------------------------------------------------- matrices, dynamics

FC = TS + ", fc AS (SELECT a.subject, a.roi AS i, b.roi AS j, corr(a.v, b.v) AS w FROM ts a JOIN ts b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY ALL)"


def _fc(spark: SparkSession, d: str) -> DataFrame:
    return se.correlation(series(spark, d))


_W = "SELECT subject, i, j, round(w, 6) + 0.0 AS w FROM"


@query(f"{_W} fc", FC)
def fc_matrix(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(_fc(spark, d), "w")


@query(f"{_W} (SELECT a.subject, a.roi AS i, b.roi AS j, covar_samp(a.v, b.v) AS w FROM ts a JOIN ts b ON a.subject = b.subject AND a.t = b.t AND a.roi <= b.roi GROUP BY ALL)".replace("round(w, 6)", "round(w, 3)"), TS)
def fc_covariance(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(se.covariance(series(spark, d)), "w", digits=3)


@query(f"{_W} (SELECT subject, i, j, atanh(greatest(-0.9999, least(0.9999, w))) AS w FROM fc)", FC)
def fc_fisher_z(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(mx.fisher_z(_fc(spark, d)), "w")


@query(f"{_W} fc", FC)
def fc_inverse_fisher_z(spark, d):  # noqa: ANN001, ANN201, D103
    return rounded(mx.inverse_fisher_z(mx.fisher_z(_fc(spark, d))), "w")


_DIRECTED = "a AS (SELECT 0 AS subject, c_nationkey AS i, s_nationkey AS j, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), s AS (SELECT subject, least(i, j) AS i, greatest(i, j) AS j, sum(CASE WHEN i < j THEN w ELSE 0 END) AS x, sum(CASE WHEN i > j THEN w ELSE 0 END) AS y FROM a WHERE i <> j GROUP BY ALL)"


def _directed(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    x = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.lit(0).alias("subject"), F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("w"))


for _how, _expr in (("avg", "(x + y) / 2"), ("max", "greatest(x, y)"), ("min", "least(x, y)")):
    query(f"SELECT subject, i, j, {_expr} AS w FROM s", _DIRECTED, f"symmetrize_{_how}")(lambda spark, d, how=_how: mx.symmetrize(_directed(spark, d), how))

_NORMAL = {"max": "coalesce(w / nullif(max(abs(w)) OVER s, 0), 0)", "minmax": "coalesce((w - min(w) OVER s) / nullif(max(w) OVER s - min(w) OVER s, 0), 0)"}
for _how, _expr in _NORMAL.items():
    query(f"SELECT subject, i, j, round({_expr}, 6) + 0.0 AS w FROM fc WINDOW s AS (PARTITION BY subject)", FC, f"normalize_{_how}")(lambda spark, d, how=_how: rounded(mx.normalize(_fc(spark, d), how), "w"))
_TRADE1 = ", t1 AS (SELECT 0 AS subject, i, j, n AS w FROM trade)"


def _trade1(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).select(F.lit(0).alias("subject"), "i", "j", F.col("n").alias("w"))


query(f"{_W} (SELECT subject, i, j, ln(1 + w) AS w FROM t1)", TRADE + _TRADE1, "normalize_log")(lambda spark, d: rounded(mx.normalize(_trade1(spark, d), "log"), "w"))
query(f"{_W} (SELECT subject, i, j, w / sum(w) OVER (PARTITION BY subject, i) AS w FROM (SELECT * FROM t1 UNION ALL SELECT subject, j, i, w FROM t1))", TRADE + _TRADE1, "normalize_rowsum")(lambda spark, d: rounded(mx.normalize_rows(_trade1(spark, d)), "w"))
query(f"{_W} (SELECT *, rank() OVER (PARTITION BY subject ORDER BY w DESC) AS r FROM fc) WHERE r <= 3", FC, "threshold_density")(lambda spark, d: rounded(mx.threshold_density(_fc(spark, d), 0.3, CHANNELS), "w"))
query(f"{_W} fc WHERE abs(w) >= 0.05", FC, "threshold_absolute")(lambda spark, d: rounded(mx.threshold_absolute(_fc(spark, d), 0.05), "w"))
query(f"{_W} fc JOIN (SELECT subject AS s, quantile_cont(abs(w), 0.7) AS c FROM fc GROUP BY 1) ON s = subject WHERE abs(w) >= c", FC, "threshold_percentile")(lambda spark, d: rounded(mx.threshold_percentile(_fc(spark, d), 0.3), "w"))
query(f"{_W} (SELECT subject, i, j, greatest(w, 0) AS w FROM fc)", FC, "negatives_zero")(lambda spark, d: rounded(mx.negatives(_fc(spark, d)), "w"))
query(f"{_W} (SELECT subject, i, j, abs(w) AS w FROM fc)", FC, "negatives_abs")(lambda spark, d: rounded(mx.negatives(_fc(spark, d), "abs"), "w"))
query("SELECT subject, round(sum(CASE WHEN w <> 0 THEN 1.0 ELSE 0.0 END) / 300, 6) + 0.0 AS density FROM t1 GROUP BY 1", TRADE + _TRADE1, "density")(lambda spark, d: rounded(mx.density(_trade1(spark, d), NATIONS), "density"))
query(
    "SELECT subject, round(avg(w), 6) + 0.0 AS mean_w, round(stddev_pop(w), 6) + 0.0 AS sd_w, round(min(w), 6) + 0.0 AS min_w, round(max(w), 6) + 0.0 AS max_w, round(median(w), 6) + 0.0 AS median_w, round(avg(CASE WHEN w > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS positive, round(avg(CASE WHEN w < 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS negative FROM fc GROUP BY 1",
    FC, "edge_weight_stats",
)(lambda spark, d: rounded(mx.edge_statistics(_fc(spark, d)), "mean_w", "sd_w", "min_w", "max_w", "median_w", "positive", "negative"))
query("SELECT subject, i, j, round(w, 6) + 0.0 AS w, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY abs(w) DESC, i, j) AS INTEGER) AS place FROM fc) WHERE place <= 3", FC, "top_edges")(lambda spark, d: rounded(mx.top_edges(_fc(spark, d), 3), "w"))
_SIM = "FROM {t} x JOIN {t} y ON x.i = y.i AND x.j = y.j AND x.subject < y.subject GROUP BY ALL"
_RANKED = ", rk AS (SELECT subject, i, j, rank() OVER (PARTITION BY subject ORDER BY w) + (count(*) OVER (PARTITION BY subject, w) - 1) / 2.0 AS w FROM fc)"
query("SELECT x.subject AS a, y.subject AS b, round(corr(x.w, y.w), 6) + 0.0 AS similarity " + _SIM.format(t="fc"), FC, "matrix_similarity_pearson")(lambda spark, d: rounded(mx.similarity(_fc(spark, d)), "similarity"))
query("SELECT x.subject AS a, y.subject AS b, round(corr(x.w, y.w), 6) + 0.0 AS similarity " + _SIM.format(t="rk"), FC + _RANKED, "matrix_similarity_spearman")(lambda spark, d: rounded(mx.similarity(_fc(spark, d), "spearman"), "similarity"))
query("SELECT x.subject AS a, y.subject AS b, round(sum(x.w * y.w) / nullif(sqrt(sum(x.w * x.w) * sum(y.w * y.w)), 0), 6) + 0.0 AS similarity " + _SIM.format(t="fc"), FC, "matrix_similarity_cosine")(lambda spark, d: rounded(mx.similarity(_fc(spark, d), "cosine"), "similarity"))
_HALVES = TS + ", h AS (SELECT *, t < (SELECT (max(t) + 1) // 2 FROM ts) AS first FROM ts), f2 AS (SELECT a.first, a.subject, a.roi AS i, b.roi AS j, corr(a.v, b.v) AS w FROM h a JOIN h b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi GROUP BY ALL)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ts = series(spark, d)
    lim = ts.agg(F.floor((F.max("t") + 1) / 2).alias("h"))
    x = ts.join(F.broadcast(lim), how="cross")
    return se.correlation(x.filter("t < h")), se.correlation(x.filter("t >= h"))


query(
    "SELECT a AS subject, b AS match, round(r, 6) + 0.0 AS r, a = b AS identified FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS n FROM (SELECT x.subject AS a, y.subject AS b, corr(x.w, y.w) AS r FROM f2 x JOIN f2 y ON x.i = y.i AND x.j = y.j AND x.first AND NOT y.first GROUP BY ALL)) WHERE n = 1",
    _HALVES, "fingerprint",
)(lambda spark, d: rounded(mx.fingerprint(*_halves(spark, d)), "r"))
query("SELECT i, j, round(avg(w), 6) + 0.0 AS mean_w, round(stddev_samp(w), 6) + 0.0 AS sd_w, count(w) AS n FROM fc GROUP BY ALL", FC, "group_stats")(lambda spark, d: rounded(mx.group_statistics(_fc(spark, d)), "mean_w", "sd_w"))
query(
    "SELECT subject, round(ms, 6) + 0.0 AS mean_similarity, round(coalesce((ms - avg(ms) OVER ()) / nullif(stddev_samp(ms) OVER (), 0), 0), 6) + 0.0 AS z, coalesce((ms - avg(ms) OVER ()) / nullif(stddev_samp(ms) OVER (), 0) <= -3, false) AS is_outlier FROM (SELECT subject, avg(s) AS ms FROM (SELECT a AS subject, s FROM sim UNION ALL SELECT b, s FROM sim) GROUP BY 1)",
    FC + ", sim AS (SELECT x.subject AS a, y.subject AS b, corr(x.w, y.w) AS s " + _SIM.format(t="fc") + ")", "outlier_subjects",
)(lambda spark, d: rounded(mx.outlier_subjects(_fc(spark, d)), "mean_similarity", "z"))
query("SELECT subject, roi, round(avg(v) / nullif(stddev_pop(v), 0), 6) + 0.0 AS tsnr FROM ts GROUP BY ALL", TS, "tsnr")(lambda spark, d: rounded(se.temporal_snr(series(spark, d)), "tsnr"))
query(
    "SELECT subject, roi, round(sd, 6) + 0.0 AS sd, round(coalesce(0.6745 * gap / nullif(median(gap) OVER (PARTITION BY subject), 0), 0), 6) + 0.0 AS robust_z, coalesce(0.6745 * gap / nullif(median(gap) OVER (PARTITION BY subject), 0) >= 3, false) AS is_outlier FROM (SELECT *, abs(sd - median(sd) OVER (PARTITION BY subject)) AS gap FROM (SELECT subject, roi, stddev_pop(v) AS sd FROM ts GROUP BY ALL))",
    TS, "outlier_channels",
)(lambda spark, d: rounded(se.outlier_channels(series(spark, d)), "sd", "robust_z"))
query(f"{_W} fc WHERE i <> 'click' AND j <> 'click'", FC, "drop_rois")(lambda spark, d: rounded(mx.drop_nodes(_fc(spark, d), ["click"]), "w"))
query(f"{_W} fc WHERE subject NOT IN (1, 3)", FC, "exclude_subjects")(lambda spark, d: rounded(_fc(spark, d).filter(~F.col("subject").isin(1, 3)), "w"))
query("SELECT subject, 10 - count(*) AS missing, CAST(sum(CASE WHEN w IS NULL OR isnan(w) THEN 1 ELSE 0 END) AS BIGINT) AS invalid, CAST(sum(CASE WHEN abs(w) > 1 + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, count(*) = 10 AND sum(CASE WHEN w IS NULL OR isnan(w) OR abs(w) > 1 + 1e-9 THEN 1 ELSE 0 END) = 0 AS is_valid FROM fc GROUP BY 1", FC, "validate")(lambda spark, d: mx.validation(_fc(spark, d), CHANNELS))
query("SELECT subject, i, j, round(CASE WHEN w IS NULL OR isnan(w) OR isinf(w) THEN 0 ELSE w END, 6) + 0.0 AS w, CASE WHEN w IS NULL OR isnan(w) OR isinf(w) THEN 1 ELSE 0 END AS cleaned FROM fc", FC, "sanitize")(lambda spark, d: rounded(mx.sanitized(_fc(spark, d)), "w"))
_DYN = TS + ", dy AS (SELECT a.subject, wn AS \"window\", a.roi AS i, b.roi AS j, corr(a.v, b.v) AS w FROM ts a JOIN ts b ON a.subject = b.subject AND a.t = b.t AND a.roi < b.roi JOIN (SELECT unnest(range(0, (SELECT (max(t) + 1 - 120) // 60 + 1 FROM ts))) AS wn) ON a.t >= wn * 60 AND a.t < wn * 60 + 120 GROUP BY ALL)"
query('SELECT subject, "window", i, j, round(w, 6) + 0.0 AS w FROM dy', _DYN, "dynamic_fc")(lambda spark, d: rounded(se.sliding_correlation(series(spark, d), 120, 60), "w"))
query("SELECT subject, i, j, round(avg(w), 6) + 0.0 AS mean_w, round(stddev_pop(w), 6) + 0.0 AS sd_w, count(*) AS n FROM dy WHERE w IS NOT NULL AND NOT isnan(w) GROUP BY ALL", _DYN, "coupling_variability")(lambda spark, d: rounded(se.coupling_variability(se.sliding_correlation(series(spark, d), 120, 60)), "mean_w", "sd_w"))
query("SELECT subject, roi, t // 6 AS t, round(avg(v), 6) + 0.0 AS v FROM ts GROUP BY ALL HAVING count(*) = 6", TS, "coarse_grain")(lambda spark, d: rounded(se.coarse_grain(series(spark, d), 6), "v"))
query("SELECT subject, t, roi, v, round(avg(v) OVER (PARTITION BY subject, roi ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smooth FROM ts", TS, "moving_average")(lambda spark, d: rounded(se.moving_average(series(spark, d), 2), "smooth"))
query(
    "SELECT subject, roi, round(-sum(p * log2(p)) / log2(6), 6) + 0.0 AS entropy FROM (SELECT subject, roi, count(*) / sum(count(*)) OVER (PARTITION BY subject, roi) AS p FROM (SELECT subject, roi, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN b <= c AND c < a THEN 3 WHEN c < a AND a <= b THEN 4 ELSE 5 END AS pattern FROM (SELECT subject, roi, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM ts WINDOW w AS (PARTITION BY subject, roi ORDER BY t)) WHERE c IS NOT NULL) GROUP BY subject, roi, pattern) GROUP BY ALL",
    TS, "permutation_entropy",
)(lambda spark, d: rounded(se.permutation_entropy(series(spark, d)), "entropy"))

# --------------------------------------------------------------------------- graphs


def _g(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d)


_TRI = TRADE + ", tri AS (SELECT a.g, a.i AS a, a.j AS b, b.j AS c, a.w AS w1, b.w AS w2, c.w AS w3 FROM e a JOIN e b ON a.g = b.g AND a.j = b.i JOIN e c ON a.g = c.g AND a.i = c.i AND b.j = c.j), top AS (SELECT g, max(w) AS top FROM e GROUP BY 1), per AS (SELECT g, node, count(*) AS x, sum(y) AS y FROM (SELECT tri.g, cbrt(w1 * w2 * w3) / top AS y, unnest([a, b, c]) AS node FROM tri JOIN top ON top.g = tri.g) GROUP BY ALL)"
query("SELECT g, node, degree FROM deg", TRADE, "degree")(lambda spark, d: gr.degree_strength(_g(spark, d)).select("g", "node", "degree"))
query("SELECT g, node, strength FROM deg", TRADE, "strength")(lambda spark, d: gr.degree_strength(_g(spark, d)).select("g", "node", "strength"))
for _name, _col, _weighted in (("clustering_binary", "x", False), ("clustering_onnela", "y", True)):
    query(f"SELECT deg.g, deg.node, round(CASE WHEN degree < 2 THEN 0 ELSE coalesce({_col}, 0) / (degree * (degree - 1) / 2) END, 6) + 0.0 AS clustering FROM deg LEFT JOIN per ON per.g = deg.g AND per.node = deg.node", _TRI, _name)(lambda spark, d, w=_weighted: rounded(gr.clustering(_g(spark, d), w), "clustering"))
query("SELECT 0 AS g, round((SELECT count(*) FROM tri) * 3.0 / (SELECT sum(degree * (degree - 1) / 2) FROM deg), 6) + 0.0 AS transitivity", _TRI, "transitivity")(lambda spark, d: rounded(gr.transitivity(_g(spark, d)), "transitivity"))
query("SELECT a.g, round(corr(x.degree, y.degree), 6) + 0.0 AS assortativity FROM arcs a JOIN deg x ON x.node = a.i JOIN deg y ON y.node = a.j GROUP BY 1", TRADE, "assortativity")(lambda spark, d: rounded(gr.assortativity(_g(spark, d)), "assortativity"))
query(
    "SELECT n.g, k, n, round(CASE WHEN n < 2 THEN 0 ELSE 2.0 * (SELECT count(*) FROM e JOIN deg x ON x.node = e.i JOIN deg y ON y.node = e.j WHERE x.degree > k AND y.degree > k) / (n * (n - 1)) END, 6) + 0.0 AS phi FROM (SELECT deg.g, k, count(*) AS n FROM deg, (SELECT unnest(range(0, (SELECT max(degree) FROM deg))) AS k) WHERE degree > k GROUP BY ALL) n",
    TRADE, "rich_club_phi",
)(lambda spark, d: rounded(gr.rich_club(_g(spark, d)), "phi"))
_PART = ", pt AS (SELECT g, node, 1 - sum(w * w) / pow(sum(w), 2) AS participation FROM (SELECT g, arcs.i AS node, module, sum(w) AS w FROM arcs JOIN modules ON modules.node = arcs.j GROUP BY ALL) GROUP BY ALL), wk AS (SELECT m.node, m.module, coalesce(k, 0) AS k FROM modules m LEFT JOIN (SELECT arcs.i AS node, sum(w) AS k FROM arcs JOIN modules a ON a.node = arcs.i JOIN modules b ON b.node = arcs.j WHERE a.module = b.module GROUP BY 1) u ON u.node = m.node), wz AS (SELECT 0 AS g, node, module, CASE WHEN stddev_pop(k) OVER p > 0 THEN (k - avg(k) OVER p) / stddev_pop(k) OVER p ELSE 0 END AS z FROM wk WINDOW p AS (PARTITION BY module))"
query("SELECT g, node, round(participation, 6) + 0.0 AS participation FROM pt", TRADE + _PART, "participation")(lambda spark, d: rounded(gr.participation(_g(spark, d), modules(spark, d)), "participation"))
query("SELECT g, node, module, round(z, 6) + 0.0 AS z FROM wz", TRADE + _PART, "within_module_z")(lambda spark, d: rounded(gr.within_module_z(_g(spark, d), modules(spark, d)), "z"))
query(
    "SELECT wz.g, wz.node, module, round(z, 6) + 0.0 AS z, round(coalesce(participation, 0), 6) + 0.0 AS participation, CASE WHEN coalesce(participation, 0) > 0.3 THEN 'connector' ELSE 'provincial' END || CASE WHEN z > 1.0 THEN '_hub' ELSE '_non_hub' END AS role FROM wz LEFT JOIN pt ON pt.node = wz.node",
    TRADE + _PART, "node_roles",
)(lambda spark, d: rounded(gr.node_roles(_g(spark, d), modules(spark, d)), "z", "participation"))
query("SELECT g, round(sum(i / m - pow(k / m, 2)), 6) + 0.0 AS modularity FROM (SELECT *, sum(k) OVER () AS m FROM (SELECT g, a.module, sum(CASE WHEN a.module = b.module THEN w ELSE 0 END) AS i, sum(w) AS k FROM arcs JOIN modules a ON a.node = arcs.i JOIN modules b ON b.node = arcs.j GROUP BY ALL)) GROUP BY 1", TRADE, "modularity")(lambda spark, d: rounded(gr.modularity(_g(spark, d), modules(spark, d)), "modularity"))
query("SELECT g, least(x.module, y.module) AS a, greatest(x.module, y.module) AS b, count(*) AS n, sum(w) AS total, round(avg(w), 6) + 0.0 AS mean_w FROM e JOIN modules x ON x.node = e.i JOIN modules y ON y.node = e.j GROUP BY 1, 2, 3", TRADE, "inter_module")(lambda spark, d: rounded(gr.inter_module(_g(spark, d), modules(spark, d)), "mean_w"))
_RUNS = "pr AS (SELECT r AS run, n_nationkey AS node, (n_nationkey * (r + 1) + n_regionkey) % 4 AS community FROM nation, (SELECT unnest(range(0, 5)) AS r))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return n.select("run", F.col("n_nationkey").alias("node"), ((F.col("n_nationkey") * (F.col("run") + 1) + F.col("n_regionkey")) % 4).alias("community"))


query("SELECT x.node AS i, y.node AS j, round(count(*) / 5, 6) + 0.0 AS agreement FROM pr x JOIN pr y ON x.run = y.run AND x.community = y.community AND x.node < y.node GROUP BY ALL", _RUNS, "agreement_matrix")(lambda spark, d: rounded(gr.agreement(_runs(spark, d)), "agreement"))
query(
    "SELECT g, node, round(strength, 0) + 0.0 AS strength, round(z, 6) + 0.0 AS z, z > 1.0 AS is_hub FROM (SELECT g, node, strength, coalesce((strength - avg(strength) OVER p) / nullif(stddev_pop(strength) OVER p, 0), 0) AS z FROM ldeg WINDOW p AS (PARTITION BY g))",
    TRADE, "layer_hubs",
)(lambda spark, d: rounded(rounded(gr.layer_hubs(layers(spark, d)), "strength", digits=0), "z"))
query("SELECT node, round(2.0 * (1 - sum(strength * strength) / pow(sum(strength), 2)), 6) + 0.0 AS participation FROM ldeg GROUP BY 1", TRADE, "multiplex_participation")(lambda spark, d: rounded(gr.multiplex_participation(layers(spark, d)), "participation"))


def _modes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = trade(spark, d)
    return tuple(t.select(F.lit(0).alias("g"), "i", "j", F.col(c).alias("w")) for c in ("n", "revenue"))


query("SELECT 0 AS g, round(corr(n, revenue), 6) + 0.0 AS r, count(*) AS n FROM trade", TRADE, "sc_fc_coupling_global")(lambda spark, d: rounded(gr.coupling_global(*_modes(spark, d)), "r"))
query("SELECT 0 AS g, i AS node, round(corr(n, revenue), 6) + 0.0 AS r, count(*) AS n FROM (SELECT i, j, n, revenue FROM trade UNION ALL SELECT j, i, n, revenue FROM trade) GROUP BY i HAVING count(*) >= 3", TRADE, "sc_fc_coupling_regional")(lambda spark, d: rounded(gr.coupling_regional(*_modes(spark, d)), "r"))
query("SELECT 0 AS g, i AS node, round(corr(n, revenue), 6) + 0.0 AS r, count(*) AS n FROM (SELECT i, j, n, revenue FROM trade UNION ALL SELECT j, i, n, revenue FROM trade) WHERE n > 0 GROUP BY i HAVING count(*) >= 3", TRADE, "sc_fc_baum")(lambda spark, d: rounded(gr.coupling_regional(*_modes(spark, d), positive_only=True), "r"))
query(
    "SELECT 0 AS g, node, round(abs(f - s) / (abs(f) + abs(s) + 1e-10), 6) + 0.0 AS decoupling FROM (SELECT x.node, x.strength / max(x.strength) OVER () AS s, y.strength / max(y.strength) OVER () AS f FROM ldeg x JOIN ldeg y ON x.node = y.node AND x.g = 0 AND y.g = 1)",
    TRADE, "decoupling_index",
)(lambda spark, d: rounded(gr.decoupling_index(*_modes(spark, d)), "decoupling"))
query(
    "SELECT 0 AS g, node, min(c) AS component FROM reach GROUP BY node",
    TRADE + ", strong AS (SELECT i, j FROM trade WHERE n >= (SELECT quantile_cont(n, 0.95) FROM trade)), sa AS (SELECT i, j FROM strong UNION ALL SELECT j, i FROM strong), reach AS (SELECT i AS node, i AS c FROM sa UNION SELECT sa.j, reach.c FROM reach JOIN sa ON sa.i = reach.node)",
    "supra_threshold_components",
)(lambda spark, d: gr.components(_strong(spark, d)))


def _strong(spark: SparkSession, d: str) -> DataFrame:
    t = trade(spark, d)
    return t.join(F.broadcast(t.agg(F.percentile("n", 0.95).alias("c"))), F.col("n") >= F.col("c")).select(F.lit(0).alias("g"), "i", "j", F.col("n").alias("w"))


# ----------------------------------------------------------------------- statistics

_TWO = METRICS + ", s AS (SELECT metric, count(value) FILTER (grp = 'BUILDING') AS n1, avg(value) FILTER (grp = 'BUILDING') AS m1, var_samp(value) FILTER (grp = 'BUILDING') AS v1, count(value) FILTER (grp = 'MACHINERY') AS n2, avg(value) FILTER (grp = 'MACHINERY') AS m2, var_samp(value) FILTER (grp = 'MACHINERY') AS v2 FROM m GROUP BY 1), ef AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s)"
A, B = "BUILDING", "MACHINERY"


def _two(spark: SparkSession, d: str) -> DataFrame:
    return st.two_groups(metrics(spark, d), "value", "grp", A, B, "metric")


query("SELECT metric, n1, n2, round(m1, 6) + 0.0 AS m1, round(m2, 6) + 0.0 AS m2, round(v1, 3) + 0.0 AS v1, round(v2, 3) + 0.0 AS v2 FROM s", _TWO, "group_compare_stats")(lambda spark, d: rounded(rounded(_two(spark, d), "m1", "m2"), "v1", "v2", digits=3))
query(
    "SELECT metric, round(d, 6) + 0.0 AS d, round(d * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1)), 6) + 0.0 AS hedges_g, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM ef",
    _TWO, "effect_sizes",
)(lambda spark, d: rounded(st.effect_sizes(_two(spark, d)), "d", "hedges_g").select("metric", "d", "hedges_g", "effect"))
query(
    "SELECT metric, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS t_student, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t_welch, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) + 0.0 AS df_welch FROM s",
    _TWO, "t_tests",
)(lambda spark, d: rounded(rounded(st.t_statistics(_two(spark, d)), "t_student", "t_welch"), "df_welch", digits=4).select("metric", "t_student", "t_welch", "df_welch"))
_MW = METRICS + ", rk AS (SELECT metric, grp, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM m WHERE grp IN ('BUILDING', 'MACHINERY')), u AS (SELECT metric, sum(r) FILTER (grp = 'BUILDING') AS r1, count(*) FILTER (grp = 'BUILDING') AS n1, count(*) FILTER (grp <> 'BUILDING') AS n2 FROM rk GROUP BY 1)"
query("SELECT metric, r1 - n1 * (n1 + 1) / 2.0 AS u, round(2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) + 0.0 AS rank_biserial FROM u", _MW, "mann_whitney_u")(lambda spark, d: rounded(st.mann_whitney(metrics(spark, d), "value", "grp", A, B, "metric"), "rank_biserial"))
query(
    "SELECT metric, round(12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1), 4) + 0.0 AS h, count(*) AS groups FROM (SELECT metric, grp, sum(r) AS s, count(*) AS n FROM (SELECT metric, grp, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM m) GROUP BY ALL) GROUP BY 1",
    METRICS, "kruskal_h",
)(lambda spark, d: rounded(st.kruskal(metrics(spark, d), "value", "grp", "metric"), "h", digits=4))
query(
    "SELECT round(max(abs(c1 / t1 - c2 / t2)), 6) + 0.0 AS ks FROM (SELECT sum(n1) OVER o AS c1, sum(n2) OVER o AS c2, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM (SELECT balance AS v, count(*) FILTER (grp = 'BUILDING') AS n1, count(*) FILTER (grp = 'MACHINERY') AS n2 FROM x WHERE grp IN ('BUILDING', 'MACHINERY') GROUP BY 1) WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING))",
    METRICS, "ks_stat",
)(lambda spark, d: rounded(st.kolmogorov_smirnov(metrics(spark, d).filter("metric = 'balance'"), "value", "grp", A, B), "ks"))
query(
    "SELECT round((sum(n) - count(*)) / (count(*) - 1) * (sum(n * mz * mz) - pow(sum(n * mz), 2) / sum(n)) / sum(n * vz), 4) + 0.0 AS levene FROM (SELECT grp, count(*) AS n, avg(z) AS mz, var_pop(z) AS vz FROM (SELECT grp, abs(balance - avg(balance) OVER (PARTITION BY grp)) AS z FROM x) GROUP BY 1)",
    METRICS, "levene_stat",
)(lambda spark, d: rounded(st.levene(metrics(spark, d).filter("metric = 'balance'"), "value", "grp"), "levene", digits=4))
query(
    "SELECT round(b / (b + w), 6) + 0.0 AS eta_squared, round((b / (k - 1)) / (w / (t - k)), 4) + 0.0 AS f_ratio FROM (SELECT sum(n * mm * mm) - pow(sum(n * mm), 2) / sum(n) AS b, sum(n * vv) AS w, count(*) AS k, sum(n) AS t FROM (SELECT grp, count(*) AS n, avg(balance) AS mm, var_pop(balance) AS vv FROM x GROUP BY 1))",
    METRICS, "eta_squared",
)(lambda spark, d: rounded(rounded(st.eta_squared(metrics(spark, d).filter("metric = 'balance'"), "value", "grp"), "eta_squared"), "f_ratio", digits=4))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).filter("metric = 'balance'").groupBy("site", "grp").agg(F.avg("value").alias("value"))


query(
    "SELECT round((b - w) / (b + (k - 1) * w), 6) + 0.0 AS icc_11, round((b - e) / (b + (k - 1) * e + k * (r - e) / n), 6) + 0.0 AS icc_21, round((b - e) / (b + (k - 1) * e), 6) + 0.0 AS icc_31 FROM (SELECT n, k, sst / (n - 1) AS b, ssr / (k - 1) AS r, (tt - sst) / (n * (k - 1)) AS w, (tt - sst - ssr) / ((n - 1) * (k - 1)) AS e FROM (SELECT (SELECT count(DISTINCT site) FROM q) AS n, (SELECT count(DISTINCT grp) FROM q) AS k, (SELECT var_pop(a) FROM (SELECT avg(v) AS a FROM q GROUP BY site)) * count(*) AS sst, (SELECT var_pop(a) FROM (SELECT avg(v) AS a FROM q GROUP BY grp)) * count(*) AS ssr, var_pop(v) * count(*) AS tt FROM q))",
    METRICS + ", q AS (SELECT site, grp, avg(balance) AS v FROM x GROUP BY ALL)", "icc",
)(lambda spark, d: rounded(st.icc(_ratings(spark, d), "site", "grp", "value"), "icc_11", "icc_21", "icc_31"))
query("SELECT subject, metric, round(coalesce(0.6745 * (value - md) / nullif(median(abs(value - md)) OVER (PARTITION BY metric), 0), 0), 6) + 0.0 AS robust_z FROM (SELECT *, median(value) OVER (PARTITION BY metric) AS md FROM m)", METRICS, "robust_z")(lambda spark, d: rounded(st.robust_z(metrics(spark, d), "value", "metric"), "robust_z").select("subject", "metric", "robust_z"))
_REF = METRICS + ", rf AS (SELECT subject, m.metric, coalesce((value - mu) / nullif(sd, 0), 0) AS z FROM m JOIN (SELECT metric, avg(value) AS mu, stddev_samp(value) AS sd FROM m WHERE grp = 'BUILDING' GROUP BY 1) r ON r.metric = m.metric)"


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return st.reference_z(metrics(spark, d), "value", F.col("grp") == A, "metric").select("subject", "metric", "z")


query("SELECT subject, metric, round(z, 6) + 0.0 AS z FROM rf", _REF, "patient_zscores")(lambda spark, d: rounded(_patients(spark, d), "z"))
query("SELECT subject, count(*) AS n_extreme FROM rf WHERE abs(z) > 1.5 GROUP BY 1", _REF, "extreme_subjects")(lambda spark, d: _patients(spark, d).filter(F.abs("z") > 1.5).groupBy("subject").agg(F.count(F.lit(1)).alias("n_extreme")))
query(
    "SELECT subject, round(coalesce((balance - avg(balance) OVER p) / nullif(stddev_samp(balance) OVER p, 0), 0) * (SELECT stddev_samp(balance) FROM x) + (SELECT avg(balance) FROM x), 4) + 0.0 AS harmonized FROM x WINDOW p AS (PARTITION BY site)",
    METRICS, "zscore_harmonize",
)(lambda spark, d: rounded(st.harmonize(metrics(spark, d).filter("metric = 'balance'"), "value", "site"), "harmonized", digits=4).select("subject", "harmonized"))
query("SELECT subject, metric, round(100 * cume_dist() OVER (PARTITION BY metric ORDER BY value), 6) + 0.0 AS percentile FROM m", METRICS, "percentile_normalize")(lambda spark, d: rounded(st.weak_percentile(metrics(spark, d), "value", "metric"), "percentile").select("subject", "metric", "percentile"))
query(
    "SELECT site, count(*) AS n, round(avg(balance), 6) + 0.0 AS mean_v, round(stddev_samp(balance), 6) + 0.0 AS sd_v, round(kurtosis_pop(balance), 6) + 0.0 AS kurt_v FROM x GROUP BY 1",
    METRICS, "batch_diagnosis",
)(lambda spark, d: rounded(st.batch_diagnosis(metrics(spark, d).filter("metric = 'balance'"), "value", "site"), "mean_v", "sd_v", "kurt_v").drop("skew_v"))
query("SELECT metric, round(corr(rx, ry), 6) + 0.0 AS rho FROM (SELECT 'all' AS metric, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0 AS rx, rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 AS ry FROM x) GROUP BY 1", METRICS, "spearman")(
    lambda spark, d: rounded(se.spearman(metrics(spark, d).groupBy("subject").pivot("metric", ["balance", "orders"]).agg(F.first("value")).withColumn("metric", F.lit("all")), "balance", "orders", "metric"), "rho")
)
_P = "p AS (SELECT p_partkey AS id, p_brand AS grp, (p_partkey % 97 + 1) / 100.0 * (p_size / 50.0) AS p FROM part)"


def _pvalues(spark: SparkSession, d: str) -> DataFrame:
    # a column between 0 and 1 stands in for p-values
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), ((F.col("p_partkey") % 97 + 1) / 100.0 * (F.col("p_size") / 50.0)).alias("p"))


_RN = _P + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM p)"
_ADJ = {
    "bonferroni": "least(1, p * n)",
    "holm": "least(1, max(p * (n - rn + 1)) OVER (PARTITION BY grp ORDER BY p, id ROWS UNBOUNDED PRECEDING))",
    "fdr_bh": "least(1, min(p * n / rn) OVER (PARTITION BY grp ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "fdr_by": "least(1, h * min(p * n / rn) OVER (PARTITION BY grp ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
}
for _name, _expr in _ADJ.items():
    query(f"SELECT id, grp, round({_expr}, 6) + 0.0 AS p_adjusted FROM (SELECT *, sum(1.0 / rn) OVER (PARTITION BY grp) AS h FROM r)", _RN, _name)(lambda spark, d, m=_name.removeprefix("fdr_"): rounded(ranks.adjust_p(_pvalues(spark, d), "p", "grp", method=m), "p_adjusted").select("id", "grp", "p_adjusted"))
query(
    "SELECT o_orderstatus, round(sum((d - pd) * (v + pv) / 2), 2) + 0.0 AS auc FROM (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv FROM (SELECT o_orderstatus, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY d)) GROUP BY 1",
    name="auc_trapezoid",
)(lambda spark, d: rounded(st.trapezoid(table(spark, d, "orders").groupBy("o_orderstatus", F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y")), "x", "y", "o_orderstatus"), "auc", digits=2))
