"""The driver's tables bound to the domain's tables, in Spark and as SQL prefixes for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators.series import densify

SUBJECTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    """``ts(subject, t, roi, v)``: hourly sums of event values; subject = user mod 4, channel = event type."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / (3600 * hours)).cast("long")
    rows = e.select((F.col("user_id") % SUBJECTS).alias("subject"), hour.alias("h"), F.col("event_type").alias("roi"), "value")
    start = rows.agg(F.min("h").alias("h0"))
    sums = rows.join(F.broadcast(start), how="cross").groupBy("subject", "roi", (F.col("h") - F.col("h0")).alias("t")).agg(F.round(F.sum("value"), 6).alias("v"))
    return densify(sums)


TS = """
b AS (SELECT user_id % 4 AS subject, CAST(floor(epoch(date_trunc('hour', ts)) / (3600 * {hours})) AS BIGINT) AS h, event_type AS roi, value FROM events),
lim AS (SELECT min(h) AS lo, max(h) AS hi FROM b),
g AS (SELECT subject, roi, h - lo AS t, round(sum(value), 6) AS v FROM b, lim GROUP BY ALL),
grid AS (SELECT s.subject, r.roi, k.t FROM (SELECT DISTINCT subject FROM b) s, (SELECT DISTINCT roi FROM b) r, (SELECT unnest(generate_series(0, (SELECT hi - lo FROM lim))) AS t) k),
ts AS (SELECT grid.subject, grid.t, grid.roi, coalesce(g.v, 0.0) AS v FROM grid LEFT JOIN g ON grid.subject = g.subject AND grid.roi = g.roi AND grid.t = g.t),
z AS (SELECT *, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w < 1e-12 THEN 1.0 ELSE stddev_pop(v) OVER w END AS z FROM ts WINDOW w AS (PARTITION BY subject, roi))"""


def ts_sql(hours: int = 1) -> str:
    """``ts`` and ``z`` as common table expressions."""
    return TS.format(hours=hours)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected nation graph ``(i, j, n, revenue)``: the lines and the revenue between two nations."""
    o, c, s, li = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier", "lineitem"))
    # sums by order and supplier first: the join with the dimension tables then meets far fewer rows
    lines = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    sides = lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pair = sides.filter("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("i"), F.greatest("c_nationkey", "s_nationkey").alias("j"))
    return pair.agg(F.sum("n").cast("double").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


TRADE = """
trade AS (SELECT least(c_nationkey, s_nationkey) AS i, greatest(c_nationkey, s_nationkey) AS j, CAST(count(*) AS DOUBLE) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
cut AS (SELECT quantile_cont(n, 0.6) AS c FROM trade),
e AS (SELECT 0 AS g, i, j, n AS w FROM trade, cut WHERE n >= c),
layers AS (SELECT 0 AS g, i, j, n AS w FROM trade UNION ALL SELECT 1, i, j, revenue FROM trade),
arcs AS (SELECT g, i, j, w FROM e UNION ALL SELECT g, j, i, w FROM e),
larcs AS (SELECT g, i, j, w FROM layers UNION ALL SELECT g, j, i, w FROM layers),
deg AS (SELECT g, i AS node, count(*) AS degree, sum(w) AS strength FROM arcs GROUP BY ALL),
ldeg AS (SELECT g, i AS node, count(*) AS degree, sum(w) AS strength FROM larcs GROUP BY ALL),
modules AS (SELECT n_nationkey AS node, n_regionkey AS module FROM nation)"""


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 40 % of the trade graph's edges by lines: ``(g, i, j, w)``."""
    t = trade(spark, sf_dir)
    cut = t.agg(F.percentile("n", 0.6).alias("c"))
    return t.join(F.broadcast(cut), F.col("n") >= F.col("c")).select(F.lit(0).alias("g"), "i", "j", F.col("n").alias("w"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of the whole trade graph: 0 lines, 1 revenue."""
    t = trade(spark, sf_dir)
    return t.select(F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col("n").alias("w")), F.struct(F.lit(1).alias("g"), F.col("revenue").alias("w")))).alias("x"), "i", "j").select("x.g", "i", "j", "x.w")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' regions as modules."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("module"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric_long``: order counts and account balances of customers, ``(subject, grp, site, metric, value)``."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"))
    x = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").alias("site"), F.col("c_acctbal").alias("balance"), F.coalesce("n_orders", F.lit(0.0)).alias("orders"))
    return x.unpivot(["subject", "grp", "site"], ["balance", "orders"], "metric", "value")


METRICS = """
x AS (SELECT c_custkey AS subject, c_mktsegment AS grp, n_regionkey AS site, c_acctbal AS balance, CAST(coalesce(k, 0) AS DOUBLE) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey),
m AS (SELECT subject, grp, site, 'balance' AS metric, balance AS value FROM x UNION ALL SELECT subject, grp, site, 'orders', orders FROM x)"""
