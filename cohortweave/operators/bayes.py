"""Bayesian regression: one predictor by quadrature in columns, and a hierarchical model by Gibbs chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import written

#: Points of the quadrature over the logarithm of the residual deviation.
POINTS = 401


def linear(df: DataFrame, y: str, x: str, *by: str, scale: float = 2.0) -> DataFrame:
    """``by, n`` and the posterior mean and deviation of ``alpha``, ``beta`` and ``sigma`` of y = alpha + beta x + noise.

    Priors: alpha and beta normal(0, ``scale``), sigma half-Cauchy(1).  Given sigma the posterior is normal, so sigma
    alone is summed over, at ``POINTS`` points within 12 of its standard errors in the logarithm.  Rows are read
    once, as sums of a group; the points are a group's, not a row's.  Rows with a null are left out; groups under
    three rows, or without a residual, have nulls.
    """
    v, u = F.col(y).cast("double"), F.col(x).cast("double")
    both = df.select(*by, v.alias("_y"), u.alias("_x")).filter("_y is not null and _x is not null")
    s = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), *(F.sum(F.col(a) * F.col(b)).alias(k) for k, a, b in (("sxx", "_x", "_x"), ("sxy", "_x", "_y"), ("syy", "_y", "_y"))), *(F.var_pop(a).alias(k) for k, a in (("vx", "_x"), ("vy", "_y"))), F.covar_pop("_x", "_y").alias("c"))
    rest = F.col("vy") - F.coalesce(F.col("c") * F.col("c") / F.nullif("vx", F.lit(0.0)), F.lit(0.0))
    fit = s.withColumn("u0", F.when((F.col("n") >= 3) & (rest > 1e-12 * F.col("vy")), F.log(rest) / 2))
    k = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("k")
    half = (POINTS - 1) / 2
    at = fit.select("*", k).withColumn("u", F.col("u0") + (F.col("k") - half) / half * 12 / F.sqrt(2.0 * F.col("n")))
    at = at.withColumn("t", F.exp(-2 * F.col("u"))).withColumns({"p": F.col("n") * F.col("t") + 1 / scale**2, "q": F.col("sx") * F.col("t"), "r": F.col("sxx") * F.col("t") + 1 / scale**2})
    at = at.withColumn("det", F.col("p") * F.col("r") - F.col("q") * F.col("q"))
    at = at.withColumns({"a": F.col("t") * (F.col("r") * F.col("sy") - F.col("q") * F.col("sxy")) / F.col("det"), "b": F.col("t") * (F.col("p") * F.col("sxy") - F.col("q") * F.col("sy")) / F.col("det")})
    fitted = F.col("a") * F.col("sy") + F.col("b") * F.col("sxy")
    log = F.col("u") * (1 - F.col("n")) - F.col("t") * (F.col("syy") - fitted) / 2 - F.log("det") / 2 - F.log(1 + F.exp(2 * F.col("u")))
    at = at.withColumn("log", log)
    top = at.withColumn("w", F.exp(F.col("log") - F.max("log").over(Window.partitionBy(*by, "n"))))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    sigma = F.exp("u")
    m = top.groupBy(*by, "n").agg(mean(F.col("a")).alias("alpha"), mean(F.col("a") * F.col("a") + F.col("r") / F.col("det")).alias("aa"), mean(F.col("b")).alias("beta"), mean(F.col("b") * F.col("b") + F.col("p") / F.col("det")).alias("bb"), mean(sigma).alias("sigma"), mean(sigma * sigma).alias("ss"))
    sd = lambda two, one: F.sqrt(F.greatest(F.col(two) - F.col(one) * F.col(one), F.lit(0.0)))
    return m.select(*by, "n", "alpha", sd("aa", "alpha").alias("alpha_sd"), "beta", sd("bb", "beta").alias("beta_sd"), "sigma", sd("ss", "sigma").alias("sigma_sd"))


def _slices(log: Callable[[np.ndarray], np.ndarray], at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One step of slice sampling for each of independent values: intervals step out to both sides, then shrink to the point."""
    level = log(at) + np.log(rng.random(len(at)))
    low = at - rng.random(len(at))
    high = low + 1
    while (out := log(low) > level).any():
        low = low - out
    while (out := log(high) > level).any():
        high = high + out
    new, left = at, np.ones(len(at), bool)
    while left.any():
        new = np.where(left, low + (high - low) * rng.random(len(at)), new)
        left &= log(new) <= level
        low, high = np.where(left & (new < at), new, low), np.where(left & (new >= at), new, high)
    return new


def gibbs(cells: pd.DataFrame, draws: int, tune: int, seed: int, fixed: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``groups, means``: draws (``draws``, groups) of the mean slope of each group of places.

    y = a[subject] + b[place] x + noise(s);  a ~ normal(0, sa), b ~ normal(m[group], sb[group]), m ~ normal(0, 1),
    sa ~ half-normal(1), sb ~ half-normal(0.5), s ~ half-Cauchy(1).  ``cells`` has a row a subject and place with
    ``subject, place, grp, n, sx, sy, sxx, sxy, syy``.  A group's deviation is drawn with its slopes and mean
    integrated out, then the mean with the slopes integrated out, then the slopes, so that small deviations do not hold a chain.
    ``fixed`` (s, sa, sb) holds the deviations, for checks against the closed form.
    """
    rng = np.random.default_rng(seed)
    subjects, s = np.unique(cells["subject"], return_inverse=True)
    places, first, p = np.unique(cells["place"], return_index=True, return_inverse=True)
    groups, g = np.unique(cells["grp"].to_numpy()[first], return_inverse=True)
    n, sx, sy, sxx, sxy, syy = (cells[c].to_numpy(float) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    by_s = lambda w: np.bincount(s, w, len(subjects))
    by_p = lambda w: np.bincount(p, w, len(places))
    rows, own, spread = n.sum(), by_s(n), by_p(sxx)
    a, b, m = np.zeros(len(subjects)), np.zeros(len(places)), np.zeros(len(groups))
    noise, sa, sb = fixed or (1.0, 0.5, 0.25)
    log_sb = np.full(len(groups), np.log(sb))
    # places by group, one row a group; a place that fills a row up has no spread and adds a constant
    order = np.argsort(g, kind="stable")
    size = np.bincount(g, minlength=len(groups))
    slot = (g[order], np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size))
    shape = (len(groups), int(size.max()))
    z, c = np.zeros(shape), np.zeros(shape)
    z[slot] = by_p(sxx)[order]
    inverse = 1 / np.where(z > 0, z, 1.0)
    out = np.empty((draws, len(groups)))
    for it in range(tune + draws):
        weight = own / noise**2 + 1 / sa**2
        a = by_s(sy - b[p] * sx) / noise**2 / weight + rng.standard_normal(len(a)) / np.sqrt(weight)
        cross = by_p(sxy - a[s] * sx)
        c[slot] = cross[order]
        square, floor = c * c * inverse, noise**2

        def pooled(u: np.ndarray, floor: float = floor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = np.exp(2 * u)[:, None] * z + floor
            return 1 + (z / v).sum(1), (c / v).sum(1), v

        def log(u: np.ndarray, square: np.ndarray = square, pooled: Callable = pooled) -> np.ndarray:
            weight, total, v = pooled(u)
            return u - 2 * np.exp(2 * u) - 0.5 * (np.log(v).sum(1) + np.log(weight) + (square / v).sum(1) - total * total / weight)

        if not fixed:
            log_sb = _slices(log, log_sb, rng)
        weight, total, _ = pooled(log_sb)
        m = total / weight + rng.standard_normal(len(m)) / np.sqrt(weight)
        tight = np.exp(-2 * log_sb)[g]
        weight = spread / noise**2 + tight
        b = (cross / noise**2 + m[g] * tight) / weight + rng.standard_normal(len(b)) / np.sqrt(weight)
        if not fixed:
            q = float(a @ a)
            sa = float(np.exp(_slices(lambda u, q=q: u - len(a) * u - q * np.exp(-2 * u) / 2 - np.exp(2 * u) / 2, np.array([np.log(sa)]), rng)[0]))
            rest = (syy - 2 * a[s] * sy - 2 * b[p] * sxy + n * a[s] ** 2 + 2 * a[s] * b[p] * sx + b[p] ** 2 * sxx).sum()
            mixed = (1 + 1 / noise**2) / rng.gamma(1.0)  # the half-Cauchy as a mixture of inverse gammas
            noise = float(np.sqrt((max(rest, 0.0) / 2 + 1 / mixed) / rng.gamma((rows + 1) / 2)))
        if it >= tune:
            out[it - tune] = m
    return groups, out


def chains(df: DataFrame, key: str, subject: str, place: str, grp: str, y: str, x: str, draws: int, tune: int, n: int = 4) -> DataFrame:
    """``key, grp, chain, draw, m``: draws of the groups' mean slopes in ``n`` chains of each key's hierarchical model (`gibbs`).

    Rows become sums of a subject and place before anything is packed; a model is one packed row of those, so its size
    is that of the design, not of the rows.  Each chain is a row with a seed from its key and number alone.
    Rows with a null in any of these columns are left out; a place belongs to one group (the least of several).  The draws
    are a written table, as summaries read them several times.
    """
    cols = {"key": key, "subject": subject, "place": place, "grp": grp}
    rows = df.select(*(F.col(c).alias(k) for k, c in cols.items()), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna()
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    sums = rows.groupBy("key", "subject", "place").agg(F.min("grp").alias("grp"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    sums = sums.withColumn("grp", F.min("grp").over(Window.partitionBy("key", "place")))
    packed = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("subject", "place", "grp", *names))).alias("cells"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chain")).withColumn("seed", F.pmod(F.xxhash64("key", "chain"), F.lit(1 << 31))).repartition(tasks, "key", "chain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for k, cells, chain, seed in zip(t["key"], t["cells"], t["chain"], t["seed"], strict=True):
                table = pd.DataFrame([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in cells], columns=["subject", "place", "grp", *names])
                groups, m = gibbs(table, draws, tune, seed)
                yield pd.DataFrame({"key": np.repeat(k, m.size), "grp": np.tile(groups, draws), "chain": chain, "draw": np.repeat(np.arange(draws), len(groups)), "m": m.ravel()})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return written(work.mapInPandas(run, f"key {kinds['key']}, grp {kinds['grp']}, chain int, draw int, m double"))


def interval(df: DataFrame, value: str, *by: str, level: float = 0.94) -> DataFrame:
    """``by, low, high``: the narrowest stretch that holds ``level`` of the values (ties: the lowest), by a window over ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    # the stretch from rank r ends floor(level n) ranks later
    placed = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("low"), F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(whole).alias("n"))
    ends = placed.select(*by, F.col("low").alias("high"), (F.col("r") - F.floor(F.col("n") * level)).cast("int").alias("r"))
    return placed.select(*by, "low", "r").join(ends, [*by, "r"]).groupBy(*by).agg(F.min_by(F.struct("low", "high"), F.struct(F.col("high") - F.col("low"), F.col("low"))).alias("x")).select(*by, "x.low", "x.high")


def summary(draws: DataFrame, *by: str) -> DataFrame:
    """``by, mean, sd, low, high, rhat, credible`` of chains' draws: the 94 % interval, the ratio of spread between and within chains, 0 outside."""
    one = draws.groupBy(*by, "chain").agg(F.count("m").alias("k"), F.avg("m").alias("cm"), F.var_samp("m").alias("cv"))
    r = one.groupBy(*by).agg(F.sqrt((F.avg("cv") * (1 - 1 / F.avg("k")) + F.var_samp("cm")) / F.nullif(F.avg("cv"), F.lit(0.0))).alias("rhat"))
    m = draws.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    out = m.join(interval(draws, "m", *by), list(by)).join(r, list(by))
    credible: Column = (F.col("low") > 0) | (F.col("high") < 0)
    return out.select(*by, "mean", "sd", "low", "high", "rhat", credible.alias("credible"))
