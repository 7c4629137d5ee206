"""Avalanches, point processes and criticality measures on z-scored series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.operators.series import zscore


def raster(ts: DataFrame, threshold: float = 1.5, mode: str = "exceedance") -> DataFrame:
    """Events ``(subject, t, roi, z, event)`` as 0 or 1.

    ``exceedance``: abs(z) above the threshold.  ``crossing``: z above it where the
    frame before was not (the first frame never).  ``peak``: a strict local maximum at or above it.
    """
    z = zscore(ts)
    w = Window.partitionBy("subject", "roi").orderBy("t")
    before, after = F.lag("z").over(w), F.lead("z").over(w)
    event = {
        "exceedance": F.abs("z") > threshold,
        "crossing": (F.col("z") > threshold) & (before <= threshold),
        "peak": (F.col("z") >= threshold) & (F.col("z") > before) & (F.col("z") > after),
    }[mode]
    return z.withColumn("event", F.coalesce(event.cast("int"), F.lit(0)))


def activity(events: DataFrame) -> DataFrame:
    """Events per subject and frame, ``(subject, t, act)``."""
    return events.groupBy("subject", "t").agg(F.sum("event").alias("act"))


def avalanches(act: DataFrame, min_duration: int = 1) -> DataFrame:
    """Runs of active frames: ``subject, start_t, end_t, size, duration, profile`` (runs at the edges too)."""
    live = act.filter("act > 0").withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy("subject").orderBy("t")))
    runs = live.groupBy("subject", "island").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.sum("act").alias("size"), F.count(F.lit(1)).alias("duration"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "act"))), lambda x: x["act"]).alias("profile"),
    )
    return runs.filter(F.col("duration") >= min_duration).drop("island")


def bin_activity(ts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Activity over bins of ``width`` frames: channels whose largest abs(z) in the bin exceeds the threshold."""
    z = zscore(ts)
    frames = F.count_distinct("t")
    last = z.groupBy("subject").agg(F.floor(frames / width).alias("bins"))
    cut = z.groupBy("subject", "roi", F.floor(F.col("t") / width).cast("long").alias("t")).agg(F.max(F.abs("z")).alias("m"))
    return cut.join(last, "subject").filter("t < bins").groupBy("subject", "t").agg(F.sum((F.col("m") > threshold).cast("int")).alias("act"))


def silent_fraction(act: DataFrame) -> DataFrame:
    """Share of frames without an event."""
    return act.groupBy("subject").agg(F.avg((F.col("act") == 0).cast("double")).alias("silent_fraction"))


def branching(act: DataFrame) -> DataFrame:
    """Mean, population deviation and median of A(t+1)/A(t) over frames with A(t) > 0."""
    nxt = F.lead("act").over(Window.partitionBy("subject").orderBy("t"))
    r = act.withColumn("nxt", nxt).filter("act > 0 and nxt is not null").withColumn("ratio", F.col("nxt") / F.col("act"))
    return r.groupBy("subject").agg(F.avg("ratio").alias("sigma"), F.stddev_pop("ratio").alias("sd"), F.median("ratio").alias("median"), F.count(F.lit(1)).alias("n"))


def branching_mr(act: DataFrame, max_lag: int) -> DataFrame:
    """Multistep regression: ln r_k on k over lags with r_k > 0 (three at least); m = exp(slope), b = exp(intercept)."""
    w = Window.partitionBy("subject")
    c = act.withColumn("c", F.col("act") - F.avg("act").over(w)).withColumn("var", F.var_pop("act").over(w))
    o = w.orderBy("t")
    ahead = c.select("subject", "c", "var", F.array(*[F.struct(F.lit(k).alias("k"), F.lead("c", k).over(o).alias("d")) for k in range(1, max_lag + 1)]).alias("lags"))
    lagged = ahead.select("subject", "c", "var", F.explode("lags").alias("x"))
    r = lagged.filter("x.d is not null").groupBy("subject", F.col("x.k").alias("k")).agg((F.avg(F.col("c") * F.col("x.d")) / F.max(F.nullif("var", F.lit(0.0)))).alias("r"))
    fit = r.filter("r > 0").groupBy("subject").agg(F.regr_slope(F.log("r"), F.col("k")).alias("slope"), F.regr_intercept(F.log("r"), F.col("k")).alias("start"), F.count(F.lit(1)).alias("lags"))
    return fit.filter("lags >= 3").select("subject", F.exp("slope").alias("m"), F.exp("start").alias("b"), "lags")


def size_by_duration(av: DataFrame) -> DataFrame:
    """Mean size and count of each duration."""
    return av.groupBy("subject", "duration").agg(F.avg("size").alias("mean_size"), F.count(F.lit(1)).alias("n"))


def scaling_relation(av: DataFrame) -> DataFrame:
    """Slope of log10 mean size on log10 duration, per subject (two durations at least)."""
    s = size_by_duration(av)
    fit = s.groupBy("subject").agg(F.regr_slope(F.log10("mean_size"), F.log10("duration")).alias("gamma"), F.count(F.lit(1)).alias("n"))
    return fit.filter("n >= 2").select("subject", "gamma", "n")


def powerlaw_mle(values: DataFrame, col: str, xmin: int = 1) -> DataFrame:
    """Exponent 1 + n / sum ln(x / (xmin - 1/2)) of the tail, its error (alpha - 1) / sqrt(n) and its KS distance."""
    tail = values.filter(F.col(col) >= xmin).select("subject", F.col(col).alias("x"))
    fit = tail.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), (1 + F.count(F.lit(1)) / F.sum(F.log(F.col("x") / (xmin - 0.5)))).alias("alpha"))
    w = Window.partitionBy("subject").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    seen = tail.join(fit, "subject").withColumn("i", F.count(F.lit(1)).over(w))
    model = 1 - F.pow(F.col("x") / F.lit(float(xmin)), 1 - F.col("alpha"))
    ks = seen.groupBy("subject").agg(F.max(F.abs(F.col("i") / F.col("n") - model)).alias("ks"))
    return fit.join(ks, "subject").select("subject", "n", "alpha", ((F.col("alpha") - 1) / F.sqrt("n")).alias("sigma"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ks"))).alias("ks"))


def kappa(values: DataFrame, col: str, alpha: float = 1.5, points: int = 10) -> DataFrame:
    """1 + mean difference of the reference and the observed cumulative shares at log-spaced points between the extremes."""
    lim = values.groupBy("subject").agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).filter("hi > lo")
    at = lim.select("subject", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = at.withColumn("x", F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("k") / F.lit(float(points - 1))))
    got = at.join(values.select("subject", F.col(col).alias("s")), "subject").groupBy("subject", "k", "x", "lo", "hi").agg(F.avg((F.col("s") <= F.col("x") + 1e-9).cast("double")).alias("f"))
    e = 1 - alpha
    ref = (F.pow("lo", F.lit(e)) - F.pow("x", F.lit(e))) / (F.pow("lo", F.lit(e)) - F.pow("hi", F.lit(e)))
    return got.groupBy("subject").agg((1 + F.avg(ref - F.col("f"))).alias("kappa"))


def criticality_score(value: Column, target: float) -> Column:
    """max(0, 1 - |v - target| / |target|), or max(0, 1 - |v|) for target 0; null stays null."""
    gap = F.abs(value) if target == 0 else F.abs(value - target) / abs(target)
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0.0), 1 - gap))


def event_overlap(events: DataFrame) -> DataFrame:
    """Jaccard, cosine and coincidence of two channels' events, pairs i < j; a zero denominator gives 0."""
    a = events.select("subject", "t", F.col("roi").alias("i"), F.col("event").alias("x"))
    b = events.select("subject", "t", F.col("roi").alias("j"), F.col("event").alias("y"))
    s = a.join(b, ["subject", "t"]).filter("i < j").groupBy("subject", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    over = lambda d: F.coalesce(F.col("both") / F.nullif(d, F.lit(0.0)), F.lit(0.0))
    return s.select("subject", "i", "j", over((F.col("nx") + F.col("ny") - F.col("both")).cast("double")).alias("jaccard"), over(F.sqrt(F.col("nx") * F.col("ny"))).alias("cosine"), over(F.least("nx", "ny").cast("double")).alias("coincidence"))


def order_parameter(ts: DataFrame) -> DataFrame:
    """Mean, population deviation and variance over time of the channels' mean z."""
    m = zscore(ts).groupBy("subject", "t").agg(F.avg("z").alias("m"))
    return m.groupBy("subject").agg(F.avg(F.abs("m")).alias("order"), F.stddev_pop("m").alias("sd"), F.var_pop("m").alias("susceptibility"))


def susceptibility_scan(ts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Mean and variance over time of the active share, for each threshold."""
    z = zscore(ts).select("subject", "t", F.abs("z").alias("a"), F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    f = z.groupBy("subject", "threshold", "t").agg(F.avg((F.col("a") > F.col("threshold")).cast("double")).alias("share"))
    return f.groupBy("subject", "threshold").agg(F.avg("share").alias("mean_share"), F.var_pop("share").alias("susceptibility"))


def shape_profiles(av: DataFrame) -> DataFrame:
    """Mean activity at each step of avalanches of equal duration."""
    steps = av.select("subject", "duration", F.posexplode("profile").alias("step", "act"))
    return steps.groupBy("subject", "duration", "step").agg(F.avg("act").alias("mean_act"), F.count(F.lit(1)).alias("n"))


def log_bins(values: DataFrame, col: str, per_decade: int = 5) -> DataFrame:
    """Counts of positive values in logarithmic bins."""
    b = F.floor(F.log10(F.col(col)) * per_decade + 1e-9).cast("long")
    return values.filter(F.col(col) > 0).groupBy("subject", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

