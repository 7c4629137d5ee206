"""Operators on long time series ``(subject, t, roi, v)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.functions.ranks import average_rank


def densify(samples: DataFrame) -> DataFrame:
    """Every subject, channel and frame from the first to the last; missing frames are 0.

    One row of bounds and one list of channels are broadcast (channels are few by design).
    """
    bounds = samples.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    heads = samples.select("subject").distinct().join(F.broadcast(samples.select("roi").distinct()), how="cross").join(F.broadcast(bounds), how="cross")
    grid = heads.select("subject", "roi", F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(samples, ["subject", "roi", "t"], "left").select("subject", "t", "roi", F.coalesce("v", F.lit(0.0)).alias("v"))


def zscore(ts: DataFrame) -> DataFrame:
    """Add ``z`` per subject and channel (population deviation; a constant channel has 0)."""
    w = Window.partitionBy("subject", "roi")
    sd = F.stddev_pop("v").over(w)
    return ts.withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.when(sd < 1e-12, 1.0).otherwise(sd))


def correlation(ts: DataFrame) -> DataFrame:
    """Pearson correlation ``(subject, i, j, w)`` of channel pairs i < j."""
    a, b = ts.select("subject", "t", F.col("roi").alias("i"), F.col("v").alias("x")), ts.select("subject", "t", F.col("roi").alias("j"), F.col("v").alias("y"))
    return a.join(b, ["subject", "t"]).filter("i < j").groupBy("subject", "i", "j").agg(F.corr("x", "y").alias("w"))


def covariance(ts: DataFrame) -> DataFrame:
    """Sample covariance of channel pairs i <= j."""
    a, b = ts.select("subject", "t", F.col("roi").alias("i"), F.col("v").alias("x")), ts.select("subject", "t", F.col("roi").alias("j"), F.col("v").alias("y"))
    return a.join(b, ["subject", "t"]).filter("i <= j").groupBy("subject", "i", "j").agg(F.covar_samp("x", "y").alias("w"))


def sliding_correlation(ts: DataFrame, width: int, step: int) -> DataFrame:
    """Correlation of channel pairs in each complete window, ``(subject, window, i, j, w)``."""
    last = F.max("t").over(Window.partitionBy("subject"))
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / step)).cast("long"), F.floor(F.col("t") / step).cast("long"))
    rows = ts.withColumn("last", last).withColumn("window", F.explode(starts)).filter((F.col("window") * step + width - 1 <= F.col("last")) & (F.col("window") * step <= F.col("t")) & (F.col("t") < F.col("window") * step + width))
    keyed = rows.select(F.concat_ws(":", "subject", "window").alias("subject"), "t", "roi", "v")
    got = correlation(keyed)
    return got.select(F.split("subject", ":")[0].cast("long").alias("subject"), F.split("subject", ":")[1].cast("long").alias("window"), "i", "j", "w")


def coupling_variability(dynamic: DataFrame) -> DataFrame:
    """Mean, population deviation and number of windows of each pair's sliding correlation."""
    return dynamic.filter("w is not null and not isnan(w)").groupBy("subject", "i", "j").agg(F.avg("w").alias("mean_w"), F.stddev_pop("w").alias("sd_w"), F.count(F.lit(1)).alias("n"))


def coarse_grain(ts: DataFrame, scale: int) -> DataFrame:
    """Means of ``scale`` consecutive frames; an incomplete last group is dropped."""
    return ts.groupBy("subject", "roi", F.floor(F.col("t") / scale).cast("long").alias("t")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == scale).drop("n")


def moving_average(ts: DataFrame, half: int) -> DataFrame:
    """Centred mean over up to ``2 half + 1`` frames."""
    w = Window.partitionBy("subject", "roi").orderBy("t").rowsBetween(-half, half)
    return ts.withColumn("smooth", F.avg("v").over(w))


def permutation_entropy(ts: DataFrame, order: int = 3) -> DataFrame:
    """Normalised entropy (base 2) of ordinal patterns of ``order`` successive values; ties in time order."""
    w = Window.partitionBy("subject", "roi").orderBy("t")
    values = F.array(*[F.struct(F.lead("v", k).over(w).alias("v"), F.lit(k).alias("k")) for k in range(order)])
    pattern = F.array_join(F.transform(F.array_sort(values), lambda x: x["k"].cast("string")), "")
    rows = ts.select("subject", "roi", F.lead("v", order - 1).over(w).alias("end"), pattern.alias("pattern")).filter("end is not null")
    counts = rows.groupBy("subject", "roi", "pattern").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("subject", "roi"))
    most = 1
    for k in range(2, order + 1):
        most *= k
    return counts.withColumn("p", p).groupBy("subject", "roi").agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(most)))).alias("entropy"))


def autocorrelation(ts: DataFrame, max_lag: int) -> DataFrame:
    """Biased autocorrelation at lags 1..``max_lag`` of each channel, ``(subject, roi, lag, r)``."""
    w = Window.partitionBy("subject", "roi")
    c = ts.withColumn("c", F.col("v") - F.avg("v").over(w)).withColumn("ss", F.sum(F.col("c") * F.col("c")).over(w))
    ordered = w.orderBy("t")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("c", k).over(ordered).alias("d")) for k in range(1, max_lag + 1)])
    rows = c.select("subject", "roi", "c", "ss", lags.alias("lags")).select("subject", "roi", "c", "ss", F.explode("lags").alias("x"))
    return rows.groupBy("subject", "roi", F.col("x.lag").alias("lag")).agg((F.sum(F.col("c") * F.col("x.d")) / F.max(F.nullif("ss", F.lit(0.0)))).alias("r"))


def temporal_snr(ts: DataFrame) -> DataFrame:
    """Mean over population deviation of each channel; null for a constant one."""
    return ts.groupBy("subject", "roi").agg((F.avg("v") / F.nullif(F.stddev_pop("v"), F.lit(0.0))).alias("tsnr"))


def outlier_channels(ts: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Channels whose deviation lies ``threshold`` or more robust z (median, MAD) from their subject's."""
    sd = ts.groupBy("subject", "roi").agg(F.stddev_pop("v").alias("sd"))
    mid = sd.groupBy("subject").agg(F.median("sd").alias("mid"))
    gap = sd.join(mid, "subject").withColumn("gap", F.abs(F.col("sd") - F.col("mid")))
    mad = gap.groupBy("subject").agg(F.median("gap").alias("mad"))
    z = 0.6745 * F.col("gap") / F.nullif("mad", F.lit(0.0))
    return gap.join(mad, "subject").select("subject", "roi", "sd", F.coalesce(z, F.lit(0.0)).alias("robust_z"), F.coalesce(z >= threshold, F.lit(False)).alias("is_outlier"))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Spearman correlation of two columns within ``by``: Pearson's of the average ranks."""
    ranked = rows.select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    return ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))
