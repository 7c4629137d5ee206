"""Operators on event rasters ``(subject, t, roi, event)``: synchrony, density and spatio-temporal clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.operators.graph import components

SIGMA = 3.0
RADIUS = 12


def kuramoto(events: DataFrame) -> DataFrame:
    """``subject, mean_r, sd_r, susceptibility`` of the phase coherence of events as phases 0 and pi, by frame."""
    phase = F.col("event") * math.pi
    r = events.groupBy("subject", "t").agg(F.hypot(F.avg(F.cos(phase)), F.avg(F.sin(phase))).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.groupBy("subject").agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("sd_r"), (F.max("n") * F.var_pop("r")).alias("susceptibility"))


def control_parameter(events: DataFrame) -> DataFrame:
    """``subject, t, density, smoothed, spread``: events of a frame, the same under a Gaussian of 3 frames, and the channels' variance.

    The series is mirrored at its ends.  Frames run from 0 without gaps.
    """
    frames = events.groupBy("subject", "t").agg(F.sum("event").cast("double").alias("density"), F.var_pop("v").alias("spread"))
    weights = [math.exp(-k * k / (2 * SIGMA**2)) for k in range(-RADIUS, RADIUS + 1)]
    total = sum(weights)
    taps = F.explode(F.array(*[F.struct(F.lit(k - RADIUS).alias("k"), F.lit(w / total).alias("w")) for k, w in enumerate(weights)])).alias("tap")
    size = frames.groupBy("subject").agg((F.max("t") + 1).alias("n"))
    at = F.pmod(F.col("t") + F.col("tap.k"), 2 * F.col("n"))
    wanted = frames.join(size, "subject").select("subject", "t", "n", taps).select("subject", "t", F.col("tap.w").alias("w"), F.when(at < F.col("n"), at).otherwise(2 * F.col("n") - 1 - at).alias("s"))
    source = frames.select("subject", F.col("t").alias("s"), F.col("density").alias("x"))
    smooth = wanted.join(source, ["subject", "s"]).groupBy("subject", "t").agg(F.sum(F.col("w") * F.col("x")).alias("smoothed"))
    return frames.join(smooth, ["subject", "t"]).select("subject", "t", "density", "smoothed", "spread")


def st_clusters(events: DataFrame, adjacency: DataFrame, window: int = 1) -> DataFrame:
    """``subject, component, size, start_t, duration`` of events joined through frames at most ``window`` apart and adjacent channels.

    ``adjacency`` has ``subject, i, j`` (either order); a channel is adjacent to itself.  The
    band join is an equality join: each event is offered to the ``window + 1`` frames from its own on.
    """
    hits = events.filter("event = 1").select("subject", "t", "roi", F.concat(F.lpad(F.col("t").cast("string"), 10, "0"), F.lit(":"), F.col("roi").cast("string")).alias("node"))
    offered = hits.select("subject", F.col("roi").alias("i"), F.col("node").alias("a"), F.explode(F.sequence(F.col("t"), F.col("t") + window)).alias("t"))
    met = offered.join(hits.select("subject", "t", F.col("roi").alias("j"), F.col("node").alias("b")), ["subject", "t"]).filter("a <> b")
    both = adjacency.select("subject", "i", "j").union(adjacency.select("subject", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    near = met.filter("i <> j").join(both, ["subject", "i", "j"], "left_semi").select("subject", "a", "b").union(met.filter("i = j").select("subject", "a", "b"))
    found = components(near.select(F.col("subject").alias("g"), F.col("a").alias("i"), F.col("b").alias("j"), F.lit(1.0).alias("w")))
    named = hits.join(found.select(F.col("g").alias("subject"), "node", "component"), ["subject", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("subject", "component").agg(F.count(F.lit(1)).alias("size"), F.min("t").alias("start_t"), (F.max("t") - F.min("t") + 1).alias("duration"))


def powerlaw_xmin(sizes: DataFrame, value: str, *by: str, least_tail: int = 5) -> DataFrame:
    """``by, xmin, alpha, ks, n_tail, sigma``: the lower cut whose fitted tail is nearest to the data by Kolmogorov-Smirnov distance.

    Candidates are the distinct values but the last two with ``least_tail`` values in their tail; the smallest of equals
    wins.  Works on counts of distinct values, so its candidate join grows with the square of those, not of the rows.
    """
    counts = sizes.filter(F.col(value) > 0).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy(*by).orderBy(F.desc("x"))
    ranked = counts.withColumn("place", F.row_number().over(down)).withColumn("tail", F.sum("c").over(down))
    candidates = ranked.filter((F.col("place") > 2) & (F.col("tail") >= least_tail)).select(*by, F.col("x").alias("xmin"), F.col("tail").alias("n"))
    tails = candidates.join(counts, list(by)).filter("x >= xmin")
    alpha = tails.groupBy(*by, "xmin", "n").agg((1 + F.max("n") / F.sum(F.col("c") * F.log(F.col("x") / (F.col("xmin") - 0.5)))).alias("alpha"))
    upto = F.sum("c").over(Window.partitionBy(*by, "xmin").orderBy("x"))
    placed = tails.withColumn("upto", upto).join(alpha, [*by, "xmin", "n"])
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(F.col("x") / F.col("xmin"), 1 - F.col("alpha"))))
    gap = F.greatest(F.abs(F.col("upto") / F.col("n") - fit), F.abs((F.col("upto") - F.col("c") + 1) / F.col("n") - fit))
    ks = placed.groupBy(*by, "xmin", "n", "alpha").agg(F.max(gap).alias("ks"))
    best = ks.groupBy(*by).agg(F.min_by(F.struct("xmin", "alpha", "ks", "n"), F.struct(F.round("ks", 12), "xmin")).alias("b"))
    return best.select(*by, "b.xmin", "b.alpha", "b.ks", F.col("b.n").alias("n_tail"), ((F.col("b.alpha") - 1) / F.sqrt("b.n")).alias("sigma"))
