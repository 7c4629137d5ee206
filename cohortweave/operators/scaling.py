"""Detrended fluctuations as window sums, and the break between two scaling regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fluctuations(ts: DataFrame, scales: list[int]) -> DataFrame:
    """``subject, roi, scale, f``: root mean square distance of the profile from its line in windows of each scale.

    Windows follow one another from the start; what is left over at the end does not count.  A scale needs four windows.
    """
    by = Window.partitionBy("subject", "roi")
    centred = ts.select("subject", "roi", "t", (F.col("v") - F.avg("v").over(by)).alias("d"), F.count(F.lit(1)).over(by).alias("n"))
    path = Window.partitionBy("subject", "roi").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    profile = centred.select("subject", "roi", "n", (F.row_number().over(Window.partitionBy("subject", "roi").orderBy("t")) - 1).alias("i"), F.sum("d").over(path).alias("y"))
    s = profile.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).filter(F.floor(F.col("n") / F.col("scale")) >= 4)
    s = s.withColumn("part", F.floor(F.col("i") / F.col("scale"))).filter(F.col("part") < F.floor(F.col("n") / F.col("scale")))
    u = F.col("i") - F.col("part") * F.col("scale") - (F.col("scale") - 1) / 2
    part = s.groupBy("subject", "roi", "scale", "part").agg(F.var_pop("y").alias("vy"), F.avg(u * F.col("y")).alias("uy"))
    spread = (F.col("scale") * F.col("scale") - 1) / 12  # variance of the window's own times
    rest = F.greatest(F.lit(0.0), F.col("vy") - F.col("uy") * F.col("uy") / spread)
    return part.groupBy("subject", "roi", "scale").agg(F.sqrt(F.avg(rest)).alias("f"))


def _left_over(n: Column, x: Column, y: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """The squares that a line leaves, of sums."""
    sxx, sxy, syy = xx - F.try_divide(x * x, n), xy - F.try_divide(x * y, n), yy - F.try_divide(y * y, n)
    return F.greatest(F.lit(0.0), syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)))


def _slope(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> Column:
    return F.try_divide(xy - F.try_divide(x * y, n), xx - F.try_divide(x * x, n))


def crossover(points: DataFrame, *keys: str, x: str = "x", y: str = "y", least: int = 3, gain: float = 0.1) -> DataFrame:
    """``keys, slope, crossover_x, slope_low, slope_high, improvement, split``: the best break of each curve into two lines.

    All breaks that leave ``least`` points on each side are held against one line by running sums in one window;
    the break is at the point where the second line begins.  The last five columns are null where no break takes more than
    ``gain`` of the squares that one line leaves, or a curve has under ``2 least + 1`` points.
    """
    by = Window.partitionBy(*keys)
    clean = points.dropna(subset=[x, y])
    at = clean.select(*keys, F.col(x).alias("_o"), (F.col(x) - F.avg(x).over(by)).alias("_x"), (F.col(y) - F.avg(y).over(by)).alias("_y"))
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") * F.col("_y")}
    low = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(*keys, "_o", (F.row_number().over(Window.partitionBy(*keys).orderBy("_o")) - 1).alias("split"), *(F.sum(v).over(by).alias(f"t_{k}") for k, v in terms.items()), *(F.coalesce(F.sum(v).over(low), F.lit(0.0)).alias(f"l_{k}") for k, v in terms.items()))
    total, before = {k: F.col(f"t_{k}") for k in terms}, {k: F.col(f"l_{k}") for k in terms}
    after = {k: total[k] - before[k] for k in terms}
    line = lambda s: _slope(*(s[k] for k in ("n", "x", "y", "xx", "xy")))
    may = (F.col("split") >= least) & (F.col("split") < F.col("t_n") - least) & (F.col("t_n") >= 2 * least + 1)
    one = _left_over(*total.values())
    cut = F.when(may, F.coalesce(1 - F.try_divide(_left_over(*before.values()) + _left_over(*after.values()), one), F.lit(0.0)))
    split = F.struct(cut.alias("improvement"), (-F.col("split")).alias("order"), F.col("_o").alias("crossover_x"), line(before).alias("slope_low"), line(after).alias("slope_high"))
    best = at.select(*keys, line(total).alias("slope"), split.alias("cut")).groupBy(*keys).agg(F.first("slope").alias("slope"), F.max(F.when(F.col("cut.improvement") > gain, F.col("cut"))).alias("cut"))
    return best.select(*keys, "slope", "cut.crossover_x", "cut.slope_low", "cut.slope_high", "cut.improvement", (-F.col("cut.order")).cast("long").alias("split"))
