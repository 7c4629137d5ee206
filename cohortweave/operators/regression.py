"""Least squares on several regressors: Gram matrices as sums, solved one row a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.operators.cohort import combat


def _grams(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """``keys, n``, the means of ``xs`` and ``y``, and their co-moments, by partial aggregates that do not cancel."""
    cols = [*xs, y]
    n = len(cols)
    pairs = [F.covar_pop(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    grouped = df.dropna(subset=cols).groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in cols)).alias("means"), F.array(*pairs).alias("moments"), F.lit(n).alias("width"))


def least_squares(df: DataFrame, y: str, xs: list[str], *keys: str) -> DataFrame:
    """``keys, n, intercept, slopes, r2, r2_adjusted``: the fit of ``y`` on ``xs`` in each group.

    Rows with a null in ``y`` or ``xs`` are left out.  The normal equations of a group are one row, whatever its rows, and
    are solved by a pseudo-inverse, so regressors that depend on each other share their slope.  ``r2`` is null where ``y`` is constant, ``r2_adjusted``
    where a group has no more than ``len(xs) + 1`` rows.
    """
    p = len(xs)
    upper = np.triu_indices(p + 1)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, means, moments in zip(b["n"], b["means"], b["moments"], strict=True):
                m = np.zeros((p + 1, p + 1))
                m[upper] = moments
                m = m + np.triu(m, 1).T
                size = np.sqrt(np.maximum(np.diag(m)[:p], 0))
                size[size == 0] = 1
                slopes = np.linalg.pinv(m[:p, :p] / np.outer(size, size), rcond=1e-10, hermitian=True) @ (m[:p, p] / size) / size
                whole = float(m[p, p])
                r2 = float(slopes @ m[:p, p]) / whole if whole > 0 else None
                adjusted = 1 - (1 - r2) * (n - 1) / (n - p - 1) if r2 is not None and n > p + 1 else None
                rows.append((float(means[p] - slopes @ np.asarray(means[:p])), slopes.tolist(), r2, adjusted))
            out = pd.DataFrame(rows, columns=["intercept", "slopes", "r2", "r2_adjusted"])
            yield pd.concat([b[[*keys, "n"]].reset_index(drop=True), out], axis=1)

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n long, intercept double, slopes array<double>, r2 double, r2_adjusted double"
    return _grams(df, y, xs, list(keys)).mapInPandas(solve, schema)


def within(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """``df`` with ``_c_<column>``: each column less its mean in the row's group."""
    w = Window.partitionBy(*keys)
    return df.withColumns({f"_c_{c}": F.col(c) - F.avg(c).over(w) for c in cols})


def _group_fit(df: DataFrame, y: str, xs: list[str], batch: str, keys: list[str]) -> DataFrame:
    """``df`` with ``_slopes``: slopes on ``xs`` in each of ``keys`` where every batch has a level of its own.

    Centring within batches first gives the same slopes as an indicator for each batch, whose number then does not matter.
    """
    means = df.dropna(subset=[y, *xs]).groupBy(*keys, batch).agg(*(F.avg(c).alias(f"_m_{c}") for c in (y, *xs)))
    centred = df.join(means, [*keys, batch], "left")
    centred = centred.withColumns({f"_c_{c}": F.col(c) - F.col(f"_m_{c}") for c in (y, *xs)})
    fit = least_squares(centred.select(*keys, *(f"_c_{c}" for c in (y, *xs))), f"_c_{y}", [f"_c_{x}" for x in xs], *keys)
    slopes = fit.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("slopes").alias("_slopes"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return centred.join(slopes, same, "left").drop(*(f"_k_{k}" for k in keys))


def residualize(df: DataFrame, y: str, xs: list[str], batch: str, *keys: str) -> DataFrame:
    """``df`` with ``residual``: ``y`` without what ``xs`` and the batch explain of it in each of ``keys``, about the mean of ``y``.

    A row with a null in ``y`` or ``xs`` has a null residual and does not count in the fit.
    """
    centred = _group_fit(df, y, xs, batch, list(keys))
    total = df.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    out = centred.join(total, list(keys))
    explained = sum((F.col("_slopes")[k] * F.col(f"_c_{x}") for k, x in enumerate(xs)), F.lit(0.0))
    return out.withColumn("residual", F.col(f"_c_{y}") - explained + F.col("_mean")).select(*df.columns, "residual")


def combat_with(df: DataFrame, value: str, xs: list[str], batch: str, feature: str, pooled: bool = True) -> DataFrame:
    """``df`` with ``harmonized``: ComBat that keeps what the covariates ``xs`` explain.

    Their part, from a fit with a level for every batch, is taken off first, the rest is harmonised and the part put back.
    """
    fitted = _group_fit(df, value, xs, batch, [feature])
    means = df.groupBy(feature).agg(*(F.avg(x).alias(f"_g_{x}") for x in xs))
    part = sum((F.col("_slopes")[k] * (F.col(x) - F.col(f"_g_{x}")) for k, x in enumerate(xs)), F.lit(0.0))
    less = fitted.join(means, feature).withColumn("_part", part).withColumn("_rest", F.col(value) - F.col("_part"))
    less = less.filter(F.col("_rest").isNotNull()).select(*df.columns, "_part", "_rest")
    return combat(less, "_rest", batch, feature, pooled).withColumn("harmonized", F.col("harmonized") + F.col("_part")).select(*df.columns, "harmonized")
