"""Joint Procrustes alignment of many subjects' vectors ``(subject, node, v)`` to a template that is their mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.session import cut


def _apart(name: str, k: int) -> list[Column]:
    return [F.col(name)[c] for c in range(k)]


def rotations(x: DataFrame, template: DataFrame, k: int) -> DataFrame:
    """``subject, rotation, source, target``: the orthogonal map of each subject's ``v`` onto the template's, and both means.

    Cross-moments of ``k`` by ``k`` are partial aggregates over the nodes both have; a subject is one row of an SVD, whatever its nodes.
    """
    both = x.join(template.select("node", F.col("v").alias("t")), "node")
    own, goal = _apart("v", k), _apart("t", k)
    sums = both.groupBy("subject").agg(
        F.array(*(F.covar_pop(a, b) for a in own for b in goal)).alias("cross"), F.array(*map(F.avg, own)).alias("source"), F.array(*map(F.avg, goal)).alias("target")
    )
    kind = x.schema["subject"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for m in b["cross"]:
                u, _, v = np.linalg.svd(np.asarray(m, float).reshape(k, k))
                found.append((u @ v).ravel().tolist())
            yield b[["subject"]].assign(rotation=found, source=b["source"], target=b["target"])

    return sums.mapInPandas(solve, f"subject {kind}, rotation array<double>, source array<double>, target array<double>")


def rotated(x: DataFrame, by: DataFrame, k: int) -> DataFrame:
    """``subject, node, v``: vectors less their subject's mean, turned, about the template's mean."""
    less = [F.col("v")[a] - F.col("source")[a] for a in range(k)]
    turned = [sum((less[a] * F.col("rotation")[a * k + b] for a in range(k)), F.lit(0.0)) + F.col("target")[b] for b in range(k)]
    return x.join(by, "subject").select("subject", "node", F.array(*turned).alias("v"))


def mean_template(x: DataFrame, k: int) -> DataFrame:
    """``node, v``: the mean of each node's vectors over the subjects."""
    return x.groupBy("node").agg(F.array(*map(F.avg, _apart("v", k))).alias("v"))


def align_jointly(x: DataFrame, k: int, reference: str = "mean", rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Aligned ``subject, node, v`` and the template ``node, v``.

    ``reference="first"``: all are aligned once to the smallest subject's vectors.  ``"mean"``: ``rounds`` times, each time to
    the mean of the aligned ones (the smallest subject's at first); the template returned is the mean of the vectors returned.
    Rows with a null subject, node, vector or component are left out, each (subject, node) is one row.  A round keeps a row
    a subject and a row a node; the vectors themselves are only read.
    """
    if reference not in ("first", "mean"):
        raise ValueError(f"unknown reference: {reference}")
    whole = F.col("subject").isNotNull() & F.col("node").isNotNull() & F.forall(F.slice("v", 1, k), lambda c: c.isNotNull()) & (F.size("v") >= k)
    x = cut(x.filter(whole).select("subject", "node", F.slice(F.col("v").cast("array<double>"), 1, k).alias("v")))
    first = x.join(x.agg(F.min("subject").alias("subject")), "subject")
    template = cut(first.select("node", "v"))
    if reference == "first":
        return rotated(x, rotations(x, template, k), k), template
    for _ in range(rounds):
        by = cut(rotations(x, template, k))
        template = cut(mean_template(rotated(x, by, k), k))
    return rotated(x, by, k), template


def misfit(aligned: DataFrame, template: DataFrame, k: int) -> DataFrame:
    """``subject, rmse, r``: root mean square distance of each subject's aligned vectors from the template, and their correlation over all components."""
    both = aligned.join(template.select("node", F.col("v").alias("t")), "node")
    parts = both.select("subject", "node", F.explode(F.arrays_zip("v", "t")).alias("p")).select("subject", "p.v", "p.t")
    gap = F.col("v") - F.col("t")
    return parts.groupBy("subject").agg(F.sqrt(k * F.avg(gap * gap)).alias("rmse"), F.corr("v", "t").alias("r"))
