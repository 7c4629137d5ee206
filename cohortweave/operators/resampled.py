"""Tail comparisons a group, and graphs drawn anew from uncertain weights: communities and metrics with intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import tails
from cohortweave.operators.kernels import replicates

ALTERNATIVES = ["exponential", "lognormal", "truncated_power_law"]


def powerlaw_compare(values: DataFrame, key: str, col: str, xmin: int = 1, least: int = 10) -> DataFrame:
    """``key, alternative, n, r, p``: each group's power law from ``xmin`` on against three other families.

    Spark counts the distinct whole numbers; a group's counts are one row, however many values it has.  Groups
    with under ``least`` values or under three distinct ones in the tail have null ``r`` and ``p``.
    """
    kind = values.schema[key].dataType.simpleString()
    tail = values.filter(F.col(col) >= xmin).groupBy(key, F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    packed = tail.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("counts"))
    work = packed.withColumn("alternative", F.explode(F.array(*map(F.lit, ALTERNATIVES))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, counts, other in zip(b[key], b["counts"], b["alternative"], strict=True):
                x, c = (np.array([v[f] for v in counts], float) for f in ("x", "n"))
                enough = c.sum() >= least and len(x) >= 3
                rows.append((k, other, int(c.sum()), *(tails.compare(x, c, xmin, other) if enough else (None, None))))
            yield pd.DataFrame(rows, columns=[key, "alternative", "n", "r", "p"])

    return work.mapInPandas(run, f"`{key}` {kind}, alternative string, n long, r double, p double")


def _drawn(edges: list, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and a weight matrix: each weight plus a normal deviate times its deviation, not below 0."""
    i, j, w, sd = (np.array([e[k] for e in edges]) for k in ("i", "j", "w", "sd"))
    noise = np.random.default_rng(seed).standard_normal(len(w))
    return nw.dense(i, j, np.maximum(0.0, w + sd * noise))


def _replicated(edges: DataFrame, n: int, salt: int) -> DataFrame:
    packed = edges.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "j", F.col("w").cast("double").alias("w"), F.col("sd").cast("double").alias("sd")))).alias("edges"))
    return replicates(packed, n, "g", salt=salt).repartition("g", "replicate")


def coassignment(edges: DataFrame, n: int = 100, salt: int = 11) -> DataFrame:
    """``g, i, j, p``: in which share of ``n`` drawn graphs two nodes of ``edges(g, i, j, w, sd)`` are in one Louvain community (i < j, p > 0).

    A task adds up its replicates' pairs before the shuffle, so a graph leaves it once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for g, e, seed in zip(b["g"], b["edges"], b["seed"], strict=True):
                nodes, w = _drawn(e, seed)
                label = nw.louvain(w, np.random.default_rng(seed + 1))
                same = label[:, None] == label
                sums[g] = (nodes, sums[g][1] + same if g in sums else same.astype(np.int64))
        for g, (nodes, count) in sums.items():
            i, j = np.nonzero(np.triu(count, 1))
            yield pd.DataFrame({"g": [g] * len(i), "i": nodes[i], "j": nodes[j], "k": count[i, j]})

    found = _replicated(edges, n, salt).mapInPandas(run, f"g {kinds['g']}, i {kinds['i']}, j {kinds['i']}, k long")
    return found.groupBy("g", "i", "j").agg((F.sum("k") / n).alias("p"))


def stability(pairs: DataFrame) -> DataFrame:
    """``g, node, stability``: the largest share with which a node of :func:`coassignment` goes with another."""
    both = pairs.select("g", F.col("i").alias("node"), "p").union(pairs.select("g", F.col("j").alias("node"), "p"))
    return both.groupBy("g", "node").agg(F.max("p").alias("stability"))


def graph_metrics(w: np.ndarray, seed: int) -> dict[str, float]:
    """Density, mean and deviation of strength, Louvain modularity, efficiency, transitivity of one matrix."""
    n, b = len(w), (w > 0).astype(float)
    label = nw.louvain(w, np.random.default_rng(seed))
    k, total = w.sum(1), w.sum()
    degree = b.sum(1)
    triples = float((degree * (degree - 1)).sum())
    q = float((w * (label[:, None] == label)).sum() / total - sum((k[label == c].sum() / total) ** 2 for c in np.unique(label))) if total else 0.0
    return {"density": float(b.sum() / max(1, n * (n - 1))), "mean_strength": float(k.mean()), "strength_sd": float(k.std()), "modularity": q, "efficiency": nw.efficiency(w, True), "transitivity": float(np.einsum("ij,ji", b @ b, b)) / triples if triples else 0.0}


def metrics_with_ci(edges: DataFrame, n: int = 200, level: float = 0.95, salt: int = 12, kernel: Callable[[np.ndarray, int], dict] = graph_metrics) -> DataFrame:
    """``g, metric, mean, sd, low, high, replicates``: each metric over ``n`` graphs drawn from ``edges(g, i, j, w, sd)``."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, m, v) for g, e, seed in zip(b["g"], b["edges"], b["seed"], strict=True) for m, v in kernel(_drawn(e, seed)[1], seed + 1).items()]
            yield pd.DataFrame(rows, columns=["g", "metric", "value"])

    drawn = _replicated(edges, n, salt).mapInPandas(run, f"g {kinds['g']}, metric string, value double")
    tail = (1 - level) / 2
    return drawn.groupBy("g", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.count(F.lit(1)).alias("replicates"))
