"""Coupling of two graphs within modules against modules dealt anew to the nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 100  # replicates a task row


def dealt(subject: object, nodes: np.ndarray, modules: np.ndarray, replicate: int) -> np.ndarray:
    """The modules in the order of an MD5 of subject, node and replicate; replicate 0 as they are."""
    if not replicate:
        return modules
    keys = [hashlib.md5(f"{subject}:{v}:{replicate}".encode()).hexdigest() for v in nodes]
    out = np.empty_like(modules)
    out[np.argsort(keys, kind="stable")] = modules
    return out


def within_r(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, module: np.ndarray, count: int) -> np.ndarray:
    """Correlation of ``x`` and ``y`` over the pairs within each of ``count`` modules; NaN under three pairs or without spread."""
    same = module[i] == module[j]
    of, a, b = module[i[same]], x[same], y[same]
    add = lambda v: np.bincount(of, v, count)
    n = np.bincount(of, minlength=count)
    with np.errstate(invalid="ignore", divide="ignore"):
        xx, yy = add(a * a) - add(a) ** 2 / n, add(b * b) - add(b) ** 2 / n
        r = (add(a * b) - add(a) * add(b) / n) / np.sqrt(xx * yy)
    flat = (xx <= 1e-12 * add(a * a)) | (yy <= 1e-12 * add(b * b))
    return np.where((n < 3) | flat, np.nan, r)


def coupling_nulls(edges: DataFrame, modules: DataFrame, n: int) -> DataFrame:
    """``subject, replicate, module, r``: within-module correlation of ``x`` and ``y``; replicate 0 is the observed one.

    ``edges`` has ``subject, i, j, x, y`` (each pair once), ``modules`` ``node, module``; pairs with a null, NaN or a node without
    module do not count.  A subject's graph is one packed row and ``CHUNK`` replicates a task row; labels are permuted and summed there,
    so no edge is copied for a replicate.  What a node gets depends on the hash of subject, node and replicate alone.
    """
    m = modules.dropna().select("node", "module").distinct()
    a, b = (m.select(F.col("node").alias(k), F.col("module").alias(f"m{k}")) for k in "ij")
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = edges.filter(real("x") & real("y") & (F.col("i") != F.col("j"))).join(a, "i").join(b, "j")
    entry = F.struct("i", "j", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "mi", "mj")
    packed = rows.groupBy("subject").agg(F.collect_list(entry).alias("e"))
    work = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(CHUNK)))).repartition("subject", "first")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, first, e in zip(batch["subject"], batch["first"], batch["e"], strict=True):
                cols = pd.DataFrame([tuple(v.values()) if isinstance(v, dict) else tuple(v) for v in e], columns=["i", "j", "x", "y", "mi", "mj"])
                cols = cols.sort_values(["i", "j", "x", "y"])  # sums do not depend on the order of arrival
                own = dict(zip(cols["i"], cols["mi"], strict=True)) | dict(zip(cols["j"], cols["mj"], strict=True))
                nodes = np.array(sorted(own))
                names, code = np.unique([own[v] for v in nodes], return_inverse=True)
                i, j = (np.searchsorted(nodes, cols[k].to_numpy()) for k in "ij")
                x, y = (cols[k].to_numpy() - cols[k].mean() for k in "xy")
                out = []
                for r in range(first, min(first + CHUNK, n + 1)):
                    value = within_r(i, j, x, y, dealt(subject, nodes, code, r), len(names))
                    out += [(subject, r, names[k], v) for k, v in enumerate(value) if v == v]
                yield pd.DataFrame(out, columns=["subject", "replicate", "module", "r"])

    return work.mapInPandas(run, f"subject {kinds['subject']}, replicate int, module {kinds['mi']}, r double")


def coupling_test(edges: DataFrame, modules: DataFrame, n: int = 1000) -> DataFrame:
    """``module, subjects, r, null_mean, null_sd, z, p``: the subjects' mean coupling within each module against ``n`` permutations.

    A replicate's value is the mean over the subjects in which the module has one; p is the share of replicates at least as high.
    """
    means = coupling_nulls(edges, modules, n).groupBy("module", "replicate").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("subjects"))
    own = means.filter("replicate = 0").select("module", "subjects", F.col("r").alias("own"))
    both = means.filter("replicate > 0").select("module", "r").join(own, "module")
    out = both.groupBy("module", "subjects", "own").agg(F.avg("r").alias("null_mean"), F.stddev_pop("r").alias("null_sd"), F.avg((F.col("r") >= F.col("own") - 1e-12).cast("double")).alias("p"))
    z = (F.col("own") - F.col("null_mean")) / F.greatest("null_sd", F.lit(1e-8))
    return out.select("module", "subjects", F.col("own").alias("r"), "null_mean", "null_sd", z.alias("z"), "p")
