"""Cohort operators: dependent correlations, sign-flip and component permutations, harmonisation, validation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions.ranks import average_rank
from cohortweave.operators.graph import components
from cohortweave.operators.kernels import added, graph_rows, resampled_sums
from cohortweave.session import written


def dependent_z(r_xy: Column, r_xz: Column, r_yz: Column, n: Column) -> Column:
    """Steiger's z of two correlations that share a variable; null where it is not defined."""
    bound = lambda r: F.greatest(F.least(r, F.lit(0.9999)), F.lit(-0.9999))
    m2 = F.pow((r_xy + r_xz) / 2, F.lit(2.0))
    f = F.greatest((1 - r_yz) / (2 * (1 - m2)), F.lit(0.0))
    h = (1 - f * m2) / (1 - m2)
    return (F.atanh(bound(r_xy)) - F.atanh(bound(r_xz))) / F.nullif(F.sqrt(2 * (1 - r_yz) * h / (n - 3)), F.lit(0.0))


def distance_dependence(edges: DataFrame, places: DataFrame, value: str) -> DataFrame:
    """``rho, n, passed``: rank correlation of |``value``| of each pair with the distance of its channels; passed under 0.1.

    ``places`` has ``roi, x, y, z``.
    """
    a, b = (places.select(F.col("roi").alias(k), *[F.col(c).alias(c + k) for c in "xyz"]) for k in "ij")
    far = edges.join(a, "i").join(b, "j").withColumn("distance", F.sqrt(sum((F.col(c + "i") - F.col(c + "j")) * (F.col(c + "i") - F.col(c + "j")) for c in "xyz")))
    one = far.select(F.lit(0).alias("all"), F.abs(value).alias("r"), "distance")
    ranked = one.select("all", average_rank("r", "all").alias("a"), average_rank("distance", "all").alias("b"))
    return ranked.groupBy("all").agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n")).select("rho", "n", (F.abs("rho") < 0.1).alias("passed"))


def md5_signs(ids: np.ndarray, n: int) -> np.ndarray:
    """1 or -1 for each id and replicate 1 to ``n`` by the first bit of the MD5 of ``id:replicate``; a first column of ones."""
    heads = [hashlib.md5(f"{i}:".encode()) for i in ids]
    tails = [str(r).encode() for r in range(1, n + 1)]

    def bits(head: hashlib._Hash) -> bytes:
        out = bytearray()
        for t in tails:
            h = head.copy()
            h.update(t)
            out.append(h.digest()[0])
        return bytes(out)

    first = np.frombuffer(b"".join(map(bits, heads)), np.uint8).reshape(len(ids), n)
    return np.hstack([np.ones((len(ids), 1)), np.where(first < 128, 1.0, -1.0)])


def sign_flips(df: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """``by, observed, p, replicates``: two-sided p of a mean of zero under random signs, 1 / (n + 1) at least.

    A row's sign in a replicate is a digit of the MD5 of its ``id`` and the replicate, so it depends on nothing
    else.  Rows are read once and never copied: the tasks add up arrays of signed sums.  Rows without a value are
    left out, and so are groups without any.
    """

    def p(sums: np.ndarray, counts: np.ndarray) -> tuple:
        m = sums / counts[0]
        return float(m[0]), max(int((np.abs(m[1:]) >= abs(m[0]) - 1e-12).sum()) / n, 1 / (n + 1)), n

    rows = df.select(*by, F.col("id").cast("string").alias("id"), F.col(value).cast("double").alias("v")).filter("v is not null")
    parts = resampled_sums(rows, list(by), n + 1, lambda ids: md5_signs(ids, n))
    return added(parts, list(by), "observed double, p double, replicates long", p)


#: Replicates whose labels share one word a subject.
WORD = 64


def label_words(subjects: DataFrame, n: int) -> DataFrame:
    """``chunk, words``: a row for each `WORD` replicates of 0 to ``n``; bit r of a subject's word is its label in replicate 64 chunk + r.

    Replicate 0 has the labels as they are; in the others as many subjects are in the first group, by the order of the MD5 of
    subject and replicate.  ``subjects`` has ``subjects``, one row of ``(subject, first)`` in order: 8 bytes a subject a row come out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for chunk, ids, first in zip(t["chunk"], t["ids"], t["first"], strict=True):
                own = np.asarray(first, bool)
                words = np.zeros(len(own), np.uint64)
                for r in range(WORD * chunk, min(WORD * chunk + WORD, n + 1)):
                    dealt = np.zeros(len(own), bool)
                    dealt[np.argsort([hashlib.md5(f"{s}:{r}".encode()).digest() for s in ids], kind="stable")[: own.sum()]] = True
                    words |= (own if r == 0 else dealt).astype(np.uint64) << np.uint64(r % WORD)
                out.append((chunk, words.view(np.int64)))
            yield pd.DataFrame(out, columns=["chunk", "words"])

    tasks = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = F.transform("subjects", lambda s: s["subject"].cast("string")).alias("ids")
    work = subjects.select(ids, F.col("subjects.first").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(n // WORD))).alias("chunk"))
    return work.repartition(tasks, "chunk").mapInPandas(run, "chunk int, words array<long>")


def welch_under(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Welch t of values (subjects) for each row of labels (replicates, subjects); 0 where a group has under two values or neither any spread.

    Sums are of values less their mean; a variance under 1e-12 of the mean square counts as none.
    """
    x = w - w.mean()
    n1 = first.sum(1).astype(float)
    n2 = len(x) - n1
    s1, q1 = first @ x, first @ (x * x)
    s2, q2 = x.sum() - s1, (x * x).sum() - q1
    with np.errstate(divide="ignore", invalid="ignore"):
        v1, v2 = (q1 - s1 * s1 / n1) / (n1 - 1), (q2 - s2 * s2 / n2) / (n2 - 1)
        floor = 1e-12 * (x * x).mean()
        v1, v2 = np.where(v1 > floor, v1, 0.0), np.where(v2 > floor, v2, 0.0)
        t = (s1 / n1 - s2 / n2) / np.sqrt(v1 / n1 + v2 / n2)
    return np.where((n1 > 1) & (n2 > 1) & (v1 + v2 > 0), t, 0.0)


def strong_pairs(edges: DataFrame, subjects: DataFrame, threshold: float, n: int) -> DataFrame:
    """``replicate, i, j, t``: the pairs with |Welch t| over the threshold under the labels (0) and ``n`` permutations of them.

    A pair is one packed row of its subjects' values; it meets rows of 64 replicates' labels, so it is copied n / 64 times, not n times,
    and only strong pairs come out.  Pairs and labels hold 8 bytes a subject: the cohort must fit a row, the pairs need not.
    """
    packed = subjects.groupBy().agg(F.array_sort(F.collect_list(F.struct("subject", "first"))).alias("subjects"))
    place = packed.select(F.posexplode("subjects").alias("at", "s")).select("at", "s.subject")
    x = edges.filter("w is not null").join(place, "subject").groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("at", F.col("w").cast("double").alias("w")))).alias("s"))
    copies = x.select("i", "j", F.col("s.at").alias("at"), F.col("s.w").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n // WORD))).alias("chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, j, at, w, chunk, words in zip(b["i"], b["j"], b["at"], b["w"], b["chunk"], b["words"], strict=True):
                count = min(WORD, n + 1 - WORD * chunk)
                own = np.asarray(words, np.int64).view(np.uint64)[np.asarray(at)]
                t = welch_under(np.asarray(w, float), ((own >> np.arange(count, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(float))
                out += [(WORD * chunk + int(r), i, j, float(t[r])) for r in np.flatnonzero(np.abs(t) > threshold)]
            yield pd.DataFrame(out, columns=["replicate", "i", "j", "t"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = copies.join(label_words(packed, n), "chunk").repartition(tasks, "i", "j", "chunk")
    return both.mapInPandas(run, f"replicate int, i {kinds['i']}, j {kinds['j']}, t double")


def nbs(edges: DataFrame, subjects: DataFrame, threshold: float, n: int) -> DataFrame:
    """Network-based statistic: ``component, edges, total_t, p`` of the connected parts of the pairs with |t| over the threshold.

    p is the share of ``n`` label permutations whose largest part has as many edges.  ``edges`` has ``subject, i, j, w``,
    ``subjects`` has ``subject, first``.  Permuted graphs are one packed row each; the observed one is a distributed search.
    """
    strong = written(strong_pairs(edges, subjects, threshold, n)).select(F.col("replicate").alias("g"), "i", "j", F.abs("t").alias("w"))
    largest = graph_rows(strong.filter("g > 0"), "largest long", lambda w: [(nw.largest_part(w),)]).groupBy("largest").agg(F.count(F.lit(1)).alias("k"))
    own = strong.filter("g = 0")
    found = own.join(components(own).withColumnRenamed("node", "i"), ["g", "i"]).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("total_t"))
    hits = found.join(F.broadcast(largest), F.col("largest") >= F.col("edges"), "left").groupBy("component", "edges", "total_t").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("hits"))
    return hits.select("component", "edges", "total_t", (F.col("hits") / n).alias("p"))


def combat(df: DataFrame, value: str, batch: str, feature: str, pooled: bool = True, rounds: int = 100) -> DataFrame:
    """``df`` with ``harmonized``: location and scale of each batch removed from each feature (ComBat).

    Features are standardised by their mean and pooled residual deviation.  With ``pooled`` each batch's locations and
    scales are shrunk towards their distribution over the features (empirical Bayes, the fixed point of ``rounds``
    updates); without, they are taken as they are.  All from one row of sums a batch and feature.  A feature without
    residual spread, and a batch of one row, stay as they are.
    """
    means = df.groupBy(feature, batch).agg(F.avg(value).alias("_bm"))
    spread = df.join(means, [feature, batch]).groupBy(feature).agg(F.avg(value).alias("_a"), F.sqrt(F.avg((F.col(value) - F.col("_bm")) * (F.col(value) - F.col("_bm")))).alias("_s"))
    z = df.join(spread, feature).withColumn("_z", (F.col(value) - F.col("_a")) / F.nullif("_s", F.lit(0.0)))
    sums = z.groupBy(feature, batch).agg(F.count("_z").alias("n"), F.avg("_z").alias("g"), F.var_samp("_z").alias("d"), F.sum("_z").alias("s1"), F.sum(F.col("_z") * F.col("_z")).alias("s2"))
    if pooled:
        prior = sums.groupBy(batch).agg(F.avg("g").alias("gbar"), F.var_samp("g").alias("t2"), F.avg("d").alias("m"), F.var_samp("d").alias("v"))
        prior = prior.select(batch, "gbar", "t2", ((2 * F.col("v") + F.col("m") * F.col("m")) / F.col("v")).alias("a"), ((F.col("m") * F.col("v") + F.pow("m", F.lit(3.0))) / F.col("v")).alias("b"))

        def update(acc: Column, _: Column) -> Column:
            g = (F.col("t2") * F.col("n") * F.col("g") + acc["d"] * F.col("gbar")) / (F.col("t2") * F.col("n") + acc["d"])
            d = (F.col("b") + 0.5 * (F.col("s2") - 2 * g * F.col("s1") + F.col("n") * g * g)) / (F.col("n") / 2 + F.col("a") - 1)
            return F.struct(g.alias("g"), d.alias("d"))

        start = F.struct(F.col("g").alias("g"), F.col("d").alias("d"))
        sums = sums.join(prior, batch).withColumn("e", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, update)).select(feature, batch, F.col("e.g").alias("g"), F.col("e.d").alias("d"))
    fitted = sums.select(feature, batch, F.col("g").alias("_g"), F.nullif(F.sqrt("d"), F.lit(0.0)).alias("_d"))
    out = z.join(fitted, [feature, batch])
    return out.withColumn("harmonized", F.coalesce((F.col("_z") - F.col("_g")) / F.col("_d") * F.col("_s") + F.col("_a"), F.col(value))).drop("_a", "_s", "_z", "_g", "_d")


def validation(df: DataFrame, *columns: str) -> DataFrame:
    """``column, rows, missing, low, high, suspicious``: one row a numeric column; suspicious outside -0.5 to 1.5."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.withColumn("suspicious", (F.col("high") > 1.5) | (F.col("low") < -0.5))


def top_frequency(df: DataFrame, subject: str, node: str, value: str, k: int) -> DataFrame:
    """``node, n``: in how many subjects a node is among the ``k`` of largest value (ties: the smaller node)."""
    place = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc(value), node))
    return df.withColumn("_p", place).filter(F.col("_p") <= k).groupBy(node).agg(F.count(F.lit(1)).alias("n"))


def component_stats(df: DataFrame, component: str, value: str) -> DataFrame:
    """Mean, deviation, extremes, range, skewness, excess kurtosis, interquartile range and bimodality of each gradient component."""
    s = df.groupBy(component).agg(F.count(value).alias("n"), F.avg(value).alias("mean_v"), F.stddev_pop(value).alias("sd_v"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.skewness(value).alias("skew_v"), F.kurtosis(value).alias("kurt_v"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr_v"))
    return s.withColumn("range_v", F.col("max_v") - F.col("min_v")).withColumn("bimodality", (F.col("skew_v") * F.col("skew_v") + 1) / (F.col("kurt_v") + 3))


def neighbour_concordance(pairs: DataFrame, ts: DataFrame, k: int) -> DataFrame:
    """``subject, roi, reho``: mean Kendall tau-b of each channel with the ``k`` channels it is connected to most, without itself.

    ``pairs`` has ``subject, i, j, w``.  Each chosen pair of series is one packed row; tau is counted by sorting, n log n.
    """
    from cohortweave.operators.kernels import packed_series, pair_kernel

    both = pairs.select("subject", "i", "j", "w").union(pairs.select("subject", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    place = F.row_number().over(Window.partitionBy("subject", "i").orderBy(F.desc("w"), "j"))
    chosen = both.withColumn("_p", place).filter(F.col("_p") <= k).select("subject", "i", "j")
    taus = pair_kernel(chosen, packed_series(ts), nw.kendall_tau_b)
    return taus.groupBy("subject", F.col("i").alias("roi")).agg(F.avg("value").alias("reho"))
