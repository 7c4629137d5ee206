"""Grouped kernels: numpy on one packed series or graph a group, and flat seeded Monte-Carlo work tables.

A group is one subject's channel or one subject's graph, so its size does not
grow with the cohort; the cohort is what is distributed.  Replicates are rows of
their own, with a seed that is a stable hash of their key, so results do not
depend on how the work is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import signals as sg


def packed_series(ts: DataFrame) -> DataFrame:
    """One row a subject and channel: ``values`` in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))
    return ts.groupBy("subject", "roi").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def per_series(ts: DataFrame, names: list[str], kernel: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``subject, roi`` and the kernel's numbers for every series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [kernel(np.asarray(v, float)) for v in b["values"]]
            yield pd.concat([b[["subject", "roi"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=float)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in ts.schema.fields}
    return packed_series(ts).mapInPandas(run, f"subject {kinds['subject']}, roi {kinds['roi']}, " + ", ".join(f"{n} double" for n in names))


def packed_graphs(edges: DataFrame) -> DataFrame:
    """One row a graph: the edge list in order."""
    return edges.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "j", "w"))).alias("edges"))


def _arrays(edges: list) -> tuple[np.ndarray, np.ndarray]:
    i, j, w = (np.array([e[k] for e in edges]) for k in range(3))
    return nw.dense(i, j, w.astype(float))


def per_node(edges: DataFrame, names: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``g, node`` and the kernel's columns for every graph; the kernel maps a matrix to (nodes, columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, e in zip(b["g"], b["edges"], strict=True):
                nodes, w = _arrays([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e])
                out = pd.DataFrame(np.asarray(kernel(w), float).reshape(len(nodes), -1), columns=names)
                out.insert(0, "node", nodes)
                out.insert(0, "g", g)
                yield out

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return packed_graphs(edges).mapInPandas(run, f"g {kinds['g']}, node {kinds['i']}, " + ", ".join(f"{n} double" for n in names))


def replicates(keys: DataFrame, n: int, *names: str, salt: int = 0) -> DataFrame:
    """``keys`` times ``n`` replicates, each with a seed that its key and replicate alone decide."""
    work = keys.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return work.withColumn("seed", F.pmod(F.xxhash64(*names, "replicate", F.lit(salt)), F.lit(1 << 31)))


def null_graphs(edges: DataFrame, n: int, names: list[str], kernel: Callable[[np.ndarray], tuple], salt: int = 0) -> DataFrame:
    """The kernel on ``n`` degree-preserving rewirings of each graph: ``g, replicate`` and its numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, e, r, seed in zip(b["g"], b["edges"], b["replicate"], b["seed"], strict=True):
                _, w = _arrays([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e])
                rows.append((g, r, *kernel(nw.rewired(w, np.random.default_rng(seed)))))
            yield pd.DataFrame(rows, columns=["g", "replicate", *names])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    work = replicates(packed_graphs(edges), n, "g", salt=salt).repartition("g", "replicate")
    return work.mapInPandas(run, f"g {kinds['g']}, replicate int, " + ", ".join(f"{n} double" for n in names))


def surrogate_nulls(ts: DataFrame, n: int, kernel: Callable[[np.ndarray], float], method: str = "phase", salt: int = 0) -> DataFrame:
    """The kernel on ``n`` surrogates of each series (``phase`` or ``iaaft``): ``subject, roi, replicate, value``."""
    make = {"phase": sg.phase_surrogate, "iaaft": sg.amplitude_adjusted}[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [kernel(make(np.asarray(v, float), np.random.default_rng(s))) for v, s in zip(b["values"], b["seed"], strict=True)]
            yield b[["subject", "roi", "replicate"]].assign(value=np.asarray(values, float))

    kinds = {f.name: f.dataType.simpleString() for f in ts.schema.fields}
    work = replicates(packed_series(ts), n, "subject", "roi", salt=salt).repartition("subject", "roi", "replicate")
    return work.mapInPandas(run, f"subject {kinds['subject']}, roi {kinds['roi']}, replicate int, value double")


def null_summary(observed: DataFrame, null: DataFrame, *keys: str) -> DataFrame:
    """Observed value, null mean and deviation, z, and the two-sided p about the null mean, (hits + 1) / (n + 1)."""
    m = null.groupBy(*keys).agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), F.count("value").alias("n"))
    x = observed.join(m, list(keys))
    hits = null.join(x.select(*keys, "observed", "null_mean"), list(keys)).groupBy(*keys).agg(F.sum((F.abs(F.col("value") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean"))).cast("int")).alias("hits"))
    z = (F.col("observed") - F.col("null_mean")) / F.nullif("null_sd", F.lit(0.0))
    return x.join(hits, list(keys)).select(*keys, "observed", "null_mean", "null_sd", z.alias("z"), ((F.col("hits") + 1) / (F.col("n") + 1)).alias("p"))


#: Groups of up to so many values are permuted as one packed row (8 MB); larger ones by windows over rows.
PACKED_VALUES = 1_000_000


def permutation_test(df: DataFrame, value: str, group: str, a: str, b: str, n: int, *by: str) -> DataFrame:
    """Two-sided permutation p of the difference of group means within ``by``: ``observed, p, replicates``.

    Replicates are spread in chunks over tasks, each with the group's packed values.  Where a group
    has more than ``PACKED_VALUES``, a replicate deals the labels anew by ranking rows on a hash of
    their key and the replicate, and no group is gathered.
    """
    rows = df.filter(F.col(group).isin(a, b)).select(*by, F.col(value).cast("double").alias("v"), (F.col(group) == a).alias("first"), "id").filter("v is not null")
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > PACKED_VALUES:
        return _permuted_rows(rows, n, *by)
    ordered = F.array_sort(F.collect_list(F.struct(~F.col("first"), F.col("id"), F.col("v"))))
    packed = rows.groupBy(*by).agg(F.transform(ordered, lambda x: x["v"]).alias("x"), F.count_if("first").cast("int").alias("n1"))
    size = max(1, -(-n // 200))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(size))).alias("replicate")
    work = packed.select(*by, "x", "n1", chunks).withColumn("seed", F.pmod(F.xxhash64(*by, "replicate"), F.lit(1 << 31))).repartition(*by, "replicate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for x, n1, at, seed in zip(t["x"], t["n1"], t["replicate"], t["seed"], strict=True):
                x, rng, far = np.asarray(x, float), np.random.default_rng(seed), 0  # noqa: PLW2901
                whole, rest, count = x.sum(), len(x) - n1, min(size, n - at)
                observed = x[:n1].mean() - x[n1:].mean() if n1 and rest else np.nan
                for _ in range(count):
                    one = rng.permutation(x)[:n1].sum()
                    far += abs(one / n1 - (whole - one) / rest) >= abs(observed) - 1e-12 if n1 and rest else 0
                out.append((observed, int(far), count))
            yield pd.concat([t[list(by)].reset_index(drop=True), pd.DataFrame(out, columns=["observed", "far", "k"])], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    done = work.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", observed double, far long, k long")
    return done.groupBy(*by).agg(F.max("observed").alias("observed"), ((F.sum("far") + 1) / (F.sum("k") + 1)).alias("p"), F.sum("k").alias("replicates"))


def _permuted_rows(rows: DataFrame, n: int, *by: str) -> DataFrame:
    from pyspark.sql import Window

    obs = rows.groupBy(*by).agg((F.avg(F.when(F.col("first"), F.col("v"))) - F.avg(F.when(~F.col("first"), F.col("v")))).alias("observed"), F.sum(F.col("first").cast("int")).alias("n1"))
    work = rows.drop("first").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.row_number().over(Window.partitionBy(*by, "replicate").orderBy(F.xxhash64("id", "replicate"), "id"))
    dealt = work.withColumn("place", place).join(obs, list(by)).withColumn("first", F.col("place") <= F.col("n1"))
    null = dealt.groupBy(*by, "replicate", "observed").agg((F.avg(F.when(F.col("first"), F.col("v"))) - F.avg(F.when(~F.col("first"), F.col("v")))).alias("d"))
    return null.groupBy(*by, "observed").agg(((F.sum((F.abs("d") >= F.abs("observed")).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("replicates"))


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])


#: The same limits for draws of 53 bits.
_LIMITS = np.ceil(_POISSON * float(1 << 53)).astype(np.uint64)


def poisson_counts(ids: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Poisson(1) counts ``(rows, n)``: a function of a row's id and the replicate alone (a mixed counter)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0xD1B54A32D192ED03)
        high = x >> np.uint64(30)
        x ^= high
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=high)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=high)
    x >>= np.uint64(11)
    out = (x >= _LIMITS[0]).view(np.uint8)
    for limit in _LIMITS[1:3]:
        out += (x >= limit).view(np.uint8)
    rare = np.flatnonzero(x >= _LIMITS[3])  # one draw in fifty
    out.reshape(-1)[rare] += np.searchsorted(_LIMITS[3:], x.reshape(-1)[rare], "right").astype(np.uint8)
    return out


def resampled_sums(rows: DataFrame, keys: list[str], n: int, weights: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys, sums, counts``: for each key arrays of ``n`` weighted sums of ``v`` and sums of weights, partly added up by the tasks.

    ``rows`` has the keys, ``id`` and ``v``; ``weights`` maps ids to (rows, ``n``).  Each row is read once and never copied.
    Rows are dealt by ranges of key and id over a stated number of tasks (small rows with long work would be put together
    into a few), so that a task meets few keys and a large key is shared by several.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = rows.select(*keys, "id", "v").repartitionByRange(tasks, *keys, "id").sortWithinPartitions(*keys)
    step = max(8, (1 << 16) // n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}

        def out() -> pd.DataFrame:
            done = pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*keys, "sums", "counts"])
            held.clear()
            return done

        for b in batches:
            for k, part in b.groupby(keys, dropna=False):
                sums, counts = held.setdefault(k, [np.zeros(n), np.zeros(n)])
                for s in range(0, len(part), step):
                    c = weights(part["id"].to_numpy()[s : s + step])
                    sums += part["v"].to_numpy(float)[s : s + step] @ c
                    counts += c.sum(0)
            if len(held) > 4096:
                yield out()
        if held:
            yield out()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sums array<double>, counts array<double>")


def poisson_sums(rows: DataFrame, keys: list[str], n: int, salt: int) -> DataFrame:
    """`resampled_sums` by Poisson counts of the rows' ids (long)."""
    return resampled_sums(rows, keys, n, lambda ids: poisson_counts(ids, n, salt))


def added(parts: DataFrame, keys: list[str], schema: str, summary: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """The summary of each key's added arrays; a key has one part a task at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = summary(np.sum(pdf["sums"].to_list(), axis=0), np.sum(pdf["counts"].to_list(), axis=0))
        return pd.DataFrame([(*pdf[keys].iloc[0], *row)], columns=[*keys, *(x.split()[0] for x in schema.split(", "))])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return parts.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {schema}")


def bootstrap_means(df: DataFrame, value: str, n: int, *by: str, level: float = 0.95) -> DataFrame:
    """Poisson-bootstrap interval of the mean within ``by``: each row counts a Poisson(1) number of times in a replicate."""
    tail = (1 - level) / 2

    def summary(sums: np.ndarray, counts: np.ndarray) -> tuple:
        m = sums[counts > 0] / counts[counts > 0]
        return float(m.mean()), float(np.quantile(m, tail)), float(np.quantile(m, 1 - tail)), len(sums)

    rows = df.select(*by, F.xxhash64("id").alias("id"), F.col(value).cast("double").alias("v")).filter("v is not null")
    return added(poisson_sums(rows, list(by), n, 9), list(by), "mean_m double, low double, high double, replicates long", summary)


def tractogram_bootstrap(lines: DataFrame, n: int) -> DataFrame:
    """Edges ``(a, b)`` of resampled streamline tables: presence, mean, deviation, CV, interval and class.

    Classes, later ones win: spurious (0 < P < .05), fragile (P < .5), present, robust (P >= .95 and CV < .5).
    """

    def summary(s: np.ndarray, _: np.ndarray) -> tuple:
        p, mean, sd = float((s > 0).mean()), float(s.mean()), float(s.std())
        cv = sd / mean if mean else float("nan")
        kind = "robust" if p >= 0.95 and cv < 0.5 else "present" if p >= 0.5 else "fragile" if p >= 0.05 else "spurious" if p > 0 else "absent"
        return p, mean, sd, float(np.quantile(s, 0.025)), float(np.quantile(s, 0.975)), cv, kind

    x = lines.filter("a > 0 and b > 0 and a <> b").select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("v"))
    return added(poisson_sums(x, ["a", "b"], n, 13), ["a", "b"], "presence double, mean_w double, sd_w double, low double, high double, cv double, edge_class string", summary)


def virtual_lesions(edges: DataFrame) -> DataFrame:
    """Loss of global efficiency when each node is removed, ``g, node, efficiency, loss``."""

    def run(w: np.ndarray) -> np.ndarray:
        whole = nw.efficiency(w)
        left = [nw.efficiency(np.delete(np.delete(w, k, 0), k, 1)) for k in range(len(w))]
        return np.column_stack([left, [whole - x for x in left]])

    return per_node(edges, ["efficiency", "loss"], run)


def graph_rows(edges: DataFrame, schema: str, kernel: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """``g`` and the rows that the kernel gives for each graph."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, e in zip(b["g"], b["edges"], strict=True):
                _, w = _arrays([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e])
                rows += [(g, *r) for r in kernel(w)]
            yield pd.DataFrame(rows, columns=["g", *names])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return packed_graphs(edges).mapInPandas(run, f"g {kinds['g']}, {schema}")


def null_rows(edges: DataFrame, n: int, schema: str, kernel: Callable[[np.ndarray], list[tuple]], model: Callable[[np.ndarray, np.random.Generator], np.ndarray] = nw.rewired, salt: int = 0) -> DataFrame:
    """``g, replicate`` and the kernel's rows for ``n`` random graphs of each graph, made by ``model``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, e, r, seed in zip(b["g"], b["edges"], b["replicate"], b["seed"], strict=True):
                _, w = _arrays([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e])
                rows += [(g, r, *x) for x in kernel(model(w, np.random.default_rng(seed)))]
            yield pd.DataFrame(rows, columns=["g", "replicate", *names])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    # a stated number of partitions: rows are small and long to work on, and would be put together into one task
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = replicates(packed_graphs(edges), n, "g", salt=salt).repartition(tasks, "g", "replicate")
    return work.mapInPandas(run, f"g {kinds['g']}, replicate int, {schema}")


def pair_kernel(pairs: DataFrame, packed: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """``subject, i, j, value``: the kernel on the two packed series of each pair."""
    a, b = (packed.select("subject", F.col("roi").alias(k), F.col("values").alias(f"v{k}")) for k in "ij")
    rows = pairs.join(a, ["subject", "i"]).join(b, ["subject", "j"]).select("subject", "i", "j", "vi", "vj")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[["subject", "i", "j"]].assign(value=[float(kernel(np.asarray(p, float), np.asarray(q, float))) for p, q in zip(x["vi"], x["vj"], strict=True)])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"subject {kinds['subject']}, i {kinds['i']}, j {kinds['j']}, value double")
