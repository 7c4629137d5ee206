"""Queries of the grouped kernels and the Monte-Carlo operators; checked by properties and brute force in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import signals as sg
from cohortweave.operators import kernels as kr
from cohortweave.plans.bindings import layers, metrics, series, table, trade_graph
from cohortweave.plans.catalogue import query

HOUR = 3600.0
BAND = (1 / (48 * HOUR), 1 / (6 * HOUR))
#: The reference's default replicates, and the steps and delays of its memory capacity.
SURROGATES, NULLS, PERMUTATIONS, BOOTSTRAPS, RESAMPLES = 99, 100, 10_000, 10_000, 1000
STEPS, SWEEP_STEPS, DELAYS = 5000, 3000, 50


def _series(name: str, names: list[str], kernel) -> None:  # noqa: ANN001
    query(name=name)(lambda spark, d: kr.per_series(series(spark, d), names, kernel))


def _nodes(name: str, names: list[str], kernel) -> None:  # noqa: ANN001
    query(name=name)(lambda spark, d: kr.per_node(trade_graph(spark, d), names, kernel))


def _peak(x: np.ndarray) -> tuple[float, float]:
    f, p = sg.welch(x, HOUR, 128)
    return float(f[p.argmax()]), float(p.sum() * (f[1] - f[0]))


def _multiscale(x: np.ndarray) -> tuple:
    return tuple(sg.sample_entropy(x[: len(x) // s * s].reshape(-1, s).mean(1)) for s in (1, 2, 4))


_series("alff_falff", ["alff", "falff"], lambda x: sg.band_amplitudes(x, HOUR, *BAND))
_series("welch_psd", ["peak_frequency", "power"], _peak)
_series("bandpass_power", ["variance", "kept"], lambda x: (float(x.var()), float(sg.bandpass(x, HOUR, *BAND).var())))
_series("inst_frequency", ["frequency"], lambda x: (sg.instantaneous_frequency(sg.bandpass(x, HOUR, *BAND), HOUR),))
_series("dfa", ["alpha"], lambda x: (sg.scaling_exponent(x),))
_series("mfdfa", ["h_minus2", "h_0", "h_2", "width"], lambda x: (*(h := [sg.scaling_exponent(x, q) for q in (-2.0, 0.0, 2.0)]), h[0] - h[2]))
_series("sample_entropy", ["entropy"], lambda x: (sg.sample_entropy(x),))
_series("multiscale_entropy", ["scale_1", "scale_2", "scale_4"], _multiscale)
_series("lempel_ziv", ["complexity"], lambda x: (sg.lempel_ziv(x),))
_series("spectral_entropy", ["entropy"], lambda x: (sg.spectral_entropy(x),))
_nodes("local_efficiency_weighted", ["local_efficiency"], lambda w: np.array([nw.efficiency(w[np.ix_(k, k)], True) for k in (np.flatnonzero(r > 0) for r in w)]))
_nodes("local_efficiency", ["local_efficiency"], nw.local_efficiency)
_nodes("louvain", ["community"], lambda w: nw.louvain(w, np.random.default_rng(0)))
_nodes("consensus", ["community"], lambda w: nw.consensus(w, 0))
_nodes("gradients_dm", ["g1", "g2"], lambda w: nw.diffusion_map(nw.affinity(w, 50), 2)[0])
_nodes("gradients_le", ["g1", "g2"], lambda w: nw.laplacian_map(nw.affinity(w, 50), 2)[0])
_nodes("gradients_pca", ["g1", "g2"], lambda w: nw.principal(nw.affinity(w, 50), 2)[0])
_nodes("gradient_align", ["g1", "g2"], lambda w: nw.aligned(nw.principal(nw.affinity(w, 30), 2)[0], nw.principal(nw.affinity(w, 50), 2)[0]))
_nodes("esn_states", ["mean_state", "sd_state"], lambda w: (lambda s: np.column_stack([s.mean(0), s.std(0)]))(nw.reservoir_states(w, np.random.default_rng(3).uniform(-1, 1, (200, 1)), 0.9, 0.3, 1)))


@query(name="virtual_lesion")
def _lesions(spark: SparkSession, d: str) -> DataFrame:
    return kr.virtual_lesions(trade_graph(spark, d))


@query(name="memory_capacity")
def _capacity(spark: SparkSession, d: str) -> DataFrame:
    work = kr.null_graphs(layers(spark, d), NULLS, ["memory", "rank"], _reservoir)
    return work.groupBy("g").agg(F.avg("memory").alias("memory"), F.avg("rank").alias("kernel_rank"), F.count(F.lit(1)).alias("replicates"))


def _reservoir(w: np.ndarray) -> tuple[float, float]:
    s = nw.reservoir_states(w, np.random.default_rng(7).uniform(-1, 1, (200, 1)), 0.9, 0.5, 2)
    return float(nw.memory_capacity(w, 0.9, 0.5, 2, STEPS, DELAYS).sum()), float(nw.kernel_quality(s))


@query(name="radius_sweep")
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """Memory at each spectral radius: one row a graph and radius, so the sweep is what is distributed."""
    radii = F.explode(F.array(*[F.lit(k / 10) for k in range(1, 15)]))
    spread = kr.packed_graphs(trade_graph(spark, d)).withColumn("rho", radii).repartition("g", "rho")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = []
            for g, e, rho in zip(b["g"], b["edges"], b["rho"], strict=True):
                _, w = kr._arrays([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e])
                rows.append((g, rho, nw.memory_capacity(w, rho, 0.5, 2, SWEEP_STEPS, DELAYS).sum()))
            yield pd.DataFrame(rows, columns=["g", "rho", "memory"])

    return spread.mapInPandas(run, "g int, rho double, memory double")


@query(name="sdi")
def _sdi(spark: SparkSession, d: str) -> DataFrame:
    two = layers(spark, d)
    both = two.groupBy("i", "j").pivot("g", [0, 1]).agg(F.first("w"))
    packed = both.select(F.lit(0).alias("g"), "i", "j", F.col("0").alias("w")).join(both.select("i", "j", F.col("1").alias("u")), ["i", "j"])
    one = packed.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "j", "w", "u"))).alias("e"))

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            for g, e in zip(b["g"], b["e"], strict=True):
                rows = np.array([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in e], float)
                nodes, sc = nw.dense(rows[:, 0], rows[:, 1], rows[:, 2])
                _, fc = nw.dense(rows[:, 0], rows[:, 1], rows[:, 3])
                raw = nw.structural_decoupling(sc, fc)
                yield pd.DataFrame({"g": g, "node": nodes.astype(int), "sdi": raw, "sdi_log2": nw.decoupling_log2(sc, fc)})

    return one.mapInPandas(run, "g int, node int, sdi double, sdi_log2 double")


@query(name="null_topology")
def _null_topology(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    null = kr.null_graphs(g, NULLS, ["value", "efficiency"], lambda w: (float(nw.clustering(w).mean()), nw.efficiency(w)))
    observed = kr.per_node(g, ["c"], nw.clustering).groupBy("g").agg(F.avg("c").alias("observed"))
    return kr.null_summary(observed, null, "g")


@query(name="small_world")
def _small_world(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)

    def both(w: np.ndarray) -> tuple[float, float]:
        x = nw.distances(w)
        return float(nw.clustering(w).mean()), float(x[np.isfinite(x) & (x > 0)].mean())

    null = kr.null_graphs(g, NULLS, ["c", "l"], both, salt=1).groupBy("g").agg(F.avg("c").alias("c_null"), F.avg("l").alias("l_null"))
    own = kr.per_node(g, ["c", "l"], lambda w: np.tile(both(w), (len(w), 1))).groupBy("g").agg(F.max("c").alias("c"), F.max("l").alias("l"))
    return own.join(null, "g").select("g", "c", "l", "c_null", "l_null", (F.col("c") / F.col("c_null") / (F.col("l") / F.col("l_null"))).alias("sigma"))


@query(name="norm_modularity")
def _norm_modularity(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    q = lambda w: nw.modularity(w, nw.louvain(w, np.random.default_rng(0)))
    null = kr.null_graphs(g, NULLS, ["value"], lambda w: (q(w),), salt=2)
    observed = kr.per_node(g, ["q"], lambda w: np.full(len(w), q(w))).groupBy("g").agg(F.max("q").alias("observed"))
    return kr.null_summary(observed, null, "g")


@query(name="surrogate_compare")
def _surrogates(spark: SparkSession, d: str) -> DataFrame:
    ts = series(spark, d)
    kernel = sg.scaling_exponent
    observed = kr.per_series(ts, ["observed"], lambda x: (kernel(x),))
    return kr.null_summary(observed, kr.surrogate_nulls(ts, SURROGATES, kernel, "iaaft"), "subject", "roi")


@query(name="perm_twosample")
def _permutation(spark: SparkSession, d: str) -> DataFrame:
    m = metrics(spark, d).withColumn("id", F.col("subject"))
    return kr.permutation_test(m, "value", "grp", "BUILDING", "MACHINERY", PERMUTATIONS, "metric")


@query(name="bootstrap_ci")
def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return kr.bootstrap_means(metrics(spark, d).withColumn("id", F.col("subject")), "value", BOOTSTRAPS, "metric", "grp")


@query(name="tractogram_bootstrap")
def _tractogram(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    x = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = x.select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), (F.col("s_nationkey") + 1).alias("a"), (F.col("c_nationkey") + 1).alias("b"), F.col("l_quantity").alias("w"))
    return kr.tractogram_bootstrap(lines, RESAMPLES)


@query(name="eigenfeatures")
def _eigen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    names = ["l1", "l2", "l3", "linearity", "planarity", "sphericity", "entropy", "omnivariance", "anisotropy", "surface_variation"]

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        out = pd.DataFrame(nw.surface_features(pdf[["x", "y", "z"]].to_numpy(), 0.25), columns=names)
        out.insert(0, "vec_id", pdf["vec_id"].to_numpy())
        out.insert(0, "label", pdf["label"].to_numpy())
        return out

    return e.groupBy("label").applyInPandas(run, "label int, vec_id long, " + ", ".join(f"{n} double" for n in names))
