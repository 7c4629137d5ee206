"""Closed forms and properties of the numpy kernels and the Monte-Carlo operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import ranks
from cohortweave.functions import signals as sg
from cohortweave.operators import criticality as cr
from cohortweave.operators import graph as gr
from cohortweave.operators import kernels as kr
from cohortweave.operators import matrix as mx


def complete(n):
    return np.ones((n, n)) - np.eye(n)


def ring(n):
    w = np.zeros((n, n))
    for k in range(n):
        w[k, (k + 1) % n] = w[(k + 1) % n, k] = 1
    return w


def test_closed_form_graphs():
    assert nw.efficiency(complete(5)) == pytest.approx(1)
    assert nw.clustering(complete(5)) == pytest.approx(1)
    assert nw.clustering(ring(8)) == pytest.approx(0)
    star = np.zeros((5, 5))
    star[0, 1:] = star[1:, 0] = 1
    assert nw.betweenness(star) == pytest.approx([1, 0, 0, 0, 0])
    two = np.kron(np.eye(2), complete(4))
    labels = nw.louvain(two, np.random.default_rng(0))
    assert len(set(labels[:4])) == len(set(labels[4:])) == 1 and nw.modularity(two, labels) == pytest.approx(0.5)
    n = 10
    d2 = np.sort(np.linalg.eigvalsh(2 * nw.laplacian(ring(n))))
    assert d2 == pytest.approx(np.sort(2 - 2 * np.cos(2 * np.pi * np.arange(n) / n)))


def test_rewiring_keeps_degrees():
    rng = np.random.default_rng(1)
    w = np.triu(rng.random((20, 20)) < 0.2, 1).astype(float)
    w += w.T
    r = nw.rewired(w, rng)
    assert (r.sum(0) == w.sum(0)).all() and (r == r.T).all() and np.trace(r) == 0


def test_scaling_exponents():
    x = np.random.default_rng(2).normal(size=4000)
    assert sg.scaling_exponent(x) == pytest.approx(0.5, abs=0.1)
    assert sg.scaling_exponent(np.cumsum(x)) == pytest.approx(1.5, abs=0.15)
    assert np.isnan(sg.sample_entropy(np.ones(50)))
    s = sg.phase_surrogate(x, np.random.default_rng(3))
    assert np.abs(np.fft.rfft(s)) == pytest.approx(np.abs(np.fft.rfft(x)), rel=1e-6, abs=1e-6)
    assert np.sort(sg.amplitude_adjusted(x, np.random.default_rng(3))) == pytest.approx(np.sort(x))


def test_decoupling_and_gradients():
    rng = np.random.default_rng(4)
    a = rng.random((12, 12))
    a = a + a.T
    np.fill_diagonal(a, 0)
    assert ((nw.structural_decoupling(a, a) >= 0) & (nw.structural_decoupling(a, a) <= 1)).all()
    x, _ = nw.principal(a, 3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    assert nw.aligned(x @ q, x) == pytest.approx(x)


def test_avalanche_runs(spark):
    act = spark.createDataFrame([(0, t, a) for t, a in enumerate([1, 1, 0, 1, 0, 0, 1, 1, 1])], "subject int, t long, act long")
    got = sorted((r["start_t"], r["size"], r["duration"]) for r in cr.avalanches(act).collect())
    assert got == [(0, 2, 2), (3, 1, 1), (6, 3, 3)]


def test_p_adjustment(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.02, 0.03, 0.04])], "id int, p double").withColumn("g", F.lit(1))
    assert [round(r[0], 9) for r in ranks.adjust_p(df, "p", "g").select("p_adjusted").collect()] == [0.04] * 4
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03])], "id int, p double").withColumn("g", F.lit(1))
    assert [round(r[0], 9) for r in ranks.adjust_p(df, "p", "g", method="holm").orderBy("id").select("p_adjusted").collect()] == [0.03, 0.06, 0.06]


@pytest.mark.parametrize("method", ["bh", "by", "holm"])
def test_p_adjustment_scans_no_frame_anew_for_each_row(spark, method):
    rng = np.random.default_rng(4)
    rows = [(k, g, None if k % 40 == 7 else float(np.round(rng.random() ** 2, 2))) for k, g in enumerate(["a"] * 300 + ["b"] * 30 + [None] * 20 + ["c"])]
    got = ranks.adjust_p(spark.createDataFrame(rows, "id int, g string, p double").repartition(3), "p", "g", method=method)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    values = {r["id"]: r["p_adjusted"] for r in got.collect()}
    assert len(values) == len(rows)
    for g in ("a", "b", None, "c"):  # nulls come last, as in SQL
        mine = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, x[2] or 0, x[0]))
        n, seen = len(mine), []
        raw = [None if x[2] is None else x[2] * (n - k if method == "holm" else n / (k + 1)) for k, x in enumerate(mine)]
        h = sum(1 / k for k in range(1, n + 1)) if method == "by" else 1.0
        for k, x in enumerate(mine):
            seen = [v for v in (raw[: k + 1] if method == "holm" else raw[k:]) if v is not None]
            want = min(1.0, h * (max(seen) if method == "holm" else min(seen))) if seen else 1.0
            assert values[x[0]] == pytest.approx(want, abs=1e-12)


def test_components_and_identity(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 5, 6, 1.0)], "g int, i int, j int, w double")
    assert {(r["node"], r["component"]) for r in gr.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    fc = spark.createDataFrame([(s, i, j, float((s * 7 + i * 3 + j) % 5)) for s in range(3) for i in range(4) for j in range(i + 1, 4)], "subject int, i int, j int, w double")
    assert all(r["identified"] for r in mx.fingerprint(fc, fc).collect())


def test_nulls_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(0, f"r{k}", t, float(v)) for k in range(2) for t, v in enumerate(rng.normal(size=64))]
    ts = spark.createDataFrame(rows, "subject int, roi string, t long, v double")
    one = sorted(tuple(r) for r in kr.surrogate_nulls(ts.repartition(1), 3, lambda x: float(x[0])).collect())
    many = sorted(tuple(r) for r in kr.surrogate_nulls(ts.repartition(7), 3, lambda x: float(x[0])).collect())
    assert one == many


def test_monte_carlo_queries_have_the_references_replicates(spark):
    import __spark_entry__

    run = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()
    for name, n in (("surrogate_compare", 99), ("null_topology", 100), ("norm_modularity", 100)):
        assert all(r["p"] * (n + 1) == pytest.approx(round(r["p"] * (n + 1))) for r in run(name))
    assert {r["replicates"] for r in run("perm_twosample")} == {10_000}
    assert {r["replicates"] for r in run("memory_capacity")} == {100}
