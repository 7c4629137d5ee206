"""Tail families and resampled graphs against loops, known answers and samples of known families."""

import math

import numpy as np
import pytest

from cohortweave.functions import networks as nw
from cohortweave.functions import tails
from cohortweave.operators import kernels as kr
from cohortweave.operators import resampled as rs


def zeta(s, m):
    return sum(k**-s for k in range(m, 200_000)) + 199_999.5 ** (1 - s) / (s - 1)


def test_normalisers_equal_long_sums():
    for p, m in (([0.3], 1), ([0.0], 4)):
        want = -(1 + math.exp(p[0])) * math.log(7) - math.log(zeta(1 + math.exp(p[0]), m))
        assert abs(tails.log_likelihoods("power_law", np.array(p), np.array([7.0]), m)[0] - want) < 1e-6
    for family, p in (("exponential", [-2.0]), ("lognormal", [1.0, 0.5]), ("truncated_power_law", [1.5, -4.0])):
        x = np.arange(3, 400_000, dtype=float)
        assert abs(np.exp(tails.log_likelihoods(family, np.array(p), x, 3)).sum() - 1) < 1e-5


def test_fits_are_the_largest_likelihood():
    rng = np.random.default_rng(1)
    x, c = np.unique(np.floor(rng.pareto(1.2, 3000) + 1), return_counts=True)
    for family in tails.FAMILIES:
        p, best = tails.fit(family, x, c.astype(float), 1)
        for _ in range(60):
            q = p + rng.normal(size=len(p)) * rng.choice([0.003, 0.05, 0.4])
            low, high = np.array(tails._BOUNDS[family]).T
            assert c @ tails.log_likelihoods(family, np.clip(q, low, high), x, 1) <= best + 1e-6
    rate = math.log(1 + 1 / (rng.geometric(0.2, 5000).mean() - 1))
    y, k = np.unique(np.random.default_rng(2).geometric(0.2, 5000), return_counts=True)
    assert abs(math.exp(tails.fit("exponential", y.astype(float), k.astype(float), 1)[0][0]) - math.log(1 + 1 / ((y @ k) / k.sum() - 1))) < 1e-4 and rate > 0


def test_the_true_family_wins(spark):
    rng = np.random.default_rng(3)
    u = rng.random(4000)
    samples = {"power": np.floor((1 - u) ** (-1 / 1.5)), "exponential": rng.geometric(0.1, 4000), "lognormal": np.maximum(1, np.round(rng.lognormal(3, 0.5, 4000))), "few": np.array([1, 2, 3])}
    df = spark.createDataFrame([(k, int(v)) for k, x in samples.items() for v in x], "k string, size long").repartition(3)
    got = {(r["k"], r["alternative"]): (r["n"], r["r"], r["p"]) for r in rs.powerlaw_compare(df, "k", "size").collect()}
    assert len(got) == 12
    assert got["power", "exponential"][1] > 3 and got["power", "exponential"][2] < 0.01
    assert got["power", "truncated_power_law"][2] > 0.01
    for family in ("exponential", "lognormal"):
        assert got[family, family][1] < -3 and got[family, family][2] < 0.01
    assert got["exponential", "truncated_power_law"][2] < 0.01
    assert got["few", "lognormal"][1:] == (None, None)
    x, c = np.unique(samples["power"], return_counts=True)
    first, second = (tails.fit(f, x, c.astype(float), 1)[0] for f in ("power_law", "lognormal"))
    d = np.concatenate([np.repeat(a - b, k) for a, b, k in zip(tails.log_likelihoods("power_law", first, x, 1), tails.log_likelihoods("lognormal", second, x, 1), c, strict=True)])
    ratio = d.sum() / (d.std() * math.sqrt(len(d)))
    assert np.allclose(got["power", "lognormal"][1:], [ratio, math.erfc(abs(ratio) / math.sqrt(2))], atol=1e-6)


@pytest.fixture(scope="module")
def graphs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, j, float(2 * (i // 6 == j // 6) + rng.random()), float(rng.random())) for g in (0, 1) for i in range(18) for j in range(i + 1, 18) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "g int, i int, j int, w double, sd double").repartition(3)


def drawn(graphs, n, salt):
    out = {}
    for r in kr.replicates(graphs.select("g").distinct(), n, "g", salt=salt).collect():
        e = sorted((x["i"], x["j"], x["w"], x["sd"]) for x in graphs.filter(f"g = {r['g']}").collect()) if (r["g"], "e") not in out else out[r["g"], "e"]
        out[r["g"], "e"] = e
        noise = np.random.default_rng(r["seed"]).standard_normal(len(e))
        w = np.zeros((18, 18))
        for (i, j, m, sd), z in zip(e, noise, strict=True):
            w[i, j] = w[j, i] = max(0.0, m + sd * z)
        out.setdefault(r["g"], []).append((w, r["seed"] + 1))
    return {g: v for g, v in out.items() if isinstance(g, int)}


def test_coassignment_equals_a_loop(graphs):
    got = {(r["g"], r["i"], r["j"]): r["p"] for r in rs.coassignment(graphs, 12).collect()}
    want = {}
    for g, ws in drawn(graphs, 12, 11).items():
        for w, seed in ws:
            c = nw.louvain(w, np.random.default_rng(seed))
            for i in range(18):
                for j in range(i + 1, 18):
                    if c[i] == c[j]:
                        want[g, i, j] = want.get((g, i, j), 0) + 1 / 12
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    stable = {(r["g"], r["node"]): r["stability"] for r in rs.stability(rs.coassignment(graphs, 12)).collect()}
    assert all(abs(stable[g, v] - max(p for (h, i, j), p in want.items() if h == g and v in (i, j))) < 1e-9 for g, v in stable)


def test_metrics_intervals_equal_a_loop(graphs):
    got = {(r["g"], r["metric"]): (r["mean"], r["sd"], r["low"], r["high"], r["replicates"]) for r in rs.metrics_with_ci(graphs, 15, 0.9).collect()}
    for g, ws in drawn(graphs, 15, 12).items():
        values = [rs.graph_metrics(w, seed) for w, seed in ws]
        for m in values[0]:
            v = np.array([x[m] for x in values])
            assert np.allclose(got[g, m], [v.mean(), v.std(), *np.quantile(v, [0.05, 0.95]), 15])
    full = 1.0 - np.eye(6)
    m = rs.graph_metrics(full, 0)
    assert m["density"] == m["transitivity"] == m["efficiency"] == 1 and m["mean_strength"] == 5
