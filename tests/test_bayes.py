"""Bayesian regression against numerical integration, the closed form and brute force."""

import numpy as np
import pandas as pd
import pytest

from cohortweave.operators import bayes as by


def test_linear_against_integration_on_a_grid(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=12)
    y = 0.4 + 0.8 * x + rng.normal(size=12)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("a", None, 1.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0)] + [("exact", float(k), 2.0 * k) for k in range(5)]
    got = {r["g"]: r for r in by.linear(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", "g").collect()}
    assert got["two"]["beta"] is None and got["exact"]["beta"] is None and got["a"]["n"] == 12
    a, b, u = np.meshgrid(np.linspace(-3, 4, 141), np.linspace(-3, 4, 141), np.linspace(-1.5, 2, 141), indexing="ij")
    rest = sum((q - a - b * p) ** 2 for p, q in zip(x, y, strict=True))
    log = -12 * u - rest / 2 * np.exp(-2 * u) - (a * a + b * b) / 8 - np.log(1 + np.exp(2 * u)) + u
    w = np.exp(log - log.max())
    w /= w.sum()
    for name, v in (("alpha", a), ("beta", b), ("sigma", np.exp(u))):
        mean = (w * v).sum()
        assert got["a"][name] == pytest.approx(mean, abs=2e-3)
        assert got["a"][f"{name}_sd"] == pytest.approx(np.sqrt((w * (v - mean) ** 2).sum()), abs=2e-3)


def design(seed, subjects=6, places=8, noise=0.5, slopes=(0.8, -0.5)):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 0.7, subjects), np.array([rng.normal(slopes[k % 2], 0.1) for k in range(places)])
    rows = [(s, k, k % 2, float(x), float(a[s] + b[k] * x + rng.normal(0, noise))) for s in range(subjects) for k in range(places) for x in rng.normal(size=2)]
    return pd.DataFrame(rows, columns=["subject", "place", "grp", "x", "y"])


def cells(rows):
    r = rows.assign(n=1.0, sx=rows.x, sy=rows.y, sxx=rows.x**2, sxy=rows.x * rows.y, syy=rows.y**2)
    return r.groupby(["subject", "place", "grp"], as_index=False)[["n", "sx", "sy", "sxx", "sxy", "syy"]].sum()


def test_chain_with_held_deviations_equals_the_closed_form():
    rows, (s, sa, sb) = design(2), (0.5, 0.7, 0.3)
    _, draws = by.gibbs(cells(rows), 20000, 500, 3, (s, sa, sb))
    # all of a, b, m at once: a normal posterior with the precision of the likelihood and the priors
    k = 6 + 8 + 2
    z = np.zeros((len(rows), k))
    z[np.arange(len(rows)), rows.subject] = 1
    z[np.arange(len(rows)), 6 + rows.place] = rows.x
    prior = np.diag([1 / sa**2] * 6 + [0.0] * 8 + [1.0] * 2)
    for p in range(8):
        d = np.zeros(k)
        d[6 + p], d[14 + p % 2] = 1, -1
        prior += np.outer(d, d) / sb**2
    cov = np.linalg.inv(z.T @ z / s**2 + prior)
    mean = cov @ z.T @ rows.y.to_numpy() / s**2
    assert draws.mean(0) == pytest.approx(mean[14:], abs=0.01)
    assert draws.std(0) == pytest.approx(np.sqrt(np.diag(cov)[14:]), rel=0.05)


def test_chains_find_the_slopes_they_came_from_and_meet(spark):
    a, b = design(4, 10, 16), design(5, 10, 16, slopes=(0.0, 0.4))
    df = spark.createDataFrame(pd.concat([a.assign(key="a"), b.assign(key="b")]))
    df = df.unionByName(spark.createDataFrame([("a", 1, 1, 1, None, 3.0)], "key string, subject long, place long, grp long, x double, y double"))
    draws = by.chains(df, "key", "subject", "place", "grp", "y", "x", 600, 300)
    got = {(r["key"], r["grp"]): r for r in by.summary(draws, "key", "grp").collect()}
    assert len(got) == 4
    for (key, g), true in {("a", 0): 0.8, ("a", 1): -0.5, ("b", 0): 0.0, ("b", 1): 0.4}.items():
        r = got[(key, g)]
        assert abs(r["mean"] - true) < 0.2 and r["rhat"] < 1.05 and r["low"] < r["mean"] < r["high"]
    assert got[("a", 0)]["credible"] and got[("a", 1)]["credible"]
    again = by.chains(df.repartition(7), "key", "subject", "place", "grp", "y", "x", 600, 300)
    assert {(r["key"], r["grp"]): pytest.approx(r["mean"], abs=1e-6) for r in by.summary(again, "key", "grp").collect()} == {k: r["mean"] for k, r in got.items()}


def test_free_deviations_against_integration():
    """One place and one group: s, sa and sb are free; the group's mean is found on a grid with all else integrated out."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=9)
    y = 0.6 * x + rng.normal(0, 0.4, 9)
    rows = pd.DataFrame({"subject": np.repeat([0, 1, 2], 3), "place": 0, "grp": 0, "x": x, "y": y})
    _, draws = by.gibbs(cells(rows), 30000, 1000, 8)
    u = [np.exp(np.linspace(low, high, 33)) for low, high in ((-2.2, 0.6), (-6, 1.2), (-6, 0.8))]
    same = (rows.subject.to_numpy()[:, None] == rows.subject.to_numpy()).astype(float)
    total = first = second = 0.0
    for s in u[0]:
        for sa in u[1]:
            base = s * s * np.eye(9) + sa * sa * same
            for sb in u[2]:
                c = base + (1 + sb * sb) * np.outer(x, x)
                inv = np.linalg.inv(c)
                like = np.exp(-0.5 * (np.linalg.slogdet(c)[1] + y @ inv @ y)) * s * sa * sb / (1 + s * s) * np.exp(-sa * sa / 2 - sb * sb / 0.5)
                m, v = x @ inv @ y, 1 - x @ inv @ x
                total, first, second = total + like, first + like * m, second + like * (m * m + v)
    mean = first / total
    assert draws.mean() == pytest.approx(mean, abs=0.02)
    assert draws.std() == pytest.approx(np.sqrt(second / total - mean**2), rel=0.06)


def test_interval_is_the_narrowest(spark):
    v = np.sort(np.random.default_rng(7).gamma(2.0, size=500))
    got = by.interval(spark.createDataFrame([("k", float(x)) for x in v], "g string, v double"), "v", "g").first()
    k = int(np.floor(0.94 * 500))
    widths = v[k:] - v[:-k]
    at = int(widths.argmin())
    assert (got["low"], got["high"]) == (v[at], v[at + k])
