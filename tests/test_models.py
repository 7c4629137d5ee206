"""Radius joins, scaling breaks, models with covariates and Leiden communities against loops in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import signals as sg
from cohortweave.operators import communities as cm
from cohortweave.operators import regression as rg
from cohortweave.operators import scaling as sc
from cohortweave.operators import surface as su


def test_multiscale_features_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    xyz = np.r_[rng.normal(size=(1900, 3)) * [1, 1, 0.2], np.repeat([[0.5, 0.5, 0.1]], 80, 0), [[50.0, 0, 0]] * 3, 9 + np.outer(np.arange(17), [0.1, 0, 0])]
    radii = [0.2, 0.4, 0.8, 1.6]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)] + [(9999, None, 0.0, 0.0)], "id long, x double, y double, z double").repartition(3)
    got = su.multiscale_eigenfeatures(df, radii)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "cx" in plan
    rows = got.collect()
    assert len(rows) == 4 * len(xyz)
    names = ["l1", "l2", "l3", "linearity", "planarity", "sphericity", "eigenentropy", "omnivariance", "anisotropy", "surface_variation"]
    for k, r in enumerate(radii):
        want = nw.surface_features(xyz, r)
        n = (((xyz[:, None] - xyz[None]) ** 2).sum(2) <= r * r).sum(1)
        for row in (x for x in rows if x["radius"] == r):
            assert row["n"] == n[row["id"]]
            mine = np.array([np.nan if row[c] is None else row[c] for c in names])
            if np.isnan(want[row["id"]]).all():  # too few points, or no extent
                assert np.isnan(mine[3:]).all()
            else:
                assert np.allclose(mine[[0, 1, 2, 3, 4, 5, 6, 8, 9]], want[row["id"]][[0, 1, 2, 3, 4, 5, 6, 8, 9]], atol=1e-6), (k, row)


def test_features_keep_surfaces_apart(spark):
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(s, k, *map(float, p)) for s in ("l", "r") for k, p in enumerate(xyz[: 60 if s == "l" else 30])], "side string, id long, x double, y double, z double")
    got = {(r["side"], r["id"]): r["n"] for r in su.multiscale_eigenfeatures(df, [1.0], "side").collect()}
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 1
    assert got == {("l", k): near[k].sum() for k in range(60)} | {("r", k): near[k, :30].sum() for k in range(30)}


def test_neighbours_meet_in_blocks_and_not_by_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(su, "BLOCK", 50)  # the lattice has many distances equal to a radius, and one small cell holds 200 points
    rng = np.random.default_rng(5)
    xyz = np.r_[np.stack(np.meshgrid(*[np.arange(11) / 10 - 0.5] * 3), -1).reshape(-1, 3), np.round(0.31 + rng.random((200, 3)) * 0.01, 6), [[np.nan, 0, 0], [0, np.inf, 0]]]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "id long, x double, y double, z double").repartition(3)
    radii = [0.3, 0.5]
    sizes = [r["count"] for r in su.blocks(df, 0.5).groupBy("cx", "cy", "cz", "block", "part").count().collect()]
    assert max(sizes) <= 120 and sum(sizes) == len(xyz) - 2
    sums = su.radius_sums(df, radii)
    assert "MapInPandas" in sums._jdf.queryExecution().optimizedPlan().toString()
    with np.errstate(invalid="ignore"):
        d = xyz[None] - xyz[:, None]
        d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    got = {(r["x"], r["y"], r["z"], r["k"]): r for r in sums.collect()}
    assert len(got) == 2 * (len(xyz) - 2)
    for k, r in enumerate(radii):
        for i, p in enumerate(xyz[:-2]):
            near, row = d[i][d2[i] <= r * r], got[(*p, k)]
            assert row["n"] == len(near)
            assert np.allclose([row["dx"], row["dy"], row["dz"]], near.sum(0), atol=1e-9)
            assert np.allclose([row["dxdx"], row["dxdy"], row["dydz"], row["dzdz"]], [(near[:, a] * near[:, b]).sum() for a, b in ((0, 0), (0, 1), (1, 2), (2, 2))], atol=1e-9)


def test_fluctuations_equal_the_kernel(spark):
    rng = np.random.default_rng(3)
    series = {("a", "x"): rng.normal(size=400), ("a", "y"): np.cumsum(rng.normal(size=400)), ("b", "x"): rng.normal(size=97), ("b", "z"): np.zeros(50)}
    df = spark.createDataFrame([(s, t, r, float(v)) for (s, r), x in series.items() for t, v in enumerate(x)], "subject string, t int, roi string, v double").repartition(3)
    scales = [4, 7, 10, 24, 60, 99]
    got = {(r["subject"], r["roi"], r["scale"]): r["f"] for r in sc.fluctuations(df, scales).collect()}
    want = {}
    for key, x in series.items():
        y = np.cumsum(x - x.mean())
        for s in scales:
            if len(x) // s >= 4:
                part = y[: len(x) // s * s].reshape(-1, s)
                u = np.arange(s)
                want[*key, s] = np.sqrt(np.mean([(p - np.polyval(np.polyfit(u, p, 1), u)) ** 2 for p in part]))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)
    assert abs(sg.scaling_exponent(series["a", "x"]) - 0.5) < 0.3


def brute_crossover(x, y, least=3, gain=0.1):
    def rest(a, b):
        return ((b - np.polyval(np.polyfit(a, b, 1), a)) ** 2).sum()

    if len(x) < 2 * least + 1:
        return None
    one, best = rest(x, y), (gain, None)
    for k in range(least, len(x) - least):
        g = 1 - (rest(x[:k], y[:k]) + rest(x[k:], y[k:])) / one
        if g > best[0] + 1e-12:
            best = (g, k)
    return best[1] and (best[0], best[1], np.polyfit(x[: best[1]], y[: best[1]], 1)[0], np.polyfit(x[best[1] :], y[best[1] :], 1)[0])


def test_crossover_equals_all_breaks(spark):
    rng = np.random.default_rng(4)
    curves = {}
    for k in range(40):
        n = int(rng.integers(4, 25))
        x = np.sort(rng.uniform(0, 3, n))
        curves[k] = (x, (0.5 * x + (k % 3 > 0) * np.maximum(x - 1.5, 0) + rng.normal(size=n) * (0.02, 0.02, 0.3)[k % 3]))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in curves.items() for a, b in zip(x, y, strict=True)] + [(0, None, 1.0)], "k int, x double, y double").repartition(3)
    got = {r["k"]: r for r in sc.crossover(df, "k").collect()}
    found = 0
    for k, (x, y) in curves.items():
        want = brute_crossover(x, y)
        if want is None:
            assert got[k]["split"] is None
            continue
        found += 1
        r = got[k]
        assert r["split"] == want[1] and r["crossover_x"] == x[want[1]]
        assert np.allclose([r["improvement"], r["slope_low"], r["slope_high"], r["slope"]], [want[0], want[2], want[3], np.polyfit(x, y, 1)[0]])
    assert found > 15
    flat = spark.createDataFrame([(1, float(k), 2.0) for k in range(12)], "k int, x double, y double")
    assert sc.crossover(flat, "k").first()["split"] is None and sc.crossover(flat.limit(0), "k").count() == 0


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        site, age, sex = f"s{rng.integers(0, 4)}", float(rng.normal(50, 10)), float(rng.integers(0, 2))
        shift = {"s0": 0, "s1": 5, "s2": -3, "s3": 1}[site]
        for metric, slope in (("a", 0.3), ("b", -1.0)):
            rows.append((k, site, age, sex, metric, slope * age + 2 * sex + shift + float(rng.normal()) * (1 + (site == "s1"))))
    return rows, spark.createDataFrame(rows, "subject int, site string, age double, sex double, metric string, v double").repartition(3)


def _design(rows, metric):
    mine = [r for r in rows if r[4] == metric]
    sites = np.array([[r[1] == s for s in ("s0", "s1", "s2", "s3")] for r in mine], float)
    return mine, np.c_[sites, [[r[2], r[3]] for r in mine]], np.array([r[5] for r in mine])


def test_residuals_equal_a_fit_with_site_indicators(cohort):
    rows, df = cohort
    got = {(r["subject"], r["metric"]): r["residual"] for r in rg.residualize(df, "v", ["age", "sex"], "site", "metric").collect()}
    for metric in "ab":
        mine, x, y = _design(rows, metric)
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0] + y.mean()
        assert np.allclose([got[r[0], metric] for r in mine], want)


def test_least_squares_equals_numpy_and_bears_dependent_regressors(spark, cohort):
    rows, df = cohort
    got = {r["metric"]: r for r in rg.least_squares(df, "v", ["age", "sex"], "metric").collect()}
    for metric in "ab":
        mine, x, y = _design(rows, metric)
        x = np.c_[np.ones(len(y)), x[:, 4:]]
        b, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
        r2 = 1 - rest[0] / ((y - y.mean()) ** 2).sum()
        assert np.allclose([got[metric]["intercept"], *got[metric]["slopes"], got[metric]["r2"]], [*b, r2])
    twice = df.withColumn("again", 2 * F.col("age"))
    same = {r["metric"]: r for r in rg.least_squares(twice, "v", ["age", "again"], "metric").collect()}
    once = {r["metric"]: r for r in rg.least_squares(df, "v", ["age"], "metric").collect()}
    assert all(abs(same[m]["r2"] - once[m]["r2"]) < 1e-9 and abs(same[m]["slopes"][0] + 2 * same[m]["slopes"][1] - once[m]["slopes"][0]) < 1e-9 for m in "ab")
    odd = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", None, 5.0), ("b", 1.0, 3.0)], "k string, x double, y double")
    flat = {r["k"]: r for r in rg.least_squares(odd, "y", ["x"], "k").collect()}
    assert flat["a"]["n"] == 2 and flat["a"]["r2"] is None and flat["b"]["r2_adjusted"] is None


@pytest.mark.parametrize("pooled", [False, True])
def test_combat_keeps_what_covariates_explain(cohort, pooled):
    rows, df = cohort
    got = {(r["subject"], r["metric"]): r["harmonized"] for r in rg.combat_with(df, "v", ["age", "sex"], "site", "metric", pooled).collect()}
    for metric in "ab":
        mine, x, y = _design(rows, metric)
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        part = (x[:, 4:] - x[:, 4:].mean(0)) @ b[4:]
        h = np.array([got[r[0], metric] for r in mine])
        rest, before = h - part, y - part
        sites = np.array([r[1] for r in mine])
        gaps = np.ptp([rest[sites == s].mean() for s in np.unique(sites)])
        assert gaps < (1e-9 if not pooled else 0.6) and np.ptp([before[sites == s].mean() for s in np.unique(sites)]) > 5
        if not pooled:  # the definition, straight
            a, s = before.mean(), np.sqrt(np.mean([(before[k] - before[sites == sites[k]].mean()) ** 2 for k in range(len(before))]))
            z = (before - a) / s
            want = [(z[k] - z[sites == sites[k]].mean()) / z[sites == sites[k]].std(ddof=1) * s + a + part[k] for k in range(len(z))]
            assert np.allclose(h, want)


def modularity(w, c):
    return (w * (c[:, None] == c[None])).sum() / w.sum() - sum((w[c == x].sum() / w.sum()) ** 2 for x in np.unique(c))


def test_leiden_communities_are_connected_and_good(spark):
    rng = np.random.default_rng(1)
    rows, mats = [], {}
    for g in range(8):
        n, b = int(rng.integers(12, 40)), int(rng.integers(2, 6))
        own = rng.integers(0, b, n)
        w = np.triu((rng.random((n, n)) < np.where(own[:, None] == own, 0.5, 0.08)) * rng.uniform(0.2, 2, (n, n)), 1)
        w[np.arange(n - 1), np.arange(1, n)] += 0.1
        mats[g] = w + w.T
        rows += [(g, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
    rows += [(99, k, k + 1, 1.0) for k in (0, 10, 20)] + [(99, 5, 5, 3.0), (99, 7, 8, 0.0)]  # pairs, a loop and no edge
    got = cm.leiden(spark.createDataFrame(rows, "g int, i int, j int, w double"), runs=2).toPandas()
    gains = []
    for g, w in mats.items():
        mine = got[got.g == g].sort_values("node")
        c = mine.community.to_numpy()
        assert mine.node.tolist() == list(range(len(w))) and abs(modularity(w, c) - mine.modularity.iloc[0]) < 1e-9
        for x in np.unique(c):
            at = np.flatnonzero(c == x)
            assert at.min() == x
            part = w[np.ix_(at, at)] > 0
            assert (np.linalg.matrix_power(part + np.eye(len(at)), len(at)) > 0).all()
        gains.append(modularity(w, c) - modularity(w, nw.louvain(w, np.random.default_rng(0))))
    assert min(gains) > -0.02 and np.mean(gains) > -0.002
    assert sorted(got[got.g == 99][["node", "community"]].itertuples(index=False, name=None)) == [(0, 0), (1, 0), (10, 10), (11, 10), (20, 20), (21, 20)]
