"""Communication, regional coupling and joint alignment against numpy."""

import hashlib
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.operators import alignment as al
from cohortweave.operators import communication as co
from cohortweave.operators import labels as lb


def graphs():
    """Dense, bipartite, disconnected and star graphs as matrices."""
    rng = np.random.default_rng(5)
    dense = np.triu(rng.uniform(0.1, 2, (12, 12)) * (rng.random((12, 12)) < 0.5), 1)
    two = np.zeros((7, 7))
    two[0, 1], two[1, 2], two[0, 2], two[3, 4], two[5, 6] = 1, 2, 0.5, 3, 0.25
    ring = np.zeros((6, 6))
    for k in range(6):
        ring[min(k, (k + 1) % 6), max(k, (k + 1) % 6)] = 1.5
    star = np.zeros((40, 40))
    star[0, 1:] = 1
    return {k: w + w.T for k, w in enumerate((dense, two, ring, star))}


def edges_of(spark, found):
    rows = [(g, int(i), int(j), float(w[i, j])) for g, w in found.items() for i, j in zip(*np.nonzero(np.triu(w)), strict=True)]
    return spark.createDataFrame([*rows, (0, 3, 3, 9.0), (0, 100, 101, 0.0)], "g int, i int, j int, w double").repartition(3)


def exponential(w):
    values, vectors = np.linalg.eigh(w / np.abs(np.linalg.eigvalsh(w)).max())
    return vectors * np.exp(values) @ vectors.T


def test_radius_and_communicability_equal_eigenvalues(spark):
    found = graphs()
    edges = edges_of(spark, found)
    got = {r["g"]: r["radius"] for r in co.spectral_radius(edges).collect()}
    assert set(got) == set(found)
    for g, w in found.items():
        assert got[g] == pytest.approx(np.abs(np.linalg.eigvalsh(w)).max(), rel=1e-9)
    mine = {g: np.zeros_like(w) for g, w in found.items()}
    for r in co.communicability(edges).collect():
        mine[r["g"]][r["i"], r["j"]] = r["c"]
    for g, w in found.items():
        on = w.sum(0) > 0
        assert np.allclose(mine[g][np.ix_(on, on)], exponential(w)[np.ix_(on, on)], atol=1e-9), g


def test_graphs_without_edges_are_empty(spark):
    none = spark.createDataFrame([(0, 1, 2, 0.0), (0, 3, 3, 1.0)], "g int, i int, j int, w double")
    assert co.communicability(none).count() == 0 and co.communication_features(none).count() == 0


def dijkstra(w, s):
    d, heap = np.full(len(w), np.inf), [(0.0, s)]
    while heap:
        c, v = heapq.heappop(heap)
        if c < d[v]:
            d[v] = c
            for u in np.nonzero(w[v])[0]:
                heapq.heappush(heap, (c + 1 / w[v, u], u))
    return d


def test_features_and_coupling_equal_loops(spark):
    found = graphs()
    rng = np.random.default_rng(6)
    places = {g: rng.normal(size=(len(w), 3)) for g, w in found.items()}
    target = {g: np.triu(rng.normal(size=w.shape), 1) for g, w in found.items()}
    target[0][2, 5] = np.nan
    at = spark.createDataFrame([(g, k, *map(float, p)) for g, x in places.items() for k, p in enumerate(x)], "g int, node int, x double, y double, z double")
    ys = spark.createDataFrame([(g, int(i), int(j), float(y[i, j])) for g, y in target.items() for i, j in zip(*np.triu_indices(len(y), 1), strict=True)], "g int, i int, j int, y double")
    f = co.communication_features(edges_of(spark, found), at)
    x = {g: np.full((*w.shape, 3), np.nan) for g, w in found.items()}
    rows = f.collect()
    for r in rows:
        x[r["g"]][r["i"], r["j"]] = r["shortest_path"], r["communicability"], r["euclidean"]
    assert len(rows) == sum(len(w) * (len(w) - 1) for w in found.values())
    want = {}
    for g, w in found.items():
        d = np.array([dijkstra(w, s) for s in range(len(w))])
        d[np.isinf(d)] = 2 * d[np.isfinite(d)].max()
        far = np.sqrt(((places[g][:, None] - places[g][None]) ** 2).sum(2))
        want[g] = np.stack([d, exponential(w), far], 2)
        off = ~np.eye(len(w), dtype=bool)
        assert np.allclose(x[g][off], want[g][off], atol=1e-8), g
    got = {(r["g"], r["node"]): r for r in co.regional_coupling(f, ys).collect()}
    for g, w in found.items():
        y = target[g] + target[g].T
        for i in range(len(w)):
            on = (np.arange(len(w)) != i) & np.isfinite(y[i])
            r, n = got[g, i], on.sum()
            assert r["n"] == n
            if n < 6:
                assert r["coupling"] is None and r["betas"] is None
                continue
            a = np.column_stack([np.ones(n), want[g][i, on]])
            if np.linalg.matrix_rank(a - [0, *a[:, 1:].mean(0)], tol=1e-8) < 4:
                continue  # slopes are not defined alone
            b = np.linalg.lstsq(a, y[i, on], rcond=None)[0]
            r2 = 1 - ((y[i, on] - a @ b) ** 2).sum() / ((y[i, on] - y[i, on].mean()) ** 2).sum()
            assert r["coupling"] == pytest.approx(1 - (1 - r2) * (n - 1) / (n - 4), abs=1e-6)
            assert np.allclose(r["betas"], b[1:], atol=1e-6)


def turned(rng, x):
    q, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    return x @ q + rng.normal(size=x.shape[1]) + rng.normal(size=x.shape) * 0.05


def one_round(xs, template):
    out = []
    for x in xs:
        a, b = x - x.mean(0), template - template.mean(0)
        u, _, v = np.linalg.svd(a.T @ b)
        out.append(a @ (u @ v) + template.mean(0))
    return out


def test_joint_alignment_equals_a_loop_and_the_error_falls(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 4)) * [3, 2, 1, 0.5]
    xs = [turned(rng, base) for _ in range(9)]
    rows = [(f"s{k}", n, row.tolist()) for k, x in enumerate(xs) for n, row in enumerate(x)]
    bad = [("s3", 99, None), (None, 1, [1.0] * 4), ("s4", 98, [1.0, None, 2.0, 3.0]), ("s5", 97, [1.0])]
    df = spark.createDataFrame(rows + bad, "subject string, node int, v array<double>").repartition(5)
    errors = []
    for rounds in (1, 2, 5):
        got, template = al.align_jointly(df, 4, rounds=rounds)
        want, mean = None, xs[0]
        for _ in range(rounds):
            want = one_round(xs, mean)
            mean = np.mean(want, axis=0)
        mine = {(r["subject"], r["node"]): r["v"] for r in got.collect()}
        assert len(mine) == 270
        assert all(np.allclose(mine[f"s{k}", n], want[k][n], atol=1e-9) for k in range(9) for n in range(30))
        assert all(np.allclose(r["v"], mean[r["node"]], atol=1e-9) for r in template.collect())
        errors.append(sum(r["rmse"] ** 2 for r in al.misfit(got, template, 4).collect()))
    assert errors[0] > errors[1] >= errors[2]
    got, template = al.align_jointly(df, 4, reference="first")
    want = one_round(xs, xs[0])
    assert all(np.allclose(r["v"], want[int(r["subject"][1])][r["node"]], atol=1e-9) for r in got.collect())
    with pytest.raises(ValueError, match="unknown reference"):
        al.align_jointly(df, 4, reference="last")
    plan = al.rotated(df, al.rotations(df, template, 4), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_misfit_of_equal_vectors_is_zero(spark):
    df = spark.createDataFrame([(s, n, [float(n), float(n * n)]) for s in (1, 2) for n in range(5)], "subject int, node int, v array<double>")
    got = al.misfit(*al.align_jointly(df, 2), 2).collect()
    assert [r["rmse"] for r in got] == pytest.approx([0, 0], abs=1e-9) and df.filter(F.col("subject") == 1).count() == 5


def test_moved_weights_keep_strengths_and_edges():
    rng = np.random.default_rng(8)
    for w in (graphs()[0], graphs()[2][:4, :4] + np.ones((4, 4)) - np.eye(4)):
        a = nw.strength_preserving(w, rng)
        assert np.allclose(a.sum(0), w.sum(0), atol=1e-9) and np.array_equal(a, a.T)
        assert np.array_equal(a > 0, w > 0)
        assert np.abs(a - w).sum() > 0.2 * w.sum()
    for w in (graphs()[3], graphs()[1], np.zeros((3, 3))):  # a star, paths and a triangle: no cycle of four
        assert np.array_equal(nw.strength_preserving(w, rng), w)


def test_permuted_modules_equal_a_loop(spark):
    rng = np.random.default_rng(9)
    n, nodes, module = 150, np.arange(3, 21), ["a", "b", "a", "c", "b", "a"] * 3
    rows, want = [], {}
    for s in ("s1", "s2", "s3"):
        x, y = np.triu(rng.normal(size=(18, 18)), 1), np.triu(rng.normal(size=(18, 18)), 1)
        same = np.array(module)[:, None] == np.array(module)
        y = np.where(same, y + x, y)
        rows += [(s, int(nodes[i]), int(nodes[j]), float(x[i, j]), float(y[i, j])) for i, j in zip(*np.triu_indices(18, 1), strict=True)]
        for r in range(n + 1):
            order = sorted(range(18), key=lambda k: hashlib.md5(f"{s}:{nodes[k]}:{r}".encode()).hexdigest()) if r else range(18)
            mine = [""] * 18
            for place, k in enumerate(order):
                mine[k] = module[place]
            for m in "abc":
                on = [(i, j) for i in range(18) for j in range(i + 1, 18) if mine[i] == mine[j] == m]
                want[s, r, m] = np.corrcoef([x[p] for p in on], [y[p] for p in on])[0, 1]
    bad = [("s1", 3, 4, None, 1.0), ("s1", 3, 99, 1.0, 1.0), ("s2", 5, 6, 1.0, float("nan")), ("s4", 3, 5, 1.0, 1.0), ("s4", 3, 8, 1.0, 2.0)]
    edges = spark.createDataFrame(rows + bad, "subject string, i int, j int, x double, y double").repartition(4)
    labels = spark.createDataFrame([(int(v), m) for v, m in zip(nodes, module, strict=True)] + [(50, None)], "node int, module string")
    got = {(r["subject"], r["replicate"], r["module"]): r["r"] for r in lb.coupling_nulls(edges, labels, n).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for row in lb.coupling_test(edges, labels, n).collect():
        m = row["module"]
        mean = np.array([np.mean([want[s, r, m] for s in ("s1", "s2", "s3")]) for r in range(n + 1)])
        assert row["r"] == pytest.approx(mean[0]) and row["p"] == pytest.approx((mean[1:] >= mean[0] - 1e-12).mean())
        assert row["z"] == pytest.approx((mean[0] - mean[1:].mean()) / mean[1:].std()) and row["subjects"] == 3
