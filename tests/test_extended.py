"""Kernels against brute force and known answers; permutation and resampling operators against loops."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import networks as nw
from cohortweave.functions import signals as sg
from cohortweave.operators import cohort as co
from cohortweave.operators import kernels as kr
from cohortweave.operators import paths as pa
from cohortweave.operators import pointprocess as pp
from cohortweave.plans import extended
from cohortweave.streaming.activity import windowed_activity


def graph(n, share, seed=0):
    rng = np.random.default_rng(seed)
    w = np.triu(np.where(rng.random((n, n)) < share, rng.integers(1, 9, (n, n)), 0), 1).astype(float)
    return w + w.T


def edges(spark, w, g=0):
    return spark.createDataFrame([(g, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w)), strict=True)], "g int, i int, j int, w double")


def test_paths_of_a_long_ring(spark):
    n = 15
    ring = spark.createDataFrame([(0, k, (k + 1) % n, 2.0) for k in range(n)], "g int, i int, j int, w double")
    got = {(r["i"], r["j"]): r["d"] for r in pa.lengths(ring).collect()}
    assert got == {(a, b): min((a - b) % n, (b - a) % n) for a in range(n) for b in range(n) if a != b}
    assert {r["d"] for r in pa.lengths(ring, True).collect()} == {k / 2 for k in range(1, n // 2 + 1)}


def test_weighted_betweenness_against_all_paths():
    w = graph(7, 0.5, 3)
    n, out = 7, np.zeros(7)
    for s, t in itertools.permutations(range(n), 2):
        rest = [v for v in range(n) if v not in (s, t)]
        every = [(s, *m, t) for k in range(n - 1) for m in itertools.permutations(rest, k)]
        cost = {p: sum(1 / w[a, b] if w[a, b] else np.inf for a, b in itertools.pairwise(p)) for p in every}
        low = min(cost.values())
        best = [p for p in every if np.isfinite(low) and cost[p] <= low * (1 + 1e-12)]
        for p in best:
            for v in p[1:-1]:
                out[v] += 1 / len(best)
    assert nw.betweenness_weighted(w) == pytest.approx(out / ((n - 1) * (n - 2)))


def test_tau_b_against_all_pairs():
    rng = np.random.default_rng(2)
    for size in (5, 40):
        x, y = rng.integers(0, 6, size).astype(float), rng.integers(0, 6, size).astype(float)
        s = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2)]
        want = sum(a * b for a, b in s) / np.sqrt(sum(abs(a) for a, _ in s) * sum(abs(b) for _, b in s))
        assert nw.kendall_tau_b(x, y) == pytest.approx(want)
    assert np.isnan(nw.kendall_tau_b(np.ones(5), np.arange(5.0)))


def test_lempel_ziv_by_hand():
    x = np.array([1.0, 0, 0, 1, 1, 0, 0, 1])  # 1 | 0 | 01 | 1001 has been seen: an unfinished phrase
    s, i, c, size = "".join("1" if v > np.median(x) else "0" for v in x), 0, 1, 1
    while i + size <= len(s):
        if s[i : i + size] in s[: i + size - 1]:
            size += 1
        else:
            c, i, size = c + 1, i + size, 1
    assert sg.lempel_ziv(x) == pytest.approx(c * np.log2(len(x)) / len(x))


def test_butterworth_passes_its_band_without_delay():
    t = np.arange(4000)
    for rate, low, high in ((1.0, 0.05, 0.15), (1.0, 0.01, 0.2)):
        inside, outside = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 0.4 * t)
        kept = sg.bandpass(inside + outside + 3, 1 / rate, low, high)[500:-500]
        assert kept == pytest.approx(inside[500:-500], abs=0.02)
    edge = np.sin(2 * np.pi * 0.05 * t)  # half the power at the edge, twice over
    assert sg.bandpass(edge, 1.0, 0.05, 0.15)[1000:-1000].std() / edge.std() == pytest.approx(0.5, abs=0.01)


def test_spectra_and_amplitudes_of_known_signals():
    t = np.arange(1024)
    x = np.sin(2 * np.pi * 0.125 * t)
    f, p = sg.welch(x, 1.0, 128)
    assert f[p.argmax()] == pytest.approx(0.125) and p.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=0.02)
    alff, share = sg.band_amplitudes(x, 1.0, 0.1, 0.15)
    power = np.abs(np.fft.rfft(sg.detrended(x))) ** 2
    band = power[(np.fft.rfftfreq(1024) >= 0.1) & (np.fft.rfftfreq(1024) <= 0.15)]
    assert alff == pytest.approx(np.sqrt(band.mean())) and share == pytest.approx(np.sqrt(band.mean() / power.mean()))
    assert sg.spectral_entropy(x) < 0.05 < 0.9 < sg.spectral_entropy(np.random.default_rng(1).normal(size=1024))
    assert sg.instantaneous_frequency(x, 1.0) == pytest.approx(0.125, abs=1e-3)


def test_sample_entropy_against_pairs():
    x = np.random.default_rng(5).normal(size=60)
    tol, n = 0.2 * x.std(), len(x)
    count = [sum(max(abs(x[i + q] - x[j + q]) for q in range(m)) <= tol for i, j in itertools.combinations(range(n - 2), 2)) for m in (2, 3)]
    assert sg.sample_entropy(x) == pytest.approx(-np.log(count[1] / count[0]))


def test_null_models_keep_what_they_say():
    w, rng = graph(20, 0.3, 4), np.random.default_rng(1)
    m = int((w > 0).sum() / 2)
    place = np.random.default_rng(2).random((20, 3))
    assert int((nw.erdos_renyi(w, rng) > 0).sum() / 2) == m
    shuffled = nw.weights_shuffled(w, rng)
    assert ((shuffled > 0).sum(0) == (w > 0).sum(0)).all() and sorted(shuffled.ravel()) == sorted(w.ravel())
    assert ((nw.configuration(w, rng) > 0).sum(0) <= (w > 0).sum(0)).all()
    near = nw.geometry_rewired(w, place, rng)
    assert sorted(near.ravel()) == sorted(w.ravel()) and (near == near.T).all()
    i, j = np.triu_indices(20, 1)
    far = np.linalg.norm(place[i] - place[j], axis=1)
    bin_of = np.searchsorted(np.quantile(far, np.linspace(0, 1, 11)[1:-1]), far, "right")
    assert (np.bincount(bin_of[near[i, j] > 0], minlength=10) == np.bincount(bin_of[w[i, j] > 0], minlength=10)).all()


def test_reservoir_measures():
    w = graph(12, 0.5, 6)
    mc = nw.memory_capacity(w, 0.9, 0.5, 2, 1500, 20, 200)
    assert (mc >= 0).all() and (mc <= 1).all() and mc[0] > mc[-1] and mc.sum() <= 12
    assert nw.echo_index(w, 0.5, 0.5, 1, steps=300) > 0.99  # contracting: all trials meet
    assert nw.lyapunov(w, 0.3, 0.5, 1, 800, 100) < 0
    assert nw.state_entropy(np.random.default_rng(3).random((5000, 3))) > 0.98


def test_network_based_statistic_against_a_loop(spark):
    rng, n, reps = np.random.default_rng(7), 6, 60
    rows = [(s, i, j, float(rng.normal() + (2.5 if s < 5 and i < 3 and j < 3 else 0))) for s in range(10) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(rows, "subject int, i int, j int, w double")
    subjects = spark.createDataFrame([(s, s < 5) for s in range(10)], "subject int, first boolean")
    got = {(r["component"], r["edges"]): r["p"] for r in co.nbs(df, subjects, 2.0, reps).collect()}

    def parts(first):
        w = np.zeros((n, n))
        for i, j in itertools.combinations(range(n), 2):
            a, b = ([v for s, p, q, v in rows if (p, q) == (i, j) and (s in first) == side] for side in (True, False))
            if abs((np.mean(a) - np.mean(b)) / np.sqrt(np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b))) > 2.0:
                w[i, j] = w[j, i] = 1
        return w

    sizes = []
    for r in range(1, reps + 1):
        order = sorted(range(10), key=lambda s: hashlib.md5(f"{s}:{r}".encode()).hexdigest())
        sizes.append(nw.largest_part(parts(set(order[:5]))))
    own = nw.largest_part(parts(set(range(5))))
    (component, k), p = max(got.items(), key=lambda x: x[0][1])
    assert component == 0 and k == own and p == pytest.approx(np.mean([s >= own for s in sizes]))


def test_permutations_agree_packed_and_by_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, "a" if k % 3 else "b", "m", float(rng.normal() + (0.6 if k % 3 else 0))) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, grp string, metric string, value double")
    packed = kr.permutation_test(df, "value", "grp", "a", "b", 2000, "metric").first()
    monkeypatch.setattr(kr, "PACKED_VALUES", 10)
    by_rows = kr.permutation_test(df, "value", "grp", "a", "b", 2000, "metric").first()
    assert packed["replicates"] == by_rows["replicates"] == 2000 and packed["observed"] == pytest.approx(by_rows["observed"])
    assert packed["p"] == pytest.approx(by_rows["p"], abs=0.03)


def test_resampled_sums_do_not_depend_on_partitions(spark):
    rows = [(k % 3, k, float(k % 7)) for k in range(900)]
    df = spark.createDataFrame(rows, "key int, id long, v double")
    one, many = ({r["key"]: (r["mean_m"], r["low"], r["high"]) for r in kr.bootstrap_means(df.repartition(p), "v", 500, "key").collect()} for p in (1, 5))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)
    mean, low, high = one[0]
    values = np.array([v for k, _, v in rows if k == 0])
    assert mean == pytest.approx(values.mean(), abs=0.02) and high - low == pytest.approx(2 * 1.96 * values.std() / np.sqrt(len(values)), rel=0.15)
    counts = kr.poisson_counts(np.arange(2000), 300, 1)
    assert counts.mean() == pytest.approx(1, abs=0.01) and counts.var() == pytest.approx(1, abs=0.02)


def test_resampling_is_dealt_over_stated_tasks_and_draws_stay(spark):
    ids = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 300)
    mask = (1 << 64) - 1

    def draw(i, r):  # one count by plain integers
        x = (int(i) * 0x9E3779B97F4A7C15 + (r + 1 + (13 << 32)) * 0xD1B54A32D192ED03) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return int(np.searchsorted(kr._POISSON, ((x ^ (x >> 31)) >> 11) / float(1 << 53), "right"))

    counts = kr.poisson_counts(ids, 400, 13)
    assert (counts == [[draw(i, r) for r in range(400)] for i in ids]).all() and counts.max() >= 6
    one_task = spark.createDataFrame([(k % 5, k, float(k % 7)) for k in range(5000)], "key int, id long, v double").coalesce(1)
    parts = kr.poisson_sums(one_task, ["key"], 50, 1)
    spread = parts.select("key", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["task"] for r in spread}) >= 8 and max(sum(r["key"] == k for r in spread) for k in range(5)) <= 8


def test_power_law_cut_of_a_sample(spark):
    rng = np.random.default_rng(9)
    x = np.floor(4.5 * (1 - rng.random(3000)) ** (-1 / 1.5) + 0.5)
    x = np.concatenate([x, rng.integers(1, 5, 1500)])
    got = pp.powerlaw_xmin(spark.createDataFrame([(0, int(v)) for v in x], "subject int, size long"), "size", "subject").first()
    xmin, alpha, ks = extended.tail_distance(x)
    assert (got["xmin"], got["alpha"], got["ks"]) == pytest.approx((xmin, alpha, ks))
    assert alpha == pytest.approx(2.5, abs=0.2)


def test_batches_are_harmonised(spark):
    rng = np.random.default_rng(10)
    rows = [(s, b, f"m{f}", float(rng.normal(f, 1 + f / 5) * (1 + b) + 3 * b)) for b in range(3) for s in range(80) for f in range(6)]
    df = spark.createDataFrame(rows, "subject int, site int, metric string, value double")
    for pooled in (True, False):
        m = co.combat(df, "value", "site", "metric", pooled).groupBy("metric", "site").agg(F.avg("harmonized").alias("a"), F.stddev("harmonized").alias("s")).collect()
        for f in range(6):
            own = [r for r in m if r["metric"] == f"m{f}"]
            assert np.ptp([r["a"] for r in own]) < 0.8 and max(r["s"] for r in own) / min(r["s"] for r in own) < 1.35


def test_windowed_activity(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0), ("2024-01-01 00:20:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_activity(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["start"])[11:13], r["roi"]): (r["n"], r["v"]) for r in spark.table("windows").collect()}
    assert got == {("00", "a"): (2, 3.0), ("01", "a"): (1, 4.0), ("00", "b"): (1, 8.0)}


def test_strong_pairs_over_several_words_of_labels_against_a_loop(spark):
    rng, reps = np.random.default_rng(17), 150
    rows = [(f"s{s}", i, i + 1, None if (s, i) == (3, 2) else 1.0 if i == 4 else float(rng.normal() + (1.5 if s < 5 and i < 2 else 0))) for s in range(11) for i in range(5)]
    df = spark.createDataFrame([*rows, ("unknown", 0, 1, 99.0)], "subject string, i int, j int, w double")
    subjects = spark.createDataFrame([(f"s{s}", s < 5) for s in range(11)], "subject string, first boolean")
    got = {(r["replicate"], r["i"]): r["t"] for r in co.strong_pairs(df, subjects, 1.0, reps).collect()}
    want = {}
    for r in range(reps + 1):
        ids = [f"s{s}" for s in range(11)]
        first = set(ids[:5] if r == 0 else sorted(ids, key=lambda s: hashlib.md5(f"{s}:{r}".encode()).hexdigest())[:5])
        for i in range(5):
            a, b = ([w for s, p, _, w in rows if p == i and w is not None and (s in first) == side] for side in (True, False))
            spread = np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b)
            t = (np.mean(a) - np.mean(b)) / np.sqrt(spread) if spread else 0.0
            if abs(t) > 1.0:
                want[(r, i)] = t
    assert got == pytest.approx(want) and max(r for r, _ in got) > 128


def test_sign_flips_against_a_loop(spark):
    rng, n = np.random.default_rng(18), 500
    rows = [(k, "a" if k % 2 else "b", float(rng.normal() + 0.4)) for k in range(20)] + [(50, "a", None), (51, "none", None)]
    got = {r["g"]: r for r in co.sign_flips(spark.createDataFrame(rows, "id int, g string, v double"), "v", n, "g").collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        own = [(k, v) for k, x, v in rows if x == g and v is not None]
        observed = np.mean([v for _, v in own])
        null = [np.mean([v if hashlib.md5(f"{k}:{r}".encode()).hexdigest()[0] < "8" else -v for k, v in own]) for r in range(1, n + 1)]
        assert got[g]["observed"] == pytest.approx(observed)
        assert got[g]["p"] == pytest.approx(max(np.mean(np.abs(null) >= abs(observed) - 1e-12), 1 / (n + 1)))
