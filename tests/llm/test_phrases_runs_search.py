"""Phrase mining, periodic runs and exact search against brute force, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import balltree, collocations, periodic

DOCS = "doc_id long, text string, lang string, phrase string, f long, id string, runs string, parts string, v string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, "clash", "clash", "clash", "clash") for i, t, lang in rows], DOCS).repartition(3)


# op11 ---------------------------------------------------------------------------


def brute_collocations(rows, max_words, min_count, top, cover):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    covered = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                covered[lang, w[s : s + m]] = max(a, covered.get((lang, w[s : s + m]), 0))
    kept = {}
    for (lang, w), a in found.items():
        if 100 * covered.get((lang, w), -1) < cover * a:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            kept.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, v in kept.items() for rank, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def phrase_rows(seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "İx", "ÄB", "new", "york", "city", "of", "a", "\xa0q", "zz\x85", "naïve", "-", "日本"]
    fixed = ["new york city of", "the naïve 日本", "a a a a a a"]
    rows = [(None, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "a " * 4000, "en"), (4, "End. a;a:a", None), (5, "a\x0bb\x0cc", "")]
    for k in range(160):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        rows.append((k, rng.choice([" ", "  \t", ". ", "\n", "!", ", "]).join(parts), rng.choice(["en", "en", None, "und", "de"])))
    return rows + rows[20:40]


@pytest.mark.parametrize(("max_words", "min_count", "top", "cover"), [(3, 10, 2000, 50), (3, 2, 7, 80), (4, 3, 50, 50), (2, 10, 2000, 50)])
def test_collocations(spark, max_words, min_count, top, cover):
    rows = phrase_rows()
    got = collocations.collocations(docs_of(spark, rows), max_words=max_words, min_count=min_count, top=top, cover=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, max_words, min_count, top, cover)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [(0, None, None)]).limit(0)).count() == 0
    assert collocations.collocations(docs_of(spark, [(0, None, None), (1, "", "en")])).count() == 0
    with pytest.raises(ValueError, match="min_count"):
        collocations.phrase_counts(docs_of(spark, [(0, "a", "en")]), min_count=300)


def test_phrases_are_counted_exactly_beyond_63_bits_of_ids():
    rng = np.random.default_rng(1)
    ids = np.r_[rng.integers(1, 4, 4000), 3_000_000, rng.integers(1, 4, 50)]
    at = np.arange(len(ids) - 4)
    first, counts = collocations._counted(ids, at, 4)
    want = Counter(tuple(ids[i : i + 4]) for i in at)
    assert {tuple(ids[i : i + 4]): c for i, c in zip(first.tolist(), counts.tolist(), strict=True)} == want


def test_bucket_tables_survive_the_way_through_blocks(spark):
    rng = np.random.default_rng(2)
    bits = collocations.LEAST_BITS
    tables = []
    for filled in (300, 1 << 19):  # sparse and dense blocks
        t = np.zeros(1 << bits, np.uint8)
        t[rng.integers(0, 1 << bits, filled)] = rng.integers(1, 11, filled)
        tables.append(t)
    blocks = [tuple(r) for t in tables for r in zip(*(c.to_pylist() for c in collocations._rows(t).columns), strict=True)]
    df = spark.createDataFrame([(b, bytearray(a), bytearray(c)) for b, a, c in blocks], "block int, at binary, counts binary")
    bitmap = collocations._bitmap(df, bits, 10)
    assert (np.unpackbits(bitmap, bitorder="little") == (tables[0].astype(int) + tables[1] >= 10)).all()


# op12 ---------------------------------------------------------------------------


def brute_runs(words, min_exponent=4, min_length=6):
    """Straight from the definition: every stretch with its smallest period that cannot be extended."""
    n, out = len(words), set()
    for q in range(1, n):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s:
                stretch = words[s : e + q]
                smallest = next(p for p in range(1, len(stretch) + 1) if stretch[p:] == stretch[:-p])
                if smallest == q and len(stretch) >= max(min_length, min_exponent * q):
                    out.add((s, len(stretch), q))
            s = e + 1
    return sorted(out)


def run_rows(seed=1):
    rng = random.Random(seed)
    rows = [(0, None, None), (1, "", None), (2, " \n", None), (3, "a", None), (4, "a " * 5, None), (5, "a " * 6, None), (6, "a b " * 4, None), (7, "a b " * 3 + "a", None), (8, "x " * 900, None), (None, "é é é é é é é", None)]
    for k in range(9, 120):
        words = rng.choices("abcde"[: rng.randint(2, 5)], k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choices("abcde", k=rng.randint(1, 6)) * rng.randint(3, 7)
        rows.append((k, rng.choice([" ", "\t", "\r\n", "  "]).join(words), None))
    return rows + rows[30:35] + [rows[8]]


@pytest.mark.parametrize("range_work", [periodic.RANGE_WORK, 60.0])
def test_periodic_runs(spark, range_work):
    rows = run_rows()
    got = periodic.periodic_runs(docs_of(spark, rows), range_work=range_work).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, _ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        runs = brute_runs(words)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, len(words), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in drop)] += 1
    assert Counter((r["id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got) == want
    assert sum(len(k[2]) for k in want) > 60


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 9)])
def test_periodic_runs_of_other_exponents(spark, exponent, least):
    rows = run_rows(5)
    got = periodic.periodic_runs(docs_of(spark, rows), min_exponent=exponent, min_length=least, range_work=500.0).collect()
    want = Counter((i, tuple(brute_runs((text or "").split(), exponent, least))) for i, text, _ in rows)
    assert Counter((r["id"], tuple(tuple(x) for x in r["runs"])) for r in got) == want


def test_lag_ranges_hold_every_lag_once_and_share_the_work():
    for n in (0, 3, 6, 7, 100, 12345):
        for parts in (1, 2, 7, 50):
            b = periodic.lag_bounds(n, parts)
            assert b[0] == 1 and b[-1] == n // 4 + 1 and (np.diff(b) >= 0).all() and len(b) == parts + 1
    b = periodic.lag_bounds(1_000_000, 8)
    work = [sum(1_000_000 - q for q in range(int(s), int(e))) for s, e in zip(b, b[1:], strict=False)]
    assert max(work) < 1.001 * min(work)


def test_periodic_runs_of_nothing(spark):
    assert periodic.periodic_runs(docs_of(spark, [(0, "a", None)]).limit(0)).count() == 0


def test_planted_periods_follow_the_contract(spark):
    import zlib

    from cohortweave.llm.queries import _planted

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))), None) for k in range(300)]
    got = {r["doc_id"]: r["t"].split() for r in docs_of(spark, rows).select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("t")).collect()}
    changed = 0
    for i, text, _ in rows:
        w = text.split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += w != text.split()
        assert got[i] == w
    assert changed > 10


# op13 ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, shard string, score double, block string"


def brute_top(rows, k, every):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for place, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for at, (j, v) in enumerate(usable) if at != place and len(v) == len(q)]
        for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1):
            out[i, rank, None if none else j, -s] += 1
    return out


def vector_rows(seed, n=900, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(k, (centres[k % 12] + 0.2 * rng.normal(size=d)).round(2).tolist()) for k in range(n)]
    same = [0.5] * d
    rows += [(n + k, same) for k in range(n // 2)]  # a third of all rows are copies
    rows += [(5, rows[5][1]), (0, rows[0][1]), (0, rows[0][1]), (-50, rows[3][1]), (None, rows[50][1]), (None, same), (None, None)]
    rows += [(9000, None), (9050, [None] * d), (9100, [float("nan")] * d), (9150, [float("inf")] + [0.0] * (d - 1)), (9200, [0.0] * d), (9250, []), (9251, []), (9300, [1.0, 2.0]), (9301, [3.0, -1.0]), (9350, [1.0] * 3)]
    return rows


@pytest.mark.parametrize(("k", "shard_bytes"), [(5, balltree.SHARD_BYTES), (1, 4000), (12, 4000)])
def test_top_inner_products(spark, k, shard_bytes):
    rows = vector_rows(k)
    df = spark.createDataFrame([(i, v, 1, "clash", 0.0, "clash") for i, v in rows], VECTORS).repartition(3)
    got = balltree.top_inner_products(df, F.col("vec_id") % 50 == 0, k=k, shard_bytes=shard_bytes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, k, 50)


def test_top_inner_products_of_few_and_huge(spark):
    q = F.col("vec_id") % 50 == 0
    few = [(0, [1.0, -2.0]), (1, [0.5, 0.25])]
    big = [(0, [3e6, -2.5e6, 1.0]), (1, [3e6, -2.5e6, 2.0]), (2, [3e6, -2.5e6, 1.5]), (50, [-1e6, 1e6, 0.0])]  # products beyond a double's integers
    for rows in (few, big, few[:1]):
        df = spark.createDataFrame([(i, v, 1, "", 0.0, "") for i, v in rows], VECTORS)
        assert Counter(tuple(r) for r in balltree.top_inner_products(df, q).collect()) == brute_top(rows, 5, 50)
        assert balltree.top_inner_products(df.limit(0), q).count() == 0
        assert balltree.top_inner_products(df, F.lit(False)).count() == 0


def test_branch_and_bound_opens_few_leaves_and_misses_nothing():
    rng = np.random.default_rng(3)
    centres = 100 * rng.normal(size=(40, 8))
    x = np.floor(centres[rng.integers(0, 40, 20000)] + 5 * rng.normal(size=(20000, 8)))
    tree = balltree.BallTree(np.arange(20000), x)
    q = x[:64]
    low, none = np.full(64, np.iinfo(np.int64).min), np.full(64, balltree.NO_ID)
    scores = q @ x.T
    seen = 0
    for i, ids, found in tree.search(q, 6, low, none):
        best = np.lexsort((np.arange(20000), -scores[i]))[:6]
        assert sorted(zip((-found).tolist(), ids.tolist(), strict=True)) == [(-scores[i, j], j) for j in best]
        seen += 1
    assert seen == 64
    bounds = balltree.upper_bounds(q, tree.centre, tree.radius)
    leaves = np.flatnonzero(tree.left == 0)
    kth = np.sort(scores, 1)[:, -6]
    assert (bounds[:, leaves] >= kth[:, None]).mean() < 0.2
    for node in range(len(tree.left)):
        assert (q @ tree.x[tree.lo[node] : tree.hi[node]].T <= bounds[:, [node]]).all()


def test_a_crowd_of_copies_is_cut_short_by_ids():
    x = np.full((5000, 4), 7.0)
    tree = balltree.BallTree(np.arange(100, 5100), x)
    floor, floor_id = np.array([4 * 49]), np.array([50])
    assert list(tree.search(x[:1], 3, floor, floor_id)) == []
    (_, ids, scores), *_ = tree.search(x[:1], 3, np.array([0]), np.array([0]))
    assert sorted(ids.tolist()) == [100, 101, 102] and set(scores.tolist()) == {196}


def test_top_tree_routes_every_row_to_one_leaf():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    nodes = balltree.top_tree(x, 9)
    leaf = balltree.route(nodes, x)
    assert sorted(set(leaf.tolist())) == list(range(9)) and np.bincount(leaf).max() < 1000
    assert (balltree.route(balltree.top_tree(np.ones((50, 3)), 9), np.ones((50, 3))) == 0).all()
