"""Quality rules: base counts and robust multivariate outliers, DataFrame functions only.

Each text gives four counts.  Two fixed rules reject on them.  Beyond these, the
counts become a vector of shares, pulled towards the usual value for short texts and
transformed; for each language and source the minimum covariance determinant's
location and scatter are estimated: from several deterministic starts (medians
with quartile scales; the plain mean and covariance; the correlation of values
squeezed by tanh) concentration steps take the mean and covariance of the
``KEEP`` share of rows nearest to the last estimate.  After ``FIRST_STEPS`` the start
of least determinant goes on until its determinant falls no more.  All are
aggregates: the distance that bounds the nearest share is read off a histogram of
distances, so no group is ever sorted or gathered in one task.

The scatter is multiplied by the factor that makes it consistent for normal vectors
and regularised by least variances on the diagonal, as most clean documents have no
symbol or repeat at all.  Rows with a squared Mahalanobis distance beyond ``CUTOFF``
are rejected.

Groups of under ``MIN_ROWS`` rows use their language's estimate, and small
languages that of all rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import drop_stored, stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_ROWS = 200
FIRST_STEPS = 2
#: Steps end when no determinant falls by this share any more; a group needs about ten, and MOST_STEPS raises.
SETTLED, MOST_STEPS = 1e-3, 60
KEEP = 0.75
#: KEEP over the chance of a chi-square with 6 degrees under the KEEP quantile of one with 4 (5.385): for normal vectors the scatter of the nearest share, so often, is that of all.
CONSISTENCY = 0.75 / (1 - math.exp(-5.385 / 2) * (1 + 5.385 / 2 + (5.385 / 2) ** 2 / 2))
#: Least variances; statistics that hardly vary in clean text (no symbol, no repeat) need a scale.
FLOOR = (0.05**2, 0.08**2, 0.1**2, 0.1**2)
#: Squared distance: the quantile 1 - 1e-5 of chi-square with 4 degrees, since texts' tails are heavier than normal ones.
CUTOFF = 28.5
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Groups whose estimates may be broadcast (about 500 bytes each); more are joined by salted keys.
BROADCAST_GROUPS = 20_000
SALTS = 64


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once a row, also where a lambda reads it for each element."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in ``WINDOW``-word windows that are found twice or more.

    Windows are hashed and sorted with their places; equal neighbours mark repeated
    windows, and the words they cover are counted from the gaps between their places.
    """

    def windows(w: Column) -> Column:
        last = F.size(w) - WINDOW + 1
        hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(F.slice(w, i, F.lit(WINDOW))).alias("h"), i.alias("i")))
        return F.when(last < 2, F.lit(0)).otherwise(_let(F.array_sort(hashed), repeated))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
            lambda v: v.isNotNull(),
        )
        return _let(F.array_sort(same), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    return _let(words, windows)


def base_counts(text: Column) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of a whole text; null: of an empty one."""

    def of(t: Column) -> Column:
        flat = F.translate(t, SPACES, " " * len(SPACES))
        bare = F.translate(t, SPACES, "")
        words = F.array_remove(F.split(flat, " "), "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

        def counts(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(bare).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            )

        return _let(words, counts)

    return _let(F.coalesce(text, F.lit("")), of)


def base_failed(c: Column) -> Column:
    """The fixed rules: under 20 words, or over 30 % of the words in repeated windows."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def statistics(c: Column) -> list[Column]:
    """The transformed statistic vector: word length, symbols, repeated lines and repeated words, pulled in for short texts."""
    n = c["n_words"].cast("double")
    return [
        F.log((c["word_chars"] + 5.5 * 100) / (n + 100)).alias("f_length"),
        F.sqrt(c["n_symbols"] / (n + 30)).alias("f_symbols"),
        F.sqrt(c["n_dup_lines"] * 10 / (n + 50)).alias("f_lines"),
        F.sqrt(c["n_repeat_words"] / (n + 50)).alias("f_repeats"),
    ]


# ------------------------------------------------------ small matrices as columns


def _with_inverse(params: DataFrame, d: int) -> DataFrame:
    """Add the rows of the inverse Cholesky factor, step by step so that no expression grows."""
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"s{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            params = params.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    return params


def _square(diffs: list[Column], factor: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance of the differences, by forward substitution with the Cholesky factor."""
    d = len(diffs)

    def solve(i: int, z: list[Column]) -> Column:
        if i == d:
            return reduce(lambda a, b: a + b, [x * x for x in z])
        rest = diffs[i]
        for k in range(i):
            rest = rest - factor[i, k] * z[k]
        return _let(rest / factor[i, i], lambda x: solve(i + 1, [*z, x]))

    return solve(0, [])


D = len(FEATURES)
_CELLS = [(i, j) for i in range(D) for j in range(i + 1)]
_NAMES = [*[f"m{i}" for i in range(D)], *[f"s{i}_{j}" for i, j in _CELLS], *[f"l{i}_{j}" for i, j in _CELLS]]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that has its group's estimate."""
    return _square([F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)], {c: F.col(f"l{c[0]}_{c[1]}") for c in _CELLS})


def _with_determinant(params: DataFrame) -> DataFrame:
    return params.withColumn("logdet", reduce(lambda a, b: a + b, [2 * F.log(f"l{i}_{i}") for i in range(D)]))


def _moments(rows: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Means and covariances times ``factor`` with the least variances added to the diagonal: the scatter stays invertible where a statistic is constant."""
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    cross = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in _CELLS]
    got = rows.groupBy(*keys).agg(*means, *cross)
    cells = [(F.coalesce(F.col(f"c{i}_{j}"), F.lit(0.0)) * factor + (FLOOR[i] if i == j else 0.0)).alias(f"s{i}_{j}") for i, j in _CELLS]
    return _with_inverse(got.select(*keys, *[f"m{i}" for i in range(D)], *cells), D)


def _attached(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with their keys' columns of a small table: broadcast, or where it has too many keys by a join on salted keys, so that a key with most rows is many tasks."""
    if few:
        return rows.join(F.broadcast(table), keys)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, [*keys, "salt"]).drop("salt")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """``level, key, start`` and an estimate: three first ones for each group."""
    keys = ["level", "key"]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.round(F.col(c) * 200).cast("int").alias("b")) for i, c in enumerate(FEATURES)]))
    bins = stored(rows.select(*keys, cells.alias("x")).groupBy(*keys, "x.f", "x.b").agg(F.count(F.lit(1)).alias("n")), "bins")
    shares = [_at_share(bins, [*keys, "f"], q).select(*keys, "f", (F.col("b") / 200).alias("v"), F.lit(q).alias("q")) for q in (0.25, 0.5, 0.75)]
    at = lambda i, q: F.max(F.when((F.col("f") == i) & (F.col("q") == q), F.col("v")))
    scale = lambda i: F.greatest((at(i, 0.75) - at(i, 0.25)) / 1.349, F.lit(math.sqrt(FLOOR[i])))
    middle = reduce(DataFrame.unionByName, shares).groupBy(*keys).agg(*[at(i, 0.5).alias(f"m{i}") for i in range(D)], *[scale(i).alias(f"q{i}") for i in range(D)])
    middle = stored(middle, "middle")
    drop_stored(bins)
    means = [f"m{i}" for i in range(D)]
    diagonal = middle.select(*keys, *means, *[(F.col(f"q{i}") * F.col(f"q{i}") if i == j else F.lit(0.0)).alias(f"s{i}_{j}") for i, j in _CELLS])
    squeezed = [F.tanh((F.col(f) - F.col(f"m{i}")) / F.col(f"q{i}")).alias(f"z{i}") for i, f in enumerate(FEATURES)]
    related = _attached(rows, middle, keys, few).select(*keys, *squeezed).groupBy(*keys).agg(*[(F.covar_pop(f"z{i}", f"z{j}") / (F.stddev_pop(f"z{i}") * F.stddev_pop(f"z{j}") + 1e-9)).alias(f"c{i}_{j}") for i, j in _CELLS if i != j])
    tanh = middle.join(related, keys).select(*keys, *means, *[(F.col(f"q{i}") * F.col(f"q{j}") * (1.0 if i == j else F.col(f"c{i}_{j}"))).alias(f"s{i}_{j}") for i, j in _CELLS])
    plain = _moments(rows, keys).select(*diagonal.columns)
    return reduce(DataFrame.unionByName, [_with_inverse(x, D).withColumn("start", F.lit(k)) for k, x in enumerate((diagonal, plain, tanh))])


def robust_estimates(rows: DataFrame, keep: float = KEEP) -> DataFrame:
    """Location ``m*``, scatter ``s*``, its factor ``l*`` and ``logdet`` of each ``level, key`` of ``rows`` (with the statistics as columns).

    The least determinant over three starts and all concentration steps; steps go on
    until no group's determinant falls by ``SETTLED`` of itself.
    """
    keys, each = ["level", "key"], ["level", "key", "start"]
    few = rows.select(*keys).distinct().count() <= BROADCAST_GROUPS

    def step(params: DataFrame) -> DataFrame:
        near = _attached(rows, params, keys, few).select(*each, *FEATURES, F.least(F.log1p(_distance()) * 100, F.lit(3000)).cast("int").alias("b"))
        limit = _at_share(near.groupBy(*each, "b").agg(F.count(F.lit(1)).alias("n")), each, keep).withColumnRenamed("b", "top")
        chosen = _attached(near, limit, each, few).filter("b <= top")
        return stored(_with_determinant(_moments(chosen, each, CONSISTENCY)), "estimates")

    now = stored(_starts(rows, few), "starts")
    for _ in range(FIRST_STEPS):
        now = step(now)
    least = F.min_by(F.struct("start", *_NAMES, "logdet"), F.struct("logdet", "start")).alias("e")
    best = stored(now.groupBy(*keys).agg(least).select(*keys, "e.*"), "best")
    for _ in range(MOST_STEPS):
        after = step(best)
        old = best.select(*keys, F.col("logdet").alias("before"))
        gain = after.join(old, keys).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        best = stored(best.unionByName(after).groupBy(*keys).agg(least).select(*keys, "e.*"), "best")
        if gain is None or gain < SETTLED:
            return best
    raise RuntimeError("concentration steps did not settle")


def _at_share(hist: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin at which ``share`` of each group's rows is reached, from ``keys, b, n``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    run = hist.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    return run.filter(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("b").alias("b"))


def judged(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with a struct column ``out``: the base counts, ``base_failed``, ``d2`` and ``kept``.

    Null languages and sources are groups of their own; null and empty texts fail the
    base rules; repeated rows are judged alike; columns of any other name pass through
    untouched; an empty table gives an empty table.
    """
    lang, source = F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")), F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    mine = "__quality_row"
    row = F.struct(base_counts(F.col(text_col).cast("string")).alias("c"), F.concat_ws("\x01", lang, source).alias("group"), lang.alias("lang"))
    # texts are counted once: what is carried lies beside its counts
    whole = stored(df.select(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)], row.alias(mine)), "counts")
    narrow = whole.select(F.col(mine).alias("r")).select("r.c", "r.group", "r.lang")
    return _verdict(whole, narrow.select("group", "lang", base_failed(F.col("c")).alias("bad"), *statistics(F.col("c"))), mine, out)


def _verdict(whole: DataFrame, narrow: DataFrame, mine: str, out: str) -> DataFrame:
    good = narrow.filter(~F.col("bad"))
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("group").alias("key")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("key")), F.struct(F.lit(2).alias("level"), F.lit("").alias("key")))
    groups = stored(narrow.groupBy("group", "lang").agg(F.count_if(~F.col("bad")).alias("n")), "groups")
    own = groups.select("group", "n", F.explode(levels).alias("x")).select("group", "n", "x.level", "x.key")
    size = own.groupBy("level", "key").agg(F.sum("n").alias("n"))
    usable = size.filter((F.col("n") >= MIN_ROWS) | (F.col("level") == 2)).select("level", "key")
    # each group's estimate is that of its first usable level: only those are made
    used = stored(own.join(usable, ["level", "key"]).groupBy("group").agg(F.min_by(F.struct("level", "key"), "level").alias("x")).select("group", "x.level", "x.key"), "used")
    wanted = stored(used.select("level", "key").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_GROUPS
    rows = good.select(*FEATURES, F.explode(levels).alias("x")).select("x.level", "x.key", *FEATURES)
    rows = stored(_attached(rows, wanted, ["level", "key"], few).select("level", "key", *FEATURES), "levels")
    params = robust_estimates(rows)
    prefixed = used.join(params, ["level", "key"]).select(F.col("group").alias("__quality_group"), F.struct(*_NAMES).alias("__quality_estimate"))
    prefixed = stored(prefixed, "per-group")
    drop_stored(rows)
    cond = F.col(f"{mine}.group") == F.col("__quality_group")
    if prefixed.count() <= BROADCAST_GROUPS:
        joined = whole.join(F.broadcast(prefixed), cond, "left")
    else:
        salted = prefixed.withColumn("__quality_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*[F.col(f"{mine}.c.{k}") for k in ("n_words", "word_chars", "n_symbols")]), F.lit(SALTS)).cast("int")
        joined = whole.join(salted, cond & (salt == F.col("__quality_salt")), "left")
    columns = [c for c in whole.columns if c != mine]
    c, e = F.col(f"{mine}.c"), F.col("__quality_estimate")
    factor = {(i, j): e[f"l{i}_{j}"] for i, j in _CELLS}
    d2 = _let(F.struct(*statistics(c)), lambda f: _square([f[k] - e[f"m{i}"] for i, k in enumerate(FEATURES)], factor))
    failed, distance = base_failed(c), F.coalesce(d2, F.lit(0.0))
    result = F.struct(*[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), distance.alias("d2"), (~failed & (distance <= CUTOFF)).alias("kept"))
    return joined.select(*[F.col(f"`{k}`") for k in columns], result.alias(out))
