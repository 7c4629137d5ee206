"""Shape of point neighbourhoods at several radii, by a bucketed radius join of blocks of points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_D = ("dx", "dy", "dz")
_SECOND = [(a, b) for k, a in enumerate(_D) for b in _D[k:]]
FEATURES = ["linearity", "planarity", "sphericity", "omnivariance", "anisotropy", "eigenentropy", "surface_variation"]


#: Positions a block holds, about; so many neighbours are met at a time, in stretches of ``LEAF``.
BLOCK, MET, LEAF = 4096, 4096, 64
#: Bits an axis of a place on the Morton curve through a cell; blocks are made of the cells of its first ``COARSE`` bits.
BITS, COARSE = 6, 3


def _curve(top: float) -> Column:
    """Place of ``x, y, z`` on the Morton curve through their cell of edge ``top``."""
    place = F.lit(0)
    for axis, c in enumerate("xyz"):
        v = F.least(F.lit((1 << BITS) - 1), F.floor((F.col(c) / top - F.col(f"c{c}")) * (1 << BITS))).cast("int")
        for bit in range(BITS):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(v, bit).bitwiseAND(F.lit(1)), 3 * bit + axis))
    return place


def blocks(points: DataFrame, top: float, *keys: str) -> DataFrame:
    """``keys, x, y, z, m, cx, cy, cz, curve, block, part``: distinct positions with their counts, in blocks of about ``BLOCK``.

    A block is a stretch of the curve through a cell of edge ``top``; where one of its 512 small cells alone
    holds more, it is dealt out by a hash.  The window runs over counts of small cells, never over points.
    """
    at = points.select(*keys, *(F.col(c).cast("double").alias(c) for c in "xyz")).filter(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    at = at.groupBy(*keys, "x", "y", "z").agg(F.count(F.lit(1)).alias("m"))
    at = at.select("*", *(F.floor(F.col(c) / top).cast("long").alias(f"c{c}") for c in "xyz"))
    at = at.withColumn("curve", _curve(top)).withColumn("small", F.shiftright("curve", 3 * (BITS - COARSE)))
    cell = [*keys, "cx", "cy", "cz"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("small").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = at.groupBy(*cell, "small").agg(F.count(F.lit(1)).alias("n")).select(*cell, "small", F.floor(before / BLOCK).alias("block"), F.ceil(F.col("n") / BLOCK).alias("parts"))
    return at.join(small, [*cell, "small"]).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), "parts")).drop("small", "parts")


def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(p), LEAF)
    return starts, np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)


def _moments(u: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Count, three first and six second moments of each row of ``u``, times its weight."""
    x, y, z = u.T
    return np.stack([np.ones_like(x), x, y, z, x * x, x * y, x * z, y * y, y * z, z * z], 1) * m[:, None]


def _shifted(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Moments ``(..., 10)`` when the offsets they are about grow by ``d``."""
    n, first, out = s[..., :1], s[..., 1:4], s.copy()
    out[..., 1:4] += n * d
    for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), 4):
        out[..., k] += first[..., i] * d[..., j] + first[..., j] * d[..., i] + n[..., 0] * d[..., i] * d[..., j]
    return out


class Neighbourhoods:
    """Moments of the offsets from each position of one block to the neighbours met so far, within each radius.

    Positions are compared stretch by stretch: a stretch of neighbours that lies wholly within a radius gives its sums, one
    wholly outside nothing, and only across a radius' surface are points compared.
    """

    def __init__(self, p: np.ndarray, radii: list[float]) -> None:
        self.p, self.squares = p, [r * r for r in radii]
        self.starts, self.low, self.high = _leaves(p)
        self.centre = (self.low + self.high) / 2
        self.sums = np.zeros((len(p), len(radii), 10))
        self.work = np.empty((MET, LEAF))

    def meet(self, q: np.ndarray, m: np.ndarray) -> None:
        starts, low, high = _leaves(q)
        sizes, middle = np.diff(np.r_[starts, len(q)]), (low + high) / 2
        leaf = np.add.reduceat(_moments(q - np.repeat(middle, sizes, 0), m), starts)
        gap = np.maximum(0, np.maximum(low - self.high[:, None], self.low[:, None] - high))
        near, far = (gap**2).sum(2), (np.maximum(high - self.low[:, None], self.high[:, None] - low) ** 2).sum(2)
        within = np.array([far <= s * (1 - 1e-9) for s in self.squares])
        across = np.array([near <= s * (1 + 1e-9) for s in self.squares]) & ~within
        for k in np.flatnonzero((within | across).any((0, 2))):
            rows, centre = slice(self.starts[k], self.starts[k] + LEAF), self.centre[k]
            if within[:, k].any():
                self.sums[rows] += within[:, k].astype(float) @ _shifted(leaf, middle - centre)
            some = across[:, k].any(0)
            if not some.any():
                continue
            there = np.flatnonzero(np.repeat(some, sizes))
            p, b = self.p[rows], q[there]
            u, v = p - centre, b - centre
            moments = _moments(v, m[there])
            d2 = self.work[: len(b), : len(p)]
            np.matmul(np.column_stack([(v * v).sum(1), np.ones(len(b)), v]), np.column_stack([np.ones(len(p)), (u * u).sum(1), -2 * u]).T, out=d2)
            doubt = 1e-14 * (np.abs(p).max() + np.abs(b).max() + np.abs(centre).max()) ** 2
            for r, s in enumerate(self.squares):
                if across[r, k].any():
                    mine = np.flatnonzero(np.repeat(across[r, k][some], sizes[some]))
                    whole = len(mine) == len(b)
                    inside = self._inside(d2 if whole else d2[mine], s, doubt, p, b if whole else b[mine])
                    self.sums[rows, r] += inside.astype(float).T @ (moments if whole else moments[mine])

    @staticmethod
    def _inside(d2: np.ndarray, s: float, doubt: float, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where squared distances are at most ``s``; those too near it for the product's rounding are summed up as in SQL."""
        out, sure = d2 <= s + doubt, d2 <= s - doubt
        if np.count_nonzero(out) != np.count_nonzero(sure):
            j, i = np.nonzero(out & ~sure)
            x, y, z = (b[j] - p[i]).T
            out[j, i] = x * x + y * y + z * z <= s
        return out

    def about_positions(self) -> np.ndarray:
        """``(positions, radii, 10)``: the sums about each position instead of its stretch's centre."""
        return _shifted(self.sums, (np.repeat(self.centre, LEAF, 0)[: len(self.p)] - self.p)[:, None])


def radius_sums(points: DataFrame, radii: list[float], *keys: str) -> DataFrame:
    """``keys, x, y, z, k, n`` and first and second moments of the offsets of all points within ``radii[k]``, itself included.

    Equal positions are one row with a weight first, and positions form blocks.  Blocks of the 27 cells of the largest
    radius whose boxes come near enough are paired; a block's points then meet the points of its partners, which
    stream by, so that a task holds one block and a batch.
    """
    radii, top = sorted(radii), max(radii)
    at = blocks(points, top, *keys)
    cell, name = ["cx", "cy", "cz"], ["cx", "cy", "cz", "block", "part"]
    box = at.groupBy(*keys, *name).agg(*(f(c).alias(f"{w}{c}") for c in "xyz" for f, w in ((F.min, "low"), (F.max, "high"))))
    here = box.select(*keys, *(F.col(c).alias(f"a_{c}") for c in name), *(F.col(f"{w}{c}").alias(f"{w}{c}2") for c in "xyz" for w in ("low", "high")))
    for c in cell:
        here = here.withColumn(c, F.explode(F.array(*(F.col(f"a_{c}") + s for s in (-1, 0, 1)))))
    gap = [F.greatest(F.lit(0.0), F.col(f"low{c}") - F.col(f"high{c}2"), F.col(f"low{c}2") - F.col(f"high{c}")) for c in "xyz"]
    pairs = here.join(box, [*keys, *cell]).filter(sum((g * g for g in gap), F.lit(0.0)) <= top * top * (1 + 1e-9)).select(*keys, *(f"a_{c}" for c in name), *name)
    own = [f"a_{c}" for c in name]
    met = pairs.join(at, [*keys, *name]).select(*keys, *own, F.lit(1).alias("met"), *name, "curve", "x", "y", "z", "m")
    self_ = at.select(*keys, *(F.col(c).alias(f"a_{c}") for c in name), F.lit(0).alias("met"), *name, "curve", "x", "y", "z", "m")
    spark = points.sparkSession
    # a stated number of partitions: rows are few and long to work on, and would be put together into one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12 * spark.sparkContext.defaultParallelism)
    rows = self_.union(met).repartition(tasks, *keys, *own).sortWithinPartitions(*keys, *own, "met", *name, "curve")
    named = [*keys, *own]
    seconds = [a + b for a, b in _SECOND]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own_rows, found = None, [], None

        def done() -> pd.DataFrame:
            p = np.concatenate(own_rows)
            s = (found or Neighbourhoods(p, radii)).about_positions()
            out = pd.DataFrame({k: [v] * s.shape[0] * s.shape[1] for k, v in zip(keys, at, strict=False)})
            for c, v in zip("xyz", p.T, strict=True):
                out[c] = np.repeat(v, len(radii))
            out["k"] = np.tile(np.arange(len(radii), dtype=np.int32), len(p))
            flat = s.reshape(-1, 10)
            out["n"] = np.rint(flat[:, 0]).astype(np.int64)
            for c, v in zip((*_D, *seconds), flat.T[1:], strict=True):
                out[c] = v
            return out

        for b in batches:
            if b.empty:
                continue
            new = (b[named] != b[named].shift()).any(axis=1).to_numpy() | (b["met"] != b["met"].shift()).to_numpy()
            cuts = np.flatnonzero(new)
            xyz, m = b[["x", "y", "z"]].to_numpy(float), b["m"].to_numpy(float)
            for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
                first = b.iloc[lo]
                name = tuple(first[c] for c in named)
                if name != at:
                    if at is not None:
                        yield done()
                    at, own_rows, found = name, [], None
                if first["met"] == 0:
                    own_rows.append(xyz[lo:hi])
                    continue
                found = found or Neighbourhoods(np.concatenate(own_rows), radii)
                for k in range(lo, hi, MET):
                    found.meet(xyz[k : min(hi, k + MET)], m[k : min(hi, k + MET)])
        if at is not None:
            yield done()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, y double, z double, k int, n long", *(f"{c} double" for c in (*_D, *seconds))]))


def symmetric_eigenvalues(a: dict[str, Column]) -> list[Column]:
    """The eigenvalues of a symmetric 3 x 3 matrix (entries xx, xy, xz, yy, yz, zz), largest first, not below 0."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3
    b = {k: a[k] - q if k in ("xx", "yy", "zz") else a[k] for k in a}
    p2 = b["xx"] * b["xx"] + b["yy"] * b["yy"] + b["zz"] * b["zz"] + 2 * (a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"])
    p = F.sqrt(p2 / 6)
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(1.0))))) / 3
    first = q + 2 * p * F.cos(angle)
    last = q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return [F.greatest(v, F.lit(0.0)) for v in (first, 3 * q - first - last, last)]


def multiscale_eigenfeatures(points: DataFrame, radii: list[float], *keys: str, id_col: str = "id", least: int = 6) -> DataFrame:
    """``keys, id, radius, n, l1, l2, l3`` and the seven shape features of every point's neighbourhood at each radius.

    Null for neighbourhoods of fewer than ``least`` points or without extent.  ``keys`` part independent surfaces;
    points with a null coordinate take no part.
    """
    radii = sorted(radii)
    clean = points.dropna(subset=["x", "y", "z"])
    s = radius_sums(clean, radii, *keys)
    mean = {c: F.col(f"d{c}") / F.col("n") for c in "xyz"}
    cov = {a[1] + b[1]: F.col(a + b) / F.col("n") - mean[a[1]] * mean[b[1]] for a, b in _SECOND}
    s = s.select(*keys, "x", "y", "z", "n", F.element_at(F.array(*map(F.lit, radii)), F.col("k") + 1).alias("radius"), *(v.alias(k) for k, v in cov.items()))
    enough = F.col("n") >= least
    values = symmetric_eigenvalues({k: F.col(k) for k in cov})
    s = s.select(*keys, "x", "y", "z", "n", "radius", *(F.when(enough, v).alias(f"l{k}") for k, v in enumerate(values, 1)))
    l1, l2, l3 = (F.col(f"l{k}") for k in (1, 2, 3))
    total = l1 + l2 + l3
    entropy = sum((F.when(v / total > 1e-12, -(v / total) * F.log(v / total)).otherwise(0.0) for v in (l1, l2, l3)), F.lit(0.0))
    made = [(l1 - l2) / l1, (l2 - l3) / l1, l3 / l1, F.cbrt(l1 * l2 * l3), (l1 - l3) / l1, entropy, l3 / total]
    s = s.select(*keys, "x", "y", "z", "radius", "n", "l1", "l2", "l3", *(F.when(l1 >= 1e-12, v).alias(n) for n, v in zip(FEATURES, made, strict=True)))
    own = clean.select(*keys, F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return own.join(s, [*keys, "x", "y", "z"]).drop("x", "y", "z")
