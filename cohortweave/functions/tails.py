"""Heavy-tailed families on whole numbers, fitted by Newton steps over value counts, and Vuong's comparison of two fits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_HEAD = 1000  # terms of a normalising sum that are added one by one
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_FAR = 60.0  # the rest is an integral over this many powers of e


def _log_normaliser(log_f: Callable[[np.ndarray], np.ndarray], xmin: int) -> float:
    """ln of the sum of f over the whole numbers from ``xmin`` on: a head term by term, the rest as an integral."""
    head = log_f(np.arange(xmin, xmin + _HEAD, dtype=float))
    u = (_NODES + 1) * _FAR / 2
    x = (xmin + _HEAD - 0.5) * np.exp(u)
    rest = log_f(x) + np.log(x) + np.log(_WEIGHTS * _FAR / 2)
    every = np.concatenate([head, rest])
    top = every.max()
    return float(top + np.log(np.exp(every - top).sum()))


#: ln f of each family and where a search starts, of free parameters (logarithms where a parameter is positive).
FAMILIES: dict[str, tuple[Callable, Callable]] = {
    "power_law": (lambda p, x: -(1 + np.exp(p[0])) * np.log(x), lambda x, c, m: [math.log(max(0.05, c.sum() / (c @ np.log(x / (m - 0.5)))))]),
    "exponential": (lambda p, x: -np.exp(p[0]) * x, lambda x, c, m: [math.log(1 / max(0.5, c @ x / c.sum() - m + 0.5))]),
    "lognormal": (lambda p, x: -np.log(x) - (np.log(x) - p[0]) ** 2 / (2 * np.exp(2 * p[1])), lambda x, c, m: [c @ np.log(x) / c.sum(), math.log(max(0.3, math.sqrt(c @ (np.log(x) - c @ np.log(x) / c.sum()) ** 2 / c.sum())))]),
    "truncated_power_law": (lambda p, x: -p[0] * np.log(x) - np.exp(p[1]) * x, lambda x, c, m: [1.0, math.log(0.3 / max(1.0, c @ x / c.sum()))]),
}
#: A search keeps its parameters within these bounds: what lies beyond is a limit of the family.
_BOUNDS = {"power_law": [(-3.0, 3.0)], "exponential": [(-25.0, 4.0)], "lognormal": [(-30.0, 30.0), (-3.0, 3.0)], "truncated_power_law": [(-5.0, 20.0), (-25.0, 3.0)]}


def log_likelihoods(family: str, p: np.ndarray, x: np.ndarray, xmin: int) -> np.ndarray:
    """ln of the probability of each value."""
    log_f = FAMILIES[family][0]
    return log_f(p, x) - _log_normaliser(lambda v: log_f(p, v), xmin)


def fit(family: str, x: np.ndarray, counts: np.ndarray, xmin: int, steps: int = 200) -> tuple[np.ndarray, float]:
    """The parameters of the largest likelihood of distinct values and their counts, and its logarithm."""
    low, high = np.array(_BOUNDS[family]).T
    p = np.clip(np.array(FAMILIES[family][1](x, counts, xmin), float), low, high)
    value = lambda q: float(counts @ log_likelihoods(family, q, x, xmin))
    now, n, h = value(p), len(p), 1e-4
    for _ in range(steps):
        eye = np.eye(n) * h
        up, down = np.array([value(p + e) for e in eye]), np.array([value(p - e) for e in eye])
        slope = (up - down) / (2 * h)
        bend = np.diag((up - 2 * now + down) / h**2)
        for i in range(n):
            for j in range(i):
                bend[i, j] = bend[j, i] = (value(p + eye[i] + eye[j]) - value(p + eye[i] - eye[j]) - value(p - eye[i] + eye[j]) + value(p - eye[i] - eye[j])) / (4 * h * h)
        val, vec = np.linalg.eigh(-bend)
        step = vec @ ((vec.T @ slope) / np.maximum(np.abs(val), 1e-8 * max(1.0, float(np.abs(val).max()))))
        size = 1.0
        while size > 1e-8:
            new = np.clip(p + size * step, low, high)
            got = value(new)
            if got > now:
                break
            size /= 2
        else:
            break
        done = got - now < 1e-9 * max(1.0, abs(now))
        p, now = new, got
        if done:
            break
    return p, now


def compare(x: np.ndarray, counts: np.ndarray, xmin: int, other: str) -> tuple[float, float]:
    """Vuong's normalised ratio of the power law's to another family's likelihood (positive: the power law), and its p.

    The truncated power law holds the power law as a limit, so its p is that of twice the ratio under chi square with one degree.
    """
    n = counts.sum()
    first, second = fit("power_law", x, counts, xmin)[0], fit(other, x, counts, xmin)[0]
    d = log_likelihoods("power_law", first, x, xmin) - log_likelihoods(other, second, x, xmin)
    total = float(counts @ d)
    spread = math.sqrt(max(0.0, float(counts @ (d - total / n) ** 2) / n))
    ratio = total / (spread * math.sqrt(n)) if spread > 0 else 0.0
    if other == "truncated_power_law":
        return ratio, math.erfc(math.sqrt(max(0.0, -total)))
    return ratio, math.erfc(abs(ratio) / math.sqrt(2)) if spread > 0 else 1.0
