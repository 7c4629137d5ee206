"""Numpy kernels on one series or one matrix each; used through grouped Arrow functions."""

from __future__ import annotations

import math

import numpy as np


def detrended(x: np.ndarray) -> np.ndarray:
    """``x`` without its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(t @ t, 1e-300)


def band_amplitudes(x: np.ndarray, dt: float, low: float, high: float) -> tuple[float, float]:
    """ALFF and fALFF: the root mean power in the band (both ends in), and over that of all frequencies."""
    power = np.abs(np.fft.rfft(detrended(x))) ** 2
    f = np.fft.rfftfreq(len(x), dt)
    band = power[(f >= low) & (f <= high)]
    if not len(band):
        return math.nan, math.nan
    whole = math.sqrt(power.mean())
    alff = math.sqrt(band.mean())
    return alff, alff / whole if whole > 0 else 0.0


def welch(x: np.ndarray, dt: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density: Hann windows of ``width``, half overlapping, mean removed."""
    width = min(width, len(x))
    win = np.hanning(width + 1)[:-1]
    starts = range(0, len(x) - width + 1, max(1, width // 2))
    p = np.mean([np.abs(np.fft.rfft((x[s : s + width] - x[s : s + width].mean()) * win)) ** 2 for s in starts], axis=0)
    p *= 2 * dt / (win**2).sum()
    p[0] /= 2
    if width % 2 == 0:
        p[-1] /= 2
    return np.fft.rfftfreq(width, dt), p


def butterworth(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections ``(order, 6)`` of the digital Butterworth band-pass, by the bilinear transform of the analogue poles."""
    warped = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))  # left half plane
    half = unit * width / 2
    poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
    z = (2 * rate + poles) / (2 * rate - poles)
    real = np.sort(z[np.abs(z.imag) < 1e-12].real)  # a wide band's middle pole is two real ones
    ends = [(2 * p.real, abs(p) ** 2) for p in z[z.imag >= 1e-12]] + [(p + q, p * q) for p, q in real.reshape(-1, 2)]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -total, product] for total, product in ends])
    at = np.exp(2j * math.atan(centre / (2 * rate)))  # where the gain is 1
    gain = abs(np.prod([(s[0] + s[1] / at + s[2] / at**2) / (s[3] + s[4] / at + s[5] / at**2) for s in sections]))
    sections[0, :3] /= gain
    return sections


def _filtered(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sections one after another, begun in the steady state of the first value."""
    for b0, b1, b2, _, a1, a2 in sections:
        whole = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = (whole - b0) * x[0], (b2 - a2 * whole) * x[0]
        y = np.empty(len(x))
        for t, v in enumerate(x.tolist()):
            out = b0 * v + z1
            z1, z2 = b1 * v - a1 * out + z2, b2 * v - a2 * out
            y[t] = out
        x = y
    return x


def bandpass(x: np.ndarray, dt: float, low: float, high: float, order: int = 5) -> np.ndarray:
    """Butterworth band-pass run forwards and back: no phase shift.  The ends are continued by turning the series about them."""
    sections = butterworth(order, low, high, 1 / dt)
    pad = min(6 * order + 3, len(x) - 1)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    there = _filtered(sections, long)
    return _filtered(sections, there[::-1])[::-1][pad : pad + len(x)]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def instantaneous_frequency(x: np.ndarray, dt: float) -> float:
    """Mean rate of the analytic signal's phase, in cycles."""
    return float(np.diff(np.unwrap(np.angle(analytic(x - x.mean())))).mean() / (2 * math.pi * dt))


def fluctuations(x: np.ndarray, q: float = 2.0, n_scales: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Scales and q-th order fluctuations of the profile; segments are cut from both ends."""
    n = len(x)
    scales = np.unique(np.logspace(math.log10(4), math.log10(max(5, n / 4)), n_scales).astype(int))
    scales = scales[(scales >= 4) & (scales <= n // 2)]
    y = np.cumsum(x - x.mean())
    out = []
    for s in scales:
        k = n // s
        seg = np.concatenate([y[: k * s].reshape(k, s), y[n - k * s :].reshape(k, s)])
        t = np.arange(s) - (s - 1) / 2
        c = seg - seg.mean(1, keepdims=True)
        res = c - np.outer(c @ t / (t @ t), t)
        v = (res**2).mean(1)
        out.append(math.exp(0.5 * np.log(np.maximum(v, 1e-300)).mean()) if q == 0 else (v ** (q / 2)).mean() ** (1 / q))
    return scales, np.array(out)


def scaling_exponent(x: np.ndarray, q: float = 2.0) -> float:
    """Slope of log10 fluctuation on log10 scale; NaN for under 16 values, under 3 scales or no fluctuation."""
    if len(x) < 16:
        return math.nan
    s, f = fluctuations(x, q)
    ok = f > 1e-12
    return float(np.polyfit(np.log10(s[ok]), np.log10(f[ok]), 1)[0]) if ok.sum() >= 3 else math.nan


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the share of pairs of templates within r deviations (<=) that stay so one value longer."""
    n, tol = len(x), r * x.std()
    if n <= m + 1 or tol == 0:
        return math.nan

    def pairs(k: int) -> int:
        v = np.lib.stride_tricks.sliding_window_view(x, k)[: n - m]
        return sum(int((np.abs(v[i + 1 :] - v[i]).max(1) <= tol).sum()) for i in range(len(v) - 1))

    b, a = pairs(m), pairs(m + 1)
    return -math.log(a / b) if a and b else math.nan


def lempel_ziv(x: np.ndarray) -> float:
    """Normalised LZ76 complexity of the series binarised at its median: (1 + whole phrases) * log2(n) / n.

    An unfinished phrase at the end does not count; the count begins with 1.
    """
    s = "".join(np.where(x > np.median(x), "1", "0")) if len(x) else ""
    n, at, phrases = len(s), 0, 1
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        if at + size > n:
            break
        phrases += 1
        at += size
    return phrases * math.log2(n) / n if n > 1 else float(phrases)


def spectral_entropy(x: np.ndarray) -> float:
    """Entropy of the power spectrum without its mean, over its largest possible value."""
    p = np.abs(np.fft.rfft(x - x.mean())[1:]) ** 2
    if p.sum() <= 0:
        return 0.0
    p = p / p.sum()
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / math.log2(max(2, len(x) // 2)))


def phase_surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series of the same power spectrum with random phases."""
    s = np.fft.rfft(x)
    phase = rng.uniform(0, 2 * math.pi, len(s))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(np.abs(s) * np.exp(1j * (phase + (np.angle(s[0]) if len(s) else 0) * (np.arange(len(s)) == 0))), len(x))


def amplitude_adjusted(x: np.ndarray, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Iterated amplitude-adjusted surrogate: the values of ``x`` with nearly its spectrum."""
    ordered, target = np.sort(x), np.abs(np.fft.rfft(x))
    y = rng.permutation(x)
    for _ in range(rounds):
        s = np.fft.rfft(y)
        y = np.fft.irfft(target * np.exp(1j * np.angle(s)), len(x))
        y = ordered[np.argsort(np.argsort(y))]
    return y


def kendall_w(rows: np.ndarray) -> float:
    """Kendall's coefficient of concordance of k series (rows) of n values, ranks without tie correction."""
    k, n = rows.shape
    ranks = np.argsort(np.argsort(rows, 1, kind="stable"), 1, kind="stable") + 1
    total = ranks.sum(0)
    return float(12 * ((total - total.mean()) ** 2).sum() / (k * k * (n**3 - n))) if n > 1 else math.nan
