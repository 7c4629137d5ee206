"""Numpy kernels on dense symmetric matrices (one graph each)."""

from __future__ import annotations

import math

import numpy as np


def dense(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node names and the symmetric weight matrix of edges."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a = np.zeros((len(nodes), len(nodes)))
    k = len(i)
    a[flat[:k], flat[k:]] = w
    return nodes, np.maximum(a, a.T) if (w >= 0).all() else a + a.T


def distances(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """All shortest path lengths: hops, or sums of 1 / weight; infinite where there is no path."""
    d = np.where(w > 0, 1 / np.where(w > 0, w, 1) if weighted else 1.0, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        np.minimum(d, d[:, k : k + 1] + d[k], out=d)
    return d


def efficiency(w: np.ndarray, weighted: bool = False) -> float:
    """Mean inverse path length over ordered pairs."""
    n = len(w)
    if n < 2:
        return 0.0
    d = distances(w, weighted)
    return float((1 / d[~np.eye(n, dtype=bool)]).sum() / (n * (n - 1)))


def local_efficiency(w: np.ndarray) -> np.ndarray:
    """Efficiency of the graph among each node's neighbours."""
    return np.array([efficiency(w[np.ix_(k, k)]) for k in (np.flatnonzero(row > 0) for row in w)])


def betweenness(w: np.ndarray) -> np.ndarray:
    """Share of shortest hop paths through each node, over the pairs of others."""
    n, out = len(w), np.zeros(len(w))
    near = [np.flatnonzero(r > 0) for r in w]
    for s in range(n):
        order, paths, dist = [], np.zeros(n), np.full(n, -1)
        before: list[list[int]] = [[] for _ in range(n)]
        paths[s], dist[s], queue = 1, 0, [s]
        for v in queue:
            order.append(v)
            for u in near[v]:
                if dist[u] < 0:
                    dist[u] = dist[v] + 1
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        part = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                part[u] += paths[u] / paths[v] * (1 + part[v])
            if v != s:
                out[v] += part[v]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def closeness(w: np.ndarray) -> np.ndarray:
    """(reached - 1) / total hops, scaled by the share of nodes reached."""
    d = distances(w)
    reach = np.isfinite(d).sum(1)
    total = np.where(np.isfinite(d), d, 0).sum(1)
    return np.where(total > 0, (reach - 1) / np.where(total > 0, total, 1) * (reach - 1) / max(len(w) - 1, 1), 0.0)


def pagerank(w: np.ndarray, damping: float = 0.85) -> np.ndarray:
    """Stationary share of a walker along the weights that jumps with probability 1 - damping."""
    n, s = len(w), w.sum(1)
    p = np.where(s[:, None] > 0, w / np.where(s > 0, s, 1)[:, None], 1 / n)
    x = np.full(n, 1 / n)
    for _ in range(200):
        y = (1 - damping) / n + damping * x @ p
        if np.abs(y - x).sum() < 1e-12:
            break
        x = y
    return x


def modularity(w: np.ndarray, c: np.ndarray, gamma: float = 1.0) -> float:
    """Newman's Q of a partition."""
    m, k = w.sum(), w.sum(1)
    return float(((w - gamma * np.outer(k, k) / m) * (c[:, None] == c[None, :])).sum() / m) if m else 0.0


def louvain(w: np.ndarray, rng: np.random.Generator, gamma: float = 1.0) -> np.ndarray:
    """Communities by greedy moves and aggregation until no move raises Q; numbered from 0 by first node."""
    label = np.arange(len(w))
    a = w.astype(float).copy()
    while True:
        n, m, k = len(a), a.sum(), a.sum(1)
        c = np.arange(n)
        tot = k.copy()
        moved_any = False
        moved = m > 0
        while moved:
            moved = False
            for v in rng.permutation(n):
                to = np.bincount(c, a[v], n)
                to[c[v]] -= a[v, v]
                tot[c[v]] -= k[v]
                gain = to - gamma * k[v] * tot / m
                best = int(gain.argmax())
                if gain[best] <= gain[c[v]] + 1e-12:
                    best = c[v]
                tot[best] += k[v]
                if best != c[v]:
                    c[v], moved, moved_any = best, True, True
        names, c = np.unique(c, return_inverse=True)
        label = c[label]
        if not moved_any or len(names) == n:
            break
        hot = np.eye(len(names))[c]
        a = hot.T @ a @ hot
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def consensus(w: np.ndarray, seed: int, runs: int = 20, tau: float = 0.5, rounds: int = 10) -> np.ndarray:
    """Louvain on the thresholded agreement of runs, repeated until all runs agree."""
    rng, a = np.random.default_rng(seed), w
    for _ in range(rounds):
        parts = np.array([louvain(a, rng) for _ in range(runs)])
        agree = (parts[:, :, None] == parts[:, None, :]).mean(0)
        np.fill_diagonal(agree, 0)
        if np.isin(agree, (0, 1)).all():
            break
        a = np.where(agree >= tau, agree, 0)
    return parts[0]


def rewired(w: np.ndarray, rng: np.random.Generator, swaps_per_edge: int = 5) -> np.ndarray:
    """A random graph of the same degrees: double edge swaps that make neither loops nor double edges."""
    a = w.copy()
    e = np.argwhere(np.triu(a > 0, 1))
    for _ in range(swaps_per_edge * len(e)):
        x, y = rng.integers(len(e), size=2)
        (p, q), (r, s) = e[x], e[y]
        if rng.random() < 0.5:
            r, s = s, r
        if len({p, q, r, s}) < 4 or a[p, s] or a[r, q]:
            continue
        one, two = a[p, q], a[r, s]
        a[p, q] = a[q, p] = a[r, s] = a[s, r] = 0
        a[p, s] = a[s, p] = one
        a[r, q] = a[q, r] = two
        e[x], e[y] = (p, s), (r, q)
    return a


def clustering(w: np.ndarray) -> np.ndarray:
    """Binary clustering of each node."""
    b = (w > 0).astype(float)
    k = b.sum(1)
    t = np.diag(b @ b @ b)
    return np.where(k > 1, t / np.maximum(k * (k - 1), 1), 0.0)


def diffusion_map(a: np.ndarray, k: int, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Components 2..k+1 of the density-corrected random walk, and their eigenvalues."""
    d = np.maximum(a.sum(1), 1e-12)
    b = a / np.outer(d, d) ** alpha
    s = np.maximum(b.sum(1), 1e-12)
    val, vec = np.linalg.eigh(b / np.sqrt(np.outer(s, s)))
    order = np.argsort(-val)[: k + 1]
    psi = vec[:, order] / np.sqrt(s)[:, None]
    val = val[order][1:]
    psi = psi[:, 1:] / np.maximum(np.abs(psi[:, :1]), 1e-12)
    return signed(psi * np.where(np.abs(1 - val) > 1e-12, val / np.where(np.abs(1 - val) > 1e-12, 1 - val, 1), val)), val


def laplacian_map(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` lowest non-constant modes of the normalised Laplacian."""
    val, vec = np.linalg.eigh(laplacian(a))
    return signed(vec[:, 1 : k + 1]), val[1 : k + 1]


def principal(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and variances of the first ``k`` principal components of the rows."""
    u, s, _ = np.linalg.svd(a - a.mean(0), full_matrices=False)
    return signed(u[:, :k] * s[:k]), s[:k] ** 2 / max(len(a) - 1, 1)


def signed(x: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    return x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)


def aligned(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Orthogonal Procrustes alignment of ``x`` to the reference."""
    u, _, v = np.linalg.svd(x.T @ reference)
    return x @ (u @ v)


def affinity(m: np.ndarray, sparsity: float = 90.0) -> np.ndarray:
    """Row-cosine affinity of the matrix kept above a percentile of its positive entries; no negatives, diagonal 0."""
    pos = m[m > 0]
    kept = np.where(m >= (np.percentile(pos, sparsity) if len(pos) else 0), m, 0.0)
    norm = np.linalg.norm(kept, axis=1)
    a = kept @ kept.T / np.maximum(np.outer(norm, norm), 1e-12)
    np.fill_diagonal(a, 0)
    return np.maximum(a, 0)


def laplacian(w: np.ndarray) -> np.ndarray:
    """The symmetric normalised Laplacian."""
    d = w.sum(1)
    inv = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(w)) - inv[:, None] * w * inv[None, :]


def structural_decoupling(sc: np.ndarray, fc: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Energy share of each row of ``fc`` outside the lowest modes of ``sc``."""
    _, u = np.linalg.eigh(laplacian(sc))
    low = u[:, : math.ceil(len(sc) * share)]
    rest = fc - low @ low.T @ fc
    total = (fc**2).sum(1)
    return np.where(total > 0, (rest**2).sum(1) / np.where(total > 0, total, 1), 0.0)


def decoupling_log2(sc: np.ndarray, signals: np.ndarray, share: float = 0.5) -> np.ndarray:
    """log2 of the norms of each node's signal in the high over the low modes; ``signals`` is (nodes, time)."""
    _, u = np.linalg.eigh(laplacian(sc))
    k = math.ceil(len(sc) * share)
    hat = u.T @ signals
    low, high = u[:, :k] @ hat[:k], u[:, k:] @ hat[k:]
    return np.log2(np.maximum(np.linalg.norm(high, axis=1), 1e-12) / np.maximum(np.linalg.norm(low, axis=1), 1e-12))


def reservoir_states(w: np.ndarray, u: np.ndarray, rho: float, leak: float, seed: int, scale: float = 1.0) -> np.ndarray:
    """States of an echo-state network on the connectome scaled to spectral radius ``rho``; ``u`` is (time, inputs)."""
    n, rng = len(w), np.random.default_rng(seed)
    a = (w + w.T) / 2
    np.fill_diagonal(a, 0)
    radius = np.abs(np.linalg.eigvalsh(a)).max()
    a = a / radius * rho if radius > 0 else a
    win = rng.uniform(-scale, scale, (n, u.shape[1]))
    x, out = np.zeros(n), np.empty((len(u), n))
    for t in range(len(u)):
        x = (1 - leak) * x + leak * np.tanh(win @ u[t] + a @ x)
        out[t] = x
    return out


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1e-5) -> np.ndarray:
    """Ridge weights with a bias feature, no intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def memory_capacity(w: np.ndarray, rho: float, leak: float, seed: int, steps: int = 5000, lags: int = 50, skip: int = 500, alpha: float = 1e-6) -> np.ndarray:
    """R squared, 0 at least, of the ridge recall (with intercept) of the input ``lag`` steps ago, for each lag; the first ``skip`` steps are left out."""
    u = np.random.default_rng(seed + 1).uniform(-0.5, 0.5, (steps, 1))
    s, heard = reservoir_states(w, u, rho, leak, seed)[skip:], u[skip:, 0]
    out = np.zeros(lags)
    for k in range(1, min(lags, len(s) - 1) + 1):
        x, y = s[k:], heard[:-k]
        xc, yc = x - x.mean(0), y - y.mean()
        rest = yc - xc @ np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
        out[k - 1] = max(0.0, 1 - (rest @ rest) / (yc @ yc)) if yc.any() else 0.0
    return out


def kernel_quality(states: np.ndarray, tol: float = 1e-6) -> int:
    """Rank of the states."""
    s = np.linalg.svd(states, compute_uv=False)
    return int((s > tol * s.max(initial=0)).sum())


def surface_features(xyz: np.ndarray, radius: float, least: int = 6) -> np.ndarray:
    """Per vertex: eigenvalues of the neighbourhood's covariance, and linearity, planarity, sphericity, entropy, omnivariance, anisotropy, surface variation.

    Neighbours within the radius, itself included; NaN for under ``least`` of them or no extent.
    """
    out = np.full((len(xyz), 10), math.nan)
    for v in range(len(xyz)):
        near = xyz[((xyz - xyz[v]) ** 2).sum(1) <= radius * radius]
        if len(near) < least:
            continue
        c = near - near.mean(0)
        val = np.maximum(np.linalg.eigvalsh(c.T @ c / len(near))[::-1], 0)
        if val[0] < 1e-12:
            continue
        p = val / val.sum()
        p = p[p > 1e-12]
        out[v] = [*val, (val[0] - val[1]) / val[0], (val[1] - val[2]) / val[0], val[2] / val[0], -(p * np.log(p)).sum(), val.prod() ** (1 / 3), (val[0] - val[2]) / val[0], val[2] / val.sum()]
    return out


def largest_part(w: np.ndarray) -> int:
    """Edges of the connected part that has most of them."""
    n, label = len(w), np.full(len(w), -1)
    most = 0
    for s in range(n):
        if label[s] >= 0:
            continue
        label[s], queue = s, [s]
        for v in queue:
            for u in np.flatnonzero((w[v] != 0) & (label < 0)):
                label[u] = s
                queue.append(int(u))
        inside = label == s
        most = max(most, int((w[np.ix_(inside, inside)] != 0).sum()) // 2)
    return most


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b: discordant pairs are inversions, counted by merging; NaN where a series is constant."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda *v: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.column_stack(v), axis=0, return_counts=True)[1])
    pairs, in_x, in_y, in_both = n * (n - 1) // 2, tied(x), tied(y), tied(x, y)
    ranks = np.unique(y, return_inverse=True)[1]
    swaps, width = 0, 1
    while width < n:
        for lo in range(0, n - width, 2 * width):
            left, right = ranks[lo : lo + width], ranks[lo + width : lo + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            ranks[lo : lo + 2 * width] = np.sort(ranks[lo : lo + 2 * width], kind="stable")
        width *= 2
    under = math.sqrt((pairs - in_x) * (pairs - in_y))
    return (pairs - in_x - in_y + in_both - 2 * swaps) / under if under else math.nan


def betweenness_weighted(w: np.ndarray, cost: np.ndarray | None = None) -> np.ndarray:
    """Share of shortest paths of steps 1 / weight through each node, over the pairs of others; ties share."""
    d = distances(w, weighted=True)
    n, near = len(w), w > 0
    step = np.where(near, 1 / np.where(near, w, 1), np.inf)
    same = lambda a, b: np.abs(a - b) <= 1e-9 * np.maximum(1e-300, np.abs(b))
    out = np.zeros(n)
    for s in range(n):
        order = [int(v) for v in np.argsort(d[s], kind="stable") if np.isfinite(d[s, v])]
        paths, part = np.zeros(n), np.zeros(n)
        paths[s] = 1
        before = {v: np.flatnonzero(near[:, v] & same(d[s] + step[:, v], d[s, v])) for v in order if v != s}
        for v in order:
            if v != s:
                paths[v] = paths[before[v]].sum()
        for v in reversed(order):
            if v == s:
                continue
            part[before[v]] += paths[before[v]] / paths[v] * (1 + part[v])
            out[v] += part[v]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def rich_club(w: np.ndarray) -> list[tuple[int, float]]:
    """``(k, phi)``: density among the nodes of degree over k, for each k under the largest degree."""
    b = w > 0
    k = b.sum(1)
    out = []
    for limit in range(int(k.max(initial=0))):
        rich = k > limit
        n = int(rich.sum())
        out.append((limit, float(b[np.ix_(rich, rich)].sum() / (n * (n - 1))) if n > 1 else 0.0))
    return out


def erdos_renyi(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random graph of as many nodes, edges and weights."""
    i, j = np.triu_indices(len(w), 1)
    held = w[i, j][w[i, j] > 0]
    at = rng.choice(len(i), len(held), replace=False)
    a = np.zeros_like(w, dtype=float)
    a[i[at], j[at]] = rng.permutation(held)
    return a + a.T


def configuration(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Stubs of the degrees joined at random; loops and double edges fall away, so some degrees are lost."""
    k = (w > 0).sum(1)
    stubs = rng.permutation(np.repeat(np.arange(len(w)), k))
    a = np.zeros_like(w, dtype=float)
    half = len(stubs) // 2
    one, two = stubs[:half], stubs[half : 2 * half]
    ok = one != two
    a[one[ok], two[ok]] = 1
    return np.maximum(a, a.T)


def weights_shuffled(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Degrees kept by edge swaps, and the weights dealt anew over the edges."""
    a = rewired(w, rng)
    i, j = np.nonzero(np.triu(a, 1))
    out = np.zeros_like(a)
    out[i, j] = rng.permutation(a[i, j])
    return out + out.T


def strength_preserving(w: np.ndarray, rng: np.random.Generator, moves_per_edge: int = 20) -> np.ndarray:
    """Weights moved round random cycles of four edges: more on two opposite ones, as much less on the other two.

    Every node's strength and every edge stay, weights stay positive.  A graph without such a cycle (a tree, a triangle) stays as it is.
    """
    a = w.astype(float).copy()
    on = a > 0
    np.fill_diagonal(on, False)
    near = [np.nonzero(row)[0].tolist() for row in on]
    e = np.argwhere(on).tolist()  # both directions
    for u in rng.random((moves_per_edge * len(e) // 2, 4)).tolist():
        p, q = e[int(u[0] * len(e))]
        r, s = near[q][int(u[1] * len(near[q]))], near[p][int(u[2] * len(near[p]))]
        if r == p or s == q or r == s or not on[r, s]:
            continue
        less, more = min(a[p, q], a[r, s]), min(a[q, r], a[s, p])
        d = u[3] * (less + more) - less
        for x, y, by in ((p, q, d), (r, s, d), (q, r, -d), (s, p, -d)):
            a[x, y] = a[y, x] = a[x, y] + by
    return a


def geometry_rewired(w: np.ndarray, place: np.ndarray, rng: np.random.Generator, bins: int = 10) -> np.ndarray:
    """Edges dealt anew among the pairs of about the same distance: their number in each distance bin stays."""
    i, j = np.triu_indices(len(w), 1)
    far = np.linalg.norm(place[i] - place[j], axis=1)
    cuts = np.quantile(far, np.linspace(0, 1, bins + 1)[1:-1])
    which, v = np.searchsorted(cuts, far, "right"), w[i, j]
    a = np.zeros_like(w, dtype=float)
    for b in range(bins):
        inside = np.flatnonzero(which == b)
        a[i[inside], j[inside]] = v[rng.permutation(inside)]
    return a + a.T


def state_entropy(states: np.ndarray, bins: int = 30) -> float:
    """Mean over nodes of the entropy of their states in equal bins, over its largest value."""
    out = []
    for x in states.T:
        p = np.histogram(x, bins)[0] / len(x)
        p = p[p > 0]
        out.append(-(p * np.log2(p)).sum() / math.log2(bins))
    return float(np.mean(out))


def echo_index(w: np.ndarray, rho: float, leak: float, seed: int, trials: int = 10, steps: int = 1000) -> float:
    """1 less the mean distance of states that began apart and had the same input, over the largest distance."""
    rng, n = np.random.default_rng(seed), len(w)
    a, win = scaled(w, rho), rng.uniform(-1, 1, n)
    x = rng.uniform(-1, 1, (trials, n))
    for u in rng.uniform(-1, 1, steps):
        x = (1 - leak) * x + leak * np.tanh(win * u + x @ a)
    i, j = np.triu_indices(trials, 1)
    return float(1 - np.linalg.norm(x[i] - x[j], axis=1).mean() / (2 * math.sqrt(n)))


def lyapunov(w: np.ndarray, rho: float, leak: float, seed: int, steps: int = 5000, skip: int = 500) -> float:
    """Mean logarithmic growth of a tangent vector along a driven trajectory."""
    rng, n = np.random.default_rng(seed), len(w)
    a, win = scaled(w, rho), rng.uniform(-1, 1, n)
    x, v, total = np.zeros(n), rng.normal(size=n), 0.0
    v /= np.linalg.norm(v)
    for t, u in enumerate(rng.uniform(-1, 1, steps)):
        y = np.tanh(win * u + a @ x)
        x = (1 - leak) * x + leak * y
        v = (1 - leak) * v + leak * (1 - y * y) * (a @ v)
        size = np.linalg.norm(v)
        if size < 1e-300:
            return -math.inf
        v /= size
        if t >= skip:
            total += math.log(size)
    return total / max(steps - skip, 1)


def scaled(w: np.ndarray, rho: float) -> np.ndarray:
    """The symmetrised matrix without its diagonal, at spectral radius ``rho``."""
    a = (w + w.T) / 2
    np.fill_diagonal(a, 0)
    radius = np.abs(np.linalg.eigvalsh(a)).max()
    return a / radius * rho if radius > 0 else a
