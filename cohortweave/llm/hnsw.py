"""Embedding near-duplicates with hierarchical navigable small-world graphs per shard.

Distinct vectors are dealt over shards by a hash; each shard's graph is built in
one task and written to the shared folder.  Every vector then queries every
shard, in blocks.  Searches run for a block of queries at once: their beams are
matrices, and each step expands the best unexpanded nodes of all of them.

A block's recall is audited, and the beam is widened until the audit passes, at
last to brute force.  An audit has planted queries, vectors turned away from
stored ones to just above the threshold, which must find those again: evidence
that every block has, however rare its links.  Some of the block's own queries are
compared with brute force as well, their matches with themselves left out.  A query
whose beam is full of links is searched again with a wider beam, at last by brute
force, so that dense groups lose nothing.  Links are verified by cosine in
double precision.

Each task returns one row per linked vector: how many rows it links to, and its
class's first member within the task, which is enough to union components.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import filesystem, fresh_dir, partitions, read_range, stored
from cohortweave.llm.components import connected_components

MIN_SHARDS = 8
SHARD_ROWS = 1 << 16
LINKS = 16
BEAM = 32
BUILD_BEAM = 48
BLOCK = 1024
AUDIT = 32  # planted queries of a block
PROBES = 8  # a block's own queries that are compared with brute force
AUDIT_RECALL = 0.98
EXPAND = 4
SLICE = 1 << 15  # pairs whose vectors are gathered at a time


class HNSW:
    """A layered neighbour graph over unit vectors (rows of ``x``); layer l holds the nodes of level l or more."""

    def __init__(self, x: np.ndarray, links: int = LINKS, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.links = links
        n = len(x)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 6)
        self.order = rng.permutation(n)
        self.top = 0
        self.near = [np.full((n, 2 * links), -1, np.int32)]

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> HNSW:
        g = cls(x, links)
        n = len(x)
        g.top = int(g.levels.max()) if n else 0
        g.near += [np.full((n, links), -1, np.int32) for _ in range(g.top)]
        done = 0
        while done < n:
            batch = g.order[done : done + min(BLOCK, max(64, done))]
            g._insert(g.order[:done], batch, beam)
            done += len(batch)
        g.entry = np.flatnonzero(g.levels == g.top)[:64] if n else np.empty(0, int)
        return g

    def _insert(self, present: np.ndarray, batch: np.ndarray, beam: int) -> None:
        high = self.levels[present].max(initial=-1)
        entry = present[self.levels[present] == high][:64] if len(present) else present
        at = None
        for level in range(self.top, -1, -1):
            if len(present) and level <= high:
                at = self._beam(self.x[batch], entry if at is None else at, beam if (self.levels[batch] >= level).any() else 4, level)[0]
            rows = np.flatnonzero(self.levels[batch] >= level)
            if not len(rows):
                continue
            new = batch[rows]
            cand = np.repeat(new[None, :], len(new), 0)  # the batch's own members are candidates as well
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, -np.inf)
            keep = min(len(new), beam)
            pick = np.argpartition(-sims, keep - 1, 1)[:, :keep]
            cand = np.take_along_axis(cand, pick, 1)
            cand[np.take_along_axis(sims, pick, 1) == -np.inf] = -1
            if at is not None:
                cand = np.concatenate([at[rows], cand], 1)
            width = self.near[level].shape[1]
            chosen = self._select(new, cand, width // 2 if level == 0 else width)
            self.near[level][new, : chosen.shape[1]] = chosen
            self._reverse(new, chosen, level)

    def _select(self, nodes: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
        """Up to ``keep`` candidates each, nearest first, without ones nearer to a chosen one than to the node; then the nearest rest."""
        x = self.x
        sims = (x[np.maximum(cand, 0)] @ x[nodes][:, :, None])[:, :, 0]
        sims[cand < 0] = -np.inf
        order = np.argsort(-sims, 1)[:, : 3 * keep]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        same = np.zeros(cand.shape, bool)
        same[:, 1:] = (cand[:, 1:] == cand[:, :-1]) & (cand[:, 1:] >= 0)
        sims[same] = -np.inf
        v = x[np.maximum(cand, 0)]
        inner = v @ v.transpose(0, 2, 1)
        good = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            shadow = (good[:, :c] & (inner[:, c, :c] > sims[:, c : c + 1])).any(1) if c else np.zeros(len(cand), bool)
            good[:, c] = (sims[:, c] > -np.inf) & ~shadow
        rank = np.where(sims == -np.inf, 2, np.where(good, 0, 1))
        first = np.argsort(rank, 1, kind="stable")[:, :keep]
        out = np.take_along_axis(cand, first, 1)
        out[np.take_along_axis(sims, first, 1) == -np.inf] = -1
        return out.astype(np.int32)

    def _reverse(self, new: np.ndarray, chosen: np.ndarray, level: int) -> None:
        near = self.near[level]
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        if not len(b):
            return
        order = np.lexsort((-np.einsum("ad,ad->a", self.x[a], self.x[b]), b))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        place = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)]))
        a, b, place = a[place < near.shape[1]], b[place < near.shape[1]], place[place < near.shape[1]]
        to, row = np.unique(b, return_inverse=True)
        extra = np.full((len(to), int(place.max()) + 1), -1, np.int32)
        extra[row, place] = a
        for s in range(0, len(to), 2048):
            t = to[s : s + 2048]
            picked = self._select(t, np.concatenate([near[t], extra[s : s + 2048]], 1), near.shape[1])
            near[t] = -1
            near[t, : picked.shape[1]] = picked

    def _beam(self, q: np.ndarray, entry: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes found for each query: ids (-1: none) and similarities."""
        near, x, n = self.near[level], self.x, len(q)
        ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
        done = np.zeros((n, width), bool)
        start = np.repeat(entry[None, :], n, 0) if entry.ndim == 1 else entry
        ids, sims, done = self._merge(q, ids, sims, done, start, width)
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
            k = min(EXPAND, width)
            pick = np.argpartition(-open_, k - 1, 1)[:, :k] if width > k else np.repeat(np.arange(width)[None, :], len(live), 0)
            worth = np.take_along_axis(open_, pick, 1) > -np.inf
            some = worth.any(1)
            live, pick, worth = live[some], pick[some], worth[some]
            if not len(live):
                break
            nodes = np.where(worth, np.take_along_axis(ids[live], pick, 1), -1)
            d = done[live]
            np.put_along_axis(d, pick, True, 1)
            done[live] = d
            found = np.where(nodes[:, :, None] >= 0, near[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            ids[live], sims[live], done[live] = self._merge(q[live], ids[live], sims[live], done[live], found, width)
        order = np.argsort(-sims, 1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _merge(self, q, ids, sims, done, found, width):  # noqa: ANN001, ANN202
        found = np.sort(found, 1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        s = (self.x[np.maximum(found, 0)] @ q[:, :, None])[:, :, 0]
        s[~fresh] = -np.inf
        floor = sims.min(1, keepdims=True)
        s[(s <= floor) & np.isfinite(floor)] = -np.inf
        most = int((s > -np.inf).sum(1).max(initial=0))
        if not most:
            return ids, sims, done
        most = min(most, width)
        best = np.argpartition(-s, most - 1, 1)[:, :most] if most < s.shape[1] else np.repeat(np.arange(s.shape[1])[None, :], len(s), 0)
        f, fs = np.take_along_axis(found, best, 1), np.take_along_axis(s, best, 1)
        fs[(f[:, :, None] == ids[:, None, :]).any(2)] = -np.inf
        all_ids, all_sims = np.concatenate([ids, f], 1), np.concatenate([sims, fs], 1)
        all_done = np.concatenate([done, np.zeros(f.shape, bool)], 1)
        top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
        ids, sims, done = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
        ids = np.where(sims == -np.inf, -1, ids)
        return ids, sims, done

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes of each query."""
        if not len(self.x):
            return np.full((len(q), 0), -1), np.zeros((len(q), 0), np.float32)
        q = q.astype(np.float32)
        at = self.entry
        for level in range(self.top, 0, -1):
            at = self._beam(q, at, 4, level)[0]
        return self._beam(q, at, min(width, len(self.x)), 0)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"levels": self.levels, "entry": self.entry, **{f"near{k}": v for k, v in enumerate(self.near)}}

    @classmethod
    def restored(cls, x: np.ndarray, arrays: dict[str, np.ndarray]) -> HNSW:
        g = cls.__new__(cls)
        g.x = np.ascontiguousarray(x, dtype=np.float32)
        g.levels, g.entry = arrays["levels"], arrays["entry"]
        g.near = [arrays[f"near{k}"] for k in range(sum(k.startswith("near") for k in arrays))]
        g.top, g.links = len(g.near) - 1, g.near[0].shape[1] // 2
        return g


def planted(x: np.ndarray, threshold: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``count`` stored nodes, and for each a unit vector whose cosine with it is just above ``threshold``."""
    rng = np.random.default_rng((seed, len(x)))
    at = rng.integers(0, len(x), count)
    away = rng.normal(size=(count, x.shape[1]))
    away -= np.einsum("nd,nd->n", away, x[at])[:, None] * x[at]
    size = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0.0)  # no way to turn in one dimension: the node itself
    cos = threshold + (1 - threshold) * 0.01
    q = cos * x[at] + np.sqrt(1 - cos * cos) * away
    return at, q / np.linalg.norm(q, axis=1, keepdims=True)


def links_within(g: HNSW, x: np.ndarray, q: np.ndarray, threshold: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, tuple[int, int]]:
    """Pairs ``(query, node)`` with cosine >= ``threshold`` in double precision, the beam that passed the audit, and the audit.

    ``x`` and ``q`` are unit vectors in double precision; ``own`` is each query's node
    where the queries are nodes of ``g``.  The audit is how many links it knew of and how many of them were found.
    """
    n = len(x)
    none = np.empty(0, int)
    if not n or not len(q):
        return none, none, beam, (0, 0)
    edge = threshold - 1e-5  # single precision may fall short of it
    probe = np.linspace(0, len(q) - 1, min(PROBES, len(q))).astype(int)
    truth = q[probe] @ x.T >= threshold
    if own is not None:
        truth[np.arange(len(probe)), own[probe]] = False
    at, turned = planted(x, threshold, AUDIT, len(q))
    real = int(truth.sum())
    while True:
        a, b = _search(g, x, q, edge, beam)
        real_link = _verified(q, x, a, b, threshold)
        a, b = a[real_link], b[real_link]
        seen = np.zeros(truth.shape, bool)
        inside = np.isin(a, probe)
        seen[np.searchsorted(probe, a[inside]), b[inside]] = True
        met = int((seen & truth).sum())
        c, d = _search(g, x, turned, edge, beam)
        again = len(np.unique(c[d == at[c]]))
        if again >= AUDIT_RECALL * AUDIT and met >= AUDIT_RECALL * real:
            return a, b, beam, (AUDIT + real, again + met)
        if beam >= max(512, n // 8):
            a, b = _by_hand(q, x, np.arange(len(q)), threshold)
            return a, b, n, (AUDIT + real, AUDIT + real)
        beam *= 2


def _verified(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold in double precision; ``SLICE`` pairs' vectors are gathered at a time."""
    out = np.empty(len(a), bool)
    for s in range(0, len(a), SLICE):
        out[s : s + SLICE] = np.einsum("ad,ad->a", q[a[s : s + SLICE]], x[b[s : s + SLICE]]) >= threshold
    return out


def _by_hand(q: np.ndarray, x: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the queries ``rows`` and nodes with cosine >= ``threshold``, 64 queries at a time; 8 bytes a pair are held."""
    found = [(np.empty(0, np.int32), np.empty(0, np.int32))]
    for s in range(0, len(rows), 64):
        r, c = np.nonzero(q[rows[s : s + 64]] @ x.T >= threshold)
        found.append((rows[s + r].astype(np.int32), c.astype(np.int32)))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _search(g: HNSW, x: np.ndarray, q: np.ndarray, edge: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs found with similarity >= ``edge``; beams that end within the links are widened, at last to all nodes."""
    n = len(x)
    ids, sims = g.search(q, beam)
    a, k = np.nonzero((ids >= 0) & (sims >= edge))
    b = ids[a, k]
    full = np.flatnonzero((sims[:, -1] >= edge) & (ids.shape[1] < n))
    wide = beam
    while len(full):
        wide *= 4
        a, b = a[~np.isin(a, full)], b[~np.isin(a, full)]
        if wide >= max(512, n // 8):
            c, d = _by_hand(q, x, full, edge)
            a, b = np.r_[a, c], np.r_[b, d]
            break
        i, v = g.search(q[full], wide)
        r, c = np.nonzero((i >= 0) & (v >= edge))
        a, b = np.r_[a, full[r]], np.r_[b, i[r, c]]
        full = full[v[:, -1] >= edge]
    return a, b


def _load(root: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, HNSW]:
    files, base = filesystem(root)
    info = files.get_file_info(f"{base}/{path}")
    with np.load(io.BytesIO(read_range(files, f"{base}/{path}", 0, info.size))) as z:
        arrays = {k: z[k] for k in z.files}
    nodes, weights, x = arrays.pop("nodes"), arrays.pop("weights"), arrays.pop("x")
    return nodes, weights, x, HNSW.restored(x, arrays)


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, min_shards: int = MIN_SHARDS) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept, audit_recall``.

    ``audit_recall`` is the same in all rows: the share of the links known to the audits that
    the searches found (null where no vector could be searched).

    Vectors that are null, empty or zero, or hold a null or non-finite component, link
    with nothing (``component_id`` their own id).  Vectors of different lengths never
    link.  Equal vectors are one node with a weight, so a vector that a third of all
    rows share is one node.  Repeated rows count as rows; a null id is never the
    smallest and is not kept unless alone of all ids; an empty table gives an empty table.
    """
    spark = df.sparkSession
    n_parts = partitions(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda e: e != 0)
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("v")).alias("node"), "v")
    ids = stored(rows.select("id", "node"), "ids")
    distinct = rows.filter("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"))
    distinct = stored(distinct, "vectors")
    shards = max(min_shards, -(-distinct.count() // SHARD_ROWS))
    root = fresh_dir(spark, "hnsw")
    shard = (F.size("v").cast("long") * F.lit(1 << 24) + F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards))).alias("shard")
    dealt = distinct.select(shard, "node", "weight", "v").repartition(n_parts, "shard").sortWithinPartitions("shard", "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            nodes, weights = t.column("node").to_numpy(), t.column("weight").to_numpy()
            x = np.concatenate([np.asarray(c.flatten()) for c in t.column("v").chunks]).reshape(len(nodes), -1)
            x = x / np.abs(x).max(1, keepdims=True)  # norms of huge or tiny vectors neither overflow nor vanish
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            files, base = filesystem(root)
            files.create_dir(base, recursive=True)
            name = f"shard-{shard}-{uuid.uuid4().hex}.npz"
            data = io.BytesIO()
            np.savez(data, nodes=nodes, weights=weights, x=x, **HNSW.build(x).arrays())
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(data.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([len(nodes)], pa.int64())], ["shard", "path", "n"])

        now, held = None, []
        for b in batches:
            at = 0
            keys = b.column("shard").to_numpy()
            while at < len(keys):
                end = at + int(np.searchsorted(keys[at:], keys[at], "right"))
                if keys[at] != now and held:
                    yield finish(now, held)
                    held = []
                now = int(keys[at])
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield finish(now, held)

    built = stored(dealt.mapInArrow(build, "shard long, path string, n long"), "shards")
    listed = sorted((r["shard"], r["path"], r["n"]) for r in built.collect())  # one row a shard
    lengths = np.array([k >> 24 for k, _, _ in listed], np.int64)
    first = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]]) if listed else lengths  # shards of one vector length ask each other
    last = np.r_[first[1:], len(listed)].astype(int)
    block = np.cumsum([0, *(-(-n // BLOCK) for _, _, n in listed)])  # the shards' first blocks
    tasks = np.cumsum([0, *((e - s) * int(block[e] - block[s]) for s, e in zip(first, last, strict=False))])
    total = int(tasks[-1])

    def job(task: int) -> tuple[int, int, int]:
        """The shard whose graph a task searches, the shard whose vectors ask, and the block's first vector there."""
        k = int(np.searchsorted(tasks, task, "right")) - 1
        s, e = int(first[k]), int(last[k])
        index, at = divmod(task - int(tasks[k]), int(block[e] - block[s]))
        at += int(block[s])
        asked = int(np.searchsorted(block, at, "right")) - 1
        return s + index, asked, (at - int(block[asked])) * BLOCK

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple] = {}

        def get(path: str) -> tuple:
            if path not in loaded:
                if len(loaded) >= 3:
                    loaded.pop(next(iter(loaded)))
                loaded[path] = _load(root, path)
            return loaded[path]

        for batch in batches:
            for task in batch.column(0).to_pylist():
                index, asked, lo = job(task)
                nodes, weights, x, g = get(listed[index][1])
                mine, _, q, _ = get(listed[asked][1])
                mine, q = mine[lo : lo + BLOCK], q[lo : lo + BLOCK]
                a, b, _, (knew, met) = links_within(g, x, q, threshold, own=lo + np.arange(len(q)) if index == asked else None)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([met], pa.int64()), pa.array([knew], pa.int64())], ["node", "links", "peer"])
                own = index == asked
                if own:
                    other = lo + a != b
                    a, b = a[other], b[other]
                if not len(a):
                    continue
                names = nodes if own else np.concatenate([mine, nodes])
                first = lo if own else 0  # place of the block's first vector among the names
                u, w = a + first, b if own else b + len(mine)
                links = np.zeros(len(names), np.int64)
                links[first : first + len(mine)] = np.bincount(a, weights[b], len(mine))
                linked = np.zeros(len(names), bool)
                linked[u] = linked[w] = True
                label = np.arange(len(names))
                while True:  # smallest label over the block's links
                    low = label.copy()
                    np.minimum.at(low, u, label[w])
                    np.minimum.at(low, w, low[u])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                at = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(links[at]), pa.array(names[label[at]])], ["node", "links", "peer"])

    work = spark.range(0, total, 1, max(1, min(total, 4 * n_parts)))
    answers = stored(work.mapInArrow(query, "node long, links long, peer long"), "links")
    audit = answers.filter("node is null").agg(F.sum("links").alias("met"), F.sum("peer").alias("knew")).first()  # one row
    found = answers.filter("node is not null")
    roots = connected_components(found.select("node", "peer"), "node", "peer")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = ids.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    known = stored(least.join(degree, "node", "left").join(roots, "node", "left").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "nodes")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.join(smallest, "root").select(F.col("node").alias("k"), "n_links", "component_id")
    out = ids.join(of, F.col("node") == F.col("k"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    recall = F.lit(audit["met"] / audit["knew"] if audit["knew"] else None).cast("double").alias("audit_recall")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), recall)
