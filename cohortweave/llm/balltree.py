"""Exact top-k inner products by ball trees, one a shard, with branch and bound.

The top of the tree is fitted on a bounded sample (``SAMPLE_BYTES``); every row is then routed down to
one of its leaves, a crowded leaf is dealt over several shards by a hash, and each shard's own ball tree
is built in one task and written to the shared folder.  A ball with centre c and radius r holds no vector
whose inner product with q passes q c + |q| r.

Queries go in blocks of ``BLOCK``, neighbours together.  Waves of shards, those with the highest bounds first, are
searched one after the other: every wave starts from the kth scores that all earlier ones found,
and a shard whose bound cannot reach them is not opened.  Inside a shard each query follows nodes by their bounds
and stops at the first that cannot reach its kth score.  Scores are integers, so equal bounds are
followed only where the node holds a smaller id: a third of all rows may be copies of one vector.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm._store import filesystem, fresh_dir, partitions, read_range, stored

SHARD_BYTES = 1 << 26
MIN_SHARDS = 8
SAMPLE_BYTES = 1 << 24  # of vectors that the top of the tree is fitted on
LEAF = 96
BLOCK = 256
FIRST_WAVE, WIDER = 1, 6  # shards a block asks in the first wave, and how many times as many in each next
NO_ID = np.iinfo(np.int64).max  # orders null ids last
_EXACT = float(1 << 53)


def _split(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Direction, cut and side of a split between two far points; the halves are equal in number."""
    far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    other = x[np.argmax(((x - far) ** 2).sum(1))]
    way = other - far
    along = x @ way
    cut = float(np.median(along))
    side = along > cut
    return way, cut, side if side.any() else along >= cut


def top_tree(x: np.ndarray, leaves: int) -> list[tuple[np.ndarray, float, int, int]]:
    """Splits of a sample into about ``leaves`` parts: direction, cut, and the two next nodes (~leaf where negative)."""
    nodes: list = []
    parts: list[tuple[np.ndarray, int, int]] = []  # rows, parent, side
    heap = [(-len(x), 0, np.arange(len(x)), -1, 0)]
    made = 1
    while heap and len(heap) < leaves:
        size, _, rows, parent, where = heapq.heappop(heap)
        way, cut, side = _split(x[rows])
        if -size < 2 or side.all() or not side.any():
            parts.append((rows, parent, where))
            continue
        nodes.append([way, cut, 0, 0])
        if parent >= 0:
            nodes[parent][2 + where] = len(nodes) - 1
        for k, half in enumerate((rows[~side], rows[side])):
            heapq.heappush(heap, (-len(half), made, half, len(nodes) - 1, k))
            made += 1
    parts += [(rows, parent, where) for _, _, rows, parent, where in heap]
    for leaf, (_, parent, where) in enumerate(parts):
        if parent >= 0:
            nodes[parent][2 + where] = ~leaf
    return [tuple(n) for n in nodes]


def route(nodes: list, x: np.ndarray) -> np.ndarray:
    """The leaf of the top tree that each row belongs to."""
    out = np.zeros(len(x), np.int64)
    if not nodes:
        return out
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        way, cut, low, high = nodes[node]
        side = x[rows] @ way > cut
        for child, part in ((low, rows[~side]), (high, rows[side])):
            if child < 0:
                out[part] = ~child
            elif len(part):
                todo.append((child, part))
    return out


class BallTree:
    """Nested balls over the rows of ``x`` (integers held as doubles) with the ids ``ids``.

    Node j holds the rows ``lo[j]`` to ``hi[j]`` of the reordered arrays and has the children ``left[j]`` and
    ``left[j] + 1``, or none where that is 0.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None, nodes: dict | None = None) -> None:
        if nodes is None:
            order, nodes = self._grow(ids, np.asarray(x, np.float64))
            ids, x = ids[order], np.asarray(x, np.float64)[order]
        self.ids, self.x = ids, x
        self.centre, self.radius, self.least = nodes["centre"], nodes["radius"], nodes["least"]
        self.lo, self.hi, self.left = nodes["lo"], nodes["hi"], nodes["left"]
        self.norm = float(np.sqrt((self.x**2).sum(1)).max(initial=0))

    @staticmethod
    def _grow(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict]:
        order = np.argsort(ids, kind="stable")
        lo, hi, left, centre, radius, least = [0], [len(ids)], [0], [None], [0.0], [0]
        at = 0
        while at < len(lo):
            rows = order[lo[at] : hi[at]]
            part = x[rows]
            middle = part.mean(0)
            centre[at], least[at] = middle, int(ids[rows].min())
            radius[at] = float(np.sqrt(((part - middle) ** 2).sum(1).max()))
            if len(rows) > LEAF and (part != part[0]).any():
                side = _split(part)[2]
                if side.any() and not side.all():
                    order[lo[at] : hi[at]] = np.r_[rows[~side], rows[side]]
                    middle_row = lo[at] + int((~side).sum())
                    left[at] = len(lo)
                    lo += [lo[at], middle_row]
                    hi += [middle_row, hi[at]]
                    for made, start in ((left, 0), (centre, None), (radius, 0.0), (least, 0)):
                        made += [start, start]
            at += 1
        return order, {"centre": np.array(centre), "radius": np.array(radius), "least": np.array(least, np.int64), "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left)}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"ids": self.ids, "x": self.x, "centre": self.centre, "radius": self.radius, "least": self.least, "lo": self.lo, "hi": self.hi, "left": self.left}

    @classmethod
    def restored(cls, z: dict[str, np.ndarray]) -> BallTree:
        return cls(z["ids"], z["x"], z["ids"], z)

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``query, ids, scores``: what each row of ``q`` has among its ``k`` best here and not below its floor.

        The floor is the kth best elsewhere: what ends behind it in score, or in id at the same score, is not wanted.
        """
        bounds = upper_bounds(q, self.centre, self.radius)
        norms = np.sqrt((q**2).sum(1))
        for i in range(len(q)):
            row = bounds[i]
            score, ident = int(floor[i]), int(floor_id[i])
            held: list[tuple[int, int]] = []  # the best so far, the worst of them first: score, -id
            heap = [(-row[0], 0)]
            exact = norms[i] * self.norm < _EXACT
            while heap:
                high, node = heapq.heappop(heap)
                if -high < score:
                    break
                if -high < score + 1 and self.least[node] > ident:
                    continue
                child = int(self.left[node])
                if child:
                    for c in (child, child + 1):
                        if row[c] >= score:
                            heapq.heappush(heap, (-row[c], c))
                    continue
                lo, hi = self.lo[node], self.hi[node]
                if exact:
                    s = np.rint(self.x[lo:hi] @ q[i]).astype(np.int64)
                else:  # integers beyond a double's
                    mine = [int(v) for v in q[i]]
                    s = np.array([sum(a * int(b) for a, b in zip(mine, r, strict=True)) for r in self.x[lo:hi]], np.int64)
                at = np.flatnonzero(s >= score)
                if len(at) > k:  # no more than the k best of them count
                    at = at[np.lexsort((self.ids[lo + at], -s[at]))[:k]]
                for v, ident_here in zip(s[at].tolist(), self.ids[lo + at].tolist(), strict=True):
                    if (v, -ident_here) < (score, -ident):
                        continue
                    if len(held) < k:
                        heapq.heappush(held, (v, -ident_here))
                    else:
                        heapq.heappushpop(held, (v, -ident_here))
                    if len(held) == k:
                        score, ident = max((score, -ident), held[0])
                        ident = -ident
            if held:
                yield i, np.array([-b for _, b in held]), np.array([a for a, _ in held])


def upper_bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No vector of ball j has an inner product with query i above entry (i, j); rounding is allowed for."""
    norms = np.sqrt((q**2).sum(1))[:, None]
    reach = np.sqrt((centre**2).sum(1)) + radius
    return q @ centre.T + norms * radius + norms * reach * 1e-10 + 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _save(root: str, arrays: dict) -> str:
    files, base = filesystem(root)
    files.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.npz"
    data = io.BytesIO()
    np.savez(data, **arrays)
    with files.open_output_stream(f"{base}/{name}") as f:
        f.write(data.getvalue())
    return name


def _load(root: str, name: str) -> dict[str, np.ndarray]:
    files, base = filesystem(root)
    size = files.get_file_info(f"{base}/{name}").size
    with np.load(io.BytesIO(read_range(files, f"{base}/{name}", 0, size))) as z:
        return {k: z[k] for k in z.files}


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist(), strict=True)


def _by_key(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of one key as one table, of at most ``most`` rows if given."""
    now, held, n = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        for lo, hi in _runs(b.column(key).to_numpy()):
            k = b.column(key)[lo].as_py()
            while lo < hi:
                if held and (k != now or n == most):
                    yield now, pa.Table.from_batches(held)
                    held, n = [], 0
                end = hi if most is None else min(hi, lo + most - n)
                now = k
                held.append(b.slice(lo, end - lo))
                n += end - lo
                lo = end
    if held:
        yield now, pa.Table.from_batches(held)


def top_inner_products(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, min_shards: int = MIN_SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row with ``is_query`` the ``k`` rows with the highest inner products.

    Components are floor(``scale`` x) in double precision and scores exact integers; a score beyond 64 bits raises.
    Equal scores go by the smaller id, a null id after all others.  A query's own row is no candidate; its
    repeats are, and repeated queries are answered each.  Vectors that are null or hold a null or non-finite
    component take no part; those of another length than the query's, the empty ones too, only meet their like (the empty score 0).
    Rows of which ``is_query`` is null do not ask.  Other columns are not looked at; an empty table gives an empty table.
    """
    spark = df.sparkSession
    n_parts = partitions(spark)
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda e: F.lit(float(scale)) * e)
    rows = df.select(F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False))).withColumn("size", F.size("v"))
    sizes = rows.groupBy("size").count().collect()  # a row a vector length
    trees: dict[int, list] = {}
    for r in sizes:
        d, n = r["size"], r["count"]
        shards = max(min_shards, -(-n * 8 * max(d, 1) // shard_bytes))
        most = max(2 * shards, SAMPLE_BYTES // (8 * max(d, 1)))
        # rows whose hash is small: about ``most``, whatever the number of rows
        share = F.abs(F.xxhash64("id", "v") % F.lit(1 << 40)) < F.lit(int(min(1.0, most / max(n, 1)) * (1 << 40)))
        sample = np.array([x[0] for x in rows.filter((F.col("size") == d) & share).select("v").limit(2 * most).collect()], float).reshape(-1, d) if d else np.zeros((0, 0))
        trees[d] = top_tree(np.floor(sample), shards) if len(sample) > 1 and (sample != sample[0]).any() else []

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            x = [np.floor(np.asarray(a, float)) for a in b.column("v").to_numpy(zero_copy_only=False)]
            leaf = np.zeros(len(sizes), np.int64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                leaf[at] = (d << 32) + (route(trees[d], np.array([x[i] for i in at])) if d else 0)
            yield pa.RecordBatch.from_arrays([b.column("asks"), b.column("id"), pa.array(x, pa.list_(pa.float64())), pa.array(leaf)], ["asks", "id", "v", "leaf"])

    dealt = stored(rows.select("asks", "id", "v", "size").mapInArrow(leaves, "asks boolean, id long, v array<double>, leaf long"), "routed")
    # a crowded leaf is dealt over as many shards as it needs; a row a leaf, of which there is at most one in shard_bytes of vectors and min_shards
    crowd = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"))
    many = crowd.select(F.col("leaf").alias("l"), F.ceil(F.col("n") * 8 * F.greatest(F.col("d"), F.lit(1)) / shard_bytes).alias("splits"))
    spread = dealt.join(F.broadcast(many), F.col("leaf") == F.col("l")).select("asks", "id", "v", F.xxhash64("leaf", F.pmod(F.xxhash64("id", "v", F.lit(7)), F.col("splits"))).alias("shard"))
    root = fresh_dir(spark, "balls")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches, "shard"):
            t = t.combine_chunks()
            ids = t.column("id").chunk(0).fill_null(NO_ID).to_numpy()
            x = _matrix(t.column("v").chunk(0))
            tree = BallTree(ids, x)
            name = _save(root, tree.arrays())
            centre = pa.array([tree.centre[0].tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.shape[1]], pa.int32()), centre, pa.array([tree.radius[0]]), pa.array([int(tree.least[0])])], ["path", "size", "centre", "radius", "least"])

    built = spread.repartition(n_parts, "shard").sortWithinPartitions("shard")
    listed = sorted(stored(built.mapInArrow(build, "path string, size int, centre array<double>, radius double, least long"), "shards").collect())  # one row a shard
    balls = {}
    for d in {r["size"] for r in listed}:
        mine = [r for r in listed if r["size"] == d]
        balls[d] = ([r["path"] for r in mine], np.array([r["centre"] for r in mine], float).reshape(len(mine), d), np.array([r["radius"] for r in mine]), np.array([r["least"] for r in mine], np.int64))
    known = spark.sparkContext.broadcast(balls)  # a centre a shard of SHARD_BYTES

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches, "shard", BLOCK):
            t = t.combine_chunks()
            ids, x = t.column("id").chunk(0), _matrix(t.column("v").chunk(0))
            own = [int(a) if a < _EXACT else sum(int(e) ** 2 for e in r) for a, r in zip((x**2).sum(1).tolist(), x, strict=True)]
            name = uuid.uuid4().hex
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([own], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["block", "size", "n", "ids", "own", "x"])

    asking = spread.filter("asks").repartition(n_parts, "shard").sortWithinPartitions("shard", "id")
    asking = stored(asking.mapInArrow(blocks, "block string, size int, n int, ids array<long>, own array<long>, x binary"), "queries")
    wanted = k + 1  # the own row may be among them

    def choose(lo: int, hi: int):  # noqa: ANN202
        """The shards from place ``lo`` to ``hi`` in each block's order of bounds that may still hold one of its queries' best."""

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, d, n, x, floors in zip(*(b.column(c).to_pylist() for c in ("block", "size", "n", "x", "floors")), strict=True):
                    paths, centre, radius, least = known.value[d]
                    q, floor, floor_id = _with_floors(x, n, d, floors)
                    bounds = upper_bounds(q, centre, radius)
                    order = np.argsort(-bounds.max(0), kind="stable")[lo:hi]
                    may = (bounds >= floor[:, None] + 1) | ((bounds >= floor[:, None]) & (least <= floor_id[:, None]))
                    order = [s for s in order.tolist() if may[:, s].any()]
                    if order:
                        m = len(order)
                        yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.array([paths[s] for s in order]), pa.array([d] * m, pa.int32()), pa.array([n] * m, pa.int32()), pa.array([x] * m, pa.binary()), pa.array([floors] * m, b.schema.field("floors").type)], ["block", "path", "size", "n", "x", "floors"])

        return chosen

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, tree = None, None
        for b in batches:
            for block, at, d, n, x, floors in zip(*(b.column(c).to_pylist() for c in ("block", "path", "size", "n", "x", "floors")), strict=True):
                if at != path:
                    path, tree = at, BallTree.restored(_load(root, at))
                q, floor, floor_id = _with_floors(x, n, d, floors)
                for i, ids, scores in tree.search(q, wanted, floor, floor_id):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids)), pa.array([i] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["block", "i", "id", "score"])

    best = None
    lo, width = 0, FIRST_WAVE
    shards = max((len(b[0]) for b in balls.values()), default=0)
    order = Window.partitionBy("block", "i").orderBy(F.desc("score"), F.asc("id"))
    while lo < shards:
        floors = asking.select("block", "size", "n", "x", F.array().cast("array<struct<i: int, score: bigint, id: bigint>>").alias("floors"))
        if best is not None:
            kth = best.filter(F.col("place") == wanted).groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("i", "score", "id")).alias("found"))
            floors = asking.join(kth, F.col("block") == F.col("b"), "left").select("block", "size", "n", "x", F.coalesce("found", F.array().cast("array<struct<i: int, score: bigint, id: bigint>>")).alias("floors"))
        pairs = floors.repartition(n_parts, "block").mapInArrow(choose(lo, lo + width), "block string, path string, size int, n int, x binary, floors array<struct<i: int, score: bigint, id: bigint>>")
        # by shard and block, so that the queries of a shard that all ask are several tasks
        pairs = pairs.repartition(n_parts, "path", F.pmod(F.xxhash64("block"), F.lit(n_parts))).sortWithinPartitions("path")
        found = pairs.mapInArrow(search, "block string, i int, id long, score long")
        if best is not None:
            found = found.union(best.select("block", "i", "id", "score"))
        best = stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= wanted), "best")
        lo, width = lo + width, width * WIDER
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    real = asking.select(F.col("block").alias("b"), F.posexplode(F.arrays_zip("ids", "own")).alias("k", "q")).select("b", "k", F.col("q.ids").alias("query_id"), F.col("q.own").alias("own"))
    hits = best.join(real, (F.col("block") == F.col("b")) & (F.col("i") == F.col("k")))
    mine = (F.col("id") == F.coalesce("query_id", F.lit(int(NO_ID)))) & (F.col("score") == F.col("own"))
    first = F.min(F.when(mine, F.col("place"))).over(Window.partitionBy("block", "i"))
    hits = hits.withColumn("first", F.coalesce(first, F.lit(wanted + 1))).filter(F.col("place") != F.col("first"))
    rank = F.col("place") - F.when(F.col("place") > F.col("first"), 1).otherwise(0)
    ident = F.when(F.col("id") != F.lit(int(NO_ID)), F.col("id"))
    return hits.select("query_id", rank.cast("int").alias("rank"), ident.alias("vec_id"), "score").filter(F.col("rank") <= k)


def _with_floors(x: bytes, n: int, size: int, floors: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's queries, and the kth best score and id of each that has so many already."""
    q = np.frombuffer(x, np.float64).reshape(n, size)
    floor = np.full(len(q), np.iinfo(np.int64).min, np.int64)
    ids = np.full(len(q), NO_ID, np.int64)
    for f in floors:
        floor[f["i"]], ids[f["i"]] = f["score"], f["id"]
    return q, floor, ids
