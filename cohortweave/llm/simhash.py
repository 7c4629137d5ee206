"""SimHash near-duplicates found with BK-trees.

A text's fingerprint is the majority vote, bit by bit, of the 64-bit XXH64
values of its word shingles.  Fingerprints at most ``radius`` bits apart are
linked and the links' components are the near-duplicate classes.

Candidates are searched in *shard trees*: Burkhard-Keller trees whose children
are keyed by their integer Hamming distance to the parent, so that a search
follows only the edges ``[d - radius, d + radius]``.  One tree over everything
would be neither bounded nor selective, therefore fingerprints are routed to the
shards that can hold a partner:

* 64-bit fingerprints, ``radius`` 4: the bits are cut into 6 blocks; two
  fingerprints at most 4 bits apart agree in 2 whole blocks at least, so each
  fingerprint joins the 15 shards of its block pairs.  Nothing is missed.  With
  more fingerprints more blocks are used (7 choose 3, 8 choose 4), which keeps
  shards small and stays exact.
* wide fingerprints (several hundred bits, for a lower similarity such as 0.8):
  shards are sampled bit positions; their number follows from the similarity and
  the wanted recall (:func:`bit_tables`).  They give candidates only: a link is
  one whose shingle sets have that Jaccard similarity exactly (:func:`verified`).

Shards beyond ``shard_cap`` fingerprints are cut into sub-shards, and each pair
of sub-shards is one tree: whole results, bounded memory, no hot task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import drop_stored, free_shuffles, partitions, stored
from cohortweave.llm.components import connected_components

SEED = 42
SHARD_CAP = 1024
_CHUNK = 255 * 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 of every shingle of ``words`` words, repeats included.

    Bytes' own ``lower`` and ``split`` know ASCII only: A-Z, and the white space
    ``\\x20\\x09-\\x0D``.  Fewer words give one shingle, the whole sequence; no word gives none.
    """
    seq = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return np.empty(0, "<u8")
    joined, one = b" ".join(seq), xxhash.xxh64_intdigest
    if len(seq) <= words:
        return np.array([one(joined, SEED)], "<u8")
    at = [0, *itertools.accumulate(map((1).__add__, map(len, seq)))]
    return np.array([one(joined[s : e - 1], SEED) for s, e in zip(at, itertools.islice(at, words, None), strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: bit b is 1 if set in over half the hashes."""
    return int(_majority(hashes, 1).view("<u8")[0]) if len(hashes) else 0


def _majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    votes, steps = np.zeros(64 * lanes, np.int64), np.arange(lanes, dtype=np.uint64) * _GOLD
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        x = (h[:, None] + steps) * _MIX
        x ^= x >> np.uint64(31)
        x *= _GOLD
        x ^= x >> np.uint64(29)
        x[:, 0] = h  # the first lane is the hash itself
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for s in range(0, len(h), 255):
            votes += bits[s : s + 255].sum(0, dtype=np.uint8)  # 255 ones fit a byte
    return np.packbits(votes * 2 > len(hashes), bitorder="little")


def wide_signature(text: str | None, words: int, lanes: int) -> bytes:
    """``64 * lanes`` bits over the set of shingles; a text without a word gets zeros."""
    hashes = np.unique(shingle_hashes(text, words))
    return _majority(hashes, lanes).tobytes() if len(hashes) else bytes(8 * lanes)


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """``id, fp``: the 64-bit fingerprint of every row as a signed long."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((majority(shingle_hashes(t.as_py(), words)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


# ------------------------------------------------------------------- BK-trees


class BKTree:
    """A Burkhard-Keller tree over integers that also unions what lies within the radius.

    ``add`` first finds the stored values within ``radius`` and merges their
    classes with the new value's, then inserts it.  A subtree whose values all
    belong to the class already reached is skipped: it can add nothing, and a
    large group of near copies so costs far less than its number of pairs.
    """

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int] | None] = []
        self.parent: list[int] = []
        self.uniform: list[int] = []  # a member, if the whole subtree is of one class; else -1
        self.merged: list[tuple[int, int]] = []  # the pairs within the radius that joined two classes

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def within(self, value: int) -> list[int]:
        """Positions of all stored values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= self.radius:
                found.append(i)
            if kids := self.children[i]:
                stack.extend(c for e, c in kids.items() if d - self.radius <= e <= d + self.radius)
        return found

    def add(self, value: int) -> None:
        me, radius, values, children = len(self.values), self.radius, self.values, self.children
        self.parent.append(me)
        stack = [0] if me else []
        while stack:
            i = stack.pop()
            if self.uniform[i] >= 0 and self.find(self.uniform[i]) == self.find(me):
                continue
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                a, b = self.find(me), self.find(i)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    self.merged.append((me, i))
            if kids := children[i]:
                stack.extend(c for e, c in kids.items() if d - radius <= e <= d + radius)
        values.append(value)
        children.append(None)
        self.uniform.append(me)
        if not me:
            return
        i, mine = 0, self.find(me)
        while True:
            if self.uniform[i] >= 0 and self.find(self.uniform[i]) != mine:
                self.uniform[i] = -1
            d = (values[i] ^ value).bit_count()
            kids = children[i]
            if kids is None:
                kids = children[i] = {}
            if d not in kids:
                kids[d] = me
                return
            i = kids[d]


def star_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links ``(position, position of its class's first)`` that span the classes among ``values``."""
    if len(values) == 2:
        return [(1, 0)] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree = BKTree(radius)
    for v in values:
        tree.add(v)
    return [(i, r) for i in range(len(values)) if (r := tree.find(i)) != i]


def spanning_pairs(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs of positions within ``radius`` of each other that span the classes among ``values``."""
    tree = BKTree(radius)
    for v in values:
        tree.add(v)
    return tree.merged


def pairs_between(values: np.ndarray, classes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within ``radius`` whose ``classes`` differ; ``values`` is ``(n, lanes)`` of 64 bits.

    The largest class is not compared with itself, so a large group of near copies costs its length times the others.
    """
    _, of, n = np.unique(classes, return_inverse=True, return_counts=True)
    a, b = [], []
    for i in np.flatnonzero(of != n.argmax()).tolist():
        near = (np.bitwise_count(values ^ values[i]).sum(1, dtype=np.int64) <= radius) & (of != of[i])
        near[:i] &= of[:i] == n.argmax()  # other earlier rows have had this pair
        b.append(np.flatnonzero(near))
        a.append(np.full(len(b[-1]), i))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


# --------------------------------------------------------------------- shards


def block_masks(n: int, radius: int, bits: int = 64, per_shard: int = 64) -> list[int]:
    """Masks of the block combinations that any two fingerprints within ``radius`` share one of.

    ``radius + k`` blocks, every choice of ``k``; ``k`` is the least for which ``n``
    evenly spread fingerprints give at most ``per_shard`` a shard.
    """
    for k in range(2, 5):
        blocks = radius + k
        if n <= per_shard << (bits * k // blocks):
            break
    cuts = [bits * b // blocks for b in range(blocks + 1)]
    part = [(1 << cuts[b + 1]) - (1 << cuts[b]) for b in range(blocks)]
    return [sum(part[b] for b in chosen) for chosen in itertools.combinations(range(blocks), k)]


def bit_tables(n: int, bits: int, similarity: float, recall: float = 0.99) -> np.ndarray:
    """Bit positions of each table of the wide search, ``(tables, positions)``.

    A set similarity s means an angle acos(2 s / (1 + s)) between the 0/1 shingle vectors of
    equally long texts, and so a share of equal bits; the number of tables follows
    from it and the recall at that similarity.  The positions grow with ``n``, so that
    at any size a signature meets a sixteenth of an unrelated one in a table on average.
    """
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = math.ceil(math.log2(max(n, 2))) + 4
    tables = math.ceil(math.log(1 - recall) / math.log1p(-(same**width)))
    rng = np.random.default_rng(20240517)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(tables)])


def radius_of(bits: int, similarity: float, deviations: float = 3.0) -> int:
    """Differing bits expected at that set similarity, and so many standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, given as sorted distinct hashes, have at least that Jaccard similarity."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (low + high - both) - 1e-9


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first column, in pieces that end where the key changes: starts of runs, rows."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        keys = t.column(0).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(change):
            held = t
            continue
        last = int(change[-1])
        yield np.concatenate([[0], change[:-1], [last]]), t.slice(0, last)
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield np.array([0, held.num_rows]), held


def _split_hot(rows: DataFrame, cap: int) -> DataFrame:
    """``bucket, node``: buckets beyond ``cap`` become one bucket for each pair of their sub-shards."""
    hot = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "hot")
    if hot.isEmpty():
        return rows
    hot = hot.select(F.col("bucket").alias("b"), F.ceil(F.col("n") / cap).cast("int").alias("s"))
    marked = rows.join(hot, F.col("bucket") == F.col("b"), "left")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("s")).cast("int")
    other = marked.filter("s is not null").select("bucket", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    cut = other.select(F.xxhash64("bucket", F.least("own", "o"), F.greatest("own", "o")).alias("bucket"), "node")
    return marked.filter("s is null").select("bucket", "node").union(cut)


def _split_tables(rows: DataFrame, cap: int) -> DataFrame:
    """The same for buckets of the wide search (the table's number in the bits from 44 on): ``bucket, node, tbl, own, cross``.

    ``own`` is the row's sub-shard, ``cross`` whether the bucket joins two of them.
    """
    named = rows.withColumn("tbl", F.shiftright("bucket", 44).cast("int"))
    hot = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "hot")
    whole = lambda df: df.select("bucket", "node", "tbl", F.lit(0).alias("own"), F.lit(False).alias("cross"))
    if hot.isEmpty():
        return whole(named)
    hot = hot.select(F.col("bucket").alias("b"), F.ceil(F.col("n") / cap).cast("int").alias("s"))
    marked = named.join(hot, F.col("bucket") == F.col("b"), "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("s")).cast("int"))
    other = marked.filter("s is not null").select("bucket", "node", "tbl", "own", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    cut = other.select(F.xxhash64("bucket", F.least("own", "o"), F.greatest("own", "o")).alias("bucket"), "node", "tbl", "own", (F.col("own") != F.col("o")).alias("cross"))
    return whole(marked.filter("s is null")).union(cut)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "node")


def near_links(reps: DataFrame, radius: int = 4, n: int | None = None, shard_cap: int = SHARD_CAP) -> DataFrame:
    """Links ``a, b`` that span the classes of 64-bit fingerprints within ``radius``.

    ``reps`` has one distinct fingerprint a row in ``fp``.
    """
    n = reps.count() if n is None else n
    masks = block_masks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(signed)]))
    rows = _split_hot(reps.select(shards.alias("bucket"), F.col("fp").alias("node")), shard_cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, table in _runs(batches):
            ends = np.append(starts[1:], table.num_rows)
            fps = table.column(1).to_numpy()
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                values = fps[s:e].view(np.uint64).tolist()
                for i, r in star_links(values, radius):
                    a.append(fps[s + i])
                    b.append(fps[s + r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _grouped(rows).mapInArrow(run, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: ``id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    bits.  A null or empty text has the fingerprint zero and is linked like any
    other; repeated rows stay repeated; a null id is never a component's smallest
    (a component of null ids alone has a null id); other columns are ignored; an
    empty table gives an empty table.
    """
    prints = stored(fingerprints(df, id_col, text_col, words), "prints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = stored(near_links(reps.select("fp"), radius, n=reps.count()), "near")
    nodes = connected_components(links, "a", "b")
    roots = stored(reps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    out = prints.join(of, F.col("fp") == F.col("f"), "left")
    return out.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signature(text: Column, words: int = 5, lanes: int = 16) -> Column:
    """A text column's wide signature (see :func:`wide_signature`), as binary."""

    @F.pandas_udf("binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([wide_signature(t, words, lanes) for t in texts], dtype=object)

    return sign(text)


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct candidates ``a, b`` whose shingle sets have at least that Jaccard similarity.

    ``reps`` names a node's text (``node, of``), ``texts`` has all of them (``of, text``, repeated
    ones too); only candidates' texts are read as shingles.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
    one = texts.join(wanted, "of").groupBy("node").agg(F.first("text").alias("text"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "hashes"])

    sets = stored(one.mapInArrow(shingle, "node long, hashes binary"), "sets")
    first, second = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "hashes_a", "hashes_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(b.column(2), b.column(3), strict=True)
            yield b.select([0, 1]).filter(pa.array([alike(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), similarity) for x, y in sides], pa.bool_()))

    out = stored(both.mapInArrow(check, "a long, b long"), "verified")
    drop_stored(sets)
    free_shuffles(out.sparkSession)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 16, shard_cap: int = SHARD_CAP) -> DataFrame:
    """``id, sig, keep``: one row per distinct (id, signature), ``keep`` on one of each near-duplicate class.

    Texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    at least ``similarity``.  Candidates are pairs that share a table of :func:`bit_tables` and
    whose wide signatures (``64 * lanes`` bits) differ in no more bits than :func:`radius_of`
    gives; every link is checked on the sets themselves.  Candidates that span the classes at
    the expected distance are checked first; then all candidates between different classes.
    The member with the smallest id is kept (null ids last, then by shingle set).  Null and
    empty texts are one class.
    """
    bits = 64 * lanes
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, nodes = [], []
            for t in b.column(1):
                hashes = np.unique(shingle_hashes(t.as_py(), words))
                sigs.append(_majority(hashes, lanes).tobytes() if len(hashes) else bytes(8 * lanes))
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sigs, pa.binary()), pa.array(np.array(nodes, np.uint64).view(np.int64))], ["id", "of", "sig", "node"])

    rows = rows.withColumn("of", F.xxhash64("text"))
    signed = stored(rows.mapInArrow(sign, f"id {kind}, of long, sig binary, node long"), "signed")
    reps = stored(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.min("id").alias("least"), F.min("of").alias("of")), "reps")
    texts, named = rows.select("of", "text"), reps.select("node", "of")
    picks = bit_tables(reps.count(), bits, similarity)
    near, far = radius_of(bits, similarity, 0.0), radius_of(bits, similarity)
    weights = 1 << np.arange(picks.shape[1], dtype=np.int64)

    def keys_of(sigs: np.ndarray) -> np.ndarray:
        """The bucket of each signature (row of bytes) in each table."""
        up = np.unpackbits(sigs, axis=1, bitorder="little")
        return np.stack([up[:, p].astype(np.int64) @ weights for p in picks], 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(len(picks), dtype=np.int64) << 44
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                keys = keys_of(np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint8).reshape(c.num_rows, -1)) + salt
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(c.column(0).to_numpy(), len(picks)))], ["bucket", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, table in _runs(batches):
            ends = np.append(starts[1:], table.num_rows)
            mask = np.repeat(ends - starts > 1, ends - starts)
            yield from table.filter(pa.array(mask)).to_batches()

    routed = reps.select("node", "sig").mapInArrow(route, "bucket long, node long")
    shared = stored(_grouped(routed).mapInArrow(several, "bucket long, node long"), "shared")
    free_shuffles(df.sparkSession)
    split = stored(_split_tables(shared, shard_cap), "split")
    drop_stored(shared)

    def span(values: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = spanning_pairs([int.from_bytes(v.tobytes(), "little") for v in values], near)
        return tuple(np.array(found, int).reshape(-1, 2).T)

    def between(values: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs_between(values, classes, far) if (classes != classes[0]).any() else (np.empty(0, int), np.empty(0, int))

    def first_met(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
        """Which pairs share no earlier table's bucket: each pair of signatures is given out by one table."""
        rows, flat = np.unique(np.r_[i, j], return_inverse=True)
        keys = keys_of(sigs[rows].view(np.uint8).reshape(len(rows), -1))[:, :table]
        return np.concatenate([~(keys[flat[s : min(s + 8192, len(i))]] == keys[flat[len(i) + s : len(i) + min(s + 8192, len(i))]]).any(1) for s in range(0, len(i), 8192)])

    def candidates(search, radius: int, classes: DataFrame) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for starts, table in _runs(batches):
                ends = np.append(starts[1:], table.num_rows)
                nodes, roots = table.column(1).to_numpy(), table.column(3).to_numpy()
                tables, own, cross = (table.column(k).to_numpy() for k in (4, 5, 6))
                sigs = np.frombuffer(b"".join(table.column(2).to_pylist()), "<u8").reshape(len(nodes), -1)
                several = ends - starts > 1
                pair = ends - starts == 2
                s = starts[pair]
                close = np.bitwise_count(sigs[s] ^ sigs[s + 1]).sum(1, dtype=np.int64) <= radius
                s = s[close & (roots[s] != roots[s + 1])]
                a, b = [nodes[s]], [nodes[s + 1]]
                for s, e in zip(starts[several & ~pair], ends[several & ~pair], strict=True):
                    i, j = search(sigs[s:e], roots[s:e])
                    if len(i):
                        if cross[s]:  # two parts of a hot bucket: pairs within either are met in its own bucket
                            apart = own[s:e][i] != own[s:e][j]
                            i, j = i[apart], j[apart]
                        if len(i):
                            new = first_met(sigs[s:e], i, j, int(tables[s]))
                            i, j = i[new], j[new]
                    a.append(nodes[s:e][i])
                    b.append(nodes[s:e][j])
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        known = split.join(classes, "node").select("bucket", "node", "sig", "root", "tbl", "own", "cross")
        out = stored(_grouped(known).mapInArrow(run, "a long, b long").distinct(), "candidates")
        free_shuffles(df.sparkSession)
        return out

    def classes_of(links: DataFrame) -> DataFrame:
        nodes = connected_components(links, "a", "b")
        return stored(reps.join(nodes, "node", "left").select("node", "sig", "least", F.coalesce("root", "node").alias("root")), "classes")

    alone = reps.select("node", "sig", F.col("node").alias("root"))
    links = verified(candidates(span, near, alone), named, texts, words, similarity)
    classed = classes_of(links)
    more = verified(candidates(between, far, classed.select("node", "sig", "root")), named, texts, words, similarity)
    drop_stored(split)
    classed = classes_of(links.union(more)).select("node", "least", "root")
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("f")).select(F.col("f.node").alias("kept_node"), F.col("f.least").alias("kept_id"))
    signed = signed.groupBy("id", "node").agg(F.first("sig").alias("sig"))
    return signed.join(first, (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id")), "left").select("id", "sig", F.col("kept_node").isNotNull().alias("keep"))
