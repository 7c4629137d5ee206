"""Pack token sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; full pieces are
sequences of their own.  The remainders are the items of a cutting-stock
problem: their lengths, in classes of ``step`` tokens, form a histogram of
bounded size (``seq_len / step`` classes), over whose patterns a linear program
is solved by column generation - a knapsack dynamic program prices new columns -
to within ``GAP`` of a proven bound.  The rounded patterns are then assigned to the documents by their rank within
their class, which is a distributed computation: ranks are counted in hash
buckets, so that a class with a third of all rows is spread over many tasks.

Only the histogram comes to the driver.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm._chunks import CHUNK, Memory, groups
from cohortweave.llm._store import stored

SEQ_LEN = 2048
STEP = 8
BUCKETS = 256
END_ID = 1
#: Full pieces, each a sequence of its own, are ranked in this many buckets: they may be most rows.
FULL_BUCKETS = 1 << 16
#: The linear program ends within this share of its lower bound.
GAP = 2e-3
_REMEMBERED = 80_000_000


# -------------------------------------------------------------- linear program


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within the capacity: value, count of each item."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fits = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fits:
            v = best[w - sizes[:fits]] + values[:fits]
            k = int(v.argmax())
            if v[k] > best[w] + 1e-12:
                best[w], take[w] = v[k], k
    counts, w = np.zeros(len(sizes), int), capacity
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            counts[take[w]] += 1
            w -= sizes[take[w]]
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots; without BLAS, whose threads can wait for ever in a driver that started a JVM."""
    m = len(a)
    wide = np.hstack([a, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(wide[k:, k]).argmax())
        wide[[k, p]] = wide[[p, k]]
        wide[k] /= wide[k, k]
        factor = wide[:, k].copy()
        factor[k] = 0
        wide -= factor[:, None] * wide[k]
    return wide[:, m:].copy()


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns with their fractional use, and a lower bound on the number of bins that they are within ``gap`` of.

    Revised simplex on ``min sum(x)``, ``A x >= demand``; the first basis has one
    pattern of each size alone.  The demand is raised by tiny amounts that differ from
    row to row, so that no step is without a gain.  Columns are priced by duals smoothed
    towards those of the best bound; every pricing gives a bound by Farley:
    the duals' value over the best pattern's price.  Ends only when the bound is met.
    """
    m = len(sizes)
    demand = demand * (1 + 1e-7 * np.random.default_rng(7).random(m)) + 1e-6 * np.random.default_rng(8).random(m)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    cost = np.ones(m)
    inverse = inverted(basis)
    x = np.einsum("ij,j", inverse, demand)
    bound, anchor, step = 0.0, np.zeros(m), 0
    while True:
        step += 1
        if step % 64 == 0:
            inverse = inverted(basis)
            x = np.einsum("ij,j", inverse, demand)
        now = float((cost * x).sum())
        dual = np.einsum("i,ij", cost, inverse)
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # more of this size than demanded is free
            column, price = np.zeros(m), 0.0
            column[worst] = -1
        else:
            for smooth in (0.6, 0.0):
                prices = np.maximum(smooth * anchor + (1 - smooth) * dual, 0)
                value, counts = knapsack(prices, sizes, capacity)
                at = float((prices * demand).sum()) / max(1.0, value)
                if at > bound:
                    bound, anchor = at, prices / max(1.0, value)
                if float((counts * dual).sum()) > 1 + 1e-7:
                    break
            else:  # no pattern is worth more than it costs: the optimum
                bound = max(bound, now)
            if now <= bound * (1 + gap):
                return [(basis[:, k].astype(int), float(x[k])) for k in range(m) if cost[k] > 0 and x[k] > 1e-9], bound
            column, price = counts.astype(float), 1.0
        u = np.einsum("ij,j", inverse, column)
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            raise RuntimeError("the linear program has a direction without a bound: the basis has become singular")
        basis[:, r], cost[r] = column, price
        theta = ratio[r]
        x = x - theta * u
        x[r] = theta
        row = inverse[r] / u[r]
        inverse = inverse - np.outer(u, row)
        inverse[r] = row


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest pattern of what is left that holds its largest size, large sizes first.

    Which sums are reachable with the sizes up to each one, and so many of each, are bits of integers.
    """
    order = sorted(left)
    top = order[-1]
    mask = (1 << (capacity - top + 1)) - 1
    reach = [1]
    for c in order:
        n, bits, k = min(left[c] - (c == top), (capacity - top) // c), reach[-1], 1
        while n > 0:
            k = min(k, n)
            bits |= bits << (c * k) & mask
            n -= k
            k *= 2
        reach.append(bits)
    total = reach[-1].bit_length() - 1
    pattern = {top: 1}
    for k in range(len(order) - 1, -1, -1):
        c = order[k]
        n = min(left[c] - (c == top), total // c)
        while not reach[k] >> (total - n * c) & 1:
            n -= 1
        if n:
            pattern[c] = pattern.get(c, 0) + n
        total -= n * c
    return pattern


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ``({size: count}, uses)`` that hold every item of ``{size: items}``.

    The linear program's uses are rounded down; where it covers a size beyond its items, that size is left out of the last
    of them, and the patterns' other items go on.  Then fractions of a half and more are rounded up, the largest first, where all of a
    pattern's items are there.  What is left is less than one use of each pattern, so at most about one bin a size, whatever
    the number of items; it fills bins one by one, each as full as can be.
    """
    left = {c: n for c, n in histogram.items() if n > 0}
    if not left:
        return []
    sizes = np.array(sorted(left))
    found, _ = column_generation(sizes, np.array([left[c] for c in sizes], float), capacity)
    plans: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int, whole: bool = True) -> None:
        while times > 0:
            now = pattern if whole else {c: min(k, left[c]) for c, k in pattern.items() if c in left}
            n = min([times, *(left.get(c, 0) // k for c, k in now.items())]) if now else 0
            if not n:
                return
            plans.append((now, n))
            for c, k in now.items():
                left[c] -= k * n
                if not left[c]:
                    del left[c]
            times -= n  # a size has run out, or all uses are done

    patterns = [({int(c): int(k) for c, k in zip(sizes, counts, strict=True) if k}, x) for counts, x in found]
    for pattern, x in patterns:
        use(pattern, int(x), whole=False)
    for pattern, x in sorted(patterns, key=lambda p: int(p[1]) - p[1]):
        use(pattern, int(x % 1 >= 0.5))
    while left:
        use(fullest(left, capacity), 1)
    return plans


def slots(plans: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each class: first rank, places a bin and first bin of each pattern that has it; the number of bins."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    bins = 0
    for pattern, uses in plans:
        for c, k in pattern.items():
            rows.setdefault(c, []).append((ranks.get(c, 0), k, bins))
            ranks[c] = ranks.get(c, 0) + k * uses
        bins += uses
    return {c: tuple(np.array(v) for v in zip(*r, strict=True)) for c, r in rows.items()}, bins


# -------------------------------------------------------------------- tokens


def _rank_encoder(path: str, tokenizer):  # noqa: ANN202
    """The same vocabulary as a rank encoder, which is several times faster, or None where it would differ.

    It is the same where the file is a plain byte-level BPE whose merges are in the
    order of their ids, that splits by the standard pattern, and that encodes each of its
    tokens that is a text as the rank encoder does (a token that its merges do not make differs).
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    as_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    order = [vocab["".join(m)] for m in merges]
    if order != sorted(order) or sorted(vocab[c] for c in as_byte) != list(range(256)):
        return None
    ranks = {bytes(as_byte[c] for c in t): vocab[t] for t in [*as_byte, *map("".join, merges)]}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in (t.decode("utf-8", "ignore") for t in ranks) if t]
    same = all(e.ids == encoding.encode_ordinary(t) for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))
    return encoding if same else None


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by a tokenizers file.

    Pieces between white space are encoded once and remembered; a text that holds one
    of the file's special tokens is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = _rank_encoder(path, self.tokenizer)
        one = self.ranks._core_bpe.encode_ordinary if self.ranks else None
        self.known = Memory((lambda c: array("I", one(c)).tobytes()) if one else (lambda c: self.whole([c])[0]), _REMEMBERED)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            yield self.whole([t])[0] if any(s in t for s in self.special) else b"".join(map(self.known.__getitem__, CHUNK.findall(t)))


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` (and ``ids``): documents cut at multiples of ``seq_len``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        tail = array("I", [END_ID]).tobytes()
        for b in batches:
            at, out = 0, ([], [], [], [], [], [])
            for texts in groups(t.as_py() for t in b.column(1)):
                for raw in encoder.encode(texts):
                    raw += tail
                    n = len(raw) // 4
                    for start in range(0, n, seq_len):
                        part = raw[4 * start : 4 * (start + seq_len)]
                        for column, v in zip(out, (at, start, len(part) // 4, zlib.crc32(part), n, np.frombuffer(part, "<u4").astype("<i4") if with_ids else None), strict=True):
                            column.append(v)
                    at += 1
            cols = [b.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:5])]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(out[5], pa.list_(pa.int32()))] if with_ids else [])], names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Every document's ids, then id 1, lie in exactly one piece each; sequences are at
    most ``seq_len`` long and numbered from 0 without gaps, but for patterns that the
    rounding left unused.  A null or empty text is the id 1 alone.  Repeated rows and
    null ids are packed like any other; extra columns are ignored; an empty table
    gives an empty table.
    """
    cut = stored(pieces(df, id_col, text_col, tokenizer, seq_len, with_ids), "pieces")
    size = F.when(F.col("length") == seq_len, 0).otherwise(F.ceil(F.col("length") / step)).cast("int")
    spread = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.when(F.col("cls") == 0, FULL_BUCKETS).otherwise(BUCKETS)).cast("int")
    marked = cut.withColumn("cls", size).withColumn("bucket", spread)
    counts = stored(marked.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(0, 0)
    table, bins = slots(plan_patterns(histogram, seq_len // step))
    if full:
        table[0] = (np.array([0]), np.array([1]), np.array([bins]))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # at most seq_len / step * BUCKETS + FULL_BUCKETS rows of 16 bytes; a class's window has as many rows as it has buckets
    first = F.broadcast(counts.select(F.col("cls").alias("c"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("first")))
    rank = F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("id", "start", "ids_crc32"))
    ranked = marked.withColumn("rank", rank - 1).join(first, (F.col("cls") == F.col("c")) & (F.col("bucket") == F.col("b")))
    names = list(cut.columns)
    ranked = ranked.select(*names, "cls", (F.col("rank") + F.col("first")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq = np.empty(len(cls), np.int64)
            for c in np.unique(cls):
                at = cls == c
                start, places, bin_ = table[int(c)]
                k = np.searchsorted(start, rank[at], "right") - 1
                seq[at] = bin_[k] + (rank[at] - start[k]) // places[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq)], [*names, "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy("id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
