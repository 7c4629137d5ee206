"""Phrases whose words keep company, mined by hashed buckets and Apriori pruning.

One pass over the texts for each phrase length.  The pass for length n counts exactly
those phrases of n words that can still be frequent, and at the same time counts the
phrases of n + 1 words in hashed buckets.  A bucket that stays under ``min_count``
holds no frequent phrase, so the next pass gets one bit a bucket; and a phrase can be
frequent only if both phrases of one word less are, so it also gets a bitmap of the
hashes of those found frequent.  Both bitmaps have at most ``2 ** MOST_BITS`` bits
whatever the corpus: with more phrases than bits they let more through, and the exact
counts that follow decide alone.

A task counts about ``FLUSH`` bytes at a time, so a phrase that all texts share leaves it
as few rows, and its memory is bounded by that number and by the bucket table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm._store import partitions, stored

# The bytes that end a piece, and those that only part words.
_ENDS, _GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
UNKNOWN_LANG = "und"
FLUSH = 8 << 20  # bytes of text counted at a time
LEAST_BITS, MOST_BITS = 20, 26
BLOCK_BITS = 16
SALTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAPS)], _KIND[list(_ENDS)] = 1, 2


def words_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The distinct words (lower-cased, A-Z only) and the texts as their numbers from 1, with 0 where a piece ends."""
    data = b"\n".join(texts).lower()
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    ends = np.cumsum(kind == 2, dtype=np.int32)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    joined = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).dictionary_encode()
    cut = ends[start[1:]] != ends[end[:-1] - 1]
    ids = np.zeros(len(start) + int(cut.sum()), np.int64)
    ids[np.arange(len(start)) + np.r_[0, np.cumsum(cut)]] = joined.indices.to_numpy() + 1
    return joined.dictionary, ids


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``FLUSH`` bytes that end where a piece ends."""
    at = 0
    while len(text) - at > FLUSH and (found := _END.search(text, at + FLUSH)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _slots(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hashed slots of the phrases of ``n`` words that start at ``at``."""
    h = hashes[ids[at]]
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * _MIX + hashes[ids[at + k]]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _rows(table: np.ndarray) -> pa.RecordBatch:
    """A table of saturated counts as its blocks with a count: slots and counts, or all counts where that is shorter."""
    size = 1 << BLOCK_BITS
    out: list[tuple[int, bytes, bytes]] = []
    for block in range(len(table) // size):
        part = table[block * size : (block + 1) * size]
        at = np.flatnonzero(part)
        if len(at):
            sparse = 3 * len(at) < size
            out.append((block, at.astype(np.uint16).tobytes() if sparse else b"", (part[at] if sparse else part).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["block", "at", "counts"])


def _bitmap(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bits of the slots whose counts reach ``least``; blocks are added up where they meet, and 2 ** bits bits come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(1 << BLOCK_BITS, np.uint16)
                total, more = sums[block], np.frombuffer(counts, np.uint8)
                if at:
                    where = np.frombuffer(at, np.uint16)
                    total[where] = np.minimum(total[where] + more, 255)
                else:
                    np.minimum(total + more, 255, out=total)
        packed = [np.packbits(v >= least, bitorder="little").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    spark = blocks.sparkSession
    summed = blocks.repartition(partitions(spark), "block").mapInArrow(add, "block int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for r in summed.collect():  # at most 2 ** (MOST_BITS - 3) bytes
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _counted(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A start of each distinct phrase of ``n`` words among those at ``at``, and how often it occurs."""
    base = int(ids.max(initial=0)) + 1
    key, span = ids[at].astype(np.int64), base
    for k in range(1, n):
        if span >= (1 << 62) // base:
            distinct, key = np.unique(key, return_inverse=True)
            span = len(distinct)
        key, span = key * base + ids[at + k], span * base
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return at[first], counts


def _pass(texts: DataFrame, n: int, bits: int, cap: int, found, bitmaps: tuple | None, more: bool) -> DataFrame:  # noqa: ANN001
    """One pass: exact counts ``lang, phrase, f`` of phrases of ``n`` words and, if ``more``, bucket counts ``block, at, counts`` of n + 1.

    ``found`` is the broadcast bitmap of the frequent phrases of n - 1 words, ``bitmaps`` that of the buckets of n (both null for n = 1).
    """

    def flush(lang: str, texts: list[bytes], table: np.ndarray | None) -> pa.RecordBatch:
        names, ids = words_of(texts)
        seed = _seed(lang)
        hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in names.to_pylist())], np.uint64)
        end = len(ids)
        ids = np.r_[ids, np.zeros(n + 1, np.int64)]
        whole = ids[:end] > 0
        for k in range(1, n):
            whole &= ids[k : end + k] > 0
        at = np.flatnonzero(whole)
        if n > 1:
            if n > 2:
                at = at[_has(found.value, _slots(ids, hashes, at, n - 1, bits))]
                at = at[_has(found.value, _slots(ids, hashes, at + 1, n - 1, bits))]
            else:
                every = np.arange(len(hashes))
                often = _has(found.value, _slots(every, hashes, every, 1, bits))
                at = at[often[ids[at]] & often[ids[at + 1]]]
            at = at[_has(bitmaps.value, _slots(ids, hashes, at, n, bits))]
        if table is not None:  # phrases of one word more, of which both parts may be frequent
            may = np.zeros(len(ids) + 1, bool)
            may[at] = True
            longer = at[may[at + 1]]
            slots, counts = np.unique(_slots(ids, hashes, longer, n + 1, bits), return_counts=True)
            table[slots] = np.minimum(table[slots] + counts, cap).astype(np.uint8)
        first, counts = _counted(ids, at, n)
        parts = [names.take(pa.array(ids[first + k] - 1)) for k in range(n)]
        phrases = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, b" ")
        size = len(first)
        none = pa.nulls(size, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64()), pa.nulls(size, pa.int32()), none, none], ["lang", "phrase", "f", "block", "at", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8) if more else None
        held: dict[str, list[bytes]] = {}
        waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _cut(text):
                    held.setdefault(lang, []).append(part)
                    waiting += len(part) + 1
                    if waiting >= FLUSH:
                        for k, v in held.items():
                            yield flush(k, v, table)
                        held, waiting = {}, 0
        for k, v in held.items():
            yield flush(k, v, table)
        if table is not None:
            b = _rows(table)
            none = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.string()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), *b.columns], ["lang", "phrase", "f", "block", "at", "counts"])

    return texts.mapInArrow(count, "lang string, phrase string, f long, block int, at binary, counts binary")


def _frequent_bitmap(frequent: DataFrame, n: int, bits: int) -> np.ndarray:
    """The bits of the hashes of frequent phrases of ``n`` words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8)
        seeds: dict[str, int] = {}
        for batch in batches:
            hashes = np.empty((batch.num_rows, n), np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                seed = seeds.setdefault(lang, _seed(lang))
                hashes[i] = [xxhash.xxh3_64_intdigest(w, seed) for w in phrase.encode().split(b" ")]
            flat = hashes.reshape(-1)
            table[_slots(np.arange(len(flat)), flat, np.arange(0, len(flat), n), n, bits)] = 1
        yield _rows(table)

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(mark, "block int, at binary, counts binary"), bits, 1)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10) -> DataFrame:
    """``lang, phrase, words, f``: all words, and all phrases of 2 to ``max_words`` words that occur ``min_count`` times or more (1 to 255)."""
    if not 1 <= min_count <= 255:
        raise ValueError("min_count must be 1 to 255")
    spark = df.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang")
    texts = df.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 4 + 1))))
    levels: list[DataFrame] = []
    found = bitmap = None
    for n in range(1, max_words + 1):
        more = n < max_words
        rows = stored(_pass(texts, n, bits, min_count, found, bitmap, more), f"phrases-{n}")
        counts = rows.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        counts = stored(counts if n == 1 else counts.filter(F.col("f") >= min_count), f"counts-{n}")
        levels.append(counts.select("lang", "phrase", F.lit(n).alias("words"), "f"))
        if more:
            bitmap = spark.sparkContext.broadcast(_bitmap(rows.filter("block is not null").select("block", "at", "counts"), bits, min_count))
            found = spark.sparkContext.broadcast(_frequent_bitmap(counts.filter(F.col("f") >= min_count), n, bits))
    out = levels[0]
    for more_words in levels[1:]:
        out = out.union(more_words)
    return out


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by their weakest cut.

    A phrase of 2 to ``max_words`` words with ``a`` >= ``min_count`` occurrences is cut after each
    word but the last; a cut with ``l`` and ``r`` occurrences of its parts scores
    floor(1000000 a a / (l r)), and the lowest counts (ties: the first).  Phrases
    inside a longer one that has ``cover`` per cent of their occurrences or more go.  Scores are exact up to 38 digits.

    Null languages are ``und``, null and empty texts have no words, repeated rows count each,
    ties are broken by ``a`` and then by the phrase's bytes; texts of any length are read whole,
    other columns are not looked at, and an empty table gives an empty table.
    """
    counts = phrase_counts(df, text_col, lang_col, max_words, min_count)
    totals = counts.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.filter(F.col("f") >= min_count)
    phrases = often.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda part, f: often.select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(part), F.col("f").alias(f))
    for name, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(of(name + "_part", f), (F.col("lang") == F.col(f"{f}_lang")) & (F.col(name) == F.col(name + "_part"))).drop(f"{f}_lang", name + "_part")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (wide("a") * wide("a")).alias("aa"), (wide("l") * wide("r")).alias("lr"))
    cuts = cuts.withColumn("score", F.expr("cast((aa * cast(1000000 as decimal(7, 0))) div lr as bigint)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the contiguous parts of two words or more of each longer phrase
    spans = phrases.filter("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    spans = spans.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("s"))
    inner = spans.select(F.col("lang").alias("i_lang"), part(F.col("s"), F.col("m")).alias("i_phrase"), "a").groupBy("i_lang", "i_phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left").filter(F.coalesce(100 * F.col("longest") < cover * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # within salted parts of a language first, so that a language of most phrases is no single task
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.join(totals.withColumnRenamed("lang", "t_lang"), F.col("lang") == F.col("t_lang"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
