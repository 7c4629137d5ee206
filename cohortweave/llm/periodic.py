"""Periodic runs of words: stretches that repeat a shorter stretch over and over.

Every lag from 1 to the words over ``min_exponent`` is scanned: the array of word ids is
compared with itself shifted by the lag, and stretches of equal places that are long enough
are runs of that period.  A stretch that several lags report has the smallest of them
as its period (the others are its multiples).

A text whose scan passes ``RANGE_WORK`` comparisons is dealt out as several ranges of lags of
equal work, which go to different tasks; each sees the whole text, and a run is
found by the range that holds its lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import partitions, stored

RANGE_WORK = 1 << 31
BYTES_A_WORD = 4  # for an estimate of a text's words before it is split
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def lag_bounds(n: int, parts: int, min_exponent: int = 4) -> np.ndarray:
    """The first lags of ``parts`` ranges over 1 to n // ``min_exponent`` of about equal work, and the end."""
    last = n // min_exponent
    share = np.arange(parts + 1) / parts  # a lag q costs n - q: the sum up to q is q n - q q / 2
    total = last * n - last * last / 2
    cut = n - np.sqrt(np.maximum(n * n - 2 * share * total, 0))
    bounds = 1 + np.minimum(np.round(cut), last).astype(np.int64)
    bounds[0], bounds[-1] = 1, last + 1
    return np.maximum.accumulate(bounds)


def scan(ids: np.ndarray, first: int, end: int, min_exponent: int = 4, min_length: int = 6) -> dict[tuple[int, int], int]:
    """``(start, end) -> period`` of the runs at the lags from ``first`` to before ``end``."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    for q in range(first, end):
        need = max(min_length, min_exponent * q) - q
        if need > n - q:
            break
        equal = (ids[q:] == ids[:-q]).tobytes()
        pattern = b"\1" * need
        i = equal.find(pattern)
        while i >= 0:
            j = equal.find(b"\0", i + need)
            j = n - q if j < 0 else j
            found.setdefault((i, j + q), q)  # lags rise, so the smallest stays
            i = equal.find(pattern, j)
    return found


def _merged(runs: list) -> list[tuple[int, int, int]]:
    """``start, length, period`` by start, then period; of equal stretches that with the smallest period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted((s, n, q) for (s, n), q in best.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([w for w, k in zip(words, np.cumsum(step).tolist(), strict=False) if not k])


def _batch(ids: pa.Array, ns: list, runs: list, texts: list) -> pa.RecordBatch:
    listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(listed, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = 4, min_length: int = 6, range_work: int = RANGE_WORK) -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row.

    ``runs`` lists ``start, length, period`` of all stretches of at least
    max(``min_length``, ``min_exponent`` times their smallest period) words, as far as they go, by start and period;
    words are what ASCII white space parts, numbered from 0.  ``collapsed`` has one period
    of each run left, its words joined by one space.

    Null and empty texts have no words and an empty ``collapsed``; repeated rows give a row each;
    a null id is an id like others; other columns are not looked at; an empty table gives an empty table.
    """
    n_parts = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    guess = F.octet_length("text").cast("double") / BYTES_A_WORD
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil(guess * guess / min_exponent / range_work)).cast("int"))
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_words long, runs {_RUNS_SQL}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, runs, texts = [], [], []
            for data in batch.column("text").to_pylist():
                words = data.split()  # of bytes: ASCII white space only
                found = scan(word_ids(words), 1, len(words) // min_exponent + 2, min_exponent, min_length)
                ns.append(len(words))
                runs.append(sorted((s, e - s, q) for (s, e), q in found.items()))
                texts.append(_collapsed(words, runs[-1]))
            yield _batch(batch.column("id"), ns, runs, texts)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs = [], []
            for key, data, parts, part in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "parts", "part")), strict=True):
                words = data.split()
                bounds = lag_bounds(len(words), parts, min_exponent)
                end = int(bounds[part + 1]) + (part == parts - 1)  # lag 1 of six or seven words may pass n // min_exponent
                found = scan(word_ids(words), int(bounds[part]), end, min_exponent, min_length)
                keys.append(key)
                runs.append([{"start": s, "length": e - s, "period": q} for (s, e), q in found.items()])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(runs, _RUNS)], ["key", "runs"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, runs, texts = [], [], []
            for data, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = data.split()
                ns.append(len(words))
                runs.append(_merged([(r["start"], r["length"], r["period"]) for r in found]))
                texts.append(_collapsed(words, runs[-1]))
            yield _batch(batch.column("id"), ns, runs, texts)

    body = F.col("text").cast("binary").alias("text")
    short = rows.filter("parts = 1").select("id", body).mapInArrow(whole, schema)
    # long texts: each once, by a digest; their ranges are scanned apart and meet again at it
    long = rows.filter("parts > 1").withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    once = stored(long.groupBy("key").agg(F.first("text").alias("text"), F.first("parts").alias("parts")), "long-texts")
    ranges = once.select("key", body, "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(n_parts, "key", "part")
    found = ranges.mapInArrow(ranged, f"key string, runs {_RUNS_SQL}").groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    done = once.select("key", "text").join(found, "key").select(F.col("key").alias("id"), F.col("text").cast("binary").alias("text"), "runs").mapInArrow(gathered, schema.replace(schema.split(",")[0], "id string", 1))
    again = long.select("id", "key").join(done.withColumnRenamed("id", "key"), "key").select("id", "n_words", "runs", "collapsed")
    return short.union(again)
