"""Toxicity by a factorization machine over hashed terms.

``score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the distinct hashed
terms of a text: its lower-cased words and their prefixes of 4 and 5 letters
(inflected insults share a prefix).  The pairwise part learns combinations that
no sum of single weights expresses.

Training uses a bounded sample: at most about ``SAMPLE`` labelled rows, chosen by
a hash of their id; everything else (scoring) covers whole texts of all rows.  Terms
are counted by Spark; all those that tell about the label take part, however many,
and only they come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._store import drop_stored, stored

#: Labelled rows that the model is fitted on, about; a documented bound.
SAMPLE = 16_000
SPACE = 1 << 20
#: Terms take part whose share of the label lies so many standard errors from the rest's; seen in 3 sample rows at least.
STANDARD_ERRORS = 4.0
FACTORS = 8
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def _terms(word: str) -> tuple[int, ...]:
    own = [f"w{word}"]
    own += [f"p{word[:k]}" for k in (4, 5) if len(word) > k]
    return tuple(xxhash.xxh32_intdigest(t.encode(), 11) % SPACE for t in own)


def term_ids(text: str | None, cache: dict[str, tuple[int, ...]], slot: np.ndarray | None = None) -> set[int]:
    """The distinct hashed terms of a whole text; empty for a null text or one without a letter.

    With ``slot`` only terms that it keeps, as their slots.
    """
    out: set[int] = set()
    for run in set((text or "").split()):
        ids = cache.get(run)
        if ids is None:
            ids = tuple({t for w in _WORD.findall(run.lower()) for t in _terms(w)})
            if slot is not None:
                ids = tuple(int(s) for t in ids if (s := slot[t]) >= 0)
            if len(run) <= 64:
                if len(cache) > _CACHE:
                    cache.clear()
                cache[run] = ids
        if ids:
            out.update(ids)
    return out


@dataclass
class FactorizationMachine:
    """``slot`` maps a hashed term to its row in ``w`` and ``v``, or to -1."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, slots: list[set[int]]) -> np.ndarray:
        """Probabilities of rows given by their distinct slots."""
        n = np.array([len(x) for x in slots], int)
        cols = np.fromiter((c for x in slots for c in sorted(x)), int, int(n.sum()))
        rows = np.repeat(np.arange(len(slots)), n)
        return 1 / (1 + np.exp(-np.clip(_raw(len(slots), rows, cols, self.w0, self.w, self.v)[0], -30, 30)))


def _sum_rows(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by ascending ``rows``."""
    out = np.zeros((n, *values.shape[1:]))
    if len(rows):
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[at]] = np.add.reduceat(values, at, axis=0)
    return out


def _raw(n: int, rows: np.ndarray, cols: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = _sum_rows(n, rows, v[cols])
    q = _sum_rows(n, rows, v[cols] ** 2)
    return w0 + _sum_rows(n, rows, w[cols]) + 0.5 * (s**2 - q).sum(1), s


def fit(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, epochs: int = 80, rate: float = 0.05, l2: float = 2e-4, seed: int = 5) -> FactorizationMachine:
    """Full-batch Adam on the logistic loss; ``rows`` hold hashed terms out of the distinct ``terms``.

    Without rows of both labels the model is the constant base rate.
    """
    n = len(rows)
    pos = float(y.sum()) if n else 0.0
    slot = np.full(SPACE, -1, np.int32)
    base = np.log((pos + 0.5) / (n - pos + 0.5)) if n else -3.0
    if not n or pos in (0, n) or not len(terms):
        return FactorizationMachine(slot, float(base), np.zeros(1), np.zeros((1, FACTORS)))
    m = len(terms)
    slot[np.sort(terms)] = np.arange(m)
    cols, rows = slot[np.concatenate(rows).astype(np.int64)], np.repeat(np.arange(n), [len(x) for x in rows])
    rng = np.random.default_rng(seed)
    order = np.argsort(cols, kind="stable")
    p = [np.array(base), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))]
    mom, sq = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, epochs + 1):
        raw, s = _raw(n, rows, cols, float(p[0]), p[1], p[2])
        err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        e = err[rows]
        per = e[:, None] * (s[rows] - p[2][cols])
        g = [np.array(err.mean()), _sum_rows(m, cols[order], e[order]) / n + l2 * p[1] / 10, _sum_rows(m, cols[order], per[order]) / n + l2 * p[2]]
        for k in range(3):
            mom[k] = 0.9 * mom[k] + 0.1 * g[k]
            sq[k] = 0.99 * sq[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (mom[k] / (1 - 0.9**t)) / (np.sqrt(sq[k] / (1 - 0.99**t)) + 1e-8)
    return FactorizationMachine(slot, float(p[0]), p[1], p[2])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fold: int | None = 2) -> FactorizationMachine:
    """Fit on about ``sample`` labelled rows of ``df`` outside the held-out fold (crc32(id) mod 4).

    Rows with a null id, text or label are not used.  The sample is a hash range of
    the ids, so it does not depend on how the tables are partitioned.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    if fold is not None:
        known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != fold)
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    known = known.filter(F.xxhash64(F.col("id"), F.lit(3)).bitwiseAND(F.lit((1 << 62) - 1)) <= int(share * ((1 << 62) - 1)))
    # at most about `sample` rows of 12 bytes
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            ids = [np.fromiter(sorted(term_ids(t.as_py(), cache)), np.int32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(ids, pa.list_(pa.int32()))], ["id", "y", "ids"])

    read = stored(rows.mapInArrow(run, "id string, y int, ids array<int>"), "terms")
    found, toxic = read.agg(F.count(F.lit(1)), F.sum("y")).first()
    rate = (toxic or 0) / max(found, 1)
    spread = F.greatest(F.col("df") * rate * (1 - rate), F.lit(1e-9)) + 1
    seen = read.select("y", F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("toxic"))
    telling = seen.filter((F.col("df") >= 3) & (F.abs(F.col("toxic") - F.col("df") * rate) > STANDARD_ERRORS * F.sqrt(spread))).select("term")
    terms = telling.toArrow().column("term").to_numpy()  # at most SPACE numbers

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.intersect1d(x.values.to_numpy(), terms) if x.values is not None else np.empty(0, np.int32) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(own, pa.list_(pa.int32()))], ["id", "y", "ids"])

    got = read.mapInArrow(keep, "id string, y int, ids array<int>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    drop_stored(read)
    rows = [np.asarray(x.values) if x.values is not None else np.empty(0, np.int32) for x in got.column("ids").combine_chunks()] if got.num_rows else []
    return fit(rows, got.column("y").to_numpy().astype(float), terms)


def scorer(model: FactorizationMachine):  # noqa: ANN201
    """A column function: text to score, over whole texts (null and empty ones too)."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(model.score([term_ids(t, cache, model.slot) for t in texts]))

    return toxicity
