"""Readers and writers of the domain's file formats.

Arrays come through Spark's own ``binaryFile`` reader, so any store that Spark
reaches will do; a file is decoded in one task and leaves as long-form rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUBJECT = r"(sub-[A-Za-z0-9]+)"


def _arrays(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", _SUBJECT, 1).alias("subject"), "path", "content")


def _load(content: bytes) -> np.ndarray:
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    return loaded if isinstance(loaded, np.ndarray) else loaded[loaded.files[0]]


def read_timeseries(spark: SparkSession, path: str, time_first: bool = True) -> DataFrame:
    """``subject, t, roi, v`` from ``.npy`` or ``.npz`` files (the first key) of shape (time, channels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for subject, content in zip(b["subject"], b["content"], strict=True):
                a = _load(content).astype(float)
                a = a if time_first else a.T
                t, roi = np.indices(a.shape)
                yield pd.DataFrame({"subject": subject, "t": t.ravel().astype("int64"), "roi": roi.ravel().astype("int32"), "v": a.ravel()})

    return _arrays(spark, path).mapInPandas(run, "subject string, t long, roi int, v double")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``subject, i, j, w`` with i < j from square matrices, made symmetric by the mean; invalid weights are 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for subject, name, content in zip(b["subject"], b["path"], b["content"], strict=True):
                a = np.nan_to_num(_load(content).astype(float), posinf=0.0, neginf=0.0)
                if a.ndim != 2 or a.shape[0] != a.shape[1]:
                    raise ValueError(f"{name}: not a square matrix")
                i, j = np.triu_indices(len(a), 1)
                yield pd.DataFrame({"subject": subject, "i": i.astype("int32"), "j": j.astype("int32"), "w": ((a + a.T) / 2)[i, j]})

    return _arrays(spark, path).mapInPandas(run, "subject string, i int, j int, w double")


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The same from a headerless CSV of one matrix a file."""
    lines = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", _SUBJECT, 1).alias("subject"), F.split(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""), "\r?\n").alias("rows"))
    cells = lines.select("subject", F.posexplode("rows").alias("i", "row")).select("subject", "i", F.posexplode(F.split("row", ",")).alias("j", "w"))
    return cells.select("subject", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("w").cast("double") / 2).alias("w")).filter("i <> j").groupBy("subject", "i", "j").agg(F.sum("w").alias("w"))


def read_confounds(spark: SparkSession, path: str) -> DataFrame:
    """Mean framewise displacement of each subject's table; ``n/a`` is missing."""
    t = spark.read.option("sep", "\t").option("header", "true").option("nullValue", "n/a").csv(path)
    fd = F.col("framewise_displacement").cast("double")
    return t.groupBy(F.regexp_extract(F.input_file_name(), _SUBJECT, 1).alias("subject")).agg(F.avg(fd).alias("mean_fd"), F.count(F.lit(1)).alias("frames"))


def read_streamlines(spark: SparkSession, assignments: str, weights: str) -> DataFrame:
    """``id, a, b, w``: two parcels a line (0: none), and one weight a line, joined by line number."""

    def numbered(path: str) -> DataFrame:
        body = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\r?\n")).alias("id", "line"))
        return body.filter("line not like '#%' and trim(line) <> ''")

    pairs = numbered(assignments).select("id", F.split(F.trim("line"), r"\s+").alias("p"))
    w = numbered(weights).select("id", F.trim("line").cast("double").alias("w"))
    return pairs.join(w, "id").select("id", F.col("p")[0].cast("int").alias("a"), F.col("p")[1].cast("int").alias("b"), "w")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *by: str) -> None:
    """Write a result as Parquet, JSON or CSV, in folders by the columns ``by``."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*by) if by else w).option("header", "true").save(path)
