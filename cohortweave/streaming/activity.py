"""Streaming counterparts: windowed activity and runs of active windows on an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count and sum by channel and window; state older than the watermark is dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(window.alias("w"), F.col("event_type").alias("roi")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return got.select(F.col("w.start").alias("start"), "roi", "n", "v")


def running_runs(frames: DataFrame) -> DataFrame:
    """Avalanches of a stream of ``(subject, t, act)`` frames in time order: emitted when a silent frame ends them.

    The state of a subject is the run it is in: start, size and duration.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        start, size, duration = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, act in zip(rows["t"], rows["act"], strict=True):
            if act > 0:
                start, size, duration = (int(t) if duration == 0 else start), size + int(act), duration + 1
            elif duration:
                out.append((key[0], start, size, duration))
                start, size, duration = -1, 0, 0
        state.update((start, size, duration))
        yield pd.DataFrame(out, columns=["subject", "start_t", "size", "duration"])

    return frames.groupBy("subject").applyInPandasWithState(step, "subject long, start_t long, size long, duration long", "start long, size long, duration long", "append", "NoTimeout")
