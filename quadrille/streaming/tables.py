"""Stateless checks and windowed counts over streams of the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators import audit


def linted(lines: DataFrame) -> DataFrame:
    """Faults of label lines as they come; the check looks at one line at a time."""
    return audit.lint(lines)


def rates(detections: DataFrame, *, time: str, late: str = "10 minutes", window: str = "5 minutes", least: float = 0.5) -> DataFrame:
    """Detections and those of at least a confidence, a window; rows later than the watermark are left out."""
    return detections.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("detections"), F.count_if(F.col("conf") >= least).alias("confident"))


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write its result to a folder of its number, so that a repeated batch replaces itself."""

    def write(frame: DataFrame, number: int) -> None:
        step(frame).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
