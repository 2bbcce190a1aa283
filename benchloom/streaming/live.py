"""Streaming forms of the batch operators; extensions, as recordings are batches elsewhere in the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, by: list[str], ts: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Segments between gaps as session windows, closed once the watermark has passed them."""
    s = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high")


def min_max(stream: DataFrame, by: list[str], ts: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Level of detail: smallest and largest value of each tumbling window."""
    s = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return s.select(*by, F.col("w.start").alias("start"), "low", "high", "n")


def moving_mean(stream: DataFrame, by: list[str], ts: str, value: str, width: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Means of sliding windows."""
    s = stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width, slide).alias("w")).agg(F.avg(value).alias("mean"))
    return s.select(*by, F.col("w.end").alias("at"), "mean")


def run_available(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All input that is there now, batch by batch to ``sink``; a restart with the same checkpoint goes on where it stopped."""
    out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
