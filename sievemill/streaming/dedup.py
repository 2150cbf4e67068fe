"""An extension: first-wins deduplication over a stream, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import dedup_hash


def first_wins_stream(events: DataFrame, text: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose text has not come within the watermark's delay before; state older than that goes."""
    return events.withColumn("digest", dedup_hash(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; late rows within the delay still count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
