"""Structured Streaming: an extension beyond batch, labelled as such.

The functions take a streaming DataFrame and return one; state is kept by Spark's own stateful operators,
bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of value by key and window; events later than the watermark are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: events that follow each other within the gap."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("events"))
    return w.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "events")


def first_contents(chunks: DataFrame, time: str, content: str = "content", late: str = "1 day") -> DataFrame:
    """Each chunk content once, as it first arrives; contents are remembered as long as the watermark says."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark([content])


def new_containers(spark, folder: str) -> DataFrame:
    """Containers as they arrive in a folder: path, modification time and length, a micro-batch at a time."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", "*.aff4").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
