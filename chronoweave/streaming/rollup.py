"""Windowed aggregates of event streams. Each takes a streaming or a static DataFrame; watermarks bound the state of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    kind = dict(events.dtypes)[ts]
    return (events if kind == "timestamp" else events.withColumn(ts, F.col(ts).cast("timestamp"))).withWatermark(ts, late)


def windowed(events: DataFrame, keys: list[str], ts: str, value: str, *, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """keys, window_start, n, total, least, most of each tumbling (or sliding) window; rows later than `late` are dropped in streams."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = _timed(events, ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return found.select(*keys, F.col("w.start").alias("window_start"), "n", "total", "least", "most")


def sessions(events: DataFrame, keys: list[str], ts: str, *, gap: str, late: str = "10 minutes") -> DataFrame:
    """keys, session_start, session_end (the last event's time and the gap), n."""
    found = _timed(events, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, ids: list[str], ts: str, *, late: str = "10 minutes") -> DataFrame:
    """Rows without the repeats of an id: within the watermark in a stream, all in a static table."""
    timed = _timed(events, ts, late)
    return timed.dropDuplicatesWithinWatermark(ids) if events.isStreaming else timed.dropDuplicates(ids)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Writes what is there to Parquet and ends; called again, it goes on from the checkpoint, each row once."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
