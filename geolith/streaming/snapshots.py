"""Extension: snapshots that arrive as streams. The batch engine has no streaming; these queries add it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_states(events: DataFrame, key: str, time: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Counts and the latest time of each key in windows of event time; later rows than the watermark are left out of state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.max(time).alias("last"))


def apply_snapshots(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a function once it is complete; the checkpoint makes restarts resume."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
