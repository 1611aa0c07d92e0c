"""Streams: an extension. Monthly counts with late data, first sightings of links, a batch sink that a restart repeats safely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monthly_counts(events: DataFrame, key: str, time: str = "ts", late: str = "30 days", length: str = "30 days") -> DataFrame:
    """Counts of a key by window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, id: str, time: str = "ts", late: str = "30 days") -> DataFrame:
    """Each id once, as long as its repeats come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))


def into_table(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Each batch into its own folder, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
