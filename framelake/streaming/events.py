"""Streaming forms: detections from a directory, counts by window, and a cooldown with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.dedup import cooled

SCHEMA = "event_id long, ts timestamp, camera_id string, track_id long, class_name string, confidence double, sec long"


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of detections, so many at a time; the checkpoint replays what wasn't finished."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(events: DataFrame, window: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Counts by camera, class and event-time window; events behind the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "camera_id", "class_name").agg(F.count("*").alias("n"))


def cooldown(events: DataFrame, seconds: int, late: str = "2 days") -> DataFrame:
    """Events that pass a cooldown per (camera, track). State is the time of the last that passed, and is forgotten once
    the watermark, ``late`` behind the newest event, is past it by ``seconds``. Events behind the watermark are dropped.

    A batch's events of a key go by time; events older than those of earlier batches are judged by the same state.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        own = pd.concat(list(frames)).sort_values(["sec", "event_id"])
        kept = own[list(cooled(own["sec"], seconds, last))]
        if len(kept):
            last = int(kept["sec"].iloc[-1])
            state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": kept["event_id"]})

    timed = events.withWatermark("ts", late)
    return timed.groupBy("camera_id", "track_id").applyInPandasWithState(run, "event_id long", "last long", "append", "EventTimeTimeout")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The first event of each (camera, track) within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera_id", "track_id"])
