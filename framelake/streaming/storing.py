"""From a stream of readings to stored plates: consensus with state, then two tables that a batch reaches once.

Readings come a bounded number of files at a time. The checkpoint remembers what was read and the state after it; a batch whose
tables were not finished runs again from there, and one that was finished isn't written twice. So a reading is accounted for
only once what it leads to is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.functions.consensus import Rules
from framelake.sources.sinks import store_once, stored
from framelake.streaming.consensus import stream

READINGS = "event_id long, camera_id string, track_id long, sec long, plate string, fixed string, confidence double, sharpness long, x1 long, y1 long, x2 long, y2 long, written boolean"
PLATES = "event_id long, camera_id string, track_id long, plate string, confidence double, shot long"
EVENTS = "event_id long, camera_id string, track_id long, kind string, revises boolean"


def readings(spark: SparkSession, path: str, files_per_trigger: int = 20) -> DataFrame:
    """A folder of readings as a stream, so many files at a time."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def plates(batch: DataFrame) -> DataFrame:
    return batch.where("kind is not null").select(*[c.split()[0] for c in PLATES.split(", ")])


def events(batch: DataFrame) -> DataFrame:
    """What happened: a plate was stored, or one stored before was revised."""
    return batch.where("kind is not null").select("event_id", "camera_id", "track_id", "kind", F.col("kind").isin("update", "retry").alias("revises"))


def store_plates(source: DataFrame, path: str, checkpoint: str, rules: Rules, late: str = "2 days") -> StreamingQuery:
    """Store all there is of a stream of readings in tables ``plates`` and ``events`` under ``path``."""
    writer = stream(source, rules, late).writeStream.foreachBatch(store_once(path, {"plates": plates, "events": events}))
    return writer.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_plates(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, "plates", PLATES)


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, "events", EVENTS)


def newest_plates(spark: SparkSession, path: str) -> DataFrame:
    """The newest plate of each track, as revisions in place would have left it; untracked plates all stay."""
    rows = stored_plates(spark, path)
    best = rows.where("track_id >= 0").groupBy("camera_id", "track_id").agg(F.max(F.struct("event_id", "plate", "confidence", "shot")).alias("p"))
    return best.select("camera_id", "track_id", "p.*").unionByName(rows.where("track_id < 0").select("camera_id", "track_id", "event_id", "plate", "confidence", "shot"))
