"""Cooldowns and gates over a key's ordered events, in batch; the streaming forms are in ``framelake.streaming``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.stateful import Cooldown
from framelake.plans.registry import query
from framelake.sources.tables import detections


def cooled(times: Iterable[float], seconds: float, last: float | None = None, refresh: bool = False) -> Iterator[bool]:
    """Whether each of a key's ordered times passes: the first, then those ``seconds`` or more after the last that
    passed, or after the last of all where ``refresh``."""
    for t in times:
        ok = last is None or t - last >= seconds
        if ok or refresh:
            last = t
        yield ok


def cooldown(df: DataFrame, keys: list[str], seconds: int, refresh: bool = False) -> DataFrame:
    """event_id of the events that pass a cooldown per key; with ``refresh`` every event restarts the clock.

    After a gap of more than ``seconds`` an event passes whatever came before, so that keys are cut there.
    """
    from framelake.operators.gates import gated

    return gated(df, keys, lambda: Cooldown(seconds, refresh), [])


@query(
    'SELECT event_id FROM r WHERE ok',
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id) AS k FROM (SELECT *, (x1 + x2) // 100 AS cx, (y1 + y2) // 100 AS cy FROM det) WHERE class_name = 'person' AND track_id >= 0),
  r AS (SELECT camera_id, track_id, k, event_id, sec AS last, true AS ok FROM n WHERE k = 1
    UNION ALL SELECT n.camera_id, n.track_id, n.k, n.event_id, CASE WHEN n.sec - r.last >= 7200 THEN n.sec ELSE r.last END, n.sec - r.last >= 7200 FROM r JOIN n ON n.camera_id = r.camera_id AND n.track_id = r.track_id AND n.k = r.k + 1)""",
    recursive=True,
)
def dd1_person_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(camera, track), two hours. Tested by a plain loop."""
    return cooldown(detections(spark, sf_dir).where("class_name = 'person' and track_id >= 0"), ["camera_id", "track_id"], 7200)


@query(
    'SELECT event_id FROM r WHERE ok',
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, cx, cy ORDER BY sec, event_id) AS k FROM (SELECT *, (x1 + x2) // 100 AS cx, (y1 + y2) // 100 AS cy FROM det) WHERE class_name = 'person' AND track_id < 0),
  r AS (SELECT camera_id, cx, cy, k, event_id, sec AS last, true AS ok FROM n WHERE k = 1
    UNION ALL SELECT n.camera_id, n.cx, n.cy, n.k, n.event_id, CASE WHEN n.sec - r.last >= 7200 THEN n.sec ELSE r.last END, n.sec - r.last >= 7200 FROM r JOIN n ON n.camera_id = r.camera_id AND n.cx = r.cx AND n.cy = r.cy AND n.k = r.k + 1)""",
    recursive=True,
)
def dd2_cell_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untracked persons by camera and cell of 50 pixels."""
    d = detections(spark, sf_dir).where("class_name = 'person' and track_id < 0")
    return cooldown(d.withColumn("cx", F.expr("(x1 + x2) div 100")).withColumn("cy", F.expr("(y1 + y2) div 100")), ["camera_id", "cx", "cy"], 7200)


@query(
    "SELECT event_id FROM g WHERE before IS NULL OR sec - before >= 345600",
    "g AS (SELECT *, lag(sec) OVER (PARTITION BY camera_id, plate ORDER BY sec, event_id) AS before FROM det WHERE class_name <> 'person')",
)
def dd3_parked_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sighting refreshes the clock, so the gate compares with the sighting before: a window, not a loop."""
    from pyspark.sql import Window

    before = F.lag("sec").over(Window.partitionBy("camera_id", "plate").orderBy("sec", "event_id"))
    d = detections(spark, sf_dir).where("class_name <> 'person'").withColumn("before", before)
    return d.where("before is null or sec - before >= 345600").select("event_id")


@query(
    "SELECT event_id FROM g WHERE place = 1",
    "g AS (SELECT *, row_number() OVER (PARTITION BY camera_id, sec // 7200 ORDER BY sec, event_id) AS place FROM det)",
)
def dd9_one_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("sec", "event_id")).alias("m")
    return detections(spark, sf_dir).groupBy("camera_id", F.expr("sec div 7200").alias("slot")).agg(first).select("m.event_id")
