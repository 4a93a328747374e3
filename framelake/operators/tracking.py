"""Boxes of one camera over its frames: tracks by a Kalman filter, and candidates of two detectors that become one list."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.kalman import Boxes, overlaps
from framelake.functions.stateful import overlap
from framelake.operators.gates import BOX, in_order
from framelake.plans.registry import query
from framelake.sources.tables import detections

FRAME = 900


def tracked(df: DataFrame, rule, frame: int) -> DataFrame:
    """event_id, track (null: too unsure, or new) of boxes (event_id, sec, camera_id, confidence, x1 to y2); those of ``frame``
    seconds are one frame. A camera's frames are cut where all its tracks have ended, so that a task holds the live tracks only."""
    d = df.withColumn("sec", (F.floor(F.col("sec") / frame) * frame).cast("long"))
    ordered = in_order(d, ["camera_id"], rule().quiet, ["confidence", *BOX], by_day=True)

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, start, _), own in groupby(rows, key=lambda r: r[:3]):
            state = rule()
            for now, boxes in groupby(own, key=lambda r: r[4]):
                boxes = list(boxes)  # columns: key and piece, event_id, sec, camera_id, confidence, box
                found = state.frame(now, np.array([r[7:11] for r in boxes], float), np.array([r[6] for r in boxes], float))
                yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in boxes]), pa.array([None if n is None else f"{start}-{n}" for n in found], pa.string())], names=["event_id", "track"])

    return ordered.mapInArrow(run, "event_id long, track string")


@query()
def ge19_filtered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an hour and tracks of twelve; boxes are drawn near their vehicle's usual place. Tested by plain formulas and a simulated path."""
    d = detections(spark, sf_dir).where("track_id >= 0")
    x, y = F.col("track_id") * 173 % 1500 + F.col("event_id") % 7, F.col("track_id") * 97 % 700 + F.col("event_id") % 5
    d = d.withColumns({"x1": x, "y1": y, "x2": x + 200, "y2": y + 150, "confidence": F.col("event_id") % 10 / 10.0})
    return tracked(d, lambda: Boxes(rate=1 / 3600, lost=43200, gate=1e9), FRAME)


class Argmax:
    """One camera's tracks, counted in frames: while any overlap reaches ``least``, the greatest one (the first box, then the first
    track, of equals) joins a box and a track; boxes left over begin tracks; a track ends once more than ``age`` frames in a row
    lack it, frames without a box included."""

    def __init__(self, frame: float, least: float = 0.3, age: int = 30):
        self.frame_seconds, self.least, self.age, self.made, self.tracks = frame, least, age, 0, {}

    @property
    def quiet(self) -> float:
        return (self.age + 1) * self.frame_seconds

    def frame(self, now: float, boxes: np.ndarray, scores: np.ndarray) -> list[int]:
        self.tracks = {n: t for n, t in self.tracks.items() if now - t[1] <= self.quiet}
        names, of = list(self.tracks), {}
        if names:
            near = overlaps(boxes, np.array([self.tracks[n][0] for n in names])).astype(np.float32)
            while (best := near.max()) >= self.least:
                k, t = np.unravel_index(int(near.argmax()), near.shape)
                of[int(k)] = names[t]
                near[k, :], near[:, t] = -1, -1
        for k in range(len(boxes)):
            if k not in of:
                self.made += 1
                of[k] = self.made
            self.tracks[of[k]] = (boxes[k], now)
        return [of[k] for k in range(len(boxes))]


@query()
def j8_argmax_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a quarter of an hour; boxes are drawn near their vehicle's usual place. Tested by a plain loop."""
    d = detections(spark, sf_dir).where("track_id >= 0")
    x, y = F.col("track_id") * 173 % 1500 + F.col("event_id") * 13 % 120, F.col("track_id") * 97 % 700 + F.col("event_id") * 7 % 60
    return tracked(d.withColumns({"x1": x, "y1": y, "x2": x + 200, "y2": y + 150}), lambda: Argmax(FRAME), FRAME)


def merged(first: list[tuple], second: list[tuple], same: float = 0.55, most: float = 0.45) -> list[tuple]:
    """Candidates (id, confidence, box or none) of two detectors as one list. A second one that overlaps a kept one by more than
    ``same`` takes its place if it is surer, else goes; then, surest first, those that overlap a kept one by more than ``most``
    go, and those without a box. Where a detector found nothing the other's list stays as it is."""
    if not first or not second:
        return first or second
    kept = list(first)
    for c in second:
        near = next((k for k, x in enumerate(kept) if c[2] and x[2] and overlap(x[2], c[2]) > same), None)
        if near is None:
            kept.append(c)
        elif c[1] > kept[near][1]:
            kept[near] = c
    out: list[tuple] = []
    for c in sorted(kept, key=lambda c: -c[1]):
        if c[2] and all(overlap(c[2], x[2]) <= most for x in out):
            out.append(c)
    return out


@query(
    "SELECT camera_id, slot, b.id AS event_id, place FROM (SELECT camera_id, slot, unnest(kept) AS b, unnest(range(len(kept))) AS place FROM z)",
    """d AS (SELECT camera_id, sec // 21600 AS slot, event_id, source = 'vehicles' AS second, {'id': event_id, 'c': CAST(confidence AS DOUBLE), 'x': x1 // 600 * 600 + event_id % 40, 'y': y1 // 300 * 300 + event_id % 30, 'boxed': event_id % 29 <> 0} AS b FROM det WHERE class_name <> 'person'),
  g AS (SELECT camera_id, slot, coalesce(list(b ORDER BY event_id) FILTER (WHERE NOT second), []) AS f, coalesce(list(b ORDER BY event_id) FILTER (WHERE second), []) AS s FROM d GROUP BY ALL),
  m AS (SELECT camera_id, slot, f AS kept, s, 0 AS k FROM g WHERE len(f) > 0 AND len(s) > 0
    UNION ALL SELECT camera_id, slot, CASE WHEN pos IS NULL OR pos = 0 THEN kept || [c] WHEN c.c > kept[pos].c THEN kept[:pos - 1] || [c] || kept[pos + 1:] ELSE kept END, s, k + 1 FROM (
      SELECT *, list_position(list_transform(kept, lambda o: o.boxed AND c.boxed AND (greatest(least(o.x + 150, c.x + 150) - greatest(o.x, c.x), 0) * greatest(least(o.y + 120, c.y + 120) - greatest(o.y, c.y), 0) / CAST(36000 - greatest(least(o.x + 150, c.x + 150) - greatest(o.x, c.x), 0) * greatest(least(o.y + 120, c.y + 120) - greatest(o.y, c.y), 0) AS DOUBLE)) > 0.55), true) AS pos FROM (SELECT *, s[k + 1] AS c FROM m WHERE k < len(s)))),
  w AS (SELECT camera_id, slot, unnest(kept) AS b, unnest(range(len(kept))) AS i FROM m WHERE k = len(s)),
  n AS (SELECT camera_id, slot, b, row_number() OVER (PARTITION BY camera_id, slot ORDER BY b.c DESC, i) AS k FROM w WHERE b.boxed),
  r AS (SELECT camera_id, slot, k, [b] AS kept FROM n WHERE k = 1
    UNION ALL SELECT n.camera_id, n.slot, n.k, CASE WHEN len(list_filter(r.kept, lambda o: (greatest(least(o.x + 150, n.b.x + 150) - greatest(o.x, n.b.x), 0) * greatest(least(o.y + 120, n.b.y + 120) - greatest(o.y, n.b.y), 0) / CAST(36000 - greatest(least(o.x + 150, n.b.x + 150) - greatest(o.x, n.b.x), 0) * greatest(least(o.y + 120, n.b.y + 120) - greatest(o.y, n.b.y), 0) AS DOUBLE)) > 0.45)) = 0 THEN r.kept || [n.b] ELSE r.kept END FROM r JOIN n ON n.camera_id = r.camera_id AND n.slot = r.slot AND n.k = r.k + 1),
  z AS (SELECT camera_id, slot, arg_max(kept, k) AS kept FROM r GROUP BY ALL UNION ALL SELECT camera_id, slot, f || s FROM g WHERE len(f) = 0 OR len(s) = 0)""",
    recursive=True,
)
def so5_merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one camera and six hours; what lies in one of nine fields of the picture is moved together, so that boxes
    overlap. One group's lists are in memory at a time. Tested by a plain loop."""
    d = detections(spark, sf_dir).where("class_name <> 'person'").withColumn("slot", F.expr("sec div 21600"))
    x, y = F.floor(F.col("x1") / 600) * 600 + F.col("event_id") % 40, F.floor(F.col("y1") / 300) * 300 + F.col("event_id") % 30
    box = F.when(F.col("event_id") % 29 != 0, F.array(x, y, x + 150, y + 120))
    d = d.select("camera_id", "slot", "event_id", "confidence", box.alias("box"), (F.col("source") == "vehicles").alias("second"))
    ordered = d.repartition("camera_id", "slot").sortWithinPartitions("camera_id", "slot", "second", "event_id")

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (camera, slot), own in groupby(rows, key=lambda r: r[:2]):
            lists: tuple[list, list] = ([], [])
            for _, _, event, sure, box, second in own:
                lists[second].append((event, sure, tuple(box) if box else None))
            got = merged(*lists)
            names = ["camera_id", "slot", "event_id", "place"]
            yield pa.RecordBatch.from_arrays([pa.array([camera] * len(got)), pa.array([slot] * len(got)), pa.array([c[0] for c in got]), pa.array(range(len(got)), pa.int64())], names=names)

    return ordered.mapInArrow(run, "camera_id string, slot long, event_id long, place long")
