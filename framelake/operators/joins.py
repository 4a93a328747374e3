"""Joins in time and space: nearest frame, fusion of vehicles and persons, duplicate probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.fusion import People
from framelake.plans.registry import query
from framelake.sources.tables import detections, messages

WINDOW = 6 * 3600
NEAR, FALLBACK = 1800, 7200


def around(events: DataFrame, frames: DataFrame, within: int, fallback: int = 0) -> DataFrame:
    """``events`` (event_id, camera_id, sec and more) with near and gap, of its camera's frame (frame_id, frame_sec) nearest in
    time, the earlier id on ties, if it is within so many seconds; and newest, the last one not after it, the later id on ties,
    if no more than ``fallback`` seconds old.

    Frames of one second are one row. Events and frames of a camera and slot go by in order of time, there and back, so an event
    meets the frame before it and the one after it only. A slot is eight times as long as what is looked for, and frames near
    its border go to the neighbour too, so that a hot camera splits by time.
    """
    reach = max(within, fallback)
    slot = lambda at: f"({at}) div {8 * reach}"
    f = frames.where("camera_id is not null and frame_sec is not null").groupBy("camera_id", F.col("frame_sec").alias("sec")).agg(F.min("frame_id").alias("_low"), F.max("frame_id").alias("_high"))
    f = f.withColumn("_slot", F.explode(F.expr(f"array_distinct(array({slot(f'sec - {within}')}, {slot('sec')}, {slot(f'sec + {reach}')}))")))
    f = f.select("camera_id", "sec", "_slot", F.struct("sec", "_low", "_high").alias("_f"))
    both = events.withColumn("_slot", F.expr(slot("sec"))).unionByName(f, allowMissingColumns=True).withColumn("_event", F.col("_f").isNull())
    passed = lambda *order: F.last("_f", True).over(Window.partitionBy("camera_id", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_a": passed("sec", "_event"), "_b": passed(F.desc("sec"), "_event")}).where("_event")
    gaps = [F.struct(gap.alias("gap"), F.col(c)["_low"].alias("id")) for c, gap in (("_a", F.col("sec") - F.col("_a.sec")), ("_b", F.col("_b.sec") - F.col("sec")))]
    best = F.least(*[F.when(g["gap"] <= within, g) for g in gaps])
    newest = F.when(F.col("sec") - F.col("_a.sec") <= fallback, F.col("_a._high"))
    return met.withColumn("_best", best).select(*events.columns, F.col("_best.id").alias("near"), F.col("_best.gap").alias("gap"), newest.alias("newest"))


def nearest_frame(events: DataFrame, frames: DataFrame, within: int) -> DataFrame:
    """Each event (event_id, camera_id, sec) with its camera's frame (frame_id, frame_sec) nearest in time, the earlier
    id on ties, if it is within so many seconds."""
    return around(events, frames, within).select("event_id", F.col("near").alias("frame_id"), "gap")


def frame_of(events: DataFrame, frames: DataFrame, within: int = NEAR, fallback: int = FALLBACK) -> DataFrame:
    """Each event (event_id, camera_id, sec, wanted) with a frame: the one it names, if its camera has it; else the nearest
    within ``within`` seconds; else the newest not after it, if no more than ``fallback`` seconds old."""
    asked = events.where("wanted is not null").join(frames.select("camera_id", F.col("frame_id").alias("wanted"), F.col("frame_id").alias("named")), ["camera_id", "wanted"], "left")
    got = around(asked.unionByName(events.where("wanted is null"), allowMissingColumns=True), frames, within, fallback)
    how = F.when(F.col("named").isNotNull(), "named").when(F.col("near").isNotNull(), "near").when(F.col("newest").isNotNull(), "newest")
    return got.select("event_id", F.coalesce("named", "near", "newest").alias("frame_id"), how.alias("how"))


@query(
    "SELECT e.event_id, coalesce(n.frame_id, g.frame_id, o.frame_id) AS frame_id, CASE WHEN n.frame_id IS NOT NULL THEN 'named' WHEN g.frame_id IS NOT NULL THEN 'near' WHEN o.frame_id IS NOT NULL THEN 'newest' END AS how FROM e LEFT JOIN fr n ON n.frame_id = e.wanted AND n.camera_id = e.camera_id LEFT JOIN g USING (event_id) LEFT JOIN o USING (event_id)",
    f"""e AS (SELECT event_id, camera_id, sec, CASE WHEN event_id % 3 = 0 THEN event_id - event_id % 4 END AS wanted FROM det WHERE event_id % 4 <> 0), fr AS (SELECT event_id AS frame_id, camera_id, sec AS frame_sec FROM det WHERE event_id % 4 = 0),
  g AS (SELECT event_id, frame_id FROM e JOIN fr ON e.camera_id = fr.camera_id AND abs(sec - frame_sec) <= {NEAR} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(sec - frame_sec), frame_id) = 1),
  o AS (SELECT event_id, frame_id FROM e JOIN fr ON e.camera_id = fr.camera_id AND frame_sec <= sec AND sec - frame_sec <= {FALLBACK} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY frame_sec DESC, frame_id DESC) = 1)""",
)
def j4_j5_frame_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    frames = d.where("event_id % 4 = 0").select("camera_id", F.col("event_id").alias("frame_id"), F.col("sec").alias("frame_sec"))
    wanted = F.when(F.col("event_id") % 3 == 0, F.col("event_id") - F.col("event_id") % 4).alias("wanted")
    return frame_of(d.where("event_id % 4 <> 0").select("event_id", "camera_id", "sec", wanted), frames)


@query(
    "SELECT d.event_id, frame_id, gap FROM det d LEFT JOIN (SELECT * FROM g WHERE place = 1) g USING (event_id) WHERE d.event_id % 4 <> 0",
    f"""g AS (SELECT d.event_id, f.event_id AS frame_id, abs(d.sec - f.sec) AS gap, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(d.sec - f.sec), f.event_id) AS place
  FROM det d JOIN det f ON f.event_id % 4 = 0 AND d.camera_id = f.camera_id AND abs(d.sec - f.sec) <= {NEAR} WHERE d.event_id % 4 <> 0)""",
)
def j4_j5_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    frames = d.where("event_id % 4 = 0").select("camera_id", F.col("event_id").alias("frame_id"), F.col("sec").alias("frame_sec"))
    return nearest_frame(d.where("event_id % 4 <> 0").select("event_id", "camera_id", "sec"), frames, NEAR)


def duplicates(df: DataFrame, ttl: int, most: int) -> DataFrame:
    """event_id of plates of which the same camera read one within ``most`` edits, no longer than ``ttl`` seconds before.

    Candidates share camera, the first three characters and a slot of time; lengths differ by one at most where edits are allowed.
    """
    e = df.withColumn("slot", F.expr(f"sec div {ttl}")).withColumn("head", F.substring("plate", 1, 3))
    b = e.select("camera_id", "head", F.col("event_id").alias("other"), F.col("sec").alias("before"), F.col("plate").alias("read"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    near = F.col("plate") == F.col("read") if not most else (F.abs(F.length("plate") - F.length("read")) <= 1) & F.levenshtein("plate", "read", most).between(0, most)
    earlier = (F.col("before") < F.col("sec")) | ((F.col("before") == F.col("sec")) & (F.col("other") < F.col("event_id")))
    return e.join(b, ["camera_id", "head", "slot"]).where(earlier & (F.col("sec") - F.col("before") <= ttl) & near).select("event_id").distinct()


DUPLICATE = """SELECT DISTINCT a.event_id FROM det a JOIN det b ON a.camera_id = b.camera_id AND (b.sec < a.sec OR b.sec = a.sec AND b.event_id < a.event_id)
  AND a.sec - b.sec <= 86400 AND b.class_name <> 'person' WHERE a.class_name <> 'person' AND """


@query(DUPLICATE + "a.plate = b.plate")
def j9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(detections(spark, sf_dir).where("class_name <> 'person'"), 86400, 0)


@query(DUPLICATE + "substr(a.plate, 1, 3) = substr(b.plate, 1, 3) AND abs(length(a.plate) - length(b.plate)) <= 1 AND levenshtein(a.plate, b.plate) <= 2")
def j10_dd7_fuzzy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the source's unordered limit of five candidates, which has no defined result."""
    return duplicates(detections(spark, sf_dir).where("class_name <> 'person'"), 86400, 2)


#: Pairs that go out together.
PAIRS = 65_536


def _by_window(df: DataFrame, window: int) -> DataFrame:
    """Events dealt by camera and window; of each its persons, then its vehicles by time."""
    box_of = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    d = df.select("camera_id", F.expr(f"sec div {window}").alias("slot"), (F.col("class_name") != "person").alias("vehicle"), "sec", "event_id", "track_id", (F.col("class_name") == "motorcycle").alias("motorcycle"), *box_of)
    return d.dropna().repartition("camera_id", "slot").sortWithinPartitions("camera_id", "slot", "vehicle", "sec", "event_id")


def _vehicles(batches):
    """camera_id, slot, sec, event_id, box and kind of each vehicle, with the ``People`` of its window."""
    window, people, rows = None, None, []
    for b in batches:
        for camera, slot, vehicle, sec, event, track, motorcycle, *corners in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (camera, slot) != window:
                window, people, rows = (camera, slot), None, []
            if not vehicle:
                rows.append((event, track, *corners))
            elif rows:
                people = people or People(rows)
                yield camera, slot, sec, event, (*corners, motorcycle), people


def fusion_candidates(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs of a vehicle and a person of one camera and window, with a score above 0, by ``People``: vehicles meet the persons
    of their height in the picture, so that the work goes with the pairs there are. A task holds one window's persons."""
    names = ["camera_id", "slot", "vehicle_id", "vehicle_sec", "person_id", "track_id", "score"]

    def batch(out):
        n = [len(r[-1]) for r in out]
        whole = [pa.array(np.repeat(np.array([r[k] for r in out]), n)) for k in range(4)]
        return pa.RecordBatch.from_arrays([whole[0].cast(pa.string()), *whole[1:], *[pa.array(np.concatenate([r[k] for r in out])) for k in (4, 5, 6)]], names=names)

    def run(batches):
        out, size = [], 0
        for camera, slot, sec, event, seen, people in _vehicles(batches):
            at, score = people.near(*seen)
            if len(at):
                out.append((camera, slot, event, sec, people.ids[at], people.tracks[at], score))
                size += len(at)
            if size >= PAIRS:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return _by_window(df, window).mapInArrow(run, "camera_id string, slot long, vehicle_id long, vehicle_sec long, person_id long, track_id long, score double")


CANDIDATES = f"""pairs AS (SELECT v.camera_id, v.sec // {WINDOW} AS slot, v.event_id AS vehicle_id, p.event_id AS person_id, v.class_name, v.x1, v.y1, v.x2, v.y2, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2
  FROM det v JOIN det p ON v.camera_id = p.camera_id AND v.sec // {WINDOW} = p.sec // {WINDOW} AND v.class_name <> 'person' AND p.class_name = 'person'),
  o AS (SELECT *, greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) AS inter FROM pairs),
  s AS (SELECT *, CASE WHEN class_name = 'motorcycle' THEN CASE WHEN CAST(inter AS DOUBLE) / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - inter) > 0.3
      THEN CAST(inter AS DOUBLE) / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - inter) END
    WHEN (px1 + px2) / 2.0 BETWEEN x1 AND x2 AND (py1 + py2) / 2.0 BETWEEN y1 - 0.15 * (y2 - y1) AND y1 + 0.3 * (y2 - y1) THEN 1 - ((py1 + py2) / 2.0 - y1) / (0.3 * (y2 - y1) + 1e-9) END AS score FROM o)"""


@query("SELECT camera_id, slot, vehicle_id, person_id, round(score, 6) AS score FROM s WHERE score > 0", CANDIDATES)
def j2_fusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_candidates(detections(spark, sf_dir)).select("camera_id", "slot", "vehicle_id", "person_id", F.round("score", 6).alias("score"))


def matched(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Greedy one to one within a camera and window: vehicles by time, each takes the best person left; a track is taken once.

    One pass goes through the events, without the pairs: a task keeps the persons that are left in the window it is in.
    """

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["vehicle_id", "person_id", "score"])

    def run(batches):
        out = []
        for _, _, _, event, seen, people in _vehicles(batches):
            if found := people.take(*seen):
                out.append((event, *found))
            if len(out) >= PAIRS:
                yield batch(out)
                out = []
        yield batch(out)

    return _by_window(df, window).mapInArrow(run, "vehicle_id long, person_id long, score double")


#: Pairs in the order in which they are looked at, and what is taken so far.
MATCHED = (
    CANDIDATES
    + """, n AS (SELECT s.camera_id, s.slot, s.vehicle_id, s.person_id, s.score, p.track_id, row_number() OVER (PARTITION BY s.camera_id, s.slot ORDER BY v.sec, s.vehicle_id, s.score DESC, s.person_id) AS k
    FROM s JOIN det v ON v.event_id = s.vehicle_id JOIN det p ON p.event_id = s.person_id WHERE s.score > 0),
  r AS (SELECT camera_id, slot, k, vehicle_id, person_id, score, true AS ok, vehicle_id AS served, [person_id] AS people, [track_id] AS tracks FROM n WHERE k = 1
    UNION ALL SELECT camera_id, slot, k, vehicle_id, person_id, score, ok, CASE WHEN ok THEN vehicle_id ELSE served END, CASE WHEN ok THEN people || [person_id] ELSE people END, CASE WHEN ok THEN tracks || [track_id] ELSE tracks END FROM (
      SELECT n.*, r.served, r.people, r.tracks, n.vehicle_id <> r.served AND NOT list_contains(r.people, n.person_id) AND (n.track_id < 0 OR NOT list_contains(r.tracks, n.track_id)) AS ok FROM r JOIN n ON n.camera_id = r.camera_id AND n.slot = r.slot AND n.k = r.k + 1)),
  matched AS (SELECT vehicle_id, person_id, score FROM r WHERE ok)"""
)


@query(
    """SELECT d.camera_id, d.event_id AS vehicle_id, m.person_id, d.class_name, d.plate, round(m.score, 6) AS score FROM det d LEFT JOIN matched m ON m.vehicle_id = d.event_id WHERE d.class_name <> 'person'
  UNION ALL SELECT camera_id, NULL, event_id, class_name, NULL, NULL FROM det WHERE class_name = 'person' AND event_id NOT IN (SELECT person_id FROM matched)""",
    MATCHED,
    recursive=True,
)
def j2_vehicle_person_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle with its person, if any, and every person left over (J2, J3). Tested by a plain loop.

    Matches come once, as a row for each of the two, and one join gives events theirs.
    """
    d = detections(spark, sf_dir)
    score = F.round("score", 6).alias("score")
    ends = [F.struct(F.col(a).alias("event_id"), F.col(b).alias("partner"), score) for a, b in (("vehicle_id", "person_id"), ("person_id", "vehicle_id"))]
    both = d.join(matched(d).select(F.inline(F.array(*ends))), "event_id", "left")
    person = F.col("class_name") == "person"
    both = both.where(~person | F.col("partner").isNull())
    return both.select(
        "camera_id", F.when(~person, F.col("event_id")).alias("vehicle_id"), F.when(person, F.col("event_id")).otherwise(F.col("partner")).alias("person_id"), "class_name", F.when(~person, F.col("plate")).alias("plate"), "score"
    )


def has_face() -> Column:
    """Does a person's message name someone, or say how sure a face is?"""
    named = (F.coalesce(F.trim("face_identity"), F.lit("")) != "") & (F.trim("face_identity") != "Unknown")
    return F.coalesce(named | (F.col("face_confidence").try_cast("double") > 0), F.lit(False))


@query(
    "SELECT d.event_id, d.camera_id, m.face_identity, TRY_CAST(m.face_confidence AS DOUBLE) AS face_confidence FROM det d JOIN msg m USING (event_id) WHERE d.class_name = 'person' AND d.event_id NOT IN (SELECT person_id FROM matched) AND (trim(coalesce(m.face_identity, '')) NOT IN ('', 'Unknown') OR coalesce(TRY_CAST(m.face_confidence AS DOUBLE) > 0, false))",
    MATCHED,
    recursive=True,
)
def j3_standalone_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that no vehicle has and of whose face something is known. Tested by a plain loop."""
    people = detections(spark, sf_dir).where("class_name = 'person'").select("event_id", "camera_id")
    taken = matched(detections(spark, sf_dir)).select(F.col("person_id").alias("event_id"))
    faces = messages(spark, sf_dir).where(has_face()).select("event_id", "face_identity", "face_confidence")
    return people.join(taken, "event_id", "left_anti").join(faces, "event_id").select("event_id", "camera_id", "face_identity", F.col("face_confidence").try_cast("double").alias("face_confidence"))
