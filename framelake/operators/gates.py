"""Stateful rules over keys, in batch: each key's events are cut where its rule forgets, and the pieces go to tasks.

No piece holds more than what happens without such a gap, so a key with years of events is many small groups. The cut is
a window over the key in order of time, which streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.stateful import Jitter, Spot, Still, Tracker, Votes, greedy
from framelake.plans.registry import query
from framelake.sources.sinks import kept
from framelake.sources.tables import detections

TTL, PARKED, IDLE = 86400, 345600, 21600


def pieces(df: DataFrame, keys: list[str], gap: float, by_day: bool = False) -> DataFrame:
    """``df`` with piece: the time at which the run of a key's events, with no more than ``gap`` seconds between two, begins.

    With ``by_day``, for keys with long histories, windows reach over a day of a key, and what goes from one day to the next
    is a window over a row a day.
    """
    per = [*keys, "_day"] if by_day else keys
    w = Window.partitionBy(*per).orderBy("sec", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d, before = df, F.lag("sec").over(w)
    if by_day:
        days = Window.partitionBy(*keys).orderBy("_day")
        d = d.withColumn("_day", F.floor(F.col("sec") / 86400))
        ends = d.groupBy(*per).agg(F.max("sec").alias("_end")).withColumn("_end", F.lag("_end").over(days))
        d, before = d.join(ends, per), F.coalesce(before, F.col("_end"))
    starts = F.when(F.coalesce(F.col("sec") - before > gap, F.lit(True)), F.struct("sec", "event_id"))
    d = d.withColumn("_s", starts)
    own = F.last("_s", True).over(so_far)
    if by_day:
        last = d.groupBy(*per).agg(F.max("_s").alias("_old"))
        d = d.join(last.withColumn("_old", F.last("_old", True).over(days.rowsBetween(Window.unboundedPreceding, -1))), per)
        own = F.coalesce(own, F.col("_old"))
    return d.withColumn("piece", own).drop("_s", "_day", "_end", "_old")


def in_order(df: DataFrame, keys: list[str], gap: float, columns: list[str], by_day: bool = False) -> DataFrame:
    """Pieces dealt to tasks and each in order: columns are those of the key and its piece, then event_id, sec and ``columns``."""
    cut = pieces(df.select(*dict.fromkeys(["event_id", "sec", *keys, *columns])), keys, gap, by_day)
    begins = [F.col("piece.sec").alias("_sec"), F.col("piece.event_id").alias("_id")]
    cut = cut.select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)], *begins, *dict.fromkeys(["event_id", "sec", *keys, *columns]))
    names = cut.columns[: len(keys) + 2]
    return cut.repartition(*names).sortWithinPartitions(*names, "sec", "event_id")


def gated(df: DataFrame, keys: list[str], rule: Callable[[], object], columns: list[str]) -> DataFrame:
    """event_id of the events that pass their key's rule. ``columns`` are what the rule reads besides sec.

    One pass over a task's pieces; it holds the state of one piece at a time.
    """
    ordered, width = in_order(df, keys, rule().quiet, columns), len(keys) + 2
    names = ordered.columns[width:]

    def run(batches):
        last = state = None
        for b in batches:
            passed = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:width] != last:
                    last, state = row[:width], rule()
                e = SimpleNamespace(zip(names, row[width:], strict=True))
                if state.step(e):
                    passed.append(e.event_id)
            yield pa.RecordBatch.from_arrays([pa.array(passed, pa.int64())], names=["event_id"])

    return ordered.mapInArrow(run, "event_id long")


def stepped(df: DataFrame, keys: list[str], rule: Callable[[], object], columns: list[str], schema: str, row: Callable[[SimpleNamespace, tuple], tuple]) -> DataFrame:
    """A row of ``schema`` for each event: ``row`` of the event and of what its key's rule gives for it; one pass, as in ``gated``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered, width = in_order(df, keys, rule().quiet, columns, by_day=keys == ["camera_id"]), len(keys) + 2
    names, arrow = ordered.columns[width:], to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        last = state = None
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:width] != last:
                    last, state = r[:width], rule()
                e = SimpleNamespace(zip(names, r[width:], strict=True))
                out.append(row(e, state.step(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("class_name <> 'person'").withColumn("head", F.substring(F.upper(F.regexp_replace("plate", "[-. ]", "")), 1, 3))


BOX = ["x1", "y1", "x2", "y2"]


@query(
    "SELECT event_id FROM g WHERE before IS NULL OR sec - before >= 345600 OR sqrt(CAST((cx - px) * (cx - px) + (cy - py) * (cy - py) AS DOUBLE)) > 140",
    """g AS (SELECT *, lag(sec) OVER w AS before, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM (SELECT *, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM det WHERE class_name <> 'person')
  WINDOW w AS (PARTITION BY camera_id, plate ORDER BY sec, event_id))""",
)
def dd3_ge10_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plate passes again when it has moved by more than 140 pixels or 96 hours have gone since it was last seen. Every
    sighting restarts the clock, so the one before decides."""
    w = Window.partitionBy("camera_id", "plate").orderBy("sec", "event_id")
    d = vehicles(spark, sf_dir).withColumn("cx", F.expr("(x1 + x2) div 2")).withColumn("cy", F.expr("(y1 + y2) div 2"))
    d = d.select("event_id", "sec", "cx", "cy", F.lag("sec").over(w).alias("before"), F.lag("cx").over(w).alias("bx"), F.lag("cy").over(w).alias("by"))
    far = F.sqrt(((F.col("cx") - F.col("bx")) * (F.col("cx") - F.col("bx")) + (F.col("cy") - F.col("by")) * (F.col("cy") - F.col("by"))).cast("double"))
    return d.where(F.col("before").isNull() | (F.col("sec") - F.col("before") >= PARKED) | (far > 140)).select("event_id")


@query(
    'SELECT event_id FROM r WHERE passes',
    """n AS (SELECT *, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy, row_number() OVER (PARTITION BY camera_id, plate ORDER BY sec, event_id) AS k FROM det WHERE class_name <> 'person'),
  r AS (SELECT camera_id, plate, k, event_id, true AS passes, sec AS ls, cx AS lx, cy AS ly FROM n WHERE k = 1
    UNION ALL SELECT camera_id, plate, k, event_id, passes, CASE WHEN renew THEN sec ELSE ls END, CASE WHEN renew THEN cx ELSE lx END, CASE WHEN renew THEN cy ELSE ly END FROM (
      SELECT *, CASE WHEN far <= 140 AND gap < 345600 THEN false WHEN gap < 86400 THEN far > 200 ELSE true END AS passes, CASE WHEN far <= 140 AND gap < 345600 THEN true WHEN gap < 86400 THEN far > 200 ELSE true END AS renew FROM (
        SELECT n.*, r.ls, r.lx, r.ly, n.sec - r.ls AS gap, sqrt(CAST((n.cx - r.lx) * (n.cx - r.lx) + (n.cy - r.ly) * (n.cy - r.ly) AS DOUBLE)) AS far FROM r JOIN n ON n.camera_id = r.camera_id AND n.plate = r.plate AND n.k = r.k + 1)))""",
    recursive=True,
)
def dd4_spot_or_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by a plain loop."""
    return gated(vehicles(spark, sf_dir), ["camera_id", "plate"], lambda: Spot(TTL, PARKED), BOX)


@query(
    "SELECT event_id FROM r WHERE ok",
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, head ORDER BY sec, event_id) AS k FROM (SELECT *, substr(l, 1, 3) AS head FROM (SELECT event_id, sec, camera_id, track_id, plate, upper(regexp_replace(plate, '[-. ]', '', 'g')) AS l FROM det WHERE class_name <> 'person'))),
  r AS (SELECT camera_id, head, k, event_id, true AS ok, [{'track': track_id, 'plate': plate, 'l': l, 't': sec}] AS seen FROM n WHERE k = 1
    UNION ALL SELECT camera_id, head, k, event_id, NOT same AND coalesce(pos, 0) = 0, CASE WHEN same THEN live WHEN coalesce(pos, 0) > 0 THEN live[:pos - 1] || [{'track': live[pos].track, 'plate': live[pos].plate, 'l': live[pos].l, 't': sec}] || live[pos + 1:]
        WHEN coalesce(old, 0) > 0 THEN live[:old - 1] || [{'track': track_id, 'plate': plate, 'l': l, 't': sec}] || live[old + 1:] ELSE live || [{'track': track_id, 'plate': plate, 'l': l, 't': sec}] END FROM (
      SELECT *, len(list_filter(live, lambda x: x.track = track_id AND x.plate = plate AND sec - x.t < 86400)) > 0 AS same, list_position(list_transform(live, lambda x: x.track = track_id AND x.plate = plate), true) AS old,
        list_position(list_transform(live, lambda x: length(l) >= 6 AND length(x.l) >= 6 AND sec - x.t < 86400 AND levenshtein(x.l, l) <= 1), true) AS pos FROM (
        SELECT n.*, list_filter(r.seen, lambda x: n.sec - x.t <= 86400) AS live FROM r JOIN n ON n.camera_id = r.camera_id AND n.head = r.head AND n.k = r.k + 1)))""",
    recursive=True,
)
def dd5_jitter_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by a plain loop."""
    return gated(vehicles(spark, sf_dir), ["camera_id", "head"], lambda: Jitter(TTL), ["plate", "track_id"])


@query(
    "SELECT event_id FROM r WHERE ok",
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, head ORDER BY sec, event_id) AS k FROM (SELECT *, substr(l, 1, 3) AS head FROM (SELECT event_id, sec, camera_id, track_id, plate, upper(regexp_replace(plate, '[-. ]', '', 'g')) AS l FROM det WHERE class_name <> 'person'))),
  r AS (SELECT camera_id, head, k, event_id, true AS ok, [{'t': sec, 'plate': plate, 'l': l}] AS seen FROM n WHERE k = 1
    UNION ALL SELECT camera_id, head, k, event_id, near IS NULL, list_filter(live, lambda x: x.plate <> CASE WHEN near IS NULL THEN plate ELSE near.plate END) || [CASE WHEN near IS NULL THEN {'t': sec, 'plate': plate, 'l': l} ELSE {'t': sec, 'plate': near.plate, 'l': near.l} END] FROM (
      SELECT *, list_sort(list_filter(live, lambda x: length(l) >= 6 AND length(x.l) >= 6 AND levenshtein(x.l, l) <= 1))[1] AS near FROM (
        SELECT n.*, list_filter(r.seen, lambda x: n.sec - x.t < 86400) AS live FROM r JOIN n ON n.camera_id = r.camera_id AND n.head = r.head AND n.k = r.k + 1)))""",
    recursive=True,
)
def dd6_jitter_of_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by a plain loop."""
    return gated(vehicles(spark, sf_dir), ["camera_id", "head"], lambda: Jitter(TTL, by_track=False), ["plate"])


@query(
    'SELECT event_id FROM r WHERE ok',
    """m AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, plate ORDER BY sec, event_id) AS k FROM det WHERE class_name <> 'person'),
  n2 AS (SELECT camera_id, track_id, plate, k, event_id, sec, confidence >= 0.85 OR (SELECT count(*) FROM m b WHERE a.camera_id = b.camera_id AND a.track_id = b.track_id AND a.plate = b.plate AND b.k <= a.k AND a.sec - b.sec <= 86400) >= 2 AS can FROM m a),
  r AS (SELECT camera_id, track_id, plate, k, event_id, can AS ok, CASE WHEN can THEN sec END AS last FROM n2 WHERE k = 1
    UNION ALL SELECT n.camera_id, n.track_id, n.plate, n.k, n.event_id, n.can AND (r.last IS NULL OR n.sec - r.last >= 86400), CASE WHEN n.can AND (r.last IS NULL OR n.sec - r.last >= 86400) THEN n.sec ELSE r.last END
      FROM r JOIN n2 n ON n.camera_id = r.camera_id AND n.track_id = r.track_id AND n.plate = r.plate AND n.k = r.k + 1)""",
    recursive=True,
)
def dd8_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by a plain loop."""
    return gated(vehicles(spark, sf_dir), ["camera_id", "track_id", "plate"], lambda: Votes(TTL), ["confidence"])


@query(
    'SELECT event_id FROM r WHERE ok',
    """n AS (SELECT *, (x1 + x2) / CAST(2 AS DOUBLE) AS cx, (y1 + y2) / CAST(2 AS DOUBLE) AS cy, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id) AS k FROM det WHERE track_id >= 0),
  r AS (SELECT camera_id, track_id, k, event_id, true AS ok, cx AS lx, cy AS ly, sec AS seen, CAST(0 AS BIGINT) AS stood, sec AS passed FROM n WHERE k = 1
    UNION ALL SELECT camera_id, track_id, k, event_id, far OR stands < 2 OR sec - passed >= 86400, cx, cy, sec, stands, CASE WHEN far OR stands < 2 OR sec - passed >= 86400 THEN sec ELSE passed END FROM (
      SELECT *, CASE WHEN far THEN 0 ELSE stood + 1 END AS stands FROM (
        SELECT n.*, r.stood, r.passed, n.sec - r.seen > 345600 OR sqrt((n.cx - r.lx) * (n.cx - r.lx) + (n.cy - r.ly) * (n.cy - r.ly)) > 400 AS far FROM r JOIN n ON n.camera_id = r.camera_id AND n.track_id = r.track_id AND n.k = r.k + 1)))""",
    recursive=True,
)
def wn11_still_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements and numbers of frames that suit sparse events. Tested by a plain loop."""
    return gated(detections(spark, sf_dir).where("track_id >= 0"), ["camera_id", "track_id"], lambda: Still(PARKED, 400, 2, TTL), BOX)


@query()
def ge18_j7_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's boxes of one quarter of an hour are a frame. A track's name is where it begins, and its number. Tested by a plain loop."""
    d = detections(spark, sf_dir).withColumn("sec", F.expr("sec div 900 * 900"))
    return followed_boxes(d, lambda: Tracker(IDLE, 0.2), hits=2)


def followed_boxes(df: DataFrame, rule: Callable[[], Tracker], hits: int) -> DataFrame:
    """event_id, track and confirmed (it has ``hits`` boxes) of boxes (event_id, sec, camera_id, confidence, x1 to y2), of which those of one second are a frame.

    A camera's frames are cut at pauses, after which only the tracks of the frame before can go on, and only in the first frame.
    So pieces run apart, each as if nothing came before; then a camera's borders, the live tracks of one piece and the first
    boxes of the next, are matched in order, which says how tracks that begin a piece are to be called.
    """
    ordered = in_order(df, ["camera_id"], rule().quiet, ["confidence", *BOX], by_day=True)

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["camera_id", "start", "head", "event_id", "n", "boxes", "border"]
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        for (camera, start, event), own in groupby(rows, key=lambda r: r[:3]):
            state, first = rule(), None
            for now, frame in groupby(own, key=lambda r: r[4]):
                frame = list(frame)  # columns: key and piece, event_id, sec, camera_id, confidence, box
                boxes, scores = [r[7:11] for r in frame], [r[6] for r in frame]
                found = state.frame(now, boxes, scores)
                first = first or [[n, box, score] for (n, _), box, score in zip(found, boxes, scores, strict=True)]
                out += [(camera, start, event, r[3], n, k, None) for r, (n, k) in zip(frame, found, strict=True)]
                if len(out) >= 10000:
                    yield batch()
                    out = []
            border = json.dumps([first, [[n, t[0]] for n, t in state.tracks.items()]])
            out.append((camera, start, event, None, None, None, border))
        if out:
            yield batch()

    pieces_of = kept(ordered.mapInArrow(run, "camera_id string, start long, head long, event_id long, n long, boxes long, border string"))
    borders = pieces_of.where("border is not null").select("camera_id", "start", "head", "border").repartition("camera_id").sortWithinPartitions("camera_id", "start", "head")
    least = rule().least

    def named(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for camera, own in groupby(rows, key=lambda r: r[0]):
            live: dict[str, tuple] = {}  # names and boxes of the tracks that the piece before has left
            for _, start, head, border in own:
                first, left = json.loads(border)
                of = greedy(live, [tuple(box) for _, box, _ in first], [score for *_, score in first], least)
                names = {first[k][0]: name for k, name in of.items()}
                live = {names.get(n, f"{start}-{n}"): tuple(box) for n, box in left}
                if names:
                    columns = [pa.array([camera] * len(names)), pa.array([start] * len(names)), pa.array([head] * len(names)), pa.array(list(names)), pa.array(list(names.values()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["camera_id", "start", "head", "n", "name"])

    names = borders.mapInArrow(named, "camera_id string, start long, head long, n long, name string")
    boxes = pieces_of.where("border is null").join(names, ["camera_id", "start", "head", "n"], "left")
    own = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("n").cast("string"))
    return boxes.select("event_id", F.coalesce("name", own).alias("track"), (F.col("name").isNotNull() & F.lit(hits <= 2) | (F.col("boxes") >= hits)).alias("confirmed"))
