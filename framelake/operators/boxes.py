"""Geometry over boxes: filters, overlaps, suppression, regions of interest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.boxes import Survivors
from framelake.functions.geometry import box, inside, iou
from framelake.plans.registry import query
from framelake.sources.tables import FRAME_HEIGHT, FRAME_WIDTH, detections, faces

REGION = [(200, 100), (1500, 200), (1300, 900), (400, 800)]
IOU = """CASE WHEN (x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) > 0
  THEN CAST(greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) AS DOUBLE)
  / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0)) ELSE 0 END"""


@query(
    f"SELECT event_id, {IOU} AS iou FROM pairs WHERE px1 IS NOT NULL",
    """pairs AS (SELECT event_id, x1, y1, x2, y2, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2
  FROM det WINDOW w AS (PARTITION BY camera_id ORDER BY ts, event_id))""",
)
def ge1_iou_with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.operators.history import with_previous

    d = with_previous(detections(spark, sf_dir), box_names(), ["camera_id"], ["ts", "event_id"]).where("_before is not null")
    d = d.select("event_id", *box_names(), *[F.col("_before")[c].alias(f"p{c}") for c in box_names()])
    return d.select("event_id", iou(box(), box("p")).alias("iou"))


def box_names() -> list[str]:
    return ["x1", "y1", "x2", "y2"]


@query(
    'SELECT camera_id, hour, event_id, CAST(confidence AS DOUBLE) AS score FROM r WHERE ok',
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, hour ORDER BY confidence DESC, event_id) AS k FROM (SELECT *, sec // 3600 AS hour FROM det)),
  r AS (SELECT camera_id, hour, k, event_id, confidence, true AS ok, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM n WHERE k = 1
    UNION ALL SELECT camera_id, hour, k, event_id, confidence, ok, CASE WHEN ok THEN kept || [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ELSE kept END FROM (
      SELECT n.*, r.kept, NOT EXISTS (SELECT 1 FROM unnest(r.kept) u(q) WHERE (CASE WHEN greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0) > 0 THEN CAST(greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0) AS DOUBLE) / ((q.x2 - q.x1) * (q.y2 - q.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0)) ELSE 0 END) > 0.45) AS ok FROM r JOIN n ON n.camera_id = r.camera_id AND n.hour = r.hour AND n.k = r.k + 1))""",
    recursive=True,
)
def ge3_suppressed_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of non-maximum suppression in each camera and hour. Tested by a plain loop."""
    d = detections(spark, sf_dir).withColumn("hour", F.floor(F.col("sec") / 3600))
    return survivors(d.withColumn("score", F.col("confidence")), ["camera_id", "hour"], 0.45).select("camera_id", "hour", "event_id", "score")


def survivors(df: DataFrame, frame: list[str], most: float, inclusive: bool = False) -> DataFrame:
    """The rows of ``df`` (``frame``: a text and a number, event_id, score, x1 to y2) that survive suppression in their frame. They
    come by score and id, and a task keeps the survivors of the frame it is in, which are as many as fit into a picture."""
    box_of = [F.col(c).cast("double").alias(c) for c in box_names()]
    rows = df.select(*frame, "event_id", "score", *box_of).repartition(*frame).sortWithinPartitions(*frame, F.desc("score"), "event_id")

    def run(batches):
        last = state = None
        for b in batches:
            stay = []
            for first, second, *corners in zip(*(b.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 7)), strict=True):
                if (first, second) != last:
                    last, state = (first, second), Survivors(most, inclusive)
                stay.append(state.keep(*corners))
            yield b.filter(pa.array(stay, pa.bool_())).select([0, 1, 2, 3])

    return rows.mapInArrow(run, rows.select(*frame, "event_id", "score").schema)


@query(
    "SELECT event_id, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM c WHERE crossings % 2 = 1",
    "c AS (SELECT *, "
    + " + ".join(
        f"CASE WHEN ({ya} > (y1 + y2) / 2.0) <> ({yb} > (y1 + y2) / 2.0) AND (x1 + x2) / 2.0 < CAST({xb - xa} AS DOUBLE) * ((y1 + y2) / 2.0 - {ya}) / CAST({yb - ya} AS DOUBLE) + {xa} THEN 1 ELSE 0 END"
        for (xa, ya), (xb, yb) in zip(REGION, REGION[1:] + REGION[:1], strict=True)
    )
    + " AS crossings FROM det)",
)
def ge5_ge6_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    return detections(spark, sf_dir).where(inside(cx, cy, REGION)).select("event_id", cx.alias("cx"), cy.alias("cy"))


@query("""SELECT event_id, greatest(x1 - (x2 - x1) * CAST(0.1 AS DOUBLE), 0) AS ex1, greatest(y1 - (y2 - y1) * CAST(0.1 AS DOUBLE), 0) AS ey1,
  least(x2 + (x2 - x1) * CAST(0.1 AS DOUBLE), 1920) AS ex2, least(y2 + (y2 - y1) * CAST(0.1 AS DOUBLE), 1080) AS ey2 FROM det""")
def ge8_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1, x2, y2 = box()
    w, h = (x2 - x1) * 0.1, (y2 - y1) * 0.1
    zero = F.lit(0.0)
    return detections(spark, sf_dir).select(
        "event_id", F.greatest(x1 - w, zero).alias("ex1"), F.greatest(y1 - h, zero).alias("ey1"), F.least(x2 + w, F.lit(float(FRAME_WIDTH))).alias("ex2"), F.least(y2 + h, F.lit(float(FRAME_HEIGHT))).alias("ey2")
    )


@query("SELECT event_id, x1 / 1920.0 AS nx1, y1 / 1080.0 AS ny1, least(x2 / 1920.0, 1) AS nx2, least(y2 / 1080.0, 1) AS ny2 FROM det")
def pf26_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    sides = {"nx1": ("x1", FRAME_WIDTH), "ny1": ("y1", FRAME_HEIGHT), "nx2": ("x2", FRAME_WIDTH), "ny2": ("y2", FRAME_HEIGHT)}
    return detections(spark, sf_dir).select("event_id", *[F.least(F.greatest(F.col(c) / float(n), zero), one).alias(k) for k, (c, n) in sides.items()])


@query("""SELECT event_id FROM det WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) / 2073600.0 <= 0.02
  AND NOT ((x2 - x1) * (y2 - y1) / 2073600.0 > 0.01 AND confidence < 0.45)""")
def pf16_pf17_pf18_box_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without degenerate boxes, giant boxes and large weak ones; limits as parameters fit these frames."""
    share = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / float(FRAME_WIDTH * FRAME_HEIGHT)
    d = detections(spark, sf_dir).where("x2 > x1 and y2 > y1")
    return d.where(share <= 0.02).where(~((share > 0.01) & (F.col("confidence") < 0.45))).select("event_id")


@query("""SELECT event_id FROM det WHERE confidence >= 0.6 OR (x1 >= 1920 * (CASE WHEN class_name IN ('truck', 'bus') OR x2 - x1 > 300 THEN 0.04 ELSE 0.08 END)
  AND x2 <= 1920 * (1 - CASE WHEN class_name IN ('truck', 'bus') OR x2 - x1 > 300 THEN 0.04 ELSE 0.08 END))""")
def pf20_edge_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.when(F.col("class_name").isin("truck", "bus") | (F.col("x2") - F.col("x1") > 300), 0.04).otherwise(0.08)
    within = (F.col("x1") >= F.lit(FRAME_WIDTH) * margin) & (F.col("x2") <= F.lit(FRAME_WIDTH) * (F.lit(1) - margin))
    return detections(spark, sf_dir).where((F.col("confidence") >= 0.6) | within).select("event_id")


@query("""SELECT event_id, CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) > 3.2 THEN 'one' ELSE 'two' END AS lines,
  CAST(x2 - x1 AS DOUBLE) / (y2 - y1) BETWEEN 1.2 AND 7.0 AND x2 - x1 >= 20 AND y2 - y1 >= 10 AS plate_shaped FROM det""")
def ge17_pf34_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = w.cast("double") / h
    return detections(spark, sf_dir).select("event_id", F.when(aspect > 3.2, "one").otherwise("two").alias("lines"), (aspect.between(1.2, 7.0) & (w >= 20) & (h >= 10)).alias("plate_shaped"))


@query(
    "SELECT event_id, CAST(moved2 AS BIGINT) AS moved2 FROM m WHERE moved2 IS NOT NULL AND moved2 <= 140 * 140",
    """m AS (SELECT event_id, ((x1 + x2) - lag(x1 + x2) OVER w) * ((x1 + x2) - lag(x1 + x2) OVER w) + ((y1 + y2) - lag(y1 + y2) OVER w) * ((y1 + y2) - lag(y1 + y2) OVER w) AS moved2
  FROM det WHERE track_id >= 0 WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY ts, event_id))""",
)
def ge10_small_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance between twice the centres of a track's neighbouring boxes, where it is small."""
    w = Window.partitionBy("camera_id", "track_id").orderBy("ts", "event_id")
    x, y = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    dx, dy = x - F.lag(x).over(w), y - F.lag(y).over(w)
    return detections(spark, sf_dir).where("track_id >= 0").select("event_id", (dx * dx + dy * dy).alias("moved2")).where("moved2 <= 140 * 140")


@query(
    "SELECT camera_id, track_id, event_id, CAST(area AS BIGINT) AS area, place FROM r WHERE place <= 3",
    "r AS (SELECT camera_id, track_id, event_id, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY (x2 - x1) * (y2 - y1) DESC, event_id) AS place FROM det WHERE class_name <> 'person' AND track_id >= 0)",
)
def sl12_largest_per_vehicle(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """The largest boxes of each vehicle's track; each task keeps its own largest before the shuffle."""
    d = detections(spark, sf_dir).where("class_name <> 'person' and track_id >= 0").select("camera_id", "track_id", "event_id", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    place = F.row_number().over(Window.partitionBy("camera_id", "track_id").orderBy(F.desc("area"), "event_id"))
    return d.withColumn("place", place.cast("long")).where(F.col("place") <= most)


#: Bytes of probes that one pass over the faces sends to all tasks, through the driver.
PASS_BYTES = 32 << 20


class Probes:
    """What a pass sends to all tasks: probes with their norms; ``run`` gives each its best known face and its best of all of a batch."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int):
        self.ids, self.vectors, self.norms, self.block = ids, vectors, np.linalg.norm(vectors, axis=1), block

    def run(self, batches):
        for b in batches:
            ids, known = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            if not len(ids) or not len(self.ids):
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            nx = np.linalg.norm(x, axis=1)
            for k in range(0, len(self.ids), self.block):
                who, y, ny = self.ids[k : k + self.block], self.vectors[k : k + self.block], self.norms[k : k + self.block]
                s = np.where((nx[None, :] < 1e-9) | (ny[:, None] < 1e-9), 0.0, y @ x.T / np.maximum(ny[:, None] * nx[None, :], 1e-30)).round(12)
                s[who[:, None] == ids[None, :]] = -2
                for kind, some in (("known", known), ("all", np.ones(len(ids), bool))):
                    t = np.where(some[None, :], s, -2)
                    best = t.max(1)
                    match = np.where(t == best[:, None], ids[None, :], np.iinfo(np.int64).max).min(1)
                    real = best > -2
                    yield pa.RecordBatch.from_arrays([pa.array(who[real]), pa.array([kind] * int(real.sum())), pa.array(match[real]), pa.array(best[real])], names=["probe", "kind", "match", "similarity"])


def nearest_faces(probes: DataFrame, faces: DataFrame, block: int = 256) -> DataFrame:
    """probe, and of the faces (vec_id, known, v; vectors of one length) but itself the nearest known one and the nearest of all:
    match and similarity.

    All tasks have the probes, and each batch of faces meets them in blocks; a batch gives each probe's best. Of more probes
    than ``PASS_BYTES`` hold some go in another pass, so that faces are read once a pass and never copied.
    """
    spark, found = probes.sparkSession, None
    width = probes.select(F.size("v").alias("n")).first()
    passes = max(1, -(-probes.count() * 8 * (width.n if width else 1) // PASS_BYTES))
    for k in range(passes):
        own = probes.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k).select("vec_id", "v").toArrow().combine_chunks()
        vectors = np.array(own.column("v").to_pylist(), float).reshape(own.num_rows, -1)
        shared = spark.sparkContext.broadcast(Probes(own.column("vec_id").to_numpy(), vectors, block))
        met = faces.select("vec_id", "known", "v").mapInArrow(lambda batches, shared=shared: shared.value.run(batches), "probe long, kind string, match long, similarity double")
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("probe", "kind").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("b"))
    return best.select("probe", "kind", F.col("b.match").alias("match"), (-F.col("b.s")).alias("similarity"))


@query(
    """SELECT k.vec_id, CASE WHEN k.similarity > 0.35 THEN k.match ELSE a.match END AS match, round(CASE WHEN k.similarity > 0.35 THEN k.similarity ELSE a.similarity END, 6) AS similarity,
  CASE WHEN k.similarity > 0.35 THEN 'known' WHEN a.similarity > 0.35 THEN 'seen' ELSE 'new' END AS found FROM a LEFT JOIN k ON k.vec_id = a.vec_id""",
    """m AS (SELECT p.vec_id, f.vec_id AS match, f.known, round(list_cosine_similarity(p.v, f.v), 12) AS similarity FROM face p JOIN face f ON NOT f.deleted AND f.vec_id <> p.vec_id WHERE p.vec_id % 100 = 0),
  k AS (SELECT vec_id, match, similarity FROM m WHERE known QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match) = 1), a AS (SELECT vec_id, match, similarity FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match) = 1)""",
)
def j14_ge15_ge16_known_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known face by cosine where 1 - similarity is under 0.65, else the nearest of all. Probes are the faces whose
    id is divisible by 100, against all that aren't deleted."""
    f = faces(spark, sf_dir)
    got = nearest_faces(f.where("vec_id % 100 = 0").select("vec_id", "v"), f.where("not deleted").select("vec_id", "known", "v"))
    by = got.groupBy("probe").agg(*[F.max(F.when(F.col("kind") == k, F.struct("similarity", "match"))).alias(k) for k in ("known", "all")])
    known, seen = F.col("known.similarity") > 0.35, F.col("all.similarity") > 0.35
    b = F.when(known, F.col("known")).otherwise(F.col("all"))
    return by.select(F.col("probe").alias("vec_id"), b["match"].alias("match"), F.round(b["similarity"], 6).alias("similarity"), F.when(known, "known").when(seen, "seen").otherwise("new").alias("found"))
