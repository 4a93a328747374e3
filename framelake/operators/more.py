"""Further operators: trackers, gates and exports that build on the families beside this module."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.boxes import Overlapped
from framelake.functions.geometry import box

from framelake.plans.registry import query
from framelake.sources.tables import FRAME_HEIGHT, FRAME_WIDTH, cameras, detections



@query("""SELECT event_id, greatest(x1 - greatest(w * p, m), 0) AS ex1, greatest(y1 - greatest(h * q, n), 0) AS ey1, least(x2 + greatest(w * p, m), 1920) AS ex2, least(y2 + greatest(h * q, n), 1080) AS ey2 FROM (
  SELECT *, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h, CAST(CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 3.2 THEN 0.3 ELSE 0.25 END AS DOUBLE) AS p,
    CAST(CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 3.2 THEN 0.25 ELSE 0.2 END AS DOUBLE) AS q, CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 3.2 THEN 20 ELSE 15 END AS m,
    CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 3.2 THEN 15 ELSE 10 END AS n FROM det)""")
def ge21_padded_plate_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding by shape: compact plates 30 and 25 percent, 20 and 15 pixels at least; others 25 and 20 percent, 15 and 10 pixels."""
    x1, y1, x2, y2 = box()
    w, h = x2 - x1, y2 - y1
    compact = w / h < 3.2
    dx = F.greatest(w * F.when(compact, 0.3).otherwise(0.25), F.when(compact, 20.0).otherwise(15.0))
    dy = F.greatest(h * F.when(compact, 0.25).otherwise(0.2), F.when(compact, 15.0).otherwise(10.0))
    zero = F.lit(0.0)
    return detections(spark, sf_dir).select(
        "event_id", F.greatest(x1 - dx, zero).alias("ex1"), F.greatest(y1 - dy, zero).alias("ey1"), F.least(x2 + dx, F.lit(float(FRAME_WIDTH))).alias("ex2"), F.least(y2 + dy, F.lit(float(FRAME_HEIGHT))).alias("ey2")
    )


@query("""SELECT event_id, (x1 + x2) / 2.0 - 1.4 * (x2 - x1) AS vx1, (x1 + x2) / 2.0 + 1.4 * (x2 - x1) AS vx2, y1 - CAST(4.5 AS DOUBLE) * (y2 - y1) AS vy1, y2 + CAST(2.2 AS DOUBLE) * (y2 - y1) AS vy2 FROM det WHERE class_name <> 'person'""")
def ge13_vehicle_from_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vehicle's box from its plate's: 2.8 widths across, 4.5 heights above and 2.2 below."""
    x1, y1, x2, y2 = box()
    c, w, h = (x1 + x2) / 2, x2 - x1, y2 - y1
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    return d.select("event_id", (c - F.lit(1.4) * w).alias("vx1"), (c + F.lit(1.4) * w).alias("vx2"), (y1 - F.lit(4.5) * h).alias("vy1"), (y2 + F.lit(2.2) * h).alias("vy2"))


@query("""SELECT event_id, CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) <= 1.7 AND (x2 - x1) * (y2 - y1) / 2073600.0 >= 0.015 AND (x2 - x1) * (y2 - y1) <= 45000 AND class_name = 'car'
  THEN 'motorcycle' ELSE class_name END AS refined FROM det""")
def ge11_refined_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1, x2, y2 = box()
    area = (x2 - x1) * (y2 - y1)
    bike = ((x2 - x1) / (y2 - y1) <= 1.7) & (area / float(FRAME_WIDTH * FRAME_HEIGHT) >= 0.015) & (area <= 45000) & (F.col("class_name") == "car")
    return detections(spark, sf_dir).select("event_id", F.when(bike, "motorcycle").otherwise(F.col("class_name")).alias("refined"))


@query(
    "SELECT event_id, best FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, best) AS place FROM c) WHERE place = 1 AND score >= 0.1",
    """c AS (SELECT a.event_id, b.event_id AS best, CAST(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS DOUBLE)
  / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) AS score
  FROM det a JOIN det b ON a.camera_id = b.camera_id AND a.sec // 21600 = b.sec // 21600 AND a.event_id % 2 = 0 AND b.event_id % 2 = 1)""",
)
def j6_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even event with the odd one of its camera and window that it overlaps most, 0.1 at least. A task holds one window's
    odd boxes; those as good as equal go on, and their rounded overlaps and ids decide."""
    d = detections(spark, sf_dir).select("camera_id", F.expr("sec div 21600").alias("slot"), (F.col("event_id") % 2 == 0).alias("even"), "event_id", *[c.alias(n) for c, n in zip(box(), ("x1", "y1", "x2", "y2"), strict=True)])
    rows = d.dropna().repartition("camera_id", "slot").sortWithinPartitions("camera_id", "slot", "even")

    def run(batches):
        window, odd, others = None, [], None
        for b in batches:
            out = []
            for camera, slot, even, event, *corners in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (camera, slot) != window:
                    window, odd, others = (camera, slot), [], None
                if not even:
                    odd.append((event, *corners))
                elif odd:
                    others = others or Overlapped(odd)
                    out += [(event, int(o), float(s)) for o, s in zip(*others.best(*corners, 0.1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["event_id", "other", "score"])

    best = F.max_by("other", F.struct(F.round("score", 9), -F.col("other"))).alias("best")
    return rows.mapInArrow(run, "event_id long, other long, score double").groupBy("event_id").agg(best)


@query("SELECT track_id, max(sec) AS sec, arg_max(plate, sec * 10000000 + event_id) AS plate FROM det WHERE track_id >= 0 GROUP BY track_id")
def ag31_sk3_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins per track: the view over appended versions that stands for updates in place."""
    last = F.max_by("plate", F.col("sec") * 10000000 + F.col("event_id"))
    return detections(spark, sf_dir).where("track_id >= 0").groupBy("track_id").agg(F.max("sec").alias("sec"), last.alias("plate"))


FRAME = "SELECT *, sec // 3600 AS slot, (y1 + y2) / CAST(2 AS DOUBLE) AS yc FROM det WHERE class_name <> 'person'"


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with their frame, here of one camera and hour, and the height of their middle."""
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    return d.withColumn("slot", F.expr("sec div 3600")).withColumn("yc", (F.col("y1") + F.col("y2")) / 2.0)


@query(
    "SELECT camera_id, slot, string_agg(plate, '' ORDER BY line, x1, event_id) AS text, min(confidence) AS confidence, count(DISTINCT line) AS lines FROM n GROUP BY camera_id, slot",
    f"""f AS ({FRAME}), g AS (SELECT *, yc - lag(yc) OVER w AS dy, avg(y2 - y1) OVER (PARTITION BY camera_id, slot) AS tall FROM f WINDOW w AS (PARTITION BY camera_id, slot ORDER BY yc, event_id)),
  n AS (SELECT *, sum(CASE WHEN dy >= 0.5 * tall THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, slot ORDER BY yc, event_id ROWS UNBOUNDED PRECEDING) AS line FROM g)""",
)
def ag22_joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a frame from top to bottom; a line ends where the next one lies half a mean height lower. Lines go from
    left to right, and the least confidence counts."""
    frame = Window.partitionBy("camera_id", "slot")
    down = frame.orderBy("yc", "event_id")
    d = framed(spark, sf_dir).withColumn("dy", F.col("yc") - F.lag("yc").over(down)).withColumn("tall", F.avg(F.col("y2") - F.col("y1")).over(frame))
    d = d.withColumn("line", F.sum(F.when(F.col("dy") >= F.col("tall") * 0.5, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "x1", "event_id", "plate")))
    by = d.groupBy("camera_id", "slot").agg(parts.alias("p"), F.min("confidence").alias("confidence"), (F.max("line") + 1).alias("lines"))
    return by.select("camera_id", "slot", F.array_join("p.plate", "").alias("text"), "confidence", "lines")


@query(
    "SELECT camera_id, slot, string_agg(plate, '' ORDER BY two AND yc > middle, x1, event_id) AS text, min(confidence) AS confidence, bool_or(two) AS two FROM t GROUP BY camera_id, slot",
    f"""f AS ({FRAME}), s AS (SELECT camera_id, slot, max(yc) - min(yc) > 0.2 * (max(y2) - min(y1)) AS two, list_sort(list(yc))[count(*) // 2 + 1] AS middle FROM f GROUP BY ALL), t AS (SELECT * FROM f JOIN s USING (camera_id, slot))""",
)
def ag28_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines where the middles spread over a fifth of the frame's height, parted at the upper median; else one."""
    d = framed(spark, sf_dir)
    s = d.groupBy("camera_id", "slot").agg(
        (F.max("yc") - F.min("yc") > F.lit(0.2) * (F.max("y2") - F.min("y1"))).alias("two"), F.sort_array(F.collect_list("yc")).alias("ys"), F.array_sort(F.collect_list(F.struct("x1", "event_id", "yc", "plate"))).alias("p"), F.min("confidence").alias("confidence")
    )
    s = s.withColumn("middle", F.get("ys", F.expr("cast(size(ys) div 2 as int)")))
    low = F.filter("p", lambda q: F.col("two") & (q["yc"] > F.col("middle")))
    top = F.filter("p", lambda q: ~(F.col("two") & (q["yc"] > F.col("middle"))))
    return s.select("camera_id", "slot", F.array_join(F.concat(top["plate"], low["plate"]), "").alias("text"), "confidence", "two")


@query("SELECT camera_id, replace(url, 'rtsp://', 'rtsp://user:pass@') AS url FROM cam WHERE regexp_matches(url, '^rtsp://')")
def sf33_urls_with_login(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir).where(F.col("url").rlike("^rtsp://"))
    return c.select("camera_id", F.replace("url", F.lit("rtsp://"), F.lit("rtsp://user:pass@")).alias("url"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sf35_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "SELECT event_id, greatest(share, CASE WHEN n > 15 THEN CAST(0.15 AS DOUBLE) ELSE 0 END) * CASE WHEN class_name = 'motorcycle' THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS ratio FROM c",
    "c AS (SELECT event_id, class_name, count(*) OVER (PARTITION BY camera_id, sec // 21600) AS n, least((count(*) OVER (PARTITION BY sec // 21600) - 100) / CAST(100 AS DOUBLE), CAST(0.25 AS DOUBLE)) AS share FROM det)",
)
def st8_st11_effective_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of the backlog's share, a quarter at most, and the camera's; half for motorcycles. Counts are joined back."""
    d = detections(spark, sf_dir).withColumn("slot", F.expr("sec div 21600"))
    own = d.groupBy("camera_id", "slot").agg(F.count("*").alias("n"))
    every = own.groupBy("slot").agg(F.sum("n").alias("m"))
    share = F.least((F.col("m") - 100) / 100.0, F.lit(0.25))
    ratio = F.greatest(share, F.when(F.col("n") > 15, 0.15).otherwise(0.0)) * F.when(F.col("class_name") == "motorcycle", 0.5).otherwise(1.0)
    return d.join(own, ["camera_id", "slot"]).join(every, "slot").select("event_id", ratio.alias("ratio"))


@query(
    "SELECT event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, slot ORDER BY sec, event_id) AS k FROM (SELECT *, sec // 3600 AS slot FROM det)) WHERE k <= 3"
)
def dd10_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each camera and hour."""
    w = Window.partitionBy("camera_id", F.expr("sec div 3600")).orderBy("sec", "event_id")
    return detections(spark, sf_dir).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("event_id", "k")


@query("SELECT camera_id, class_name, count(*) AS n, grouping(class_name) AS g FROM det GROUP BY ROLLUP (camera_id, class_name)")
def extra_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the described operators: totals at each level."""
    return detections(spark, sf_dir).rollup("camera_id", "class_name").agg(F.count("*").alias("n"), F.grouping("class_name").cast("long").alias("g"))
