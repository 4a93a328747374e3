"""Serving queries: history, search, statistics and top lists over detections, plates and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from framelake.plans.registry import query
from framelake.sources.tables import cameras, detections

AS_OF = "2024-01-31 00:00:00"


def history(df: DataFrame, camera: str | None = None, start: str | None = None, end: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first, of one camera (as written, trimmed) and a closed span of time; the limit is held within 1 and 500."""
    if camera and camera.strip():
        df = df.where(F.col("camera_id") == camera.strip())
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df.orderBy(F.desc_nulls_last("ts"), F.desc("event_id")).limit(min(max(limit, 1), 500))


def latest(df: DataFrame, names: str, limit: int = 50) -> DataFrame:
    """Newest of several cameras, a list with commas in any case; the limit is held within 1 and 200."""
    wanted = [x.strip().lower() for x in names.split(",") if x.strip()]
    return df.where(F.lower("camera_id").isin(wanted)).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(max(limit, 1), 200))


def plate_search(df: DataFrame, needle: str, camera: str | None = None) -> DataFrame:
    """Plates that contain the needle in any case, without wildcards; a blank needle finds nothing."""
    if not needle or not needle.strip():
        return df.limit(0)
    df = df.where(F.upper("plate").contains(needle.strip().upper()))
    return df.where(F.col("camera_id") == camera) if camera else df


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("class_name <> 'person'")


@query("SELECT class_name, count(*) AS n FROM det GROUP BY class_name")
def ag1_count_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"))


@query("""SELECT event_id, camera_id, class_name, confidence, ts FROM det WHERE camera_id = 'cam-03' AND ts >= TIMESTAMP '2024-01-05'
  AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 200""")
def pf4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = history(detections(spark, sf_dir), " cam-03 ", "2024-01-05 00:00:00", "2024-01-20 00:00:00", 200)
    return got.select("event_id", "camera_id", "class_name", "confidence", "ts")


@query("SELECT event_id, camera_id, ts FROM det WHERE camera_id IN ('cam-01', 'cam-02') ORDER BY ts DESC, event_id DESC LIMIT 120")
def pf5_latest_of_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(detections(spark, sf_dir), "CAM-01, cam-02,", 120).select("event_id", "camera_id", "ts")


@query("SELECT event_id, plate, camera_id FROM det WHERE class_name <> 'person' AND contains(upper(plate), 'A') AND camera_id = 'cam-04'")
def pf6_plate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plate_search(plates(spark, sf_dir), " a", "cam-04").select("event_id", "plate", "camera_id")


@query("SELECT event_id, plate FROM det WHERE false")
def pf7_blank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plate_search(plates(spark, sf_dir), "  ").select("event_id", "plate")


@query("""SELECT event_id, plate, d.camera_id, name, ts FROM det d LEFT JOIN cam c ON d.camera_id = c.camera_id WHERE class_name <> 'person'
  ORDER BY ts DESC, event_id DESC LIMIT 300""")
def j1_plates_with_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plates(spark, sf_dir).join(cameras(spark, sf_dir), "camera_id", "left")
    return got.orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "plate", "camera_id", "name", "ts")


@query("SELECT count(*) AS total, count(DISTINCT plate) AS plates FROM det WHERE class_name <> 'person'")
def ag2_ag3_plate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates(spark, sf_dir).agg(F.count("*").alias("total"), F.countDistinct("plate").alias("plates"))


@query("SELECT plate, count(*) AS n FROM det WHERE class_name <> 'person' GROUP BY plate ORDER BY n DESC, plate LIMIT 10")
def ag4_top_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates(spark, sf_dir).groupBy("plate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "plate").limit(10)


@query("SELECT class_name, count(*) AS n, count(DISTINCT camera_id) AS cameras FROM det WHERE class_name <> 'person' GROUP BY class_name")
def ag5_by_vehicle_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), F.countDistinct("camera_id").alias("cameras"))


@query(f"""SELECT (SELECT count(*) FROM cam) AS cameras, (SELECT count(*) FROM cam WHERE status = 'online') AS online, count(*) AS stream_length,
  count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS last_day, CAST(0 AS BIGINT) AS alerts FROM det""")
def ag6_ag7_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of "today": the length of the stream, and the last day before a given time."""
    day = F.col("ts") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval 1 day")
    d = detections(spark, sf_dir).agg(F.count("*").alias("stream_length"), F.count_if(day).alias("last_day"))
    c = cameras(spark, sf_dir).agg(F.count("*").alias("cameras"), F.count_if(F.col("status") == "online").alias("online"))
    return c.join(d, F.lit(True)).withColumn("alerts", F.lit(0).cast("long"))  # one row each


@query("""SELECT camera_id, class_name, count(*) AS attempted, count(*) FILTER (WHERE sharpness >= 100) AS saved,
  count(*) FILTER (WHERE sharpness < 100) AS rejected FROM det GROUP BY ALL""")
def ag13_collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("sharpness") >= 100
    return detections(spark, sf_dir).groupBy("camera_id", "class_name").agg(F.count("*").alias("attempted"), F.count_if(good).alias("saved"), F.count_if(~good).alias("rejected"))


@query("""SELECT track_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN count(*) >= 5 THEN 'Critical' ELSE 'Error' END AS severity
  FROM det WHERE class_name = 'motorcycle' AND track_id >= 0 GROUP BY track_id ORDER BY n DESC, track_id LIMIT 20""")
def ag14_ag15_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detections(spark, sf_dir).where("class_name = 'motorcycle' and track_id >= 0").groupBy("track_id")
    got = got.agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return got.orderBy(F.desc("n"), "track_id").limit(20).withColumn("severity", F.when(F.col("n") >= 5, "Critical").otherwise("Error"))


@query("SELECT camera_id, name FROM cam WHERE lower(trim(status)) = 'online' AND url IS NOT NULL AND url <> ''")
def sc12_sc20_online_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras(spark, sf_dir).where((F.lower(F.trim("status")) == "online") & (F.coalesce("url", F.lit("")) != "")).select("camera_id", "name")


@query("SELECT camera_id, coalesce(plate_ocr, true) AS plate_ocr FROM cam WHERE camera_id IN ('cam-01', 'cam-04', 'cam-06')")
def sc13_scheduled_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras(spark, sf_dir).where(F.col("camera_id").isin("cam-01", "cam-04", "cam-06")).select("camera_id", F.coalesce("plate_ocr", F.lit(True)).alias("plate_ocr"))


@query("SELECT camera_id FROM cam WHERE contains(url, '10.0.0.5') ORDER BY camera_id LIMIT 1")
def sc14_camera_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras(spark, sf_dir).where(F.col("url").contains("10.0.0.5")).orderBy("camera_id").limit(1).select("camera_id")


@query("""SELECT event_id, CASE WHEN source = 'vehicles' THEN class_name || ' · ' || plate ELSE class_name END AS type,
  source || ':' || CAST(event_id AS VARCHAR) AS id FROM det WHERE source <> 'humans'""")
def so1_pf2_union_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    plain = d.where("source = 'detections'").select("event_id", F.col("class_name").alias("type"), F.lit("detections").alias("source"))
    rich = d.where("source = 'vehicles'").select("event_id", F.concat_ws(" · ", "class_name", "plate").alias("type"), F.lit("vehicles").alias("source"))
    both = plain.unionByName(rich)
    return both.select("event_id", "type", F.concat_ws(":", "source", F.col("event_id").cast("string")).alias("id"))


@query("""SELECT CASE WHEN source = 'vehicles' AND plate <> '' THEN 'plate' WHEN source = 'vehicles' THEN 'vehicle' WHEN source = 'humans' THEN 'human'
  ELSE 'detection' END AS route, count(*) AS n FROM det GROUP BY 1""")
def pf9_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    route = F.when((s == "vehicles") & (F.col("plate") != ""), "plate").when(s == "vehicles", "vehicle").when(s == "humans", "human").otherwise("detection")
    return detections(spark, sf_dir).groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT plate FROM det WHERE source = 'vehicles'")
def so2_distinct_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("source = 'vehicles'").select("plate").distinct()


@query("SELECT camera_id, n, name FROM (SELECT camera_id, count(*) AS n FROM det WHERE class_name = 'bus' GROUP BY camera_id) FULL JOIN cam USING (camera_id)")
def j12_so4_cameras_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = detections(spark, sf_dir).where("class_name = 'bus'").groupBy("camera_id").agg(F.count("*").alias("n"))
    return n.join(cameras(spark, sf_dir).select("camera_id", "name"), "camera_id", "full")


@query("SELECT event_id, ts FROM det ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def sl9_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id", "ts")


@query("""SELECT event_id, '"' || plate || '","' || camera_id || '",' || CAST(CAST(floor(confidence * 1000 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.'
  || CAST(CAST(floor(confidence * 1000 + 0.5) AS BIGINT) % 10 AS VARCHAR) || '%' AS line FROM det WHERE source = 'vehicles'""")
def sk8_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the exported file: quoted, confidence as a percentage with one decimal."""
    tenths = F.floor(F.col("confidence") * 1000 + 0.5)
    line = F.concat(F.lit('"'), "plate", F.lit('","'), "camera_id", F.lit('",'), F.expr("cast(floor(confidence * 1000 + 0.5) div 10 as string)"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return detections(spark, sf_dir).where("source = 'vehicles'").select("event_id", line.alias("line"))
