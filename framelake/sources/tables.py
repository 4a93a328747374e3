"""The detection tables, derived by Spark from the given parquet tables; the same formulas in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes by kind of event, and the letters a series may have.
CLASSES = {"click": "car", "error": "motorcycle", "signup": "bus", "purchase": "truck", "view": "person"}
SERIES = "ABCDEFGHJKLMNPRSTUVWXYZ"
FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080
COLOURS = ["white", "yellow", "red", "blue", "green"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str | Column = "ts") -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    i = F.col("event_id")
    clean = F.concat((F.lit(11) + F.col("user_id") % 89).cast("string"), F.substring(F.lit(SERIES), (F.col("user_id") % 23 + 1).cast("int"), F.lit(1)), F.lpad((F.col("user_id") * 7919 % 100000).cast("string"), 5, "0"))
    out = e.select(
        "event_id",
        "ts",
        epoch().alias("sec"),
        F.concat(F.lit("cam-"), F.lpad((F.col("user_id") % 8).cast("string"), 2, "0")).alias("camera_id"),
        F.when(i % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")).alias("track_id"),
        kind[F.col("event_type")].alias("class_name"),
        (F.least(F.floor(F.col("value") * 2 + 0.5), F.lit(999)) / 1000.0).alias("confidence"),
        (i * 37 % 1600).alias("x1"),
        (i * 53 % 800).alias("y1"),
        (i * 37 % 1600 + 40 + i * 17 % 280).alias("x2"),
        (i * 53 % 800 + 40 + i * 29 % 240).alias("y2"),
        (i * 13 % 400).alias("sharpness"),
        clean.alias("plate_clean"),
    )
    p = F.col("plate_clean")
    noise = (
        F.when(i % 5 == 1, F.regexp_replace(p, "^([^0]*)0", "$1O"))
        .when(i % 5 == 2, F.regexp_replace(p, "^([^1]*)1", "$1I"))
        .when(i % 5 == 3, F.concat(F.substring(p, 1, 5), F.substring(p, 7, 2)))
        .when(i % 5 == 4, F.translate(p, "8", "B"))
        .otherwise(p)
    )
    source = F.when(F.col("class_name") == "person", "humans").when(i % 3 == 0, "vehicles").otherwise("detections")
    return out.withColumn("plate", noise).withColumn("source", source)


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where("s_suppkey < 8")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("cam-0"), k.cast("string")).alias("camera_id"),
        F.col("s_name").alias("name"),
        F.when(k % 3 == 0, "offline").otherwise("online").alias("status"),
        F.when(k % 4 != 3, F.concat(F.lit("rtsp://10.0.0."), k.cast("string"), F.lit(":554/realmonitor?channel="), k.cast("string"))).alias("url"),
        (k % 2 == 0).alias("plate_ocr"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("person"), (F.col("label") != 0).alias("known"), (F.col("vec_id") % 50 == 0).alias("deleted"), F.col("embedding").cast("array<double>").alias("v")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as they come off a stream: every field is text, some are blank, missing or malformed."""
    d, i = detections(spark, sf_dir), F.col("event_id")

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    vehicle, human = F.col("source") == "vehicles", F.col("source") == "humans"
    thousandths = F.concat(F.lit("0."), F.lpad(F.round(F.col("confidence") * 1000).cast("int").cast("string"), 3, "0"))
    return d.select(
        "event_id",
        F.col("source").alias("stream"),
        "sec",
        F.when(i % 17 == 0, " ").otherwise(F.col("camera_id")).alias("camera_id"),
        F.when(i % 13 != 0, F.col("class_name")).alias("class_name"),
        F.when(i % 19 == 0, "n/a").when(i % 19 != 1, thousandths).alias("confidence"),
        F.when(i % 29 == 0, "").when(i % 31 == 0, F.concat(text("track_id"), F.lit(".0"))).otherwise(text("track_id")).alias("global_track_id"),
        F.when(i % 37 == 0, "").otherwise(F.concat(text("sec"), F.lit(".500"))).alias("timestamp"),
        F.when(i % 23 == 0, F.concat_ws(",", text("x1"), text("y1"), text("x2"))).otherwise(F.concat_ws(",", text("x1"), text("y1"), text("x2"), text("y2"))).alias("bbox"),
        F.when(vehicle & (i % 4 != 0), F.concat(F.lit(" "), F.col("plate"), F.lit(" "))).alias("plate_text"),
        F.when(vehicle, F.concat(F.lit("0."), F.lpad((i % 1000).cast("string"), 3, "0"))).alias("plate_confidence"),
        F.when(human, F.when(i % 3 == 0, "Unknown").when(i % 3 == 1, F.concat(F.lit("id-"), (i % 10).cast("string"))).otherwise("")).alias("face_identity"),
        F.when(human, F.when(i % 4 == 0, "0").otherwise("0.6")).alias("face_confidence"),
        F.when(vehicle, F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (i % 5 + 1).cast("int"))).alias("colour"),
    )


#: The same tables as DuckDB views within a query: ``WITH`` + SQL + the query's own select.
SQL = f"""
det0 AS (
  SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, 'cam-' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS camera_id,
    CASE WHEN event_id % 11 = 0 THEN CAST(-1 AS BIGINT) ELSE user_id END AS track_id,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CLASSES.items())} END AS class_name,
    least(floor(value * 2 + 0.5), 999) / 1000.0 AS confidence,
    event_id * 37 % 1600 AS x1, event_id * 53 % 800 AS y1,
    event_id * 37 % 1600 + 40 + event_id * 17 % 280 AS x2, event_id * 53 % 800 + 40 + event_id * 29 % 240 AS y2,
    event_id * 13 % 400 AS sharpness,
    CAST(11 + user_id % 89 AS VARCHAR) || substr('{SERIES}', CAST(user_id % 23 + 1 AS INT), 1) || lpad(CAST(user_id * 7919 % 100000 AS VARCHAR), 5, '0') AS plate_clean
  FROM events),
det AS (
  SELECT *, CASE event_id % 5 WHEN 1 THEN regexp_replace(plate_clean, '0', 'O') WHEN 2 THEN regexp_replace(plate_clean, '1', 'I')
    WHEN 3 THEN substr(plate_clean, 1, 5) || substr(plate_clean, 7, 2) WHEN 4 THEN replace(plate_clean, '8', 'B') ELSE plate_clean END AS plate,
    CASE WHEN class_name = 'person' THEN 'humans' WHEN event_id % 3 = 0 THEN 'vehicles' ELSE 'detections' END AS source
  FROM det0),
cam AS (
  SELECT 'cam-0' || CAST(s_suppkey AS VARCHAR) AS camera_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'offline' ELSE 'online' END AS status,
    CASE WHEN s_suppkey % 4 <> 3 THEN 'rtsp://10.0.0.' || CAST(s_suppkey AS VARCHAR) || ':554/realmonitor?channel=' || CAST(s_suppkey AS VARCHAR) END AS url,
    s_suppkey % 2 = 0 AS plate_ocr
  FROM supplier WHERE s_suppkey < 8),
face AS (SELECT vec_id, label AS person, label <> 0 AS known, vec_id % 50 = 0 AS deleted, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, msg AS (
  SELECT event_id, source AS stream, sec, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE camera_id END AS camera_id, CASE WHEN event_id % 13 <> 0 THEN class_name END AS class_name,
    CASE WHEN event_id % 19 = 0 THEN 'n/a' WHEN event_id % 19 <> 1 THEN '0.' || lpad(CAST(CAST(round(confidence * 1000) AS INT) AS VARCHAR), 3, '0') END AS confidence,
    CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN CAST(track_id AS VARCHAR) || '.0' ELSE CAST(track_id AS VARCHAR) END AS global_track_id,
    CASE WHEN event_id % 37 = 0 THEN '' ELSE CAST(sec AS VARCHAR) || '.500' END AS timestamp,
    CASE WHEN event_id % 23 = 0 THEN x1 || ',' || y1 || ',' || x2 ELSE x1 || ',' || y1 || ',' || x2 || ',' || y2 END AS bbox,
    CASE WHEN source = 'vehicles' AND event_id % 4 <> 0 THEN ' ' || plate || ' ' END AS plate_text,
    CASE WHEN source = 'vehicles' THEN '0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS plate_confidence,
    CASE WHEN source = 'humans' THEN CASE event_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'id-' || CAST(event_id % 10 AS VARCHAR) ELSE '' END END AS face_identity,
    CASE WHEN source = 'humans' THEN CASE WHEN event_id % 4 = 0 THEN '0' ELSE '0.6' END END AS face_confidence,
    CASE WHEN source = 'vehicles' THEN CASE event_id % 5 WHEN 0 THEN 'white' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' WHEN 3 THEN 'blue' ELSE 'green' END END AS colour
  FROM det)
"""
