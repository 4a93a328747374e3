"""Projections and filters of stream messages, lookups, and rules of one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.fields import blank, corners, field, number, seconds, whole
from framelake.functions.plates import motorcycle
from framelake.plans.registry import query
from framelake.sources.tables import cameras, detections, messages

NOW = "2024-01-31 00:00:00"
AT = 1706659200


def time_of(c: str = "timestamp") -> Column:
    return seconds(F.col(c), F.lit(NOW).cast("timestamp_ntz"))


TIME = f"coalesce(make_timestamp(CAST(floor(TRY_CAST(timestamp AS DOUBLE) * 1000) AS BIGINT) * 1000), TIMESTAMP '{NOW}')"
TRACK = "CASE WHEN regexp_matches(trim(global_track_id), '^[+-]?[0-9]+$') THEN CAST(trim(global_track_id) AS BIGINT) END"
BOX = "CASE WHEN len(string_split(bbox, ',')) = 4 THEN bbox END"


def detection_rows(df: DataFrame) -> DataFrame:
    """Rows for a history page; messages without a camera go, other gaps have defaults."""
    box = corners(F.col("bbox"))
    return df.where(~blank(F.col("camera_id"))).select(
        F.concat_ws(":", "stream", F.col("event_id").cast("string")).alias("id"),
        "camera_id",
        F.coalesce("class_name", F.lit("unknown")).alias("type"),
        number(F.col("confidence")).alias("confidence"),
        time_of().alias("at"),
        whole(F.col("global_track_id")).alias("track_id"),
        F.array_join(F.transform(box, lambda x: x.cast("string")), ",").alias("box"),
    )


@query(f"""SELECT stream || ':' || event_id AS id, camera_id, coalesce(class_name, 'unknown') AS type, coalesce(TRY_CAST(confidence AS DOUBLE), 0) AS confidence,
  {TIME} AS at, {TRACK} AS track_id, {BOX} AS box FROM msg WHERE stream = 'detections' AND trim(camera_id) <> ''""")
def pf1_sf34_detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_rows(messages(spark, sf_dir).where("stream = 'detections'"))


@query("SELECT event_id, camera_id AS camera, class_name AS kind, CAST(NULL AS VARCHAR) AS nothing FROM msg")
def pf3_fields_in_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("CAMERA_Id", "camera_id"), ("Class_Name", "class_name"), ("camera_id", "bbox")]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in pairs])
    m = messages(spark, sf_dir).withColumn("entries", entries)
    return m.select("event_id", field(F.col("entries"), "camera_ID").alias("camera"), field(F.col("entries"), "class_name").alias("kind"), field(F.col("entries"), "speed").alias("nothing"))


def payload() -> Column:
    """The message as JSON, with the fields that its stream has; missing ones as null."""

    def json(**names: str) -> Column:
        return F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]), {"ignoreNullFields": "false"})

    vehicle = json(label="class_name", plateText="plate_text", bbox="bbox", confidence="confidence", plateConfidence="plate_confidence", vehicleColor="colour", timestamp="timestamp")
    human = json(label="class_name", faceIdentity="face_identity", bbox="bbox", confidence="confidence", faceConfidence="face_confidence", timestamp="timestamp")
    other = json(label="class_name", globalTrackId="global_track_id", bbox="bbox", confidence="confidence", timestamp="timestamp")
    return F.when(F.col("stream") == "vehicles", vehicle).when(F.col("stream") == "humans", human).otherwise(other)


@query("""SELECT event_id, CAST(CASE stream WHEN 'vehicles' THEN json_object('label', class_name, 'plateText', plate_text, 'bbox', bbox, 'confidence', confidence, 'plateConfidence', plate_confidence, 'vehicleColor', colour, 'timestamp', timestamp)
  WHEN 'humans' THEN json_object('label', class_name, 'faceIdentity', face_identity, 'bbox', bbox, 'confidence', confidence, 'faceConfidence', face_confidence, 'timestamp', timestamp)
  ELSE json_object('label', class_name, 'globalTrackId', global_track_id, 'bbox', bbox, 'confidence', confidence, 'timestamp', timestamp) END AS VARCHAR) AS payload FROM msg""")
def pf10_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", payload().alias("payload"))


# Words in a label that make a vehicle likely, and words that rule one out.
HINTS = "car vehicle auto sedan suv crossover hatchback coupe van minivan mpv pickup jeep taxi wagon truck lorry container semi tractor bus coach minibus motorcycle motorbike moto bike scooter".split()
OTHERS = ["person", "human", "pedestrian", "face", "head", "bicycle", "cyclist", "animal", "dog", "cat", "bag", "helmet", "sign", "traffic light", "trafficlight"]
CLASSES = ["car", "truck", "bus", "motorcycle"]
MARKED, PLAIN = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹ", "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5


def ascii_key(c: Column) -> Column:
    """Lower case without accents; runs of anything but letters and digits are one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), MARKED, PLAIN), "[^a-z0-9]+", " "))


def probable_vehicle(c: Column) -> Column:
    """Whether a label holds a vehicle's word and no other thing's."""
    key = ascii_key(c)
    return key.rlike("|".join(HINTS)) & ~key.rlike("|".join(OTHERS))


LABELS = ["Xe tải nhỏ VAN", "Sedan (4 chỗ)", "traffic light", "mini-bus", "xe máy", "bicycle", "Ô tô - AUTO", "", "cat van"]
LABEL = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LABELS)) + " END"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % 9 + 1).cast("int")))


@query(
    f"SELECT event_id, key, regexp_matches(key, '{'|'.join(HINTS)}') AND NOT regexp_matches(key, '{'|'.join(OTHERS)}') AS vehicle FROM k",
    f"k AS (SELECT event_id, trim(regexp_replace(strip_accents(lower(trim({LABEL}))), '[^a-z0-9]+', ' ', 'g')) AS key FROM msg)",
)
def sf18_sf19_probable_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("event_id", ascii_key(F.col("label")).alias("key"), probable_vehicle(F.col("label")).alias("vehicle"))


@query(
    f"""SELECT event_id, CASE WHEN class_name IN ('car', 'truck', 'bus', 'motorcycle') THEN class_name ELSE 'car' END AS class_name, camera_id, coalesce(CAST(trunc(TRY_CAST(global_track_id AS DOUBLE)) AS BIGINT), -1) AS track_id,
  coalesce(TRY_CAST(confidence AS DOUBLE), 0) AS confidence FROM k WHERE class_name IN ('car', 'truck', 'bus', 'motorcycle') OR class_name IS NULL AND regexp_matches(key, '{'|'.join(HINTS)}') AND NOT regexp_matches(key, '{'|'.join(OTHERS)}')""",
    f"k AS (SELECT *, trim(regexp_replace(strip_accents(lower(trim({LABEL}))), '[^a-z0-9]+', ' ', 'g')) AS key FROM msg)",
)
def pf11_vehicles_with_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles, and rows of no known class whose label makes a vehicle likely, which count as cars."""
    known = F.col("class_name").isin(CLASSES)
    m = labelled(spark, sf_dir).where(known | (F.col("class_name").isNull() & probable_vehicle(F.col("label"))))
    track = F.coalesce(F.col("global_track_id").try_cast("double").cast("long"), F.lit(-1))
    return m.select("event_id", F.when(known, F.col("class_name")).otherwise("car").alias("class_name"), "camera_id", track.alias("track_id"), number(F.col("confidence")).alias("confidence"))


@query(f"SELECT event_id FROM msg WHERE class_name = 'person' AND len(string_split(bbox, ',')) = 4 AND coalesce(TRY_CAST(confidence AS DOUBLE), 0) >= 0.25")
def pf12_pf13_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with a box, from a confidence of 0.25 up."""
    m = messages(spark, sf_dir).where("class_name = 'person'")
    return m.where(corners(F.col("bbox")).isNotNull() & (number(F.col("confidence")) >= 0.25)).select("event_id")


@query("SELECT event_id, coalesce(TRY_CAST(face_confidence AS DOUBLE), 0) > 0 OR coalesce(TRY_CAST(confidence AS DOUBLE), 0) > 0.3 AS published FROM msg WHERE stream = 'humans'")
def pf14_publish_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face, or a confidence above 0.30."""
    m = messages(spark, sf_dir).where("stream = 'humans'")
    return m.select("event_id", ((number(F.col("face_confidence")) > 0) | (number(F.col("confidence")) > 0.3)).alias("published"))


@query("SELECT event_id FROM msg WHERE coalesce(trim(plate_text), '') <> '' OR coalesce(face_identity, '') NOT IN ('', 'Unknown') OR coalesce(TRY_CAST(face_confidence AS DOUBLE), 0) > 0")
def pf15_push_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plate, a named face or a detected one."""
    named = ~blank(F.col("face_identity")) & (F.col("face_identity") != "Unknown")
    return messages(spark, sf_dir).where(~blank(F.col("plate_text")) | named | (number(F.col("face_confidence")) > 0)).select("event_id")


@query("SELECT event_id, length(p) >= 6 AND regexp_matches(p, '^[0-9]{2}[A-Z]') AND CAST(substr(p, 1, 2) AS INT) BETWEEN 11 AND 99 AS passes FROM (SELECT event_id, CASE WHEN regexp_matches(plate, '^[0-9]{2}') THEN plate ELSE '00' || plate END AS p FROM det WHERE class_name <> 'person')")
def pf21_early_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six characters or more, a province from 11 to 99, then a letter."""
    p = F.col("plate")
    ok = (F.length(p) >= 6) & p.rlike("^[0-9]{2}[A-Z]") & F.coalesce(F.substring(p, 1, 2).try_cast("int").between(11, 99), F.lit(False))
    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", ok.alias("passes"))


@query("SELECT event_id FROM msg WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 <= 0.5 AND (TRY_CAST(confidence AS DOUBLE) IS NULL OR TRY_CAST(confidence AS DOUBLE) < 0.8 AND TRY_CAST(confidence AS DOUBLE) BETWEEN 0.2 AND 0.8)")
def pf23_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by a hash of the id; of those with a confidence only unsure ones, from 0.2 up to below 0.8."""
    share = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    c = F.col("confidence").try_cast("double")
    return messages(spark, sf_dir).where((share <= 0.5) & (c.isNull() | ((c >= 0.2) & (c < 0.8)))).select("event_id")


@query("SELECT event_id, coalesce(nullif(trim(plate_text), ''), nullif(class_name, ''), nullif(face_identity, ''), stream) AS label FROM msg")
def pf27_overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plate before class before face before the kind of stream."""
    full = [F.when(~blank(F.col(c)), F.trim(c)) for c in ("plate_text", "class_name", "face_identity")]
    return messages(spark, sf_dir).select("event_id", F.coalesce(*full, "stream").alias("label"))


@query("SELECT count(*) FILTER (WHERE lower(trim(status)) = 'online' AND coalesce(trim(url), '') <> '') AS live, count(*) AS cameras FROM cam")
def pf29_live_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = (F.lower(F.trim("status")) == "online") & ~blank(F.col("url"))
    return cameras(spark, sf_dir).agg(F.count_if(on).alias("live"), F.count("*").alias("cameras"))


def crop(width: int, height: int) -> list[Column]:
    """The part of the frame to read a vehicle's plate in: its box with margins by class."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bike = F.col("class_name") == "motorcycle"

    def pad(part: Column, share: float, least: int, most: int) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(part * share).cast("int")))

    even = pad(F.least(w, h), 0.08, 20, 80)
    side, top, below = (F.when(bike, x).otherwise(even) for x in (pad(F.greatest(w, h), 0.16, 28, 120), pad(h, 0.12, 20, 90), pad(h, 0.28, 34, 130)))
    return [F.greatest(F.lit(0), F.col("x1") - side), F.greatest(F.lit(0), F.col("y1") - top), F.least(F.lit(width), F.col("x2") + side), F.least(F.lit(height), F.col("y2") + below)]


@query(
    "SELECT event_id, greatest(0, x1 - side) AS left, greatest(0, y1 - top) AS top, least(1920, x2 + side) AS right, least(1080, y2 + below) AS bottom FROM m",
    """b AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, class_name = 'motorcycle' AS bike, least(80, greatest(20, CAST(floor(least(x2 - x1, y2 - y1) * CAST(0.08 AS DOUBLE)) AS INT))) AS even FROM det WHERE class_name <> 'person'),
  m AS (SELECT event_id, x1, y1, x2, y2, CASE WHEN bike THEN least(120, greatest(28, CAST(floor(greatest(w, h) * CAST(0.16 AS DOUBLE)) AS INT))) ELSE even END AS side,
    CASE WHEN bike THEN least(90, greatest(20, CAST(floor(h * CAST(0.12 AS DOUBLE)) AS INT))) ELSE even END AS top, CASE WHEN bike THEN least(130, greatest(34, CAST(floor(h * CAST(0.28 AS DOUBLE)) AS INT))) ELSE even END AS below FROM b)""",
)
def pf30_vehicle_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    return d.select("event_id", *[c.cast("long").alias(n) for c, n in zip(crop(1920, 1080), ("left", "top", "right", "bottom"), strict=True)])


@query("SELECT event_id, colour IN ('red', 'blue', 'green') OR coalesce(TRY_CAST(confidence AS DOUBLE) >= 0.7 AND TRY_CAST(confidence AS DOUBLE) < 0.85, false) AS sensitive FROM msg WHERE stream = 'vehicles'")
def pf31_sensitive_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of official colours, and readings that are nearly sure."""
    c = F.col("confidence").try_cast("double")
    s = F.lower("colour").isin("red", "blue", "green") | F.coalesce((c >= 0.7) & (c < 0.85), F.lit(False))
    return messages(spark, sf_dir).where("stream = 'vehicles'").select("event_id", s.alias("sensitive"))


@query(
    "SELECT camera_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY confidence DESC, event_id) AS place FROM v) WHERE place <= 40",
    f"v AS (SELECT camera_id, event_id, coalesce(TRY_CAST(confidence AS DOUBLE), 0) AS confidence FROM msg WHERE {AT} - sec < 345600 AND (TRY_CAST(timestamp AS DOUBLE) IS NULL OR {AT} - TRY_CAST(timestamp AS DOUBLE) <= 259200) AND (TRY_CAST(confidence AS DOUBLE) IS NULL OR TRY_CAST(confidence AS DOUBLE) >= 0.2))",
)
def pf32_sl11_st15_visible_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen within the time a track is shown, not from a source time long past, sure enough; the 40 surest of a camera."""
    c, t = F.col("confidence").try_cast("double"), F.col("timestamp").try_cast("double")
    m = messages(spark, sf_dir).where((F.lit(AT) - F.col("sec") < 345600) & (t.isNull() | (F.lit(AT) - t <= 259200)) & (c.isNull() | (c >= 0.2)))
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.coalesce(c, F.lit(0.0)).desc(), "event_id"))
    return m.withColumn("place", place).where("place <= 40").select("camera_id", "event_id")


@query("SELECT camera_id AS id, coalesce(name, '') AS name, CASE WHEN lower(status) = 'online' THEN 'online' ELSE 'offline' END AS status, CASE WHEN coalesce(trim(url), '') <> '' THEN 'online' ELSE 'offline' END AS status_by_url, coalesce(plate_ocr, false) AS plates, plate_ocr OR coalesce(trim(url), '') <> '' AS patched FROM cam")
def pf33_pf35_camera_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera rows with defaults, the status that the address implies, and plate reading turned on where there is one."""
    there = ~blank(F.col("url"))
    return cameras(spark, sf_dir).select(
        F.col("camera_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.when(F.lower("status") == "online", "online").otherwise("offline").alias("status"),
        F.when(there, "online").otherwise("offline").alias("status_by_url"), F.coalesce("plate_ocr", F.lit(False)).alias("plates"), (F.col("plate_ocr") | there).alias("patched"),
    )


def newest(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each stream; none for n below 1."""
    if n < 1:
        return df.limit(0)
    return df.withColumn("place", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("event_id")))).where(F.col("place") <= n).drop("place")


NEWEST = "SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id DESC) AS place FROM msg"


@query(f"SELECT stream, event_id FROM ({NEWEST}) WHERE place <= 70")
def sc1_newest_of_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(messages(spark, sf_dir), 70).select("stream", "event_id")


@query(f"SELECT stream, event_id FROM (SELECT * FROM ({NEWEST}) WHERE place <= greatest(3 * 60, 200)) WHERE camera_id = 'cam-02'")
def sl3_filtered_after_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's messages among the newest of each stream: fetched first, three for each one asked for, then filtered."""
    return newest(messages(spark, sf_dir), max(3 * 60, 200)).where("camera_id = 'cam-02'").select("stream", "event_id")


@query("SELECT event_id FROM (SELECT * FROM (SELECT * FROM msg ORDER BY sec DESC, event_id DESC LIMIT 100) ORDER BY sec DESC, event_id DESC LIMIT 15)")
def sl7_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the latest 100 events kept, the 15 that a feed shows."""
    order = F.desc("sec"), F.desc("event_id")
    return messages(spark, sf_dir).orderBy(*order).limit(100).orderBy(*order).limit(15).select("event_id")


@query("SELECT camera_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY sec DESC, event_id DESC) AS place FROM det) WHERE place <= 50")
def sl13_latest_of_each_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("sec"), F.desc("event_id")))
    return detections(spark, sf_dir).withColumn("place", place).where("place <= 50").select("camera_id", "event_id")


@query("SELECT * FROM msg WHERE stream = 'detections' AND event_id = (SELECT max(event_id) FROM msg WHERE stream = 'detections')")
def sc9_message_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message of a stream by its id: here the last one's."""
    m = messages(spark, sf_dir).where("stream = 'detections'")
    return m.join(m.agg(F.max("event_id").alias("event_id")), "event_id", "left_semi").select(m.columns)


@query("SELECT * FROM cam WHERE camera_id = 'cam-03'")
def sc11_camera_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera by its key, or no row."""
    return cameras(spark, sf_dir).where("camera_id = 'cam-03'")


# Labels of each class, without accents, in the other language too.
ALIASES = {
    "car": "car, vehicle, auto, automobile, sedan, suv, crossover, hatchback, coupe, mpv, pickup, pickup truck, pickuptruck, jeep, taxi, cab, minivan, station wagon, wagon, van, delivery van, oto, o to, xe hoi, xe oto",
    "motorcycle": "motorcycle, motorbike, bike, motor, motorcycle rider, moto, scooter, scooty, tricycle, xe may, xe gan may",
    "truck": "truck, pickuptrucks, xe ben, xe dau keo, container, container truck, tractor truck, semi, semi truck, truck tractor, xe cong, lorry, xe tai",
    "bus": "bus, coach, minibus, xe buyt, xe buyt nho",
}
CLASS_LABELS = ["Xe Tải", "xe máy", "Ô tô", "Pickup_Truck", "Station  Wagon", "bicycle", "XE BUÝT", "minibus", "", "Sedan", "Xe hơi"]
CLASS_LABEL = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(CLASS_LABELS)) + " END"


def vehicle_class(label: Column, plate: Column) -> Column:
    """The class a label stands for, without accents and marks; where it is unknown or a car, a motorcycle's plate decides."""
    of = F.create_map(*[F.lit(x) for name, labels in ALIASES.items() for one in labels.split(", ") for x in (one, name)])
    named = F.coalesce(of[ascii_key(label)], F.lit("unknown"))
    return F.when(named.isin("unknown", "car") & F.coalesce(motorcycle(plate), F.lit(False)), "motorcycle").otherwise(named)


@query(
    f"SELECT event_id, CASE WHEN named IN ('unknown', 'car') AND regexp_matches(p, '^[0-9]{{2}}[A-Z][0-9]{{6}}$') THEN 'motorcycle' ELSE named END AS class_name FROM (SELECT event_id, p, CASE {' '.join(f"WHEN key IN ({', '.join(repr(x) for x in labels.split(', '))}) THEN '{name}'" for name, labels in ALIASES.items())} ELSE 'unknown' END AS named FROM k)",
    f"k AS (SELECT event_id, trim(regexp_replace(strip_accents(lower(trim({CLASS_LABEL}))), '[^a-z0-9]+', ' ', 'g')) AS key, CASE event_id % 3 WHEN 0 THEN plate || '0' WHEN 1 THEN substr(plate, 1, 3) || '-' || substr(plate, 4) || '0' ELSE plate END AS p FROM det WHERE class_name <> 'person')",
)
def j15_sf18_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    label = F.element_at(F.array(*[F.lit(x) for x in CLASS_LABELS]), (F.col("event_id") % 11 + 1).cast("int"))
    plate = F.when(k == 0, F.concat("plate", F.lit("0"))).when(k == 1, F.concat(F.substring("plate", 1, 3), F.lit("-"), F.substring("plate", 4, 100), F.lit("0"))).otherwise(F.col("plate"))
    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", vehicle_class(label, plate).alias("class_name"))
