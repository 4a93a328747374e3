"""What keeps an event from being read, in the order in which it is looked at; and choices that need a count of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.plates import valid
from framelake.operators.joins import around
from framelake.operators.plates import VALID
from framelake.operators.quality import S, samples
from framelake.plans.registry import query
from framelake.sources.tables import cameras, detections, faces, messages

NOW, OLD, NEAR = 1706659200, 1209600, 1800
REASONS = ["backpressure", "age", "no_frame", "invalid_bbox", "oversized_bbox", "blur_frame"]


def dropped(events: DataFrame, frames: DataFrame, now: int, old: int, near: int, share: float = 0.02, unsure: float = 0.45, sharp: float = 60, frame_area: int = 1920 * 1080) -> DataFrame:
    """event_id, camera_id and reason (null: read) of events as they come (messages with sharpness and ratio, the share to be
    dropped): the first that holds of a share that is dropped under load, a time that has passed, no frame near, a box that is
    none, one too large for its confidence, and a blurred picture."""
    d = around(events, frames, near).withColumn("framed", F.col("near").isNotNull())
    part = lambda k: F.try_element_at(F.split("bbox", ","), F.lit(k)).try_cast("double")
    at, (x1, y1, x2, y2) = F.col("timestamp").try_cast("double"), (part(k) for k in (1, 2, 3, 4))
    boxed = F.coalesce((F.size(F.split("bbox", ",")) == 4) & (x2 > x1) & (y2 > y1), F.lit(False))
    large = ((x2 - x1) * (y2 - y1) / F.lit(float(frame_area)) >= share) & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) < unsure)
    tests = [
        (F.col("ratio") > 0) & (share_of("camera_id", "global_track_id", "sec") < F.col("ratio")),
        F.coalesce(now - at > old, F.lit(False)), ~F.col("framed"), ~boxed, large, F.col("sharpness") < sharp,
    ]
    reason = F.when(tests[0], REASONS[0])
    for name, test in zip(REASONS[1:], tests[1:], strict=True):
        reason = reason.when(test, name)
    return d.select("event_id", "camera_id", reason.alias("reason"))


def share_of(camera: str, identity: str, seconds: str) -> Column:
    """A number from 0 to 1 by an md5 of camera, identity and half second."""
    key = F.concat_ws(":", F.col(camera), F.coalesce(F.col(identity), F.lit("")), F.floor(F.col(seconds) * 2).cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles' messages; a quarter is to be dropped of a camera with over fifteen in six hours, half as much of motorcycles."""
    m = messages(spark, sf_dir).where("stream <> 'humans' and trim(camera_id) <> ''").withColumn("slot", F.expr("sec div 21600"))
    load = m.groupBy("camera_id", "slot").agg(F.count("*").alias("n"))
    ratio = F.when(F.col("n") > 15, 0.25).otherwise(0.0) * F.when(F.col("class_name") == "motorcycle", 0.5).otherwise(1.0)
    return m.join(load, ["camera_id", "slot"]).withColumns({"ratio": ratio, "sharpness": F.col("event_id") * 13 % 400})


CHAIN = f"""m AS (SELECT *, event_id * 13 % 400 AS sharpness, CASE WHEN count(*) OVER (PARTITION BY camera_id, sec // 21600) > 15 THEN CAST(0.25 AS DOUBLE) ELSE 0 END * CASE WHEN class_name = 'motorcycle' THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS ratio,
    string_split(bbox, ',') AS b, TRY_CAST(timestamp AS DOUBLE) AS at_, CAST('0x' || substr(md5(camera_id || ':' || coalesce(global_track_id, '') || ':' || CAST(sec * 2 AS VARCHAR)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM msg WHERE stream <> 'humans' AND trim(camera_id) <> ''),
  q AS (SELECT *, len(b) = 4 AND TRY_CAST(b[3] AS DOUBLE) > TRY_CAST(b[1] AS DOUBLE) AND TRY_CAST(b[4] AS DOUBLE) > TRY_CAST(b[2] AS DOUBLE) AS boxed, (TRY_CAST(b[3] AS DOUBLE) - TRY_CAST(b[1] AS DOUBLE)) * (TRY_CAST(b[4] AS DOUBLE) - TRY_CAST(b[2] AS DOUBLE)) / CAST(2073600 AS DOUBLE) AS part FROM m),
  chain AS (SELECT event_id, camera_id, CASE WHEN ratio > 0 AND u < ratio THEN 'backpressure' WHEN {NOW} - at_ > {OLD} THEN 'age' WHEN NOT EXISTS (SELECT 1 FROM det f WHERE f.event_id % 4 = 0 AND f.camera_id = q.camera_id AND abs(f.sec - q.sec) <= {NEAR}) THEN 'no_frame'
    WHEN NOT coalesce(boxed, false) THEN 'invalid_bbox' WHEN part >= 0.02 AND coalesce(TRY_CAST(confidence AS DOUBLE), 0) < 0.45 THEN 'oversized_bbox' WHEN sharpness < 60 THEN 'blur_frame' END AS reason FROM q)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = detections(spark, sf_dir).where("event_id % 4 = 0").select("camera_id", F.col("event_id").alias("frame_id"), F.col("sec").alias("frame_sec"))
    return dropped(arrivals(spark, sf_dir), frames, NOW, OLD, NEAR)


@query("SELECT event_id, reason FROM chain", CHAIN)
def st12_drop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(spark, sf_dir).select("event_id", "reason")


@query("SELECT camera_id, reason, count(*) AS n FROM chain WHERE reason IS NOT NULL GROUP BY ALL", CHAIN)
def ag10_st12_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each camera's events each reason drops."""
    return chained(spark, sf_dir).where("reason is not null").groupBy("camera_id", "reason").agg(F.count("*").alias("n"))


@query(
    "SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'processed' WHEN score <= 0.3 THEN 'raw' ELSE 'unknown' END AS source, round(CASE WHEN score >= 0.6 THEN least(1, score) WHEN score <= 0.3 THEN least(1, 1 - score) ELSE 0.5 END, 6) AS confidence FROM (SELECT event_id, round(CASE WHEN sharpness > 500 THEN 0.3 WHEN sharpness > 200 THEN 0.15 ELSE 0 END + CASE WHEN contrast > 60 THEN 0.2 WHEN contrast > 45 THEN 0.1 ELSE 0 END + CASE WHEN event_id * 19 % 25 < 5 THEN 0.25 WHEN event_id * 19 % 25 < 10 THEN 0.1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.25 END, 6) AS score FROM (SELECT * REPLACE (sharpness * 2 AS sharpness) FROM s))",
    S,
)
def sf39_picture_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a picture has been worked on: by sharpness, contrast, little noise and no traces of compression."""
    sharp, contrast, noise, traces = F.col("sharpness") * 2, F.col("contrast"), F.col("event_id") * 19 % 25, F.col("event_id") % 3 == 0
    score = F.when(sharp > 500, 0.3).when(sharp > 200, 0.15).otherwise(0.0) + F.when(contrast > 60, 0.2).when(contrast > 45, 0.1).otherwise(0.0) + F.when(noise < 5, 0.25).when(noise < 10, 0.1).otherwise(0.0) + F.when(traces, 0.0).otherwise(0.25)
    d = samples(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"))
    kind = F.when(F.col("score") >= 0.6, "processed").when(F.col("score") <= 0.3, "raw").otherwise("unknown")
    sure = F.when(F.col("score") >= 0.6, F.least(F.lit(1.0), "score")).when(F.col("score") <= 0.3, F.least(F.lit(1.0), 1 - F.col("score"))).otherwise(0.5)
    return d.select("event_id", "score", kind.alias("source"), F.round(sure, 6).alias("confidence"))


@query(
    f"SELECT event_id, CASE WHEN fits THEN CAST(confidence AS DOUBLE) ELSE least(CAST(confidence AS DOUBLE), 0.5) END AS confidence, NOT fits OR confidence < 0.85 OR colour IN ('red', 'blue', 'green') AS verify FROM (SELECT d.event_id, d.confidence, m.colour, {VALID.format(p='f.fixed')} AS fits FROM det d JOIN msg m USING (event_id) JOIN fx f USING (event_id) WHERE m.stream = 'vehicles')",
    "fx AS (SELECT event_id, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS fixed FROM det)",
)
def pf36_to_be_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of a device that are looked at again: of no valid form, whose confidence counts 0.5 at most, not sure, or of an official colour."""
    fits = valid(F.col("plate"))
    d = detections(spark, sf_dir).where("source = 'vehicles'").join(messages(spark, sf_dir).select("event_id", "colour"), "event_id")
    again = ~fits | (F.col("confidence") < 0.85) | F.coalesce(F.col("colour").isin("red", "blue", "green"), F.lit(False))
    return d.select("event_id", F.when(fits, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.5))).alias("confidence"), again.alias("verify"))


@query(
    "SELECT vec_id FROM f WHERE w >= 20 AND h >= 20 AND score >= 0.5 AND norm >= 0.1",
    "f AS (SELECT vec_id, vec_id * 7 % 60 AS w, vec_id * 11 % 70 AS h, vec_id % 10 / CAST(10 AS DOUBLE) AS score, sqrt(list_inner_product(v, v)) * CASE WHEN vec_id % 6 = 0 THEN 0.001 ELSE 1 END AS norm FROM face)",
)
def pf25_usable_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces large and sure enough whose vector isn't next to nothing; some vectors are made small here."""
    i = F.col("vec_id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) * F.when(i % 6 == 0, 0.001).otherwise(1.0)
    return faces(spark, sf_dir).where((i * 7 % 60 >= 20) & (i * 11 % 70 >= 20) & (i % 10 / 10.0 >= 0.5) & (norm >= 0.1)).select("vec_id")


def drawn(df: DataFrame, key: str, n: Column | int) -> DataFrame:
    """Exactly ``n`` rows of ``df`` (all, if fewer), those of the smallest md5 of ``key``; equal keys go by it.

    Counts by the first four characters of the md5 say which of those groups are drawn whole; only one is ordered.
    """
    d = df.withColumn("_md5", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_group", F.substring("_md5", 1, 4))
    w = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    groups = d.groupBy("_group").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    d = d.join(groups.where(F.col("_before") < n), "_group")
    whole = F.col("_before") + F.col("_n") <= n
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_md5", key))
    cut = d.where(~whole).withColumn("_place", place).where(F.col("_before") + F.col("_place") <= n)
    return d.where(whole).unionByName(cut.drop("_place")).drop("_md5", "_group", "_n", "_before")


def mixed(real: DataFrame, made: DataFrame, key: str, ratio: float) -> DataFrame:
    """Real and made examples, of which made ones are a share of ``ratio`` of all there are, as far as there are so many; with origin."""
    n_real, n_made = real.count(), made.count()
    want = int((n_real + n_made) * max(0.0, min(1.0, ratio)))
    rest = max(0, n_real + n_made - want)
    return drawn(real, key, rest).withColumn("origin", F.lit("real")).unionByName(drawn(made, key, want).withColumn("origin", F.lit("made")))


@query(
    "SELECT event_id, CASE WHEN made THEN 'made' ELSE 'real' END AS origin FROM r WHERE place <= CASE WHEN made THEN floor(CAST(0.45 AS DOUBLE) * n) ELSE n - floor(CAST(0.45 AS DOUBLE) * n) END",
    "r AS (SELECT event_id, source = 'vehicles' AS made, count(*) OVER () AS n, row_number() OVER (PARTITION BY source = 'vehicles' ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS place FROM det WHERE source <> 'humans')",
)
def so6_mixed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles' events stand for made examples, others for real ones."""
    d = detections(spark, sf_dir).where("source <> 'humans'").select("event_id", "source")
    return mixed(d.where("source <> 'vehicles'").drop("source"), d.where("source = 'vehicles'").drop("source"), "event_id", 0.45)


@query(
    "SELECT event_id, frame_id, how FROM (SELECT e.event_id, CASE WHEN n.frame_id IS NOT NULL THEN n.frame_id WHEN b.k = 1 OR b.gap <= 3600 THEN b.frame_id END AS frame_id, CASE WHEN n.frame_id IS NOT NULL THEN 'named' WHEN b.k = 1 THEN 'only' WHEN b.gap <= 3600 THEN 'nearest' END AS how FROM e LEFT JOIN fr n ON n.frame_id = e.wanted AND n.camera_id = e.camera_id LEFT JOIN b USING (event_id))",
    """e AS (SELECT event_id, camera_id, sec, CASE WHEN event_id % 7 = 0 THEN event_id - event_id % 4 END AS wanted FROM det WHERE event_id % 4 <> 0), fr AS (SELECT event_id AS frame_id, camera_id, sec AS frame_sec FROM det WHERE event_id % 4 = 0),
  p AS (SELECT event_id, sec, frame_id, frame_sec FROM e JOIN fr ON e.camera_id = fr.camera_id AND frame_sec <= sec + 7200 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY frame_sec DESC, frame_id DESC) <= 5),
  b AS (SELECT event_id, frame_id, abs(frame_sec - sec) AS gap, count(*) OVER (PARTITION BY event_id) AS k FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(frame_sec - sec), frame_sec DESC, frame_id DESC) = 1)""",
)
def j4_frame_of_last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are looked at two hours after they happen, and a frame may be an hour off."""
    d = detections(spark, sf_dir)
    frames = d.where("event_id % 4 = 0").select("camera_id", F.col("event_id").alias("frame_id"), F.col("sec").alias("frame_sec"))
    wanted = F.when(F.col("event_id") % 7 == 0, F.col("event_id") - F.col("event_id") % 4).alias("wanted")
    return frame_of_last(d.where("event_id % 4 <> 0").select("event_id", "camera_id", "sec", wanted), frames, 7200, 3600)


def frame_of_last(events: DataFrame, frames: DataFrame, late: int, within: int, last: int = 5) -> DataFrame:
    """Each event (event_id, camera_id, sec, wanted) with the frame it names, if its camera has it; else, of the ``last`` frames
    its camera had ``late`` seconds after it, the nearest in time (the newer of two), if within so many seconds or the only one.

    A camera's frames are numbered over its days; the number of the newest frame before a time is found within that day, or is
    the day's first less one; so the frames to look at are met by their numbers.
    """
    day = lambda c: F.floor(F.col(c) / 86400)
    f = frames.withColumn("day", day("frame_sec"))
    in_day = Window.partitionBy("camera_id", "day").orderBy("frame_sec", "frame_id")
    days = f.groupBy("camera_id", "day").agg(F.count("*").alias("n"))
    # a row a day and camera, for days with events too
    due = events.withColumn("due", F.col("sec") + late).withColumn("day", day("due"))
    every = due.select("camera_id", "day").distinct().join(days, ["camera_id", "day"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    before = every.withColumn("earlier", F.sum("n").over(Window.partitionBy("camera_id").orderBy("day")) - F.col("n")).drop("n")
    f = f.withColumn("k", F.row_number().over(in_day)).join(before, ["camera_id", "day"]).select("camera_id", "day", "frame_id", "frame_sec", (F.col("k") + F.col("earlier")).alias("place"))
    both = f.select("camera_id", "day", F.col("frame_sec").alias("at"), "frame_id", "place", F.lit(None).cast("long").alias("event_id"))
    both = both.unionByName(due.select("camera_id", "day", F.col("due").alias("at"), F.lit(None).cast("long").alias("frame_id"), F.lit(None).cast("long").alias("place"), "event_id"))
    seen = F.max("place").over(Window.partitionBy("camera_id", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    newest = both.withColumn("seen", seen).where("event_id is not null").join(before, ["camera_id", "day"]).select("event_id", F.coalesce("seen", "earlier").alias("newest"))
    asked = events.join(newest, "event_id").where("newest > 0").withColumn("place", F.explode(F.sequence(F.greatest(F.lit(1), F.col("newest") - last + 1), F.col("newest"))))
    gap = F.abs(F.col("frame_sec") - F.col("sec"))
    best = asked.join(f.select("camera_id", "place", "frame_id", "frame_sec"), ["camera_id", "place"]).groupBy("event_id").agg(F.count("*").alias("k"), F.min(F.struct(gap.alias("gap"), (-F.col("place")).alias("p"), "frame_id")).alias("b"))
    named = events.join(frames.select("camera_id", F.col("frame_id").alias("wanted"), F.col("frame_id").alias("named")), ["camera_id", "wanted"], "left").join(best, "event_id", "left")
    how = F.when(F.col("named").isNotNull(), "named").when(F.col("k") == 1, "only").when(F.col("b.gap") <= within, "nearest")
    return named.withColumn("how", how).select("event_id", F.when(F.col("how") == "named", F.col("named")).when(F.col("how").isNotNull(), F.col("b.frame_id")).alias("frame_id"), "how")


@query(
    "SELECT event_id, CASE WHEN regexp_matches(t, p) THEN regexp_extract(t, p) WHEN length(cleaned) BETWEEN 6 AND 12 THEN cleaned END AS found FROM (SELECT event_id, upper(a || b) AS t, '[0-9]{2}[A-Z][0-9]?[-. ]?[0-9]{3,5}[. ]?[0-9]{0,2}' AS p, regexp_replace(upper(a || b), '[^A-Z0-9.-]', '', 'g') AS cleaned FROM (SELECT event_id, CASE WHEN event_id % 10 > 2 THEN trim(substr(plate, 1, 3)) ELSE '' END AS a, CASE WHEN event_id % 11 > 4 THEN trim(CASE event_id % 4 WHEN 0 THEN '-' || substr(plate, 4) WHEN 1 THEN ' ' || lower(substr(plate, 4, 3)) || '.' || substr(plate, 7) WHEN 2 THEN ' no plate/' ELSE substr(plate, 4) END) ELSE '' END AS b FROM det WHERE class_name <> 'person'))",
)
def sf32_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sure lines of a picture say, put together: the first part of the form of a plate, else all that may be part of
    one, if it has six to twelve characters."""
    i, p = F.col("event_id"), F.col("plate")
    second = F.when(i % 4 == 0, F.concat(F.lit("-"), F.substring(p, 4, 100))).when(i % 4 == 1, F.concat(F.lit(" "), F.lower(F.substring(p, 4, 3)), F.lit("."), F.substring(p, 7, 100))).when(i % 4 == 2, " no plate/").otherwise(F.substring(p, 4, 100))
    lines = F.array(F.struct(F.substring(p, 1, 3).alias("text"), (i % 10 / 5.0).alias("sure")), F.struct(second.alias("text"), (i % 11 / 9.0).alias("sure")))
    d = detections(spark, sf_dir).where("class_name <> 'person'").withColumn("lines", lines)
    return d.select("event_id", extracted(F.col("lines")).alias("found"))


def extracted(lines: Column, sure: float = 0.5) -> Column:
    """The plate in lines (text, sure) of a picture, or null."""
    text = F.upper(F.array_join(F.transform(F.filter(lines, lambda x: x["sure"] > sure), lambda x: F.trim(x["text"])), ""))
    found = F.regexp_extract(text, r"\d{2}[A-Z]\d?[-.\s]?\d{3,5}[.\s]?\d{0,2}", 0)
    cleaned = F.regexp_replace(text, "[^A-Z0-9.-]", "")
    return F.when(found != "", found).when(F.length(cleaned).between(6, 12), cleaned)


@query(
    "SELECT camera_id, regexp_extract(u, '^rtsp://(?:[^@/]*@)?([^:/?]+)', 1) AS host, coalesce(TRY_CAST(regexp_extract(u, '[?].*channel=([0-9]+)', 1) AS BIGINT) - 1, 0) AS channel, CASE WHEN regexp_matches(u, '^rtsp://[^@/]+@') THEN regexp_extract(u, '^rtsp://([^:@/]+)', 1) ELSE 'admin' END AS login FROM u WHERE lower(trim(status)) = 'online' AND starts_with(u, 'rtsp://') AND regexp_matches(u, '^rtsp://(?:[^@/]*@)?[^:/?]+') AND (contains(lower(u), 'realmonitor') OR contains(lower(name), 'dahua'))",
    "u AS (SELECT camera_id, CASE WHEN camera_id IN ('cam-01', 'cam-02') THEN ' Online' ELSE status END AS status, CASE WHEN camera_id IN ('cam-02', 'cam-07') THEN 'Dahua ' || name ELSE name END AS name, CASE camera_id WHEN 'cam-01' THEN 'rtsp://viewer:x@10.0.0.1:554/cam/RealMonitor?subtype=0' WHEN 'cam-02' THEN 'rtsp://10.0.0.2/stream1' WHEN 'cam-05' THEN 'RTSP://10.0.0.5/realmonitor' WHEN 'cam-07' THEN 'rtsp:///stream' ELSE url END AS u FROM cam)",
)
def sc15_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices that can be spoken to: online, with an address that has a host, and a name or path of the maker. The channel counts
    from 0, and is 0 where none is given."""
    c, u = addressed(spark, sf_dir), F.col("url")
    host = F.regexp_extract(u, r"^rtsp://(?:[^@/]*@)?([^:/?]+)", 1)
    made = F.lower(u).contains("realmonitor") | F.lower(F.coalesce("name", F.lit(""))).contains("dahua")
    login = F.when(u.rlike("^rtsp://[^@/]+@"), F.regexp_extract(u, "^rtsp://([^:@/]+)", 1)).otherwise("admin")
    channel = F.coalesce(F.regexp_extract(u, r"[?].*channel=([0-9]+)", 1).try_cast("long") - 1, F.lit(0).cast("long"))
    return c.where((F.lower(F.trim("status")) == "online") & u.startswith("rtsp://") & (host != "") & made).select("camera_id", host.alias("host"), channel.alias("channel"), login.alias("login"))


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras with addresses, names and states in more ways."""
    k = F.col("camera_id")
    urls = {"cam-01": "rtsp://viewer:x@10.0.0.1:554/cam/RealMonitor?subtype=0", "cam-02": "rtsp://10.0.0.2/stream1", "cam-05": "RTSP://10.0.0.5/realmonitor", "cam-07": "rtsp:///stream"}
    url = F.coalesce(F.create_map(*[F.lit(x) for p in urls.items() for x in p])[k], F.col("url"))
    status = F.when(k.isin("cam-01", "cam-02"), " Online").otherwise(F.col("status"))
    return cameras(spark, sf_dir).withColumns({"url": url, "status": status, "name": F.when(k.isin("cam-02", "cam-07"), F.concat(F.lit("Dahua "), F.col("name"))).otherwise(F.col("name"))})


@query("SELECT camera_id FROM (SELECT camera_id, status, CASE camera_id WHEN 'cam-05' THEN ' RTSP://10.0.0.5/realmonitor' WHEN 'cam-07' THEN 'http://10.0.0.7/rtsp' ELSE url END AS u FROM cam) WHERE status = 'online' AND starts_with(lower(trim(u)), 'rtsp')")
def sc20_synchronised_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status exactly as written, and an address that starts with rtsp in any case, after white space."""
    url = F.when(F.col("camera_id") == "cam-05", " RTSP://10.0.0.5/realmonitor").when(F.col("camera_id") == "cam-07", "http://10.0.0.7/rtsp").otherwise(F.col("url"))
    return cameras(spark, sf_dir).where((F.col("status") == "online") & F.lower(F.trim(url)).startswith("rtsp")).select("camera_id")


def _one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures run for what the stream had on its last days; those that should run are the online cameras with an address but one."""
    wanted = cameras(spark, sf_dir).where("status = 'online'").select("camera_id")
    running = detections(spark, sf_dir).where(f"{NOW} - sec < 864000 and camera_id <> 'cam-05'").select("camera_id").distinct()
    return wanted.join(running, "camera_id", "left_anti").withColumn("change", F.lit("start")).unionByName(running.join(wanted, "camera_id", "left_anti").withColumn("change", F.lit("stop")))


_SIDES = f"w AS (SELECT camera_id FROM cam WHERE status = 'online'), r AS (SELECT DISTINCT camera_id FROM det WHERE {NOW} - sec < 864000 AND camera_id <> 'cam-05')"


@query("SELECT camera_id, 'start' AS change FROM w WHERE camera_id NOT IN (SELECT camera_id FROM r) UNION ALL SELECT camera_id, 'stop' FROM r WHERE camera_id NOT IN (SELECT camera_id FROM w)", _SIDES)
def so3_j13_cameras_on_one_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures to start and to stop: cameras that only one side has."""
    return _one_sided(spark, sf_dir)


@query("SELECT camera_id FROM w WHERE camera_id NOT IN (SELECT camera_id FROM r)", _SIDES)
def so3_j13_cameras_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_sided(spark, sf_dir).where("change = 'start'").select("camera_id")


@query(f"SELECT event_id FROM det WHERE {NOW} - sec <= CASE WHEN class_name = 'person' THEN 172800 ELSE 345600 END")
def st4_st5_not_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of two days at most, vehicles of four, counted from a given time."""
    return detections(spark, sf_dir).where(NOW - F.col("sec") <= F.when(F.col("class_name") == "person", 172800).otherwise(345600)).select("event_id")


@query(
    'SELECT event_id FROM r WHERE ok',
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, slot ORDER BY confidence DESC, event_id) AS k FROM (SELECT camera_id, event_id, confidence, sec // 21600 AS slot, x1 // 100 * 100 AS x1, y1 // 400 * 400 AS y1, x1 // 100 * 100 + 300 AS x2, y1 // 400 * 400 + 100 AS y2 FROM det)),
  r AS (SELECT camera_id, slot, k, event_id, confidence, true AS ok, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM n WHERE k = 1
    UNION ALL SELECT camera_id, slot, k, event_id, confidence, ok, CASE WHEN ok THEN kept || [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ELSE kept END FROM (
      SELECT n.*, r.kept, NOT EXISTS (SELECT 1 FROM unnest(r.kept) u(q) WHERE (CASE WHEN greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0) > 0 THEN CAST(greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0) AS DOUBLE) / ((q.x2 - q.x1) * (q.y2 - q.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(q.x2, n.x2) - greatest(q.x1, n.x1), 0) * greatest(least(q.y2, n.y2) - greatest(q.y1, n.y1), 0)) ELSE 0 END) >= 0.5) AS ok FROM r JOIN n ON n.camera_id = r.camera_id AND n.slot = r.slot AND n.k = r.k + 1))""",
    recursive=True,
)
def ge4_suppressed_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors in each camera and hour where an overlap of just as much suppresses too; boxes lie on a coarse grid, so that
    there are such. Tested by a plain loop."""
    from framelake.operators.boxes import survivors
    d = detections(spark, sf_dir).withColumn("slot", F.expr("sec div 21600"))
    x, y = F.floor(F.col("x1") / 100) * 100, F.floor(F.col("y1") / 400) * 400
    d = d.select("camera_id", "slot", "event_id", F.col("confidence").alias("score"), x.alias("x1"), y.alias("y1"), (x + 300).alias("x2"), (y + 100).alias("y2"))
    return survivors(d, ["camera_id", "slot"], 0.5, inclusive=True).select("event_id")
