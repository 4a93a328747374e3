"""Measurements of frames and crops: load, drops, light, glare, colour, quality, and choices among candidate readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.plates import basic, valid
from framelake.operators.plates import BASIC, VALID
from framelake.plans.registry import query
from framelake.sources.tables import detections

SLOT = 21600


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with what was measured on their crops and what became of them, derived like the other columns."""
    i = F.col("event_id")
    return detections(spark, sf_dir).select(
        "*",
        (i * 31 % 256).alias("v_centre"),
        (i * 43 % 256).alias("v_lower"),
        (i * 59 % 180).alias("hue"),
        (i * 61 % 256).alias("saturation"),
        (i * 17 % 90).alias("contrast"),
        ((i * 7 % 30) / 100.0).alias("edges"),
        (i % 13).alias("components"),
        (i * 7 % 180 + 5).alias("ms"),
        (i * 11 % 2500).alias("lag_ms"),
        F.when(i % 10 < 6, "processed").when(i % 10 == 6, "backpressure").when(i % 10 == 7, "age").when(i % 10 == 8, "no_frame").otherwise("invalid_bbox").alias("outcome"),
        F.when(i % 3 == 0, "fallback").otherwise("first").alias("route"),
        (i % 4 != 0).alias("success"),
        F.element_at(F.array(*[F.lit(x) for x in ENGINES]), (i % 6 + 1).cast("int")).alias("engine"),
    )


# How far each source of readings is trusted, and what a length adds.
ENGINES = ["dahua_sdk", "fortress", "paddleocr", "yolo", "easyocr", "other"]
TRUST = {"dahua_sdk": 0.95, "fortress": 0.90, "paddleocr": 0.80, "yolo": 0.75, "easyocr": 0.70}
LENGTHS = {7: 0.05, 8: 0.10, 9: 0.10, 10: 0.05}

S = f"""s AS (SELECT *, event_id * 31 % 256 AS v_centre, event_id * 43 % 256 AS v_lower, event_id * 59 % 180 AS hue, event_id * 61 % 256 AS saturation, event_id * 17 % 90 AS contrast, (event_id * 7 % 30) / CAST(100 AS DOUBLE) AS edges,
  event_id % 13 AS components, event_id * 7 % 180 + 5 AS ms, event_id * 11 % 2500 AS lag_ms, CASE WHEN event_id % 10 < 6 THEN 'processed' WHEN event_id % 10 = 6 THEN 'backpressure' WHEN event_id % 10 = 7 THEN 'age' WHEN event_id % 10 = 8 THEN 'no_frame' ELSE 'invalid_bbox' END AS outcome,
  CASE WHEN event_id % 3 = 0 THEN 'fallback' ELSE 'first' END AS route, event_id % 4 <> 0 AS success, CASE event_id % 6 {" ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ENGINES))} END AS engine, {BASIC} AS plain FROM det)"""


def load(df: DataFrame) -> DataFrame:
    """Per camera: rate, counts, share dropped, mean and last times; of processed frames only, for the times."""
    done = F.col("outcome") == "processed"
    n, got = F.count("*"), F.greatest(F.count_if(done), F.lit(1))
    last = F.max(F.when(done, F.struct("sec", "event_id", "ms", "lag_ms")))
    by = df.groupBy("camera_id").agg(
        n.alias("received"), F.count_if(done).alias("processed"), F.round(n / F.greatest(F.max("sec") - F.min("sec"), F.lit(1)), 6).alias("fps"),
        F.round(F.count_if(~done) * 100.0 / n, 2).alias("drop_percent"), F.round(F.sum(F.when(done, F.col("ms"))) / got, 2).alias("avg_ms"),
        F.round(F.sum(F.when(done, F.col("lag_ms"))) / got, 2).alias("avg_lag_ms"), last.alias("last"),
    )
    return by.select("*", F.col("last.ms").alias("last_ms"), F.col("last.lag_ms").alias("last_lag_ms")).drop("last")


@query(
    """SELECT camera_id, count(*) AS received, count(*) FILTER (WHERE outcome = 'processed') AS processed, round(count(*) / CAST(greatest(max(sec) - min(sec), 1) AS DOUBLE), 6) AS fps,
  round(count(*) FILTER (WHERE outcome <> 'processed') * CAST(100 AS DOUBLE) / count(*), 2) AS drop_percent, round(sum(ms) FILTER (WHERE outcome = 'processed') / CAST(greatest(count(*) FILTER (WHERE outcome = 'processed'), 1) AS DOUBLE), 2) AS avg_ms,
  round(sum(lag_ms) FILTER (WHERE outcome = 'processed') / CAST(greatest(count(*) FILTER (WHERE outcome = 'processed'), 1) AS DOUBLE), 2) AS avg_lag_ms, arg_max(ms, sec * 10000000 + event_id) FILTER (WHERE outcome = 'processed') AS last_ms,
  arg_max(lag_ms, sec * 10000000 + event_id) FILTER (WHERE outcome = 'processed') AS last_lag_ms FROM s GROUP BY camera_id""",
    S,
)
def ag8_camera_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(samples(spark, sf_dir))


@query(
    """SELECT round(avg(ms) FILTER (WHERE outcome = 'processed'), 6) AS avg_ms, round(avg(lag_ms) FILTER (WHERE outcome = 'processed'), 6) AS avg_lag_ms, round(count(*) FILTER (WHERE route = 'first' AND success) / CAST(count(*) FILTER (WHERE route = 'first') AS DOUBLE), 3) AS success_rate,
  round(count(*) FILTER (WHERE route = 'fallback' AND success) / CAST(count(*) FILTER (WHERE route = 'fallback') AS DOUBLE), 3) AS fallback_rate FROM s""",
    S,
)
def ag9_ag11_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all cameras: mean times of what was processed, and how often the first way and the fallback succeed."""
    done, first = F.col("outcome") == "processed", F.col("route") == "first"
    return samples(spark, sf_dir).agg(
        F.round(F.avg(F.when(done, F.col("ms"))), 6).alias("avg_ms"), F.round(F.avg(F.when(done, F.col("lag_ms"))), 6).alias("avg_lag_ms"),
        F.round(F.count_if(first & F.col("success")) / F.count_if(first), 3).alias("success_rate"), F.round(F.count_if(~first & F.col("success")) / F.count_if(~first), 3).alias("fallback_rate"),
    )


LIGHT = "0.6 * v_centre + 0.4 * v_lower"


@query(
    "SELECT camera_id, slot, round(CAST(0.6 AS DOUBLE) * quantile_cont(v_centre, 0.9) + CAST(0.4 AS DOUBLE) * quantile_cont(v_lower, 0.9), 6) AS brightness FROM (SELECT *, sec // 21600 AS slot FROM s) GROUP BY camera_id, slot",
    S,
)
def ag29_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera and six hours: nine tenths of the samples are darker, 0.6 of it from the centre and 0.4 from below."""
    both = F.lit(0.6) * F.percentile("v_centre", F.lit(0.9)) + F.lit(0.4) * F.percentile("v_lower", F.lit(0.9))
    return samples(spark, sf_dir).groupBy("camera_id", F.expr(f"sec div {SLOT}").alias("slot")).agg(F.round(both, 6).alias("brightness"))


def glare(bright: int = 200, pale: int = 60) -> Column:
    """The share of samples that are bright and pale."""
    return F.count_if((F.col("v_centre") > bright) & (F.col("saturation") < pale)).cast("double") / F.count("*")


@query("SELECT camera_id, count(*) FILTER (WHERE v_centre > 200 AND saturation < 60) / CAST(count(*) AS DOUBLE) AS ratio, count(*) FILTER (WHERE v_centre > 200 AND saturation < 60) / CAST(count(*) AS DOUBLE) > 0.1 AS glare FROM s GROUP BY camera_id", S)
def ag30_glare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("camera_id").agg(glare().alias("ratio")).withColumn("glare", F.col("ratio") > 0.1)


@query("SELECT CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_image' WHEN (x2 - x1) * (y2 - y1) < 10000 THEN 'too_small' WHEN v_centre < 40 THEN 'too_dark' WHEN v_centre > 220 THEN 'too_bright' WHEN sharpness < 80 THEN 'blurry' ELSE 'good' END AS quality, count(*) AS n FROM s GROUP BY 1", S)
def pf24_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that keeps a crop out of a collection."""
    w, h, v = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("v_centre")
    q = F.when((w <= 0) | (h <= 0), "invalid_image").when(w * h < 10000, "too_small").when(v < 40, "too_dark").when(v > 220, "too_bright").when(F.col("sharpness") < 80, "blurry").otherwise("good")
    return samples(spark, sf_dir).groupBy(q.alias("quality")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, CASE WHEN saturation < 30 AND v_centre > 150 THEN 'white' WHEN hue > 100 AND hue < 130 AND saturation > 50 THEN 'blue' WHEN (hue > 170 OR hue < 10) AND saturation > 80 THEN 'red' WHEN hue < 30 AND saturation > 100 THEN 'yellow'
  WHEN hue > 35 AND hue < 85 AND saturation > 50 THEN 'green' ELSE 'unknown' END AS colour FROM s""",
    S,
)
def sf36_plate_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mean hue (of 180), saturation and value."""
    h, s, v = F.col("hue"), F.col("saturation"), F.col("v_centre")
    colour = F.when((s < 30) & (v > 150), "white").when((h > 100) & (h < 130) & (s > 50), "blue").when(((h > 170) | (h < 10)) & (s > 80), "red").when((h < 30) & (s > 100), "yellow").when((h > 35) & (h < 85) & (s > 50), "green")
    return samples(spark, sf_dir).select("event_id", F.coalesce(colour, F.lit("unknown")).alias("colour"))


@query(
    """SELECT event_id, round(CAST(0.5 AS DOUBLE) * least(edges / CAST(0.12 AS DOUBLE), 1) + CAST(0.3 AS DOUBLE) * CASE WHEN components < 5 THEN 0 ELSE least((components - 4) / CAST(6 AS DOUBLE), 1) END + CAST(0.2 AS DOUBLE) * least(sharpness / CAST(200 AS DOUBLE), 1), 6) AS score,
  CASE WHEN sharpness > 300 AND contrast > 60 THEN 'none' WHEN sharpness > 100 AND contrast > 40 THEN 'light' ELSE 'full' END AS enhancement FROM s""",
    S,
)
def sf38_sf43_crop_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, parts and sharpness in one score; and how much to enhance: not at all, lightly or fully."""
    parts = F.when(F.col("components") < 5, 0.0).otherwise(F.least((F.col("components") - 4) / 6.0, F.lit(1.0)))
    score = F.lit(0.5) * F.least(F.col("edges") / 0.12, F.lit(1.0)) + F.lit(0.3) * parts + F.lit(0.2) * F.least(F.col("sharpness") / 200.0, F.lit(1.0))
    level = F.when((F.col("sharpness") > 300) & (F.col("contrast") > 60), "none").when((F.col("sharpness") > 100) & (F.col("contrast") > 40), "light").otherwise("full")
    return samples(spark, sf_dir).select("event_id", F.round(score, 6).alias("score"), level.alias("enhancement"))


def weighted() -> Column:
    """Confidence by the trust in its source, more for a valid form and a usual length, 1 at most."""
    trust = F.coalesce(F.create_map(*[F.lit(x) for p in TRUST.items() for x in p])[F.col("engine")], F.lit(0.6))
    length = F.coalesce(F.create_map(*[F.lit(x) for p in LENGTHS.items() for x in p])[F.length("plain")], F.lit(0.0))
    return F.least(F.lit(1.0), F.col("confidence") * trust + F.when(valid("plain"), 0.15).otherwise(0.0) + length)


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("class_name <> 'person'").withColumn("plain", basic("plate"))


WEIGHTED = f"""least(CAST(1 AS DOUBLE), confidence * CASE engine {" ".join(f"WHEN '{e}' THEN CAST({t} AS DOUBLE)" for e, t in TRUST.items())} ELSE CAST(0.6 AS DOUBLE) END + CASE WHEN {VALID.format(p="plain")} THEN CAST(0.15 AS DOUBLE) ELSE 0 END
  + CASE length(plain) {" ".join(f"WHEN {n} THEN CAST({b} AS DOUBLE)" for n, b in LENGTHS.items())} ELSE 0 END)"""


@query(f"SELECT event_id, round({WEIGHTED}, 9) AS score FROM s WHERE class_name <> 'person'", S)
def sf23_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir).select("event_id", F.round(weighted(), 9).alias("score"))


@query(
    "SELECT camera_id, slot, event_id, plain AS plate, score FROM f WHERE place = 1",
    S
    + f""", w AS (SELECT *, sec // {SLOT} AS slot, {WEIGHTED} AS weighted, {VALID.format(p="plain")} AS fits FROM s WHERE class_name <> 'person'),
  n AS (SELECT *, count(*) OVER (PARTITION BY camera_id, slot, plain) AS n FROM w), b AS (SELECT *, round(least(CAST(1 AS DOUBLE), weighted + CASE WHEN n >= 2 THEN least(CAST(0.1 AS DOUBLE), n * CAST(0.02 AS DOUBLE)) ELSE 0 END), 9) AS score FROM n WHERE fits AND weighted >= 0.65),
  f AS (SELECT *, row_number() OVER (PARTITION BY camera_id, slot ORDER BY score DESC, event_id) AS place FROM b)""",
)
def sf24_best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera and six hours, the best valid reading of 0.65 or more; readings that agree add to each other's score."""
    d = read(spark, sf_dir).withColumn("slot", F.expr(f"sec div {SLOT}")).withColumn("weighted", weighted())
    same = d.groupBy("camera_id", "slot", "plain").agg(F.count("*").alias("n"))
    d = d.where(valid("plain") & (F.col("weighted") >= 0.65)).join(same, ["camera_id", "slot", "plain"])
    score = F.round(F.least(F.lit(1.0), F.col("weighted") + F.when(F.col("n") >= 2, F.least(F.lit(0.1), F.col("n") * 0.02)).otherwise(0.0)), 9)
    best = F.max(F.struct(score.alias("score"), (-F.col("event_id")).alias("e"), F.col("plain").alias("plate")))
    return d.groupBy("camera_id", "slot").agg(best.alias("b")).select("camera_id", "slot", (-F.col("b.e")).alias("event_id"), "b.plate", "b.score")


@query(
    """SELECT camera_id, slot, plate, votes, round(CASE WHEN votes * 10 >= n * 8 AND votes >= 3 THEN least(1, middle * CAST(1.15 AS DOUBLE)) WHEN votes * 10 >= n * 6 AND votes >= 2 THEN least(1, middle * CAST(1.05 AS DOUBLE)) WHEN votes = 1 AND middle > 0.85 THEN middle * CAST(0.9 AS DOUBLE) ELSE middle * CAST(0.95 AS DOUBLE) END, 6) AS confidence FROM f WHERE place = 1""",
    S
    + f""", v AS (SELECT camera_id, sec // {SLOT} AS slot, plain AS plate, count(*) AS votes, median(confidence) AS middle, avg(least(confidence, 0.9)) AS capped FROM s WHERE class_name <> 'person' GROUP BY ALL),
  t AS (SELECT *, sum(votes) OVER (PARTITION BY camera_id, slot) AS n FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY camera_id, slot ORDER BY round(votes / CAST(n AS DOUBLE) * CAST(0.6 AS DOUBLE) + (middle + capped) / CAST(2 AS DOUBLE) * CAST(0.4 AS DOUBLE), 9) DESC, plate) AS place FROM t)""",
)
def ag20_agreed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one crop in several ways, here of one camera and six hours: votes and middling confidence decide together,
    and how far they agree raises or lowers the result's confidence."""
    v = read(spark, sf_dir).groupBy("camera_id", F.expr(f"sec div {SLOT}").alias("slot"), F.col("plain").alias("plate"))
    v = v.agg(F.count("*").alias("votes"), F.median("confidence").alias("middle"), F.avg(F.least("confidence", F.lit(0.9))).alias("capped"))
    n = v.groupBy("camera_id", "slot").agg(F.sum("votes").alias("n"))
    v = v.join(n, ["camera_id", "slot"])
    score = F.round(F.col("votes") / F.col("n") * 0.6 + (F.col("middle") + F.col("capped")) / 2.0 * 0.4, 9)
    v = v.withColumn("place", F.row_number().over(Window.partitionBy("camera_id", "slot").orderBy(score.desc(), "plate"))).where("place = 1")
    m, k, total = F.col("middle"), F.col("votes"), F.col("n")
    sure = F.when((k * 10 >= total * 8) & (k >= 3), F.least(F.lit(1.0), m * 1.15)).when((k * 10 >= total * 6) & (k >= 2), F.least(F.lit(1.0), m * 1.05)).when((k == 1) & (m > 0.85), m * 0.9).otherwise(m * 0.95)
    return v.select("camera_id", "slot", "plate", "votes", F.round(sure, 6).alias("confidence"))


PAIRED = f"""pr AS (SELECT a.event_id, a.plate AS one, a.confidence AS sure, b.plate AS two, b.confidence AS unsure, a.sharpness < 120 AS night, b.sharpness AS s2 FROM det a JOIN det b ON b.event_id = a.event_id + 1 AND b.class_name <> 'person' WHERE a.class_name <> 'person')"""


@query(
    """SELECT event_id, CASE WHEN ok THEN text ELSE '' END AS plate, CASE WHEN ok THEN conf ELSE 0 END AS confidence FROM (SELECT *, conf >= CASE WHEN night THEN 0.32 ELSE 0.42 END OR fits AND conf >= CASE WHEN night THEN 0.22 ELSE 0.3 END AS ok
  FROM (SELECT event_id, night, CASE WHEN first THEN one ELSE two END AS text, CASE WHEN first THEN sure ELSE unsure END AS conf, CASE WHEN first THEN v1 ELSE v2 END AS fits FROM c))""",
    PAIRED + f", w AS (SELECT *, {VALID.format(p='one')} AS v1, {VALID.format(p='two')} AS v2 FROM pr), c AS (SELECT *, CASE WHEN v1 <> v2 THEN v1 ELSE sure >= unsure END AS first FROM w)",
)
def sf30_chosen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two readings the valid one, else the surer; kept from a floor of 0.42 (0.32 by night), or if valid from a lower one."""
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    two = d.select((F.col("event_id") - 1).alias("event_id"), F.col("plate").alias("other"), F.col("confidence").alias("unsure"))
    c = d.join(two, "event_id").withColumn("v1", valid("plate")).withColumn("v2", valid("other"))
    first = F.when(F.col("v1") != F.col("v2"), F.col("v1")).otherwise(F.col("confidence") >= F.col("unsure"))
    c = c.withColumn("first", first).withColumn("text", F.when(first, F.col("plate")).otherwise(F.col("other")))
    c = c.withColumn("conf", F.when(F.col("first"), F.col("confidence")).otherwise(F.col("unsure"))).withColumn("fits", F.when(F.col("first"), F.col("v1")).otherwise(F.col("v2")))
    night = F.col("sharpness") < 120
    ok = (F.col("conf") >= F.when(night, 0.32).otherwise(0.42)) | (F.col("fits") & (F.col("conf") >= F.when(night, 0.22).otherwise(0.3)))
    return c.select("event_id", F.when(ok, F.col("text")).otherwise("").alias("plate"), F.when(ok, F.col("conf")).otherwise(0.0).alias("confidence"))


@query("SELECT event_id, substr(one, 1, 3) || substr(two, 4) AS plate, round(CAST(0.4 AS DOUBLE) * sure + CAST(0.6 AS DOUBLE) * unsure, 6) AS confidence FROM pr", PAIRED)
def ag24_j11_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and lower line of one plate put together; the lower line's confidence counts for more."""
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    low = d.select((F.col("event_id") - 1).alias("event_id"), F.substring("plate", 4, 1000).alias("low"), F.col("confidence").alias("unsure"))
    both = d.select("event_id", F.substring("plate", 1, 3).alias("top"), "confidence").join(low, "event_id")
    return both.select("event_id", F.concat("top", "low").alias("plate"), F.round(F.lit(0.4) * F.col("confidence") + F.lit(0.6) * F.col("unsure"), 6).alias("confidence"))


@query(f"SELECT camera_id, sec // {SLOT} AS slot, arg_max(event_id, (x2 - x1) * (y2 - y1) * 10000000 - event_id) AS event_id FROM det WHERE class_name = 'person' AND x2 - x1 >= 60 AND y2 - y1 >= 60 AND confidence >= 0.1 GROUP BY ALL")
def ag23_pf25_largest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a camera's faces in six hours that are large and sure enough, the largest."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = detections(spark, sf_dir).where("class_name = 'person' and confidence >= 0.1").where((w >= 60) & (h >= 60))
    return d.groupBy("camera_id", F.expr(f"sec div {SLOT}").alias("slot")).agg(F.max_by("event_id", F.struct(w * h, -F.col("event_id"))).alias("event_id"))


@query(
    f"""SELECT camera_id, slot, substr(string_agg(line, chr(10) ORDER BY event_id), 1, 12000) AS context FROM (SELECT camera_id, sec // {4 * SLOT} AS slot, event_id, class_name || ' ' || CAST(CAST(round(confidence * 1000) AS INT) AS VARCHAR) || ' [' || x1 || ', ' || y1 || ', ' || x2 || ', ' || y2 || ']' AS line FROM det) GROUP BY ALL""",
)
def ag25_context(spark: SparkSession, sf_dir: str, most: int = 12_000) -> DataFrame:
    """A camera's detections of a day as lines of text, cut at a number of characters. Lines whose break lies beyond it aren't collected."""
    line = F.concat(F.col("class_name"), F.lit(" "), F.round(F.col("confidence") * 1000).cast("int").cast("string"), F.lit(" ["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")]), F.lit("]"))
    d = detections(spark, sf_dir).select("camera_id", F.expr(f"sec div {4 * SLOT}").alias("slot"), "event_id", line.alias("line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("camera_id", "slot").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    by = d.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= most).groupBy("camera_id", "slot").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    return by.select("camera_id", "slot", F.substring(F.array_join("l.line", "\n"), 1, most).alias("context"))


@query("SELECT class_name, count(*) AS n, count(*) FILTER (WHERE v_centre >= 40 AND sharpness >= 80) AS good, max(sec) AS newest FROM s GROUP BY class_name", S)
def ag27_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been collected by kind, how much of it is good, and when the last came."""
    good = (F.col("v_centre") >= 40) & (F.col("sharpness") >= 80)
    return samples(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.max("sec").alias("newest"))


def percent_of_container(width: float, height: float, across: float, down: float) -> list[Column]:
    """A box in percent of a container that shows the whole frame, with bars where the shapes differ."""
    scale = min(across / width, down / height)
    x, y = (across - width * scale) / 2, (down - height * scale) / 2
    c = [F.col(k).cast("double") for k in ("x1", "y1", "x2", "y2")]
    return [(x + c[0] * scale) / across * 100, (y + c[1] * scale) / down * 100, (c[2] - c[0]) * scale / across * 100, (c[3] - c[1]) * scale / down * 100]


@query("SELECT event_id, round(x1 / CAST(19.2 AS DOUBLE), 6) AS x, round((CAST(60 AS DOUBLE) + y1 * (CAST(640 AS DOUBLE) / 1920)) / 480 * 100, 6) AS y, round((x2 - x1) / CAST(19.2 AS DOUBLE), 6) AS w, round((y2 - y1) * (CAST(640 AS DOUBLE) / 1920) / 480 * 100, 6) AS h FROM det")
def ge14_overlay_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(percent_of_container(1920, 1080, 640, 480), "xywh", strict=True)])


@query(
    """SELECT event_id, CASE WHEN points IS NOT NULL THEN greatest(0, x1 - CAST(floor((x2 - x1) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS left, CASE WHEN points IS NOT NULL THEN greatest(0, y1 - CAST(floor((y2 - y1) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS top,
  CASE WHEN points IS NOT NULL THEN least(1920, x2 + CAST(floor((x2 - x1) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 1920 END AS right, CASE WHEN points IS NOT NULL THEN least(1080, y2 + CAST(floor((y2 - y1) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 1080 END AS bottom
  FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN 1 END AS points FROM det)"""
)
def ge7_ge9_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon as text, parsed if it has three points of two numbers or more, as a box with margins; else the whole frame."""
    x1, y1, x2, y2 = (F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2"))
    four = F.concat(F.lit("[["), x1, F.lit(","), y1, F.lit("],["), x2, F.lit(","), y1, F.lit("],["), x2, F.lit(","), y2, F.lit("],["), x1, F.lit(","), y2, F.lit("]]"))
    bad = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("[["), x1, F.lit(","), y1, F.lit("]]"))).otherwise(F.lit("[[1,2],[3],[4,5]]"))
    d = detections(spark, sf_dir).withColumn("text", F.when(F.col("event_id") % 5 != 0, four).otherwise(bad))
    p = F.from_json("text", "array<array<double>>")
    p = F.when((F.size(p) >= 3) & F.forall(p, lambda q: F.size(q) == 2), p)
    d = d.withColumn("p", p)
    xs, ys = F.transform("p", lambda q: q[0]), F.transform("p", lambda q: q[1])
    dx, dy = F.floor((F.array_max(xs) - F.array_min(xs)) * 0.3), F.floor((F.array_max(ys) - F.array_min(ys)) * 0.3)
    sides = [(F.greatest(F.lit(0.0), F.array_min(xs) - dx), 0, "left"), (F.greatest(F.lit(0.0), F.array_min(ys) - dy), 0, "top"), (F.least(F.lit(1920.0), F.array_max(xs) + dx), 1920, "right"), (F.least(F.lit(1080.0), F.array_max(ys) + dy), 1080, "bottom")]
    return d.select("event_id", *[F.coalesce(c.cast("long"), F.lit(whole).cast("long")).alias(n) for c, whole, n in sides])


@query(
    """SELECT event_id, array_to_string(list_transform(o, lambda p: CAST(CAST(round(p.x) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(p.y) AS BIGINT) AS VARCHAR)), ',') AS corners FROM (SELECT event_id, [list_sort(list_transform(c, lambda p: {'k': round(p.x + p.y, 6), 'x': p.x, 'y': p.y}))[1], list_sort(list_transform(c, lambda p: {'k': round(p.y - p.x, 6), 'x': p.x, 'y': p.y}))[1],
    list_sort(list_transform(c, lambda p: {'k': -round(p.x + p.y, 6), 'x': p.x, 'y': p.y}))[1], list_sort(list_transform(c, lambda p: {'k': -round(p.y - p.x, 6), 'x': p.x, 'y': p.y}))[1]] AS o FROM c)""",
    """a AS (SELECT event_id, (x1 + x2) / CAST(2 AS DOUBLE) AS cx, (y1 + y2) / CAST(2 AS DOUBLE) AS cy, (x2 - x1) / CAST(2 AS DOUBLE) AS hw, (y2 - y1) / CAST(2 AS DOUBLE) AS hh, (event_id % 80) / CAST(100 AS DOUBLE) AS r FROM det),
  c AS (SELECT event_id, list_transform([[-hw, -hh], [hw, -hh], [hw, hh], [-hw, hh]], lambda q: {'x': cx + q[1] * cos(r) - q[2] * sin(r), 'y': cy + q[1] * sin(r) + q[2] * cos(r)}) AS c FROM a)""",
)
def ge12_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a turned box in order: least sum, least difference, greatest sum, greatest difference of y and x."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    hw, hh, r = (F.col("x2") - F.col("x1")) / 2.0, (F.col("y2") - F.col("y1")) / 2.0, (F.col("event_id") % 80) / 100.0
    points = F.array(*[F.struct((cx + a * hw * F.cos(r) - b * hh * F.sin(r)).alias("x"), (cy + a * hw * F.sin(r) + b * hh * F.cos(r)).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])

    def first(sign: int, of: int) -> Column:
        return F.array_min(F.transform("c", lambda p: F.struct((sign * F.round(p["y"] + of * p["x"], 6)).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))

    d = detections(spark, sf_dir).withColumn("c", points).withColumn("o", F.array(first(1, 1), first(1, -1), first(-1, 1), first(-1, -1)))
    return d.select("event_id", F.array_join(F.transform("o", lambda p: F.concat_ws(" ", F.round(p["x"]).cast("long").cast("string"), F.round(p["y"]).cast("long").cast("string"))), ",").alias("corners"))
