"""Plate strings: normalising, validating, scoring and choosing among readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.plates import PROVINCES, SERIES, TO_DIGIT, TO_SERIES, basic, motorcycle, positional, sampled, valid
from framelake.plans.registry import query
from framelake.sources.tables import detections

BASIC = "regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g')"
VALID = f"(regexp_matches({{p}}, '^[0-9]{{{{2}}}}[{SERIES}]{{{{1,2}}}}[0-9]{{{{4,6}}}}$') AND length({{p}}) BETWEEN 7 AND 10 AND substr({{p}}, 1, 2) IN ({', '.join(repr(p) for p in PROVINCES)}))"
DIGIT, LETTER = TO_DIGIT, TO_SERIES
POSITIONAL = f"""translate(substr(plate, 1, 2), '{DIGIT[0]}', '{DIGIT[1]}')
  || CASE WHEN regexp_matches(substr(plate, 3, 1), '[A-Z]') THEN substr(plate, 3, 1) ELSE translate(substr(plate, 3, 1), '{LETTER[0]}', '{LETTER[1]}') END
  || CASE WHEN regexp_matches(substr(plate, 4, 1), '[A-Z]') THEN substr(plate, 4, 1) || translate(substr(plate, 5), '{DIGIT[0]}', '{DIGIT[1]}')
     WHEN length(plate) >= 9 AND regexp_matches(substr(plate, 4, 1), '[{LETTER[0]}]') THEN translate(substr(plate, 4, 1), '{LETTER[0]}', '{LETTER[1]}') || translate(substr(plate, 5), '{DIGIT[0]}', '{DIGIT[1]}')
     ELSE translate(substr(plate, 4), '{DIGIT[0]}', '{DIGIT[1]}') END"""
P = f"p AS (SELECT *, {BASIC} AS plain, {POSITIONAL} AS fixed FROM det WHERE class_name <> 'person')"


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).where("class_name <> 'person'")
    return d.withColumn("plain", basic("plate")).withColumn("fixed", positional("plate"))


@query(f"SELECT event_id, plain, fixed, {VALID.format(p='plain')} AS plain_valid, {VALID.format(p='fixed')} AS fixed_valid FROM p", P)
def sf1_sf2_sf5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates(spark, sf_dir).select("event_id", "plain", "fixed", valid("plain").alias("plain_valid"), valid("fixed").alias("fixed_valid"))


@query("SELECT event_id, levenshtein(plate, plate_clean) AS distance, levenshtein(plate, plate_clean) <= 1 AS close FROM det WHERE class_name <> 'person'")
def sf3_sf4_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plates(spark, sf_dir)
    return d.select("event_id", F.levenshtein("plate", "plate_clean").cast("long").alias("distance"), F.levenshtein("plate", "plate_clean", 1).between(0, 1).alias("close"))


@query(
    f"""SELECT event_id, CASE WHEN regexp_matches(fixed, '^[0-9]{{2}}[A-Z]{{1,2}}[0-9]+$') THEN 0 ELSE 20 END + CASE WHEN substr(fixed, 1, 2) IN ({", ".join(repr(p) for p in PROVINCES)}) THEN 0 ELSE 50 END
  + CASE WHEN length(fixed) IN (8, 9) THEN 0 ELSE 20 END AS penalty,
  CASE WHEN length(fixed) <= 6 THEN confidence * 0.72 WHEN length(fixed) > 12 THEN confidence * 0.9 ELSE confidence END AS adjusted FROM p""",
    P,
)
def sf29_length_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties in hundredths for form, province and length alone; confidence with the length penalty. The whole score is ``sf7`` in ``correction``."""
    f = F.col("fixed")
    penalty = (
        F.when(f.rlike("^[0-9]{2}[A-Z]{1,2}[0-9]+$"), 0).otherwise(20)
        + F.when(F.substring(f, 1, 2).isin(PROVINCES), 0).otherwise(50)
        + F.when(F.length(f).isin(8, 9), 0).otherwise(20)
    )
    adjusted = F.when(F.length(f) <= 6, F.col("confidence") * 0.72).when(F.length(f) > 12, F.col("confidence") * 0.9).otherwise(F.col("confidence"))
    return plates(spark, sf_dir).select("event_id", penalty.alias("penalty"), adjusted.alias("adjusted"))


@query("SELECT event_id, NOT starts_with(plain, 'UNKNOWN') AND NOT regexp_matches(plain, '^[0-9]{12,}$') AND confidence >= CASE WHEN class_name = 'motorcycle' THEN 0.3 ELSE 0.4 END AND length(plain) >= CASE WHEN class_name = 'motorcycle' THEN 7 ELSE 8 END AS accepted FROM p", P)
def pf19_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    bike = F.col("class_name") == "motorcycle"
    ok = ~F.col("plain").startswith("UNKNOWN") & ~F.col("plain").rlike("^[0-9]{12,}$") & (F.col("confidence") >= F.when(bike, 0.3).otherwise(0.4)) & (F.length("plain") >= F.when(bike, 7).otherwise(8))
    return plates(spark, sf_dir).select("event_id", ok.alias("accepted"))


@query("SELECT event_id, least(greatest(0.5 - 0.3 * (sharpness / 400.0), 0.3), 0.45) AS threshold FROM det")
def pf22_adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.least(F.greatest(F.lit(0.5) - F.lit(0.3) * (F.col("sharpness") / 400.0), F.lit(0.3)), F.lit(0.45))
    return detections(spark, sf_dir).select("event_id", t.alias("threshold"))


@query("SELECT event_id, regexp_matches(plain, '^[0-9]{2}[A-Z][0-9]{6}$') AND NOT regexp_matches(plate, '[-/]') AS motorcycle FROM p", P)
def sf20_motorcycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plates(spark, sf_dir).select("event_id", motorcycle("plate").alias("motorcycle"))




@query(
    "SELECT camera_id, event_id, label FROM r WHERE (before IS NULL OR before <> label) AND label <> 0",
    "r AS (SELECT *, event_id % 4 AS label, lag(event_id % 4) OVER (PARTITION BY camera_id ORDER BY sec, event_id) AS before FROM det)",
)
def sf26_collapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera's labels over all events, repeats collapsed and blanks dropped: a row for each that is kept."""
    from framelake.operators.history import changed

    d = detections(spark, sf_dir).withColumn("label", F.col("event_id") % 4)
    return changed(d, "label", ["camera_id"], ["sec", "event_id"]).where("label <> 0").select("camera_id", "event_id", "label")


@query("SELECT event_id, CAST('0x' || substr(md5(camera_id || ':' || CAST(track_id AS VARCHAR) || ':' || CAST(sec * 2 AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 AS dropped FROM det")
def st9_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", sampled(F.col("camera_id"), F.col("track_id"), F.col("sec"), 0.25).alias("dropped"))


@query("SELECT event_id, substr(regexp_replace(plate || '/' || camera_id, '[^A-Za-z0-9_-]', '_', 'g'), 1, 12) AS file FROM det")
def sf31_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring(F.regexp_replace(F.concat_ws("/", "plate", "camera_id"), "[^A-Za-z0-9_-]", "_"), 1, 12)
    return detections(spark, sf_dir).select("event_id", name.alias("file"))


@query("SELECT event_id, 0.85 + 0.15 * least(sharpness / 200.0, 1) AS factor, confidence * (0.85 + 0.15 * least(sharpness / 200.0, 1)) AS weighted FROM det")
def sf40_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.lit(0.85) + F.lit(0.15) * F.least(F.col("sharpness") / 200.0, F.lit(1.0))
    return detections(spark, sf_dir).select("event_id", f.alias("factor"), (F.col("confidence") * f).alias("weighted"))


@query(
    "SELECT track_id, plate, n, score, best FROM (SELECT track_id, plain AS plate, n, round(weight, 6) AS score, best, row_number() OVER (PARTITION BY track_id ORDER BY round(weight, 6) DESC, plain) AS place FROM s WHERE n >= 2 AND (top >= 0.65 OR n >= 3)) WHERE place = 1",
    P + f""", a AS (SELECT *, max((x2 - x1) * (y2 - y1)) OVER w AS largest, count(*) OVER w AS n, max(confidence) OVER w AS top FROM p WHERE track_id >= 0 WINDOW w AS (PARTITION BY track_id)),
  s AS (SELECT track_id, plain, n, top, max(confidence) AS best, sum(confidence * confidence * (1 + 0.5 * ((x2 - x1) * (y2 - y1)) / largest) * CASE WHEN {VALID.format(p="plain")} THEN 1.0 ELSE 0.3 END) AS weight FROM a GROUP BY ALL)""",
)
def ag16_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track of two readings or more, or three where none reaches 0.65: the plate of the largest sum of squared confidence,
    raised by area and lowered for an invalid form, with its best confidence."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    d = plates(spark, sf_dir).where("track_id >= 0").withColumn("area", area)
    tracks = d.groupBy("track_id").agg(F.max("area").alias("largest"), F.count("*").alias("n"), F.max("confidence").alias("top")).where("n >= 2 and (top >= 0.65 or n >= 3)")
    score = F.col("confidence") * F.col("confidence") * (1 + F.lit(0.5) * F.col("area") / F.col("largest")) * F.when(valid("plain"), 1.0).otherwise(0.3)
    votes = d.join(tracks, "track_id").groupBy("track_id", "n", "plain").agg(F.round(F.sum(score), 6).alias("score"), F.max("confidence").alias("best"))
    first = F.min(F.struct((-F.col("score")).alias("less"), "plain", "best"))
    return votes.groupBy("track_id", "n").agg(first.alias("f")).select("track_id", F.col("f.plain").alias("plate"), "n", (-F.col("f.less")).alias("score"), F.col("f.best").alias("best"))


@query(
    "SELECT track_id, plate, votes, records FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, plate) AS place FROM v) WHERE place = 1",
    P
    + f""", t AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS records, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC, (x2 - x1) * (y2 - y1) DESC, event_id) AS rank FROM p WHERE track_id >= 0),
  v AS (SELECT track_id, fixed AS plate, records, count(*) AS votes FROM t WHERE records >= 3 AND rank <= 5 AND {VALID.format(p="fixed")} GROUP BY ALL)""",
)
def ag17_finalised_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of three records or more: of their five best by confidence and area, the most frequent valid plate."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    d = plates(spark, sf_dir).where("track_id >= 0")
    best = Window.partitionBy("track_id").orderBy(F.desc("confidence"), area.desc(), "event_id")
    d = d.withColumn("records", F.count("*").over(Window.partitionBy("track_id"))).withColumn("rank", F.row_number().over(best))
    votes = d.where("records >= 3 and rank <= 5").where(valid("fixed")).groupBy("track_id", "records", F.col("fixed").alias("plate")).agg(F.count("*").alias("votes"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("votes"), "plate"))
    return votes.withColumn("place", place).where("place = 1").select("track_id", "plate", "votes", "records")


@query(
    "SELECT track_id, plate, n, total FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY total DESC, plate) AS place FROM m) WHERE place = 1",
    P + ", m AS (SELECT track_id, fixed AS plate, count(*) AS n, round(sum(confidence), 6) AS total FROM p WHERE track_id >= 0 GROUP BY ALL)",
)
def ag19_winner_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = plates(spark, sf_dir).where("track_id >= 0").groupBy("track_id", F.col("fixed").alias("plate")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("total"), "plate"))
    return m.withColumn("place", place).where("place = 1").drop("place")


@query(
    "SELECT track_id, plate, n * 1.0 / records AS ratio FROM (SELECT *, sum(n) OVER (PARTITION BY track_id) AS records, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, plate) AS place FROM m) WHERE place = 1",
    P + ", m AS (SELECT track_id, fixed AS plate, count(*) AS n FROM p WHERE track_id >= 0 GROUP BY ALL)",
)
def ag21_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = plates(spark, sf_dir).where("track_id >= 0").groupBy("track_id", F.col("fixed").alias("plate")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("track_id")
    m = m.withColumn("records", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "plate")))
    return m.where("place = 1").select("track_id", "plate", (F.col("n").cast("double") / F.col("records")).alias("ratio"))


@query(
    """SELECT track_id, string_agg(c, '' ORDER BY pos) AS plate, count(*) FILTER (WHERE share < 0.6) AS doubtful, count(*) FILTER (WHERE share < 0.6) <= 1 AND count(*) >= 7 AS complete
  FROM (SELECT *, round(weight / sum(weight) OVER (PARTITION BY track_id, pos), 6) AS share, row_number() OVER (PARTITION BY track_id, pos ORDER BY round(weight, 6) DESC, c) AS place FROM v) WHERE place = 1 GROUP BY track_id""",
    P
    + """, l AS (SELECT track_id, length(fixed) AS n, row_number() OVER (PARTITION BY track_id ORDER BY round(sum(confidence), 6) DESC, length(fixed) DESC) AS place FROM p WHERE track_id >= 0 GROUP BY track_id, length(fixed)),
  v AS (SELECT track_id, pos, substr(fixed, CAST(pos AS INT), 1) AS c, sum(confidence * (0.3 + 0.7 * least(sharpness / 200.0, 1))) AS weight
  FROM (SELECT p.*, unnest(range(1, l.n + 1)) AS pos FROM p JOIN l ON l.track_id = p.track_id AND l.place = 1 AND length(fixed) = l.n) GROUP BY ALL)""",
)
def ag18_wn4_positional_vote(spark: SparkSession, sf_dir: str, coverage: float = 0.6, doubtful: int = 1, shortest: int = 7) -> DataFrame:
    """Per track, the length of most confidence (longer on ties), then per place the character of most weight; places where it
    has less than ``coverage`` of the weight are doubtful, and a text with few of them is complete."""
    d = plates(spark, sf_dir).where("track_id >= 0").withColumn("n", F.length("fixed"))
    by = Window.partitionBy("track_id")
    lengths = d.groupBy("track_id", "n").agg(F.round(F.sum("confidence"), 6).alias("s"))
    lengths = lengths.withColumn("place", F.row_number().over(by.orderBy(F.desc("s"), F.desc("n")))).where("place = 1").select("track_id", "n")
    weight = F.col("confidence") * (F.lit(0.3) + F.lit(0.7) * F.least(F.col("sharpness") / 200.0, F.lit(1.0)))
    each = d.join(lengths, ["track_id", "n"]).select("track_id", weight.alias("w"), F.posexplode(F.filter(F.split("fixed", ""), lambda x: x != "")).alias("pos", "c"))
    votes = each.groupBy("track_id", "pos", "c").agg(F.sum("w").alias("w"))
    place = votes.groupBy("track_id", "pos").agg(F.sum("w").alias("all"), F.min(F.struct((-F.round("w", 6)).alias("less"), "c", "w")).alias("best"))
    doubt = F.count_if(F.round(F.col("best.w") / F.col("all"), 6) < coverage)
    won = place.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("pos", "best.c"))).alias("x"), doubt.alias("doubtful"), F.count("*").alias("k"))
    return won.select("track_id", F.array_join("x.c", "").alias("plate"), "doubtful", ((F.col("doubtful") <= doubtful) & (F.col("k") >= shortest)).alias("complete"))
