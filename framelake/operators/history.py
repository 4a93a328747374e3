"""Per-key history: windows over a track's or camera's ordered events, folds and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.plates import positional
from framelake.plans.registry import query
from framelake.sources.tables import detections

W = "PARTITION BY camera_id, track_id ORDER BY ts, event_id"


def by_track():
    """The window over a track's events in order; made on demand, as it needs a session."""
    return Window.partitionBy("camera_id", "track_id").orderBy("ts", "event_id")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("track_id >= 0")


@query(f"SELECT event_id, count(*) OVER w AS n, round(avg(confidence) OVER w, 6) AS mean FROM det WHERE track_id >= 0 WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def wn1_last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_track().rowsBetween(-4, 0)
    return tracked(spark, sf_dir).select("event_id", F.count("*").over(w).alias("n"), F.round(F.avg("confidence").over(w), 6).alias("mean"))


@query(f"SELECT event_id, arg_max(event_id, sharpness * 10000000 - event_id) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_shot FROM det WHERE track_id >= 0")
def wn2_best_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharpest event of the track so far, the earlier id on ties."""
    best = F.max_by("event_id", F.col("sharpness") * 10000000 - F.col("event_id")).over(by_track().rowsBetween(Window.unboundedPreceding, 0))
    return tracked(spark, sf_dir).select("event_id", best.alias("best_shot"))


@query(
    "SELECT event_id, CASE WHEN levenshtein(plate, before) = 1 AND before_confidence >= 0.85 THEN confidence * 0.9 ELSE confidence END AS damped FROM l",
    f"l AS (SELECT *, lag(plate) OVER (w) AS before, lag(confidence) OVER (w) AS before_confidence FROM det WHERE track_id >= 0 WINDOW w AS ({W}))",
)
def wn3_damped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence times 0.9 where the plate is one edit from the one before and that was sure."""
    d = tracked(spark, sf_dir).withColumn("before", F.lag("plate").over(by_track())).withColumn("sure", F.lag("confidence").over(by_track()) >= 0.85)
    near = (F.levenshtein("plate", "before", 1) == 1) & F.col("sure")
    return d.select("event_id", F.when(near, F.col("confidence") * 0.9).otherwise(F.col("confidence")).alias("damped"))


def with_previous(df: DataFrame, values: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """``df`` (with sec) and ``_before``: a struct of ``values`` in the row before, per key; null before the first.

    Windows reach over a day of a key; each day takes the row before its first from the last day that has rows, which is a
    window over one row a day.
    """
    own = F.struct(*[F.col(v).alias(v) for v in values])
    d = df.withColumn("_day", F.expr("sec div 86400"))
    d = d.withColumn("_before", F.lag(own).over(Window.partitionBy(*keys, "_day").orderBy(*order)))
    ends = d.groupBy(*keys, "_day").agg(F.max(F.struct(*order, own.alias("own"))).alias("e"))
    ends = ends.withColumn("_last", F.lag("e.own").over(Window.partitionBy(*keys).orderBy("_day"))).drop("e")
    return d.join(ends, [*keys, "_day"]).withColumn("_before", F.coalesce("_before", "_last")).drop("_day", "_last")


def changed(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """The rows whose ``value`` isn't that of the row before, per key, and the first."""
    d = with_previous(df, [value], keys, order)
    return d.where(F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value))).drop("_before")


@query(
    "SELECT event_id, mode FROM m WHERE before IS NULL OR before <> mode",
    """m AS (SELECT *, lag(mode) OVER (PARTITION BY camera_id ORDER BY ts, event_id) AS before FROM (SELECT *, CASE WHEN sharpness < 120 THEN 'night' WHEN sharpness > 240 THEN 'day'
  ELSE 'transition' END AS mode FROM det))""",
)
def wn8_mode_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("sharpness") < 120, "night").when(F.col("sharpness") > 240, "day").otherwise("transition")
    return changed(detections(spark, sf_dir).withColumn("mode", mode), "mode", ["camera_id"], ["ts", "event_id"]).select("event_id", "mode")


@query("SELECT event_id, 0.4 * (1 - 0.3 * (1 - least(greatest((sharpness - 100) / 200.0, 0), 1))) AS threshold FROM det")
def wn7_threshold_by_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.40 by day, 0.28 by night, in between by the ratio of light."""
    ratio = F.least(F.greatest((F.col("sharpness") - 100) / 200.0, F.lit(0.0)), F.lit(1.0))
    return detections(spark, sf_dir).select("event_id", (F.lit(0.4) * (1 - F.lit(0.3) * (1 - ratio))).alias("threshold"))


@query("""SELECT camera_id, sec // 21600 AS slot, count(*) AS n, CAST(CASE WHEN count(*) > 30 THEN 0.4 WHEN count(*) > 15 THEN 0.15 ELSE 0 END AS DOUBLE) AS drop_ratio
  FROM det GROUP BY ALL""")
def wn9_drop_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).groupBy("camera_id", F.expr("sec div 21600").alias("slot")).agg(F.count("*").alias("n"))
    return d.withColumn("drop_ratio", F.when(F.col("n") > 30, 0.4).when(F.col("n") > 15, 0.15).otherwise(0.0))


@query(
    "SELECT camera_id, track_id, event_id, plate FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ts DESC, event_id DESC) AS place FROM det) WHERE track_id < 0 OR place = 1"
)
def ag12_pf28_latest_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each track, as maxima that combine before the shuffle; untracked events all stay."""
    d = detections(spark, sf_dir)
    last = d.where("track_id >= 0").groupBy("camera_id", "track_id").agg(F.max(F.struct("ts", "event_id", "plate")).alias("m")).select("camera_id", "track_id", "m.event_id", "m.plate")
    return last.unionByName(d.where("track_id < 0").select("camera_id", "track_id", "event_id", "plate"))


@query("SELECT track_id, max(confidence) AS confidence, arg_max(event_id, confidence * 1000 * 10000000 - event_id) AS event_id FROM det WHERE track_id >= 0 AND confidence >= CASE WHEN sharpness < 120 THEN 0.3 ELSE 0.4 END GROUP BY track_id")
def ag32_best_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracked(spark, sf_dir).where(F.col("confidence") >= F.when(F.col("sharpness") < 120, 0.3).otherwise(0.4))
    best = F.max_by("event_id", F.struct("confidence", -F.col("event_id")))
    return d.groupBy("track_id").agg(F.max("confidence").alias("confidence"), best.alias("event_id"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, event_id DESC) AS place FROM det) WHERE place <= 500")
def sl10_d2_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 of each camera, as a bounded stream keeps them."""
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return detections(spark, sf_dir).withColumn("place", place).where("place <= 500").select("event_id")


@query(
    "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, session ORDER BY sec, event_id) AS place FROM s) WHERE place <= 2",
    """g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id) <= 86400 THEN 0 ELSE 1 END AS starts FROM det WHERE track_id >= 0),
  s AS (SELECT *, sum(starts) OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)""",
)
def st10_first_two_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after a day without the track; the first two events of each are kept."""
    by = Window.partitionBy("camera_id", "track_id").orderBy("sec", "event_id")
    starts = F.when(F.col("sec") - F.lag("sec").over(by) <= 86400, 0).otherwise(1)
    d = tracked(spark, sf_dir).withColumn("starts", starts).withColumn("session", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("camera_id", "track_id", "session").orderBy("sec", "event_id"))
    return d.withColumn("place", place).where("place <= 2").select("event_id")


@query(
    'SELECT event_id, x1, y1, x2, y2 FROM r',
    """n AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id) AS k FROM det WHERE track_id >= 0),
  r AS (SELECT camera_id, track_id, k, event_id, sec, x1, y1, x2, y2 FROM n WHERE k = 1
    UNION ALL SELECT camera_id, track_id, k, event_id, sec, x1, y1, CASE WHEN fresh THEN x2 ELSE greatest(x2, x1 + 1) END, CASE WHEN fresh THEN y2 ELSE greatest(y2, y1 + 1) END FROM (
      SELECT n.camera_id, n.track_id, n.k, n.event_id, n.sec, n.sec - r.sec > 259200 AS fresh, CASE WHEN n.sec - r.sec > 259200 THEN n.x1 ELSE CAST(round_even(CAST(0.4 AS DOUBLE) * n.x1 + CAST(0.6 AS DOUBLE) * r.x1, 0) AS BIGINT) END AS x1, CASE WHEN n.sec - r.sec > 259200 THEN n.y1 ELSE CAST(round_even(CAST(0.4 AS DOUBLE) * n.y1 + CAST(0.6 AS DOUBLE) * r.y1, 0) AS BIGINT) END AS y1, CASE WHEN n.sec - r.sec > 259200 THEN n.x2 ELSE CAST(round_even(CAST(0.4 AS DOUBLE) * n.x2 + CAST(0.6 AS DOUBLE) * r.x2, 0) AS BIGINT) END AS x2, CASE WHEN n.sec - r.sec > 259200 THEN n.y2 ELSE CAST(round_even(CAST(0.4 AS DOUBLE) * n.y2 + CAST(0.6 AS DOUBLE) * r.y2, 0) AS BIGINT) END AS y2 FROM r JOIN n ON n.camera_id = r.camera_id AND n.track_id = r.track_id AND n.k = r.k + 1))""",
    recursive=True,
)
def wn5_smoothed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track begins anew after three days without it. Tested by a plain loop."""
    from framelake.functions.stateful import Smoothed
    from framelake.operators.gates import BOX, stepped

    schema = "event_id long, x1 long, y1 long, x2 long, y2 long"
    return stepped(tracked(spark, sf_dir), ["camera_id", "track_id"], lambda: Smoothed(259200), BOX, schema, lambda e, got: (e.event_id, *got))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles' readings; the store fails at every seventh event."""
    d = detections(spark, sf_dir).where("class_name <> 'person'").withColumn("fixed", positional("plate"))
    return d.withColumn("written", F.col("event_id") % 7 != 0)


#: Times and confidences that suit sparse events of low confidence: a track ends after a day, a plate stands for half a day.
SPARSE = {"idle": 86400.0, "patience": 57600.0, "wait": 43200.0, "ttl": 21600.0, "parked": 43200.0, "instant": 0.3, "sure": 0.1, "gain": 0.1, "known": 0.2, "retry": 0.02}


@query()
def st6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consensus of all cameras stores. Tested by a plain loop."""
    from framelake.streaming.consensus import Rules, emitted

    return emitted(readings(spark, sf_dir), Rules(**SPARSE))


@query()
def st7_track_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tracked reading's state, hits and misses; with few misses to a revert, so that confirmed tracks fall back. Tested by a plain loop."""
    from framelake.streaming.consensus import Rules, followed

    got = followed(readings(spark, sf_dir).where("track_id >= 0"), Rules(**SPARSE, revert=1, hits=3))
    return got.select("camera_id", "track_id", "event_id", "state", "hits", "misses", "doubtful")


@query()
def st14_capped_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with room for five tracks a camera: the longest unseen go. Tested by a plain loop."""
    from framelake.streaming.consensus import Rules, emitted

    return emitted(readings(spark, sf_dir), Rules(**SPARSE, cap=5, sweep=1))


def decayed(df: DataFrame, tau: float, start: float = 100.0, first: float = 0.05) -> DataFrame:
    """camera_id, sec and light: the running mean of ``value`` in which a reading fades with the seconds since, by
    1 - exp(-dt/tau) a step; readings of one second are one. Before the first reading it is ``start``.

    Times are cut into chunks of fifty tau. Within a chunk the mean is a running sum of faded readings; from before, only
    the chunk that precedes it still counts, as what is older has faded below 1e-21.
    """
    span = int(50 * tau)
    d = df.groupBy("camera_id", "sec").agg(F.avg("value").alias("value")).withColumn("chunk", F.expr(f"sec div {span}"))
    inside = Window.partitionBy("camera_id", "chunk").orderBy("sec")
    ends = d.groupBy("camera_id", "chunk").agg(F.max("sec").alias("last"), F.min("sec").alias("begin"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("camera_id").orderBy("chunk")))
    d = d.join(ends, ["camera_id", "chunk"]).withColumn("prior", F.coalesce(F.lag("sec").over(inside), "before"))
    gain = 1 - F.exp(-(F.col("sec") - F.col("prior")) / F.lit(float(tau)))
    part = F.when(F.col("prior").isNull(), F.lit(first) * F.col("value") + F.lit((1 - first) * start)).otherwise(gain * F.col("value"))
    d = d.withColumn("faded", part * F.exp((F.col("sec") - F.col("begin")) / F.lit(float(tau)))).withColumn("sum", F.sum("faded").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = d.groupBy("camera_id", "chunk").agg(F.sum("faded").alias("s"), F.first("begin").alias("b")).withColumn("chunk", F.col("chunk") + 1)
    d = d.join(totals, ["camera_id", "chunk"], "left")
    light = F.col("sum") * F.exp((F.col("begin") - F.col("sec")) / F.lit(float(tau))) + F.coalesce(F.col("s") * F.exp((F.col("b") - F.col("sec")) / F.lit(float(tau))), F.lit(0.0))
    return d.select("camera_id", "sec", light.alias("light"))


@query(
    "SELECT a.camera_id, a.sec, round(sum(b.z * exp(-(a.sec - b.sec) / CAST(21600 AS DOUBLE))), 6) AS light FROM z a JOIN z b ON a.camera_id = b.camera_id AND b.sec <= a.sec AND a.sec - b.sec <= 21600 * 60 GROUP BY ALL",
    """m AS (SELECT camera_id, sec, avg(sharpness) AS x FROM det GROUP BY ALL), p AS (SELECT *, lag(sec) OVER (PARTITION BY camera_id ORDER BY sec) AS before FROM m),
  z AS (SELECT camera_id, sec, CASE WHEN before IS NULL THEN CAST(95 AS DOUBLE) + CAST(0.05 AS DOUBLE) * x ELSE (1 - exp(-(sec - before) / CAST(21600 AS DOUBLE))) * x END AS z FROM p)""",
)
def wn6_faded_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With six hours for tau, over the sharpness of a camera's detections."""
    got = decayed(detections(spark, sf_dir).select("camera_id", "sec", F.col("sharpness").alias("value")), 21600)
    return got.select("camera_id", "sec", F.round("light", 6).alias("light"))


@query(
    'SELECT event_id, round(mn, 6) AS mean, round(share, 6) AS share, mode, changed FROM r',
    """n AS (SELECT camera_id, event_id, sec, sharpness * CAST(0.6 AS DOUBLE) AS b, row_number() OVER (PARTITION BY camera_id ORDER BY sec, event_id) AS k FROM det),
  r AS (SELECT camera_id, k, event_id, sec, mn, fl, ce, share, CASE WHEN share < 0.2 THEN 'night' WHEN share > 0.8 THEN 'day' ELSE 'transition' END AS mode, CASE WHEN share < 0.2 THEN 'night' WHEN share > 0.8 THEN 'day' ELSE 'transition' END <> mode AS changed FROM (
      SELECT *, CASE WHEN raw < 0.05 THEN 0 WHEN raw > 0.95 THEN 1 ELSE raw END AS share FROM (SELECT *, least(greatest((mn - fl) / (ce - fl), 0), CAST(1 AS DOUBLE)) AS raw FROM (SELECT camera_id, k, event_id, sec, b, mn, CASE WHEN ce2 - fl2 < 30 THEN (ce2 + fl2) / 2 - 15 ELSE fl2 END AS fl, CASE WHEN ce2 - fl2 < 30 THEN (ce2 + fl2) / 2 + 15 ELSE ce2 END AS ce, mode FROM (
      SELECT *, fl1 + CAST(0.005 AS DOUBLE) * (b - fl1) AS fl2, ce1 + CAST(0.005 AS DOUBLE) * (b - ce1) AS ce2 FROM (SELECT *, CASE WHEN b < fl0 THEN fl0 + CAST(0.05 AS DOUBLE) * (b - fl0) ELSE fl0 END AS fl1, CASE WHEN b > ce0 THEN ce0 + CAST(0.05 AS DOUBLE) * (b - ce0) ELSE ce0 END AS ce1 FROM (SELECT camera_id, k, event_id, sec, b, b AS mn, CAST(40 AS DOUBLE) AS fl0, CAST(150 AS DOUBLE) AS ce0, 'transition' AS mode FROM n WHERE k = 1))))))
    UNION ALL SELECT camera_id, k, event_id, sec, mn, fl, ce, share, CASE WHEN share < 0.2 THEN 'night' WHEN share > 0.8 THEN 'day' ELSE 'transition' END AS mode, CASE WHEN share < 0.2 THEN 'night' WHEN share > 0.8 THEN 'day' ELSE 'transition' END <> mode AS changed FROM (
      SELECT *, CASE WHEN raw < 0.05 THEN 0 WHEN raw > 0.95 THEN 1 ELSE raw END AS share FROM (SELECT *, least(greatest((mn - fl) / (ce - fl), 0), CAST(1 AS DOUBLE)) AS raw FROM (SELECT camera_id, k, event_id, sec, b, mn, CASE WHEN ce2 - fl2 < 30 THEN (ce2 + fl2) / 2 - 15 ELSE fl2 END AS fl, CASE WHEN ce2 - fl2 < 30 THEN (ce2 + fl2) / 2 + 15 ELSE ce2 END AS ce, mode FROM (
      SELECT *, fl1 + CAST(0.005 AS DOUBLE) * (b - fl1) AS fl2, ce1 + CAST(0.005 AS DOUBLE) * (b - ce1) AS ce2 FROM (SELECT *, CASE WHEN b < fl0 THEN fl0 + CAST(0.05 AS DOUBLE) * (b - fl0) ELSE fl0 END AS fl1, CASE WHEN b > ce0 THEN ce0 + CAST(0.05 AS DOUBLE) * (b - ce0) ELSE ce0 END AS ce1 FROM (SELECT n.camera_id, n.k, n.event_id, n.sec, n.b, CASE WHEN n.sec - r.sec > 21600 THEN n.b ELSE r.mn + CASE WHEN n.sec > r.sec THEN 1 - exp(-(n.sec - r.sec) / CAST(7200 AS DOUBLE)) ELSE CAST(0.05 AS DOUBLE) END * (n.b - r.mn) END AS mn,
        CASE WHEN n.sec - r.sec > 21600 THEN CAST(40 AS DOUBLE) ELSE r.fl END AS fl0, CASE WHEN n.sec - r.sec > 21600 THEN CAST(150 AS DOUBLE) ELSE r.ce END AS ce0, CASE WHEN n.sec - r.sec > 21600 THEN 'transition' ELSE r.mode END AS mode FROM r JOIN n ON n.camera_id = r.camera_id AND n.k = r.k + 1)))))))""",
    recursive=True,
)
def wn6_light_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's light (its sharpness stands for it), with floor and ceiling of its camera; times for sparse events. Tested by a plain loop."""
    from framelake.functions.stateful import Light
    from framelake.operators.gates import stepped

    d = detections(spark, sf_dir).withColumn("light", F.col("sharpness") * 0.6)
    schema = "event_id long, mean double, share double, mode string, changed boolean"
    return stepped(d, ["camera_id"], lambda: Light(idle=21600, tau=7200, slow=0.05), ["light"], schema, lambda e, got: (e.event_id, round(got[0], 6), round(got[1], 6), *got[2:]))
