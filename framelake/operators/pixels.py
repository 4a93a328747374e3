"""What a crop's pixels say: where its two lines part, and its colour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.registry import query
from framelake.sources.tables import detections

ROWS, WIDE = 24, 12


def greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and grey: rows of grey values, derived from the event's id; darker in two bands."""
    i = F.col("event_id")
    row = lambda y: F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda x: F.pmod(i * 7 + x * 31 + y * 17, F.lit(16)) * 10 + F.when((y + i) % 24 < 9, 0).otherwise(F.pmod(i, F.lit(9)) * 10))
    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), row).alias("grey"))


def otsu(pixels: Column) -> Column:
    """The grey value that parts the pixels best into those up to it and those above: by greatest variance between both, the least of equals."""
    values = F.array_sort(F.array_distinct(pixels))
    n, total = F.size(pixels), F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x)

    def step(acc: Column, v: Column) -> Column:
        own = F.size(F.filter(pixels, lambda x: x == v))
        k, s = acc["k"] + own, acc["s"] + own * v
        apart = s * n - total * k  # the difference of both means, times both counts
        # whole numbers, so that equal ones are equal: apart^2 / (k (n - k)) compared through a double of exact integers
        score = F.when((k > 0) & (k < n), apart.cast("double") * apart.cast("double") / (k * (n - k)).cast("double")).otherwise(0.0)
        better = score > acc["best"]
        return F.struct(k.cast("long").alias("k"), s.cast("long").alias("s"), F.when(better, score).otherwise(acc["best"]).alias("best"), F.when(better, v).otherwise(acc["at"]).cast("long").alias("at"))

    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"), F.lit(0.0).alias("best"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(values, start, step, lambda acc: acc["at"])


def inked(df: DataFrame) -> DataFrame:
    """event_id, threshold (as of ``otsu``) and ink, the pixels up to it a row, of crops of one size (event_id, grey: rows of values 0 to 255);
    a batch's crops are counted together."""

    def run(batches):
        for b in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
            n = b.num_rows
            x = b.column(1).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            size = x.shape[1]
            own = np.bincount((x + np.arange(n)[:, None] * 256).ravel(), minlength=n * 256).reshape(n, 256)
            k, s = own.cumsum(1), (own * np.arange(256)).cumsum(1)
            apart = (s * size - s[:, -1:] * k).astype(float)
            parts = (k * (size - k)).astype(float)
            best = np.divide(apart * apart, parts, out=np.zeros_like(apart), where=parts > 0).argmax(1)
            ink = (x <= best[:, None]).reshape(n, ROWS, -1).sum(2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(list(ink), pa.list_(pa.int64()))], names=["event_id", "threshold", "ink"])

    return df.select("event_id", "grey").mapInArrow(run, "event_id long, threshold long, ink array<long>")


def valley(projection: Column, depth: float = 0.3, first: float = 0.3, last: float = 0.7, shortest: int = 20) -> Column:
    """The row of least ink in the middle of a crop, if it is ``depth`` below the fullest one there; the first of equals."""
    n = F.size(projection)
    start, end = F.floor(n * F.lit(first)).cast("int"), F.floor(n * F.lit(last)).cast("int")
    own = F.slice(projection, start + 1, F.greatest(end - start, F.lit(0)))
    least, most = F.array_min(own), F.array_max(own)
    deep = (1 - least / most) >= depth
    return F.when((n >= shortest) & (end > start) & F.when(most > 0, deep).otherwise(False), start + F.array_position(own, least).cast("int") - 1)


@query(
    """SELECT event_id, lim AS threshold, array_to_string(ink, ' ') AS ink, CASE WHEN most > 0 AND 1 - least / CAST(most AS DOUBLE) >= 0.3 THEN 7 + list_position(own, least) - 1 END AS split FROM (SELECT *, list_min(own) AS least, list_max(own) AS most FROM (SELECT *, ink[8:16] AS own FROM r))""",
    """px AS (SELECT event_id, y, (event_id * 7 + x * 31 + y * 17) % 16 * 10 + CASE WHEN (y + event_id) % 24 < 9 THEN 0 ELSE event_id % 9 * 10 END AS v FROM det, range(24) a(y), range(12) b(x) WHERE class_name <> 'person'),
  h AS (SELECT event_id, v, count(*) AS c FROM px GROUP BY ALL), k AS (SELECT event_id, v, sum(c) OVER w AS k, sum(c * v) OVER w AS s, sum(c) OVER (PARTITION BY event_id) AS n, sum(c * v) OVER (PARTITION BY event_id) AS total FROM h WINDOW w AS (PARTITION BY event_id ORDER BY v)),
  b AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY CAST(s * n - total * k AS DOUBLE) * CAST(s * n - total * k AS DOUBLE) / CAST(k * (n - k) AS DOUBLE) DESC, v) AS place FROM k WHERE k < n),
  t AS (SELECT event_id, v AS lim FROM b WHERE place = 1), r AS (SELECT event_id, any_value(lim) AS lim, list(ink ORDER BY y) AS ink FROM (SELECT px.event_id, y, any_value(lim) AS lim, count(*) FILTER (WHERE v <= lim) AS ink FROM px JOIN t ON px.event_id = t.event_id GROUP BY ALL) GROUP BY event_id)""",
)
def ge20_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels up to the best threshold are ink; the valley of ink a row parts two lines."""
    d = inked(greys(spark, sf_dir))
    return d.select("event_id", "threshold", F.array_join(F.transform("ink", lambda k: k.cast("string")), " ").alias("ink"), valley(F.col("ink")).cast("long").alias("split"))


# Hues (of 180) of each colour, and the least saturation and value of a coloured pixel.
HUES = [("red", 0, 8), ("orange", 8, 22), ("yellow", 22, 38), ("green", 38, 82), ("blue", 82, 128), ("purple", 128, 172), ("red", 172, 180)]
NEUTRAL, DARK = 42, 35


def coloured(pixels: DataFrame, key: str) -> DataFrame:
    """The colour of each crop, of rows (key, x, y, width, height, hue, sat, val, plate: x1, y1, x2, y2 within the crop or null).

    A margin and the padded plate don't count, unless nothing else is left. Mostly pale crops go by their lightness; others by
    the colour of most weight in a circular histogram of hues, weighted by saturation and value. Sums combine before the shuffle.
    """
    c = {n: F.col(n) for n in ("x", "y", "width", "height", "hue", "sat", "val")}
    edge = lambda n: F.greatest(F.lit(1), F.floor(c[n] * F.lit(0.08)).cast("int"))
    inside = c["x"].between(edge("width"), c["width"] - edge("width") - 1) & c["y"].between(edge("height"), c["height"] - edge("height") - 1)
    x1, y1 = (F.greatest(F.lit(0), F.col(f"plate.{n}")) for n in ("x1", "y1"))
    x2, y2 = F.least("width", "plate.x2"), F.least("height", "plate.y2")
    px, py = F.greatest(F.lit(2), F.floor((x2 - x1) * F.lit(0.12)).cast("int")), F.greatest(F.lit(2), F.floor((y2 - y1) * F.lit(0.2)).cast("int"))
    hidden = F.col("plate").isNotNull() & (x2 > x1) & (y2 > y1) & (c["x"] >= x1 - px) & (c["x"] < x2 + px) & (c["y"] >= y1 - py) & (c["y"] < y2 + py)
    pixels = pixels.withColumn("in", inside & ~F.coalesce(hidden, F.lit(False)))
    weight = c["sat"] / F.lit(255.0) * (F.lit(0.35) + c["val"] / F.lit(255.0))
    vivid = (c["sat"] >= NEUTRAL) & (c["val"] >= DARK)
    sums = [F.avg("val").alias("val"), F.avg("sat").alias("sat")]
    for name, own in (("in", F.col("in")), ("all", F.lit(True))):
        sums += [F.count_if(own).alias(f"{name}_n"), F.sum(F.when(own, c["val"])).alias(f"{name}_val"), F.count_if(own & vivid).alias(f"{name}_vivid"), F.count_if(own & (c["sat"] < NEUTRAL)).alias(f"{name}_pale"), F.sum(F.when(own & (c["sat"] < NEUTRAL), c["val"])).alias(f"{name}_pale_val")]
        for colour in dict.fromkeys(h[0] for h in HUES):
            is_hue = F.lit(False)
            for n, a, b in HUES:
                is_hue = is_hue | ((c["hue"] >= a) & (c["hue"] < b)) if n == colour else is_hue
            sums.append(F.sum(F.when(own & vivid & is_hue, weight).otherwise(0.0)).alias(f"{name}_{colour}"))
    d = pixels.groupBy(key).agg(*sums)
    some = F.col("in_n") > 0
    pick = lambda n: F.when(some, F.col(f"in_{n}")).otherwise(F.col(f"all_{n}"))
    pale, light = pick("pale_val") / pick("pale"), pick("val") / pick("n")
    best = F.array_max(F.array(*[F.struct(F.round(pick(n), 6).alias("w"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(dict.fromkeys(h[0] for h in HUES))]))
    by_pale = F.when((pale < 55) & (F.col("sat") < 28), "unknown").when(pale < 65, "black").when(pale > 205, "white").when(pale > 155, "silver").otherwise("gray")
    by_light = F.when(light < 65, "black").when(light > 205, "white").otherwise("gray")
    by_hue = F.when(best["n"] == "orange", "yellow").when(best["w"] > F.round(0.02 * pick("n"), 6), best["n"]).otherwise("unknown")
    dim = (F.col("val") < 28) | ((F.col("sat") < 18) & (F.col("val") < 75))
    colour = F.when(dim, "unknown").when(pick("pale") / pick("n") >= 0.58, by_pale).when(pick("vivid") == 0, by_light).otherwise(by_hue)
    return d.select(key, colour.alias("colour"))


@query(
    """SELECT event_id, CASE WHEN val < 28 OR (sat < 18 AND val < 75) THEN 'unknown' WHEN pale / CAST(n AS DOUBLE) >= 0.58 THEN CASE WHEN pv < 55 AND sat < 28 THEN 'unknown' WHEN pv < 65 THEN 'black' WHEN pv > 205 THEN 'white' WHEN pv > 155 THEN 'silver' ELSE 'gray' END
  WHEN vivid = 0 THEN CASE WHEN mv < 65 THEN 'black' WHEN mv > 205 THEN 'white' ELSE 'gray' END WHEN best = 'orange' THEN 'yellow' WHEN w > round(0.02 * n, 6) THEN best ELSE 'unknown' END AS colour FROM f JOIN m USING (event_id) LEFT JOIN w1 USING (event_id)""",
    """px AS (SELECT event_id, x, y, 12 AS width, 10 AS height, CASE WHEN event_id % 4 = 0 THEN (event_id * 7 + x * 3) % 180 ELSE (event_id * 37 + x * 2 + y) % 180 END AS hue, CASE event_id % 3 WHEN 0 THEN (event_id + x * 5 + y * 7) % 60 ELSE (event_id * 3 + x * 11 + y) % 256 END AS sat,
    (event_id * 13 + x * 3 + y * 5) % CASE event_id % 5 WHEN 0 THEN 60 ELSE 256 END AS val, event_id % 6 AS p FROM det, range(12) a(x), range(10) b(y) WHERE class_name <> 'person'),
  q AS (SELECT *, x >= 1 AND x <= 10 AND y >= 1 AND y <= 8 AND NOT (p <> 0 AND x >= p - 2 AND x < p + 4 + 2 AND y >= 4 - 2 AND y < 7 + 2) AS ins FROM px),
  u AS (SELECT *, ins OR NOT bool_or(ins) OVER (PARTITION BY event_id) AS own FROM q), m AS (SELECT event_id, avg(val) AS val, avg(sat) AS sat FROM q GROUP BY event_id),
  f AS (SELECT event_id, count(*) AS n, avg(val) AS mv, count(*) FILTER (WHERE sat < 42) AS pale, avg(val) FILTER (WHERE sat < 42) AS pv, count(*) FILTER (WHERE sat >= 42 AND val >= 35) AS vivid FROM u WHERE own GROUP BY event_id),
  s AS (SELECT event_id, CASE WHEN hue < 8 OR hue >= 172 THEN 'red' WHEN hue < 22 THEN 'orange' WHEN hue < 38 THEN 'yellow' WHEN hue < 82 THEN 'green' WHEN hue < 128 THEN 'blue' ELSE 'purple' END AS best, round(sum(sat / CAST(255 AS DOUBLE) * (CAST(0.35 AS DOUBLE) + val / CAST(255 AS DOUBLE))), 6) AS w FROM u WHERE own AND sat >= 42 AND val >= 35 GROUP BY ALL),
  w1 AS (SELECT event_id, best, w FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, list_position(['red', 'orange', 'yellow', 'green', 'blue', 'purple'], best)) AS place FROM s) WHERE place = 1)""",
)
def sf37_vehicle_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over crops of 12 by 10 pixels that are derived from events, five in six with a plate in them."""
    return coloured(crops(spark, sf_dir), "event_id")


@query(
    """SELECT event_id, CASE WHEN v < 50 THEN 'black' WHEN v > 200 AND s < 40 THEN 'white' WHEN s < 40 THEN 'gray' WHEN h < 15 OR h >= 165 THEN 'red' WHEN h < 35 THEN 'yellow' WHEN h < 85 THEN 'green' WHEN h < 130 THEN 'blue' ELSE 'purple' END AS colour FROM (SELECT event_id, avg(hue) AS h, avg(sat) AS s, avg(val) AS v FROM px GROUP BY event_id)""",
    """px AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id * 7 + x * 3) % 180 ELSE (event_id * 37 + x * 2 + y) % 180 END AS hue, CASE event_id % 3 WHEN 0 THEN (event_id + x * 5 + y * 7) % 60 ELSE (event_id * 3 + x * 11 + y) % 256 END AS sat,
    (event_id * 13 + x * 3 + y * 5) % CASE event_id % 5 WHEN 0 THEN 60 ELSE 256 END AS val FROM det, range(12) a(x), range(10) b(y) WHERE class_name <> 'person')""",
)
def sf37_colours_by_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule: mean hue, saturation and value of the whole crop."""
    d = crops(spark, sf_dir).groupBy("event_id").agg(F.avg("hue").alias("h"), F.avg("sat").alias("s"), F.avg("val").alias("v"))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    colour = F.when(v < 50, "black").when((v > 200) & (s < 40), "white").when(s < 40, "gray").when((h < 15) | (h >= 165), "red").when(h < 35, "yellow").when(h < 85, "green").when(h < 130, "blue").otherwise("purple")
    return d.select("event_id", colour.alias("colour"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of crops, derived from events."""
    i, x, y = F.col("event_id"), F.col("x"), F.col("y")
    d = detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(9))))
    hue = F.when(i % 4 == 0, (i * 7 + x * 3) % 180).otherwise((i * 37 + x * 2 + y) % 180)
    sat = F.when(i % 3 == 0, (i + x * 5 + y * 7) % 60).otherwise((i * 3 + x * 11 + y) % 256)
    val = (i * 13 + x * 3 + y * 5) % F.when(i % 5 == 0, 60).otherwise(256)
    p = (i % 6).cast("int")
    plate = F.when(p != 0, F.struct(p.alias("x1"), F.lit(4).alias("y1"), (p + 4).alias("x2"), F.lit(7).alias("y2")))
    return d.select("event_id", "x", "y", F.lit(12).alias("width"), F.lit(10).alias("height"), hue.alias("hue"), sat.alias("sat"), val.alias("val"), plate.alias("plate"))
