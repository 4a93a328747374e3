"""Validation and correction of plate readings: distinct texts are corrected once and joined back to their events.

Every step is a column or a join over texts. The beam keeps six texts of each depth, the best by score and then by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from framelake.functions import correction as C
from framelake.functions.plates import PROVINCES, SERIES, basic
from framelake.plans.registry import query
from framelake.sources.tables import detections

EDITS, BEAM, SURE, WEAK = 2, 6, 0.9, 85


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates as read in seven ways: as they are, with small letters, an extra first character, a split letter, and so on."""
    i, p = F.col("event_id"), F.col("plate")
    raw = (
        F.when(i % 7 == 1, F.replace(F.replace(F.replace(p, F.lit("M"), F.lit("rn")), F.lit("D"), F.lit("cl")), F.lit("H"), F.lit("ll")))
        .when(i % 7 == 2, F.concat(F.lit("1"), F.translate(p, "58", "SB")))
        .when(i % 7 == 3, F.concat(F.substring(p, 1, 2), F.lit("11"), F.substring(p, 4, 9)))
        .when(i % 7 == 4, F.translate(p, "0714", "OTIA"))
        .when(i % 7 == 5, F.concat(F.lit("13"), F.substring(p, 3, 9)))
        .when(i % 7 == 6, F.concat(F.substring(p, 1, 3), F.lit("-"), F.substr(p, F.lit(4), (i % 6).cast("int"))))
        .otherwise(p)
    )
    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", "camera_id", "track_id", "sec", "confidence", raw.alias("raw"))


def beam(texts: DataFrame, edits: int = EDITS, width: int = BEAM) -> DataFrame:
    """text, best and best_score of each of the distinct ``texts`` (text): the best of what look-alikes make of it, if better."""
    kept = front = texts.select("text", F.col("text").alias("other"), C.score(F.col("text")).alias("score"))
    visited = front.select("text", "other")
    for _ in range(edits):
        new = front.select("text", F.explode(C.neighbours(F.col("other"))).alias("other")).distinct().join(visited, ["text", "other"], "left_anti")
        visited = visited.unionByName(new)
        place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "other"))
        front = new.withColumn("score", C.score(F.col("other"))).withColumn("place", place).where(F.col("place") <= width).drop("place")
        kept = kept.unionByName(front)
    first = F.min(F.struct((-F.col("score")).alias("less"), (F.col("other") != F.col("text")).alias("changed"), "other"))
    return kept.groupBy("text").agg(first.alias("b")).select("text", F.col("b.other").alias("best"), (-F.col("b.less")).alias("best_score"))


def corrected(df: DataFrame) -> DataFrame:
    """``df`` (raw, confidence) with plate, valid, penalty (hundredths), errors and adjusted (confidence)."""
    sure, below = F.col("confidence") > SURE, F.col("confidence") < SURE
    own = df.withColumn("_sure", sure).withColumn("_below", below)
    text, n = C.in_context(F.col("raw"))
    t = own.select("raw", "_sure", "_below").distinct().withColumn("clean", basic(text)).withColumn("n", n).withColumn("text", C.placed(F.col("clean")))
    t = t.join(beam(t.where("length(clean) >= 6").select("text").distinct()), "text", "left")
    t = t.withColumn("fixes", F.col("n") + C.changes(F.col("clean"), F.col("text")) + (F.col("best") != F.col("text")).cast("int"))
    # an extra first character: drop one of the first two and set what is left right by place
    two = F.col("best").rlike("^..[A-Z][A-Z]")
    # a column, as the first cut changes best_score
    t = t.withColumn("may", (F.length("clean") >= 9) & F.col("clean").rlike(f"^[0-9]{{2}}[{C.DIGITS[0]}]") & (~F.col("_sure") | (F.col("best_score") < WEAK)))
    for k, cut in (("a", F.substring("clean", 2, 1000)), ("b", F.concat(F.substring("clean", 1, 1), F.substring("clean", 3, 1000)))):
        t = t.withColumn(f"cut_{k}", cut).withColumn(f"fix_{k}", C.placed(F.col(f"cut_{k}"))).withColumn(f"score_{k}", C.score(F.col(f"fix_{k}")))
        fits = F.col("may") & F.col(f"fix_{k}").rlike(C.FORM) & F.col(f"fix_{k}").rlike("^..[A-Z][0-9]") & F.substring(f"fix_{k}", 1, 2).isin(PROVINCES)
        better = (F.col(f"score_{k}") > F.col("best_score")) | ((F.col(f"score_{k}") == F.col("best_score")) & two)
        t = t.withColumn(f"take_{k}", fits & better)
        fixes = F.col("n") + C.changes(F.col(f"cut_{k}"), F.col(f"fix_{k}")) + 1
        if k == "a":
            t = t.withColumn("two", two)
            two = F.col("two")
        t = t.withColumn("fixes", F.when(F.col(f"take_{k}"), fixes).otherwise(F.col("fixes"))).withColumn("best", F.when(F.col(f"take_{k}"), F.col(f"fix_{k}")).otherwise(F.col("best"))).withColumn("best_score", F.when(F.col(f"take_{k}"), F.col(f"score_{k}")).otherwise(F.col("best_score")))
    known = F.substring("best", 1, 2).isin(PROVINCES)
    t = t.withColumn("known", known).withColumn("near", C.other_province(F.col("best")))
    base, near = C.score(F.col("best")), C.score(F.col("near"))
    swap = ~F.col("known") & F.col("near").isNotNull() & (near > 0) & (near >= base) & (F.col("_below") | (near - base > 20))
    t = t.withColumn("swap", F.coalesce(swap, F.lit(False))).withColumn("plate", F.when(F.col("swap"), F.col("near")).otherwise(F.col("best")))
    p = F.col("plate")
    third, fourth = C.char(p, 3), C.char(p, 4)
    number = F.when(C.two_series(p), F.substring(p, 5, 1000)).otherwise(F.substring(p, 4, 1000))
    wrong = [~F.col("known"), ~third.rlike(f"[{SERIES}]"), fourth.rlike("[A-Z]") & ~fourth.rlike(f"[{SERIES}]"), number.rlike("[^0-9]")]
    errors = sum((w.cast("int") for w in wrong), F.lit(0))
    province = F.col("known") | F.col("swap")
    t = t.withColumn("errors", errors).withColumn("valid", province & (F.col("errors") <= 1) & (F.length("plate") >= 7))
    t = t.withColumn("penalty", F.least(F.lit(30), 5 * (F.col("fixes") + F.col("swap").cast("int"))) + F.when(province, 0).otherwise(10))
    short = F.length("clean") < 6
    t = t.select(
        "raw", "_sure", "_below", F.when(short, F.col("clean")).otherwise(p).alias("plate"), (~short & F.col("valid")).alias("valid"),
        F.when(short, 50).otherwise(F.col("penalty")).alias("penalty"), F.when(short, 1).otherwise(F.col("errors")).alias("errors"),
    )
    adjusted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") - F.col("penalty") / 100.0 + F.when(F.col("valid") & (F.col("errors") == 0), 0.05).otherwise(0.0)))
    return own.join(t, ["raw", "_sure", "_below"]).drop("_sure", "_below").withColumn("adjusted", adjusted)


def latest(n: int) -> WindowSpec:
    """A track's last ``n`` readings up to each one; a missing time or number comes last, as in the SQL."""
    return Window.partitionBy("camera_id", "track_id").orderBy(F.asc_nulls_last("sec"), F.asc_nulls_last("event_id")).rowsBetween(1 - n, 0)


# The same rules in SQL, step by step.
USED = ", ".join(f"'{p}'" for p in PROVINCES)
RAW = """rd AS (SELECT event_id, camera_id, track_id, sec, confidence, CASE event_id % 7 WHEN 1 THEN replace(replace(replace(plate, 'M', 'rn'), 'D', 'cl'), 'H', 'll') WHEN 2 THEN '1' || translate(plate, '58', 'SB')
  WHEN 3 THEN substr(plate, 1, 2) || '11' || substr(plate, 4, 9) WHEN 4 THEN translate(plate, '0714', 'OTIA') WHEN 5 THEN '13' || substr(plate, 3, 9) WHEN 6 THEN substr(plate, 1, 3) || '-' || substr(plate, 4, event_id % 6)
  ELSE plate END AS raw FROM det WHERE class_name <> 'person')"""


def sql_steps() -> str:
    steps, last = [], "SELECT DISTINCT raw, raw AS t0, 0 AS n0 FROM rd"
    for k, (old, new) in enumerate(C.CONTEXT):
        last = f"SELECT raw, replace(t{k}, '{old}', '{new}') AS t{k + 1}, n{k} + CAST(contains(t{k}, '{old}') AS INT) AS n{k + 1} FROM ({last})"
    k = len(C.CONTEXT)
    steps.append(f"cx AS (SELECT raw, regexp_replace(upper(t{k}), '[^A-Z0-9]', '', 'g') AS clean, n{k} AS n FROM ({last}))")
    return ", ".join(steps)


def sql_two(c: str) -> str:
    return f"(regexp_matches(substr({c}, 4, 1), '[A-Z]') OR length({c}) >= 9 AND regexp_matches(substr({c}, 4, 1), '[0-9]'))"


def sql_placed(c: str) -> str:
    letter = f"(CASE WHEN length({c}) >= 9 AND substr({c}, 4, 1) IN ('8', '6', '5') THEN translate(substr({c}, 4, 1), '865', 'BGS') WHEN length({c}) >= 10 AND substr({c}, 4, 1) = '4' THEN 'A' ELSE substr({c}, 4, 1) END)"
    return f"""CASE WHEN length({c}) < 4 THEN {c} ELSE translate(substr({c}, 1, 2), '{C.DIGITS[0]}', '{C.DIGITS[1]}') || translate(substr({c}, 3, 1), '{C.FIRST_LETTER[0]}', '{C.FIRST_LETTER[1]}')
      || CASE WHEN regexp_matches(substr({c}, 4, 1), '[A-Z]') OR length({c}) >= 9 THEN {letter} || translate(substr({c}, 5), '{C.SERIAL[0]}', '{C.SERIAL[1]}') ELSE translate(substr({c}, 4), '{C.SERIAL[0]}', '{C.SERIAL[1]}') END END"""


def sql_score(c: str) -> str:
    bad3, bad4 = f"NOT regexp_matches(substr({c}, 3, 1), '[{SERIES}]')", f"regexp_matches(substr({c}, 4, 1), '[IOQ]')"
    serial = f"CASE WHEN {sql_two(c)} THEN substr({c}, 5) ELSE substr({c}, 4) END"
    return f"""CASE WHEN length({c}) < 7 THEN 0 ELSE greatest(0, 100 - CASE WHEN regexp_matches({c}, '{C.FORM}') THEN 0 ELSE 20 END - CASE WHEN substr({c}, 1, 2) IN ({USED}) THEN 0 ELSE 50 END
      - CASE WHEN {bad3} AND {bad4} THEN 40 WHEN {bad3} OR {bad4} THEN 30 ELSE 0 END - CASE WHEN regexp_matches({serial}, '[^0-9]') THEN 40 ELSE 0 END - CASE WHEN length({c}) IN (8, 9) THEN 0 ELSE 20 END) END"""


def sql_near(source: str, c: str) -> str:
    """text and other: what one look-alike makes of column ``c``."""
    x, end = f"substr({c}, i, 1)", f"CASE WHEN {sql_two(c)} THEN 4 ELSE 3 END"
    alt = f"""CASE WHEN i <= 2 THEN translate({x}, '{C.DIGITS[0]}', '{C.DIGITS[1]}') WHEN i > {end} THEN translate({x}, '{C.SERIAL[0]}', '{C.SERIAL[1]}') WHEN regexp_matches({x}, '[0-9]') THEN translate({x}, '8654', 'BGSA')
      WHEN i = 4 AND {end} = 4 THEN translate({x}, '{C.DIGITS[0]}', '{C.DIGITS[1]}') ELSE {x} END"""
    return f"""SELECT DISTINCT text, other FROM (SELECT text, substr({c}, 1, i - 1) || {alt} || substr({c}, i + 1) AS other, {c} AS before FROM (SELECT *, CAST(unnest(range(1, length({c}) + 1)) AS INT) AS i FROM ({source}))
      UNION ALL SELECT text, substr({c}, 1, 2) || 'H' || substr({c}, 5), {c} FROM ({source}) WHERE substr({c}, 3, 2) = '11') WHERE other <> before AND regexp_matches(other, '{C.FORM}') AND length(before) >= 7"""


def sql_best(table: str, out: str) -> str:
    return f"{out} AS (SELECT text, other, {sql_score('other')} AS score FROM {table} QUALIFY row_number() OVER (PARTITION BY text ORDER BY {sql_score('other')} DESC, other) <= {BEAM})"


BEAM_SQL = f"""{sql_steps()}, pl AS (SELECT *, {sql_placed("clean")} AS text FROM cx), tx AS (SELECT DISTINCT text FROM pl WHERE length(clean) >= 6),
  v1 AS (SELECT n.* FROM ({sql_near("SELECT text, text AS other FROM tx", "other")}) n WHERE other <> text), {sql_best("v1", "f1")},
  v2 AS (SELECT n.* FROM ({sql_near("SELECT text, other FROM f1", "other")}) n LEFT JOIN v1 ON n.text = v1.text AND n.other = v1.other WHERE v1.text IS NULL AND n.other <> n.text), {sql_best("v2", "f2")},
  bm AS (SELECT text, first(other ORDER BY score DESC, other <> text, other) AS best, max(score) AS best_score FROM (SELECT text, text AS other, {sql_score("text")} AS score FROM tx UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY text)"""
DIFFERENT = "len(list_filter(range(1, length({a}) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)))"


def sql_shift(k: str, cut: str, before: str) -> str:
    fits = f"may AND regexp_matches(fix, '{C.FORM}') AND regexp_matches(fix, '^..[A-Z][0-9]') AND substr(fix, 1, 2) IN ({USED}) AND ({sql_score('fix')} > best_score OR {sql_score('fix')} = best_score AND two)"
    return f"""s{k} AS (SELECT * EXCLUDE (best, best_score, fixes, cut, fix, take), CASE WHEN take THEN fix ELSE best END AS best, CASE WHEN take THEN {sql_score("fix")} ELSE best_score END AS best_score,
    CASE WHEN take THEN n + {DIFFERENT.format(a="cut", b="fix")} + 1 ELSE fixes END AS fixes FROM (SELECT *, {fits} AS take FROM (SELECT *, {sql_placed("cut")} AS fix FROM (SELECT *, {cut} AS cut FROM {before}))))"""


ALIKE_SQL = " UNION ALL ".join(f"SELECT '{d}' AS d, '{x}' AS x" for d, alike in C.ALIKE.items() for x in alike)
CORRECTED = f"""{RAW}, {BEAM_SQL},
  s0 AS (SELECT pl.*, u.sure, u.below, bm.best, bm.best_score, n + {DIFFERENT.format(a="clean", b="pl.text")} + CAST(best <> pl.text AS INT) AS fixes, regexp_matches(best, '^..[A-Z][A-Z]') AS two,
      length(clean) >= 9 AND regexp_matches(clean, '^[0-9]{{2}}[{C.DIGITS[0]}]') AND (NOT u.sure OR best_score < {WEAK}) AS may
    FROM (SELECT DISTINCT raw, confidence > {SURE} AS sure, confidence < {SURE} AS below FROM rd) u JOIN pl ON pl.raw = u.raw LEFT JOIN bm ON bm.text = pl.text),
  {sql_shift("a", "substr(clean, 2)", "s0")}, {sql_shift("b", "substr(clean, 1, 1) || substr(clean, 3)", "sa")},
  al AS ({ALIKE_SQL}), pr AS (SELECT p, min(q) AS q FROM (SELECT CAST(unnest(range(10, 100)) AS VARCHAR) AS p) a, LATERAL (SELECT x || substr(p, 2, 1) AS q FROM al WHERE d = substr(p, 1, 1) UNION ALL SELECT substr(p, 1, 1) || x FROM al WHERE d = substr(p, 2, 1)) WHERE q IN ({USED}) GROUP BY p
    UNION ALL SELECT p, min(q) FROM (SELECT '0' || CAST(unnest(range(0, 10)) AS VARCHAR) AS p) a, LATERAL (SELECT x || substr(p, 2, 1) AS q FROM al WHERE d = substr(p, 1, 1) UNION ALL SELECT substr(p, 1, 1) || x FROM al WHERE d = substr(p, 2, 1)) WHERE q IN ({USED}) GROUP BY p),
  np AS (SELECT sb.*, substr(best, 1, 2) IN ({USED}) AS known, q || substr(best, 3) AS near FROM sb LEFT JOIN pr ON p = substr(best, 1, 2)),
  sw AS (SELECT *, coalesce(NOT known AND near IS NOT NULL AND {sql_score("near")} > 0 AND {sql_score("near")} >= {sql_score("best")} AND (below OR {sql_score("near")} - {sql_score("best")} > 20), false) AS swap FROM np),
  pt AS (SELECT *, CASE WHEN swap THEN near ELSE best END AS plate FROM sw),
  er AS (SELECT *, CAST(NOT known AS INT) + CAST(NOT regexp_matches(substr(plate, 3, 1), '[{SERIES}]') AS INT) + CAST(regexp_matches(substr(plate, 4, 1), '[IOQ]') AS INT)
    + CAST(regexp_matches(CASE WHEN {sql_two("plate")} THEN substr(plate, 5) ELSE substr(plate, 4) END, '[^0-9]') AS INT) AS errors FROM pt),
  ok AS (SELECT raw, sure, below, CASE WHEN length(clean) < 6 THEN clean ELSE plate END AS plate, length(clean) >= 6 AND coalesce((known OR swap) AND errors <= 1 AND length(plate) >= 7, false) AS valid,
    CASE WHEN length(clean) < 6 THEN 50 ELSE least(30, 5 * (fixes + CAST(swap AS INT))) + CASE WHEN known OR swap THEN 0 ELSE 10 END END AS penalty, CASE WHEN length(clean) < 6 THEN 1 ELSE errors END AS errors FROM er),
  ev AS (SELECT rd.*, ok.plate, valid, penalty, errors, greatest(0, least(1, confidence - penalty / CAST(100 AS DOUBLE) + CASE WHEN valid AND errors = 0 THEN CAST(0.05 AS DOUBLE) ELSE 0 END)) AS adjusted
    FROM rd JOIN ok ON ok.raw = rd.raw AND ok.sure = (confidence > {SURE}) AND ok.below = (confidence < {SURE}))"""


@query(f"SELECT raw, clean, n AS groups, text AS placed, {sql_score('text')} AS score FROM pl", f"{RAW}, {BEAM_SQL}")
def sf7_sf8_sf9_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different reading after its groups of letters and its places are set right, with its score."""
    text, n = C.in_context(F.col("raw"))
    t = readings(spark, sf_dir).select("raw").distinct().select("raw", basic(text).alias("clean"), n.cast("long").alias("groups"))
    t = t.withColumn("placed", C.placed(F.col("clean")))
    return t.withColumn("score", C.score(F.col("placed")).cast("long"))


@query("SELECT text, best, best_score FROM bm", f"{RAW}, {BEAM_SQL}")
def sf10_sl8_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, _ = C.in_context(F.col("raw"))
    t = readings(spark, sf_dir).select(basic(text).alias("clean")).where("length(clean) >= 6").select(C.placed(F.col("clean")).alias("text")).distinct()
    return beam(t).withColumn("best_score", F.col("best_score").cast("long"))


@query("SELECT event_id, plate, valid, CAST(penalty AS BIGINT) AS penalty, CAST(errors AS BIGINT) AS errors, round(adjusted, 6) AS adjusted FROM ev", CORRECTED)
def sf11_sf12_sf13_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corrected(readings(spark, sf_dir))
    return got.select("event_id", "plate", "valid", F.col("penalty").cast("long").alias("penalty"), F.col("errors").cast("long").alias("errors"), F.round("adjusted", 6).alias("adjusted"))


@query(
    """SELECT event_id, CASE WHEN NOT valid AND n >= 2 AND most * 10 >= n * 6 AND (sound OR most >= 2) THEN mode ELSE plate END AS plate, valid OR n >= 2 AND most * 10 >= n * 6 AND (sound OR most >= 2) AS valid FROM m""",
    CORRECTED
    + """, h AS (SELECT *, list(plate) OVER w AS plates, list(CASE WHEN valid THEN plate END) OVER w AS sounds FROM ev WHERE track_id >= 0 WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY sec, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, len(plates) AS n, list_sort(list_transform(list_distinct(plates), lambda p: {'k': -len(list_filter(plates, lambda q: q = p)), 'p': p})) AS ranked FROM h),
  m AS (SELECT *, -ranked[1].k AS most, ranked[1].p AS mode, list_contains(sounds, ranked[1].p) AS sound FROM c)""",
)
def wn10_forgiven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invalid reading takes the plate of three in five of the track's last five, if one of those was valid or two agree."""
    d = corrected(readings(spark, sf_dir).where("track_id >= 0")).withColumn("last", F.collect_list(F.struct("plate", "valid")).over(latest(5)))
    counts = F.transform(F.array_distinct("last.plate"), lambda p: F.struct((-F.size(F.filter("last", lambda q: q["plate"] == p))).alias("k"), p.alias("p")))
    d = d.withColumn("top", F.array_min(counts)).withColumn("n", F.size("last"))
    most = -F.col("top.k")
    agreed = (F.col("n") >= 2) & (most * 10 >= F.col("n") * 6) & (F.exists("last", lambda q: q["valid"] & (q["plate"] == F.col("top.p"))) | (most >= 2))
    return d.select("event_id", F.when(~F.col("valid") & agreed, F.col("top.p")).otherwise(F.col("plate")).alias("plate"), (F.col("valid") | agreed).alias("valid"))


P = "p AS (SELECT *, regexp_replace(upper(plate), '[^A-Z0-9]', '', 'g') AS plain FROM det WHERE class_name <> 'person')"


@query(
    "SELECT event_id, CASE WHEN length(plain) < 8 AND len(ranked) > 0 THEN ranked[1].p ELSE plain END AS plate FROM c",
    P
    + """, h AS (SELECT event_id, plain, list(plain) OVER (PARTITION BY camera_id, track_id ORDER BY sec, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last FROM p WHERE track_id >= 0),
  l AS (SELECT *, list_filter(last, lambda q: length(q) - length(plain) BETWEEN 1 AND 2 AND (starts_with(q, plain) OR (length(plain) < 5 OR substr(plain, 1, 5) = substr(q, 1, 5)) AND right(plain, 2) = right(q, 2)
    AND regexp_matches(q, '^.*' || regexp_replace(plain, '(.)', '\\1.*', 'g')))) AS longer FROM h),
  c AS (SELECT *, list_sort(list_transform(list_distinct(longer), lambda p: {'k': -len(list_filter(longer, lambda q: q = p)), 'p': p})) AS ranked FROM l)""",
)
def sf21_sf22_lengthened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings under eight characters become the most frequent longer one, of the track's last ten, that they are a part of."""
    d = detections(spark, sf_dir).where("class_name <> 'person' and track_id >= 0").withColumn("plain", basic("plate"))
    d = d.withColumn("last", F.collect_list("plain").over(latest(10)))
    p = F.col("plain")
    d = d.withColumn("longer", F.filter("last", lambda q: (F.length(q) - F.length(p)).between(1, 2) & (F.startswith(q, p) | C.reduced(p, q))))
    counts = F.transform(F.array_distinct("longer"), lambda q: F.struct((-F.size(F.filter("longer", lambda o: o == q))).alias("k"), q.alias("p")))
    return d.select("event_id", F.when((F.length("plain") < 8) & (F.size("longer") > 0), F.array_min(counts)["p"]).otherwise(p).alias("plate"))


@query(
    f"""SELECT event_id, CASE WHEN length(plain) < 5 THEN 0.7 WHEN form THEN CASE WHEN substr(plain, 1, 2) IN ({USED}) THEN 1.2 WHEN substr(plain, 1, 2) >= '11' THEN 1.1 ELSE 0.8 END WHEN length(plain) >= 7 AND regexp_matches(plain, '^[0-9]{{2}}') THEN 0.9 ELSE 0.7 END AS gate,
  regexp_matches(substr(plain, 1, 3), '^[0-9]{{2}}[A-Z]{{1,2}}[0-9]?$') AND length(substr(plain, 4)) >= 4 AND length(regexp_replace(substr(plain, 4), '[^0-9]', '', 'g')) * 5 >= length(substr(plain, 4)) * 4 AS two_lines
  FROM (SELECT *, regexp_matches(plain, '^[0-9]{{2}}[A-Z][0-9]{{4,6}}$') OR regexp_matches(plain, '^[0-9]{{2}}[A-Z]{{2}}[0-9]{{4,6}}$') OR regexp_matches(plain, '^[0-9]{{2}}[A-Z][0-9][0-9]{{4,5}}$') AS form FROM p)""",
    P,
)
def sf16_sf17_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplier by form, and whether the first three characters and the rest make a plate of two lines."""
    d = detections(spark, sf_dir).where("class_name <> 'person'").withColumn("plain", basic("plate"))
    p = F.col("plain")
    return d.select("event_id", C.syntax(p).alias("gate"), C.halves(F.substring(p, 1, 3), F.substring(p, 4, 1000)).alias("two_lines"))
