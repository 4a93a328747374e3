"""A reading from several sources: each corrected by its structure, then the best by confidence, form and what the camera saw lately."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.plates import PROVINCES, SERIES, basic, valid
from framelake.operators.gates import stepped
from framelake.operators.plates import VALID
from framelake.plans.registry import query
from framelake.sources.sinks import kept
from framelake.sources.tables import detections

# What a character is read as, and how often.
READ_AS = {
    "0": {"O": 0.4, "D": 0.3, "Q": 0.2, "8": 0.1},
    "1": {"I": 0.4, "L": 0.3, "T": 0.15, "6": 0.1},
    "2": {"Z": 0.5, "7": 0.3, "1": 0.2},
    "3": {"8": 0.6, "B": 0.4},
    "4": {"A": 0.7, "H": 0.3},
    "5": {"S": 0.5, "6": 0.3, "8": 0.2},
    "6": {"G": 0.4, "5": 0.3, "1": 0.1},
    "7": {"T": 0.3, "1": 0.25, "J": 0.2, "2": 0.15, "V": 0.1},
    "8": {"B": 0.5, "S": 0.2, "3": 0.15, "0": 0.15},
    "A": {"H": 0.5, "4": 0.3, "R": 0.2},
    "B": {"8": 0.6, "S": 0.3, "3": 0.1},
    "C": {"G": 0.6, "O": 0.4},
    "D": {"O": 0.5, "0": 0.3, "Q": 0.2},
    "G": {"C": 0.5, "6": 0.3, "O": 0.2},
    "H": {"A": 0.4, "M": 0.3, "K": 0.2, "N": 0.1},
    "I": {"1": 0.5, "L": 0.3, "T": 0.2},
    "K": {"H": 0.5, "R": 0.3, "X": 0.2},
    "L": {"I": 0.5, "1": 0.3, "T": 0.2},
    "M": {"N": 0.4, "H": 0.3, "S": 0.2},
    "N": {"M": 0.5, "H": 0.3, "K": 0.2},
    "O": {"0": 0.5, "D": 0.3, "Q": 0.2},
    "P": {"R": 0.6, "B": 0.4},
    "Q": {"O": 0.5, "0": 0.3, "D": 0.2},
    "R": {"P": 0.5, "K": 0.3, "A": 0.2},
    "S": {"5": 0.5, "8": 0.3, "M": 0.2},
    "T": {"1": 0.4, "I": 0.3, "7": 0.2, "L": 0.1},
    "U": {"V": 0.6, "Y": 0.4},
    "V": {"U": 0.5, "Y": 0.3, "7": 0.2},
    "X": {"K": 0.5, "Y": 0.3, "H": 0.2},
    "Y": {"V": 0.5, "U": 0.3, "X": 0.2},
    "Z": {"2": 0.6, "7": 0.4},
}
# The structures of a plate with the end of its series and how sure each is, the final form, series that are read for R1.
STRUCTURES = [("^[0-9]{2}[A-Z][0-9]{4,6}$", 3, False, 1.0), ("^[0-9]{2}[A-Z]{2}[0-9]{4,6}$", 4, False, 0.9), ("^[0-9]{2}[A-Z][0-9][0-9]{4,6}$", 4, True, 0.8)]
FORM = "^[1-9][0-9][A-Z]{1,2}[0-9]?[0-9]{4,6}$"
R1 = ["RL", "RN", "RI"]


def _meant(read: str, among: str) -> tuple[str, float] | None:
    """The likeliest of ``among`` that is read as ``read``."""
    found = [(c, p[read]) for c, p in READ_AS.items() if read in p and c in among]
    return max(found, key=lambda x: x[1]) if found else None


_READ = sorted({c for p in READ_AS.values() for c in p})
DIGIT_FOR = {c: m for c in _READ if c.isalpha() and (m := _meant(c, "0123456789"))}
LETTER_FOR = {c: m[0] for c in _READ if c not in SERIES and (m := _meant(c, SERIES))}
DIGITS = {c: d for c, (d, _) in DIGIT_FOR.items()}
#: The nearest province in use, five codes away at most; the smaller of two.
NEAR = {f"{k:02}": near for k in range(100) if f"{k:02}" not in PROVINCES and abs(int(near := min(PROVINCES, key=lambda p: abs(int(p) - k))) - k) <= 5}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _changed(name: str, text: Column, table: dict[str, str], written: bool) -> tuple[Column, Column]:
    """The text with each character of ``table`` replaced, and a note of each change, or, unless ``written``, their number."""
    new = F.translate(text, "".join(table), "".join(table.values()))
    if not written:
        return new, F.length(text) - F.length(F.translate(text, "".join(table), ""))
    each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"), F.substring(new, i + 1, F.lit(1)).alias("to")))
    return new, F.transform(F.filter(each, lambda x: x["c"] != x["to"]), lambda x: F.concat(F.lit(f"{name} "), x["i"].cast("string"), F.lit(": "), x["c"], F.lit(" to "), x["to"]))


def _added(notes: Column, more: Column, written: bool) -> Column:
    return F.concat(notes, more) if written else notes + more


def _step(s: Column, text: Column, notes: Column, written: bool, end: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (s["end"] if end is None else end).alias("end"), s["digits"].alias("digits"), s["sure"].alias("sure"), _added(s["notes"], notes, written).alias("notes"))


def _none(written: bool) -> Column:
    return F.array().cast("array<string>") if written else F.lit(0)


def _note(text: Column, written: bool) -> Column:
    return F.array(text) if written else F.lit(1)


def _structure(t: Column, written: bool) -> Column:
    fourth, n = F.substring(t, 4, 1), F.length(t)
    other = F.when(fourth.rlike("[A-Z]"), F.struct(F.lit(4).alias("end"), F.lit(False).alias("digits"), F.lit(0.5).alias("sure")))
    other = other.when((n >= 8) & fourth.rlike("[0-9]"), F.struct(F.lit(4).alias("end"), F.lit(True).alias("digits"), F.lit(0.5).alias("sure")))
    out = other.otherwise(F.struct(F.lit(3).alias("end"), F.lit(False).alias("digits"), F.lit(0.5).alias("sure")))
    for form, end, digits, sure in reversed(STRUCTURES):
        out = F.when(t.rlike(form), F.struct(F.lit(end).alias("end"), F.lit(digits).alias("digits"), F.lit(sure).alias("sure"))).otherwise(out)
    return let(out, lambda o: F.struct(t.alias("text"), o["end"].alias("end"), o["digits"].alias("digits"), o["sure"].alias("sure"), _none(written).alias("notes")))


def _province(s: Column, written: bool) -> Column:
    text, notes = _changed("province", F.substring(s["text"], 1, 2), DIGITS, written)
    near = lambda t: lookup(NEAR)[t]
    note = lambda t: F.when(near(t).isNotNull(), _note(F.concat(F.lit("province "), t, F.lit(" to "), near(t)), written)).otherwise(_none(written))
    return let(F.struct(text.alias("t"), notes.alias("n")), lambda x: _step(s, F.concat(F.coalesce(near(x["t"]), x["t"]), F.substring(s["text"], 3, 1000)), _added(x["n"], note(x["t"]), written), written))


def _series(s: Column, written: bool) -> Column:
    own = F.substring(s["text"], F.lit(3), s["end"] - 2)
    every, letters = (_changed("series", own, table, written) for table in (LETTER_FOR, {c: x for c, x in LETTER_FOR.items() if c.isalpha()}))
    text, notes = (F.when(s["digits"], b).otherwise(a) for a, b in zip(every, letters, strict=True))
    new = _step(s, F.concat(F.substring(s["text"], 1, 2), text, F.substring(s["text"], s["end"] + 1, F.lit(1000))), notes, written)
    return F.when(F.length(s["text"]) >= s["end"], new).otherwise(s)


def _serial(s: Column, written: bool) -> Column:
    """Digits after the series; four of them in an unsure structure take the last of two series characters, if that was read for a digit."""
    text, notes = _changed("serial", F.substring(s["text"], s["end"] + 1, F.lit(1000)), DIGITS, written)
    read_for = {c: m for c in _READ if (m := _meant(c, "0123456789")) and m[1] >= 0.3}

    def rescued(x: Column) -> Column:
        last = F.substring(x["text"], x["end"], F.lit(1))
        digit = lookup({c: d for c, (d, _) in read_for.items()})[last]
        serial = F.substring(x["text"], x["end"] + 1, F.lit(1000))
        ok = (F.length(F.regexp_replace(serial, "[^0-9]", "")) == 4) & (x["sure"] < 0.8) & (x["end"] == 4) & digit.isNotNull()
        new = _step(x, F.concat(F.substring(x["text"], 1, 3), digit, serial), _note(F.concat(F.lit("short serial: "), last, F.lit(" to "), digit), written), written, x["end"] - 1)
        return F.when(ok, new).otherwise(x)

    new = let(_step(s, F.concat(F.substring(s["text"], F.lit(1), s["end"]), text), notes, written), rescued)
    return F.when(F.length(s["text"]) > s["end"], new).otherwise(s)


def _pattern(s: Column, written: bool) -> Column:
    own, rest = F.substring(s["text"], F.lit(3), s["end"] - 2), F.substring(s["text"], s["end"] + 1, F.lit(1000))
    new = _step(s, F.concat(F.substring(s["text"], 1, 2), F.lit("R1"), rest), _note(F.concat(F.lit("series "), own, F.lit(" to R1")), written), written, F.lit(3))
    return F.when((s["end"] == 4) & own.isin(R1) & rest.rlike("^[0-9]+$"), new).otherwise(s)


def corrected(raw: Column, confidence: Column, written: bool = True) -> Column:
    """text, confidence and notes: digits of the province and its nearest code in use, letters of the series, digits of the
    serial, by what each character is likeliest read for; less by 0.05 a correction, more by 0.1 for a final form. Texts under
    seven characters stay, without confidence. Unless ``written``, notes is only their number."""
    steps = let(basic(raw), lambda t: _structure(t, written))
    for f in (_province, _series, _serial, _pattern):
        steps = let(steps, lambda s, f=f: f(s, written))
    fits = lambda t: t.rlike(FORM) & F.length(t).between(7, 10)

    def closed(s: Column) -> Column:
        c = F.greatest(F.lit(0.0), confidence - (F.size(s["notes"]) if written else s["notes"]) * F.lit(0.05))
        return F.struct(s["text"].alias("text"), F.round(F.when(fits(s["text"]), F.least(F.lit(1.0), c + 0.1)).otherwise(c), 9).alias("confidence"), s["notes"].alias("notes"))

    short = F.struct(raw.alias("text"), F.lit(0.0).alias("confidence"), _none(written).alias("notes"))
    return F.when(F.length(F.coalesce(raw, F.lit(""))) < 7, short).otherwise(let(steps, closed))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles' readings with more kinds of errors than ``plate`` has."""
    p, k = F.col("plate"), F.col("event_id") % 7
    text = F.when(k == 1, F.translate(p, "018", "OIB")).when(k == 2, F.concat(F.substring(p, 1, 2), F.lit("8"), F.substring(p, 4, 100))).when(k == 3, F.concat(F.lit("0"), F.substring(p, 2, 100)))
    text = text.when(k == 4, F.concat(F.substring(p, 1, 2), F.lit("RL"), F.substring(p, 5, 100))).when(k == 5, F.concat(F.substring(p, 1, 3), F.lit("T"), F.substring(p, 5, 3), F.lit("-"))).when(k == 6, F.concat(p, F.lit("47"))).otherwise(p)
    return detections(spark, sf_dir).where("class_name <> 'person'").withColumn("noisy", text)


NOISY = """y AS (SELECT *, CASE event_id % 7 WHEN 1 THEN translate(plate, '018', 'OIB') WHEN 2 THEN substr(plate, 1, 2) || '8' || substr(plate, 4) WHEN 3 THEN '0' || substr(plate, 2) WHEN 4 THEN substr(plate, 1, 2) || 'RL' || substr(plate, 5)
  WHEN 5 THEN substr(plate, 1, 3) || 'T' || substr(plate, 5, 3) || '-' WHEN 6 THEN plate || '47' ELSE plate END AS noisy FROM det WHERE class_name <> 'person')"""
_DIGITS = f"'{''.join(DIGIT_FOR)}', '{''.join(d for d, _ in DIGIT_FOR.values())}'"
_PROVINCES = ", ".join(f"'{p}'" for p in PROVINCES)
_NOTES = "list_transform(list_filter(range(0, length({a})), lambda i: substr({a}, i + 1, 1) <> substr({b}, i + 1, 1)), lambda i: '{n} ' || i || ': ' || substr({a}, i + 1, 1) || ' to ' || substr({b}, i + 1, 1))"


def _corrected_sql(src: str) -> str:
    """Views up to ``fixed`` (event_id, text, notes, confidence): what ``corrected`` makes of ``noisy`` and confidence in ``src``."""
    return f""", s0 AS (SELECT event_id, CAST(confidence AS DOUBLE) AS confidence, regexp_replace(upper(noisy), '[^A-Z0-9]', '', 'g') AS t FROM {src} WHERE length(noisy) >= 7),
  s1 AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{2}}[A-Z][0-9]{{4,6}}$') THEN 3 WHEN regexp_matches(t, '^[0-9]{{2}}[A-Z]{{2}}[0-9]{{4,6}}$') OR regexp_matches(t, '^[0-9]{{2}}[A-Z][0-9]{{5,7}}$') OR regexp_matches(substr(t, 4, 1), '[A-Z]') OR (length(t) >= 8 AND regexp_matches(substr(t, 4, 1), '[0-9]')) THEN 4 ELSE 3 END AS fin,
    length(t) >= 8 AND NOT regexp_matches(substr(t, 4, 1), '[A-Z]') AND NOT regexp_matches(t, '^[0-9]{{2}}[A-Z][0-9]{{4,6}}$') AS digits, NOT (regexp_matches(t, '^[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4,6}}$') OR regexp_matches(t, '^[0-9]{{2}}[A-Z][0-9]{{5,7}}$')) AS unsure FROM s0),
  s2 AS (SELECT *, substr(t, 1, 2) AS p0, translate(substr(t, 1, 2), {_DIGITS}) AS p1 FROM s1),
  near AS (SELECT lpad(CAST(k AS VARCHAR), 2, '0') AS code, arg_min(p, abs(CAST(p AS INT) - k) * 100 + CAST(p AS INT)) AS nearest FROM range(100) r(k), unnest([{_PROVINCES}]) u(p) GROUP BY k HAVING lpad(CAST(k AS VARCHAR), 2, '0') NOT IN ({_PROVINCES}) AND min(abs(CAST(p AS INT) - k)) <= 5),
  s3 AS (SELECT s2.*, coalesce(nearest, p1) || substr(t, 3) AS t3, {_NOTES.format(a="p0", b="p1", n="province")} || CASE WHEN nearest IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['province ' || p1 || ' to ' || nearest] END AS n3 FROM s2 LEFT JOIN near ON code = p1),
  s4 AS (SELECT *, substr(t3, 3, fin - 2) AS a4, CASE WHEN digits THEN translate(substr(t3, 3, fin - 2), '{"".join(c for c in LETTER_FOR if c.isalpha())}', '{"".join(x for c, x in LETTER_FOR.items() if c.isalpha())}') ELSE translate(substr(t3, 3, fin - 2), '{"".join(LETTER_FOR)}', '{"".join(LETTER_FOR.values())}') END AS b4,
    substr(t3, fin + 1) AS c4, translate(substr(t3, fin + 1), {_DIGITS}) AS d4 FROM s3),
  s5 AS (SELECT *, n3 || {_NOTES.format(a="a4", b="b4", n="series")} || {_NOTES.format(a="c4", b="d4", n="serial")} AS n5, substr(b4, 2, 1) AS last, CASE substr(b4, 2, 1) {" ".join(f"WHEN '{c}' THEN '{m[0]}'" for c in _READ if (m := _meant(c, "0123456789")) and m[1] >= 0.3)} END AS digit,
    unsure AND fin = 4 AND length(regexp_replace(d4, '[^0-9]', '', 'g')) = 4 AND length(c4) > 0 AS brief FROM s4),
  s6 AS (SELECT event_id, confidence, CASE WHEN brief AND digit IS NOT NULL THEN substr(t3, 1, 2) || substr(b4, 1, 1) || digit || d4 WHEN fin = 4 AND b4 IN ('RL', 'RN', 'RI') AND regexp_matches(d4, '^[0-9]+$') THEN substr(t3, 1, 2) || 'R1' || d4 ELSE substr(t3, 1, 2) || b4 || d4 END AS text,
    CASE WHEN brief AND digit IS NOT NULL THEN n5 || ['short serial: ' || last || ' to ' || digit] WHEN fin = 4 AND b4 IN ('RL', 'RN', 'RI') AND regexp_matches(d4, '^[0-9]+$') THEN n5 || ['series ' || b4 || ' to R1'] ELSE n5 END AS notes FROM s5
    UNION ALL SELECT event_id, 0, noisy, [] FROM {src} WHERE length(noisy) < 7),
  fixed AS (SELECT event_id, text, notes, round(CASE WHEN regexp_matches(text, '^[1-9][0-9][A-Z]{{1,2}}[0-9]?[0-9]{{4,6}}$') AND length(text) BETWEEN 7 AND 10 THEN least(1, c + CAST(0.1 AS DOUBLE)) ELSE c END, 9) AS confidence FROM (SELECT *, greatest(0, confidence - len(notes) * CAST(0.05 AS DOUBLE)) AS c FROM s6))"""


@query("SELECT event_id, text, confidence, array_to_string(notes, '; ') AS notes FROM fixed", NOISY + _corrected_sql("y"))
def sf14_corrected_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = noisy(spark, sf_dir).select("event_id", corrected(F.col("noisy"), F.col("confidence")).alias("c"))
    return d.select("event_id", "c.text", "c.confidence", F.array_join("c.notes", "; ").alias("notes"))


def conservative(raw: Column) -> Column:
    """Only O, I and L among the digits are set right; texts under seven characters stay."""
    t = F.regexp_replace(F.trim(F.upper(raw)), "[ .-]", "")
    end = F.when(F.substring(t, 4, 1).rlike("[A-Z]"), 4).otherwise(3)
    new = F.concat(F.translate(F.substring(t, 1, 2), "OIL", "011"), F.substring(t, F.lit(3), end - 2), F.translate(F.substring(t, end + 1, F.lit(1000)), "OIL", "011"))
    return F.when(F.length(raw) < 7, raw).otherwise(new)


def boost(text: Column) -> Column:
    """What a form adds: the narrower the more; a little for a province alone; nothing under seven characters or without one."""
    t = F.regexp_replace(F.upper(text), "[-. ]", "")
    forms = [("^[1-9][0-9][A-Z][0-9]{5}$", 0.15), ("^[1-9][0-9][A-Z]{2}[0-9]{5}$", 0.12), ("^[1-9][0-9][A-Z][0-9]{4,6}$", 0.09), ("^[1-9][0-9][A-Z]{1,2}[0-9]{4,6}$", 0.06)]
    out = F.when((F.length(text) < 7) | ~t.rlike("^[0-9]{2}") | (F.substring(t, 1, 2) < "11"), 0.0)
    for form, more in forms:
        out = out.when(t.rlike(form), more)
    return F.coalesce(out.when(F.length(t) >= 7, 0.02).otherwise(0.0), F.lit(0.0))


_BOOST = """CASE WHEN length({t}) < 7 OR NOT regexp_matches({t}, '^[0-9]{{2}}') OR substr({t}, 1, 2) < '11' THEN 0 WHEN NOT regexp_matches({t}, '^[1-9][0-9][A-Z]{{1,2}}[0-9]{{4,6}}$') THEN CASE WHEN length(replace({t}, '-', '')) >= 7 THEN 0.02 ELSE 0 END
  WHEN regexp_matches({t}, '^..[A-Z][0-9]{{5}}$') THEN 0.15 WHEN regexp_matches({t}, '^..[A-Z]{{2}}[0-9]{{5}}$') THEN 0.12 WHEN regexp_matches({t}, '^..[A-Z][0-9]') THEN 0.09 ELSE 0.06 END"""


@query(
    f"SELECT event_id, text, CAST({_BOOST.format(t='text')} AS DOUBLE) AS boost FROM (SELECT event_id, CASE WHEN length(noisy) < 7 THEN noisy ELSE (SELECT string_agg(CASE WHEN k > 2 AND (k = 3 OR (k = 4 AND regexp_matches(c, '[A-Z]'))) THEN c WHEN c = 'O' THEN '0' WHEN c IN ('I', 'L') THEN '1' ELSE c END, '' ORDER BY k) FROM (SELECT unnest(string_split(b, '')) AS c, unnest(range(1, length(b) + 1)) AS k)) END AS text FROM (SELECT *, replace(noisy, '-', '') AS b FROM y))",
    NOISY,
)
def sf15_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = noisy(spark, sf_dir).withColumn("text", conservative(F.col("noisy")))
    return d.select("event_id", "text", boost(F.col("text")).alias("boost"))


@query(
    f"""SELECT event_id, CASE WHEN adopt THEN best.t ELSE noisy END AS text, round(CASE WHEN adopt THEN best.c ELSE CAST(confidence AS DOUBLE) END, 9) AS confidence FROM (SELECT *, confidence < 0.8 AND best.c > confidence AS adopt FROM (SELECT *, list_sort(list_transform(v, lambda x: {{'f': {VALID.format(p="regexp_replace(upper(x.t), '[^A-Z0-9]', '', 'g')")}, 'c': x.c, 't': x.t}}), 'DESC')[1] AS best FROM v))""",
    NOISY
    + """, v AS (SELECT *, [{'t': noisy, 'c': CAST(confidence AS DOUBLE)}, {'t': plate_clean, 'c': confidence + CAST(0.05 AS DOUBLE) - (event_id % 9) / CAST(100 AS DOUBLE)}, {'t': substr(noisy, 1, 6), 'c': confidence + CAST(0.07 AS DOUBLE)}, {'t': plate, 'c': confidence * CAST(0.9 AS DOUBLE) + (event_id % 11) / CAST(50 AS DOUBLE)}] AS v FROM y)""",
)
def ag33_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of variants of a crop, where the first is under 0.80: of those of a valid form, or else of all, the surest, if it is surer than the first."""
    c, k = F.col("confidence"), F.col("event_id")
    variants = [("noisy", c), ("plate_clean", c + 0.05 - (k % 9) / 100.0), (F.substring("noisy", 1, 6), c + 0.07), ("plate", c * 0.9 + (k % 11) / 50.0)]
    rows = [F.struct(valid(F.col(t) if isinstance(t, str) else t).alias("fits"), x.alias("c"), (F.col(t) if isinstance(t, str) else t).alias("t")) for t, x in variants]
    d = noisy(spark, sf_dir).withColumn("best", F.array_max(F.array(*rows)))
    adopt = (c < 0.80) & (F.col("best.c") > c)
    return d.select("event_id", F.when(adopt, F.col("best.t")).otherwise(F.col("noisy")).alias("text"), F.round(F.when(adopt, F.col("best.c")).otherwise(c), 9).alias("confidence"))


def candidates(df: DataFrame) -> DataFrame:
    """``df`` (noisy, plate, plate_clean, confidence) with candidates: what each source that is asked makes of a reading, corrected, with the boost of its form.

    The first reading counts; where it is short or under 0.70 it is read again as two lines; its province and serial are
    always looked at again; where it is short or under 0.85 a second engine and augmented copies are asked too.
    """
    c, short, k = F.col("confidence"), F.length("noisy") < 8, F.col("event_id")
    sources = [
        ("first", F.length("noisy") > 0, F.col("noisy"), c), ("two_lines", short | (c < 0.7), F.concat(F.substring("plate_clean", 1, 3), F.substring("plate", 4, 100)), c * 0.9),
        ("rescue", F.lit(True), F.concat(F.substring("plate_clean", 1, 2), F.substring("noisy", 3, 100)), c * 0.95),
        ("second", short | (c < 0.85), F.translate("plate_clean", "5", "S"), F.lit(0.4) + (k % 5) / 10.0), ("augmented", (short | (c < 0.85)) & (F.length("plate") >= 7), F.col("plate"), F.lit(0.3) + (k % 7) / 10.0),
    ]
    rows = F.array(*[F.when(asked, F.struct(F.lit(name).alias("source"), corrected(text, sure, written=False).alias("c"))) for name, asked, text, sure in sources])
    found = F.filter(rows, lambda x: x.isNotNull() & (F.length(x["c"]["text"]) > 0))
    return df.withColumn("candidates", F.transform(found, lambda x: F.struct(x["source"].alias("source"), x["c"]["text"].alias("text"), basic(x["c"]["text"]).alias("plain"), x["c"]["confidence"].alias("confidence"), boost(x["c"]["text"]).alias("boost"))))


@dataclass
class Arbiter:
    """One camera: of a reading's candidates the best by 0.6 confidence, 0.25 boost and 0.15 of the share that the camera's
    leading plate has among its last choices, where it is that plate. A choice is remembered for ``window`` seconds, as of
    the last one; a camera without choices for ``idle`` seconds forgets all. The first of equal scores wins."""

    window: float = 10.0
    idle: float = 60.0
    chosen: deque[tuple[float, str]] = field(default_factory=deque)
    places: dict[str, deque[int]] = field(default_factory=dict)  # of each plate among all choices made
    lead: list[tuple[int, int, str]] = field(default_factory=list)  # a heap of counts and first places, old ones among them
    made: int = 0

    @property
    def quiet(self) -> float:
        return self.idle

    def _counted(self, plate: str) -> None:
        own = self.places[plate]
        if not own:
            del self.places[plate]
            return
        heappush(self.lead, (-len(own), own[0], plate))
        if len(self.lead) > 4 * len(self.places) + 64:
            self.lead = [(-len(x), x[0], p) for p, x in self.places.items()]
            heapify(self.lead)

    def _leader(self) -> tuple[str, int]:
        """The plate chosen most often, of equals the one chosen first, and how often."""
        while self.lead:
            n, first, plate = self.lead[0]
            own = self.places.get(plate)
            if own and (-len(own), own[0]) == (n, first):
                return plate, -n
            heappop(self.lead)
        return "", 0

    def _choose(self, now: float, plate: str) -> None:
        self.made += 1
        self.chosen.append((now, plate))
        self.places.setdefault(plate, deque()).append(self.made)
        self._counted(plate)
        while self.chosen and self.chosen[0][0] <= now - self.window:
            _, old = self.chosen.popleft()
            self.places[old].popleft()
            self._counted(old)

    def step(self, e) -> tuple | None:
        if self.chosen and e.sec - self.chosen[-1][0] > self.idle:
            self.chosen, self.places, self.lead = deque(), {}, []
        leader, n = self._leader()
        share = n / len(self.chosen) if self.chosen else 0.0
        best = None
        for c in e.candidates:
            score = 0.6 * c["confidence"] + 0.25 * c["boost"] + 0.15 * (share if c["plain"] == leader else 0.0)
            if best is None or score > best[0]:
                best = score, c
        if best is None:
            return None
        self._choose(e.sec, best[1]["plain"])
        return best[1]["source"], best[1]["text"], best[1]["confidence"], round(best[0], 9)


@query(
    "SELECT event_id, got.source AS source, got.text AS text, got.c AS confidence, round(got.score, 9) AS score FROM r WHERE k > 0",
    NOISY
    + """, q AS (SELECT *, CAST(confidence AS DOUBLE) AS sure, length(noisy) < 8 AS brief FROM y),
  src AS (SELECT event_id * 10 AS event_id, sure AS confidence, noisy FROM q WHERE length(noisy) > 0 UNION ALL SELECT event_id * 10 + 1, sure * CAST(0.9 AS DOUBLE), substr(plate_clean, 1, 3) || substr(plate, 4) FROM q WHERE brief OR sure < 0.7
    UNION ALL SELECT event_id * 10 + 2, sure * CAST(0.95 AS DOUBLE), substr(plate_clean, 1, 2) || substr(noisy, 3) FROM q UNION ALL SELECT event_id * 10 + 3, CAST(0.4 AS DOUBLE) + (event_id % 5) / CAST(10 AS DOUBLE), translate(plate_clean, '5', 'S') FROM q WHERE brief OR sure < 0.85
    UNION ALL SELECT event_id * 10 + 4, CAST(0.3 AS DOUBLE) + (event_id % 7) / CAST(10 AS DOUBLE), plate FROM q WHERE (brief OR sure < 0.85) AND length(plate) >= 7)"""
    + _corrected_sql("src")
    + f""", c AS (SELECT event_id // 10 AS event_id, list({{'source': ['first', 'two_lines', 'rescue', 'second', 'augmented'][event_id % 10 + 1], 'text': text, 'p': regexp_replace(upper(text), '[^A-Z0-9]', '', 'g'), 'c': confidence, 'b': CAST({_BOOST.format(t="text")} AS DOUBLE)}} ORDER BY event_id) AS own FROM fixed WHERE length(text) > 0 GROUP BY event_id // 10),
  n AS (SELECT c.event_id, own, camera_id, sec, row_number() OVER (PARTITION BY camera_id ORDER BY sec, c.event_id) AS k FROM c JOIN det USING (event_id)),
  r AS (SELECT DISTINCT camera_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS event_id, CAST(NULL AS STRUCT(source VARCHAR, "text" VARCHAR, p VARCHAR, c DOUBLE, b DOUBLE, score DOUBLE)) AS got, CAST([] AS STRUCT(t BIGINT, p VARCHAR)[]) AS chosen FROM n
    UNION ALL SELECT camera_id, k, event_id, got, list_filter(past || [{{'t': sec, 'p': got.p}}], lambda x: x.t > sec - 86400) FROM (
      SELECT *, scored[list_position(list_transform(scored, lambda x: x.score), list_max(list_transform(scored, lambda x: x.score)))] AS got FROM (
        SELECT *, list_transform(own, lambda x: {{'source': x.source, 'text': x.text, 'p': x.p, 'c': x.c, 'b': x.b, 'score': CAST(0.6 AS DOUBLE) * x.c + CAST(0.25 AS DOUBLE) * x.b + CAST(0.15 AS DOUBLE) * CASE WHEN x.p = leader THEN share ELSE 0 END}}) AS scored FROM (
          SELECT *, past[list_position(counts, list_max(counts))].p AS leader, coalesce(list_max(counts) / CAST(len(past) AS DOUBLE), 0) AS share FROM (
            SELECT *, list_transform(past, lambda x: len(list_filter(past, lambda o: o.p = x.p))) AS counts FROM (
              SELECT n.*, CASE WHEN len(r.chosen) > 0 AND n.sec - r.chosen[-1].t > 172800 THEN [] ELSE r.chosen END AS past FROM r JOIN n ON n.camera_id = r.camera_id AND n.k = r.k + 1))))))""",
    recursive=True,
)
def ag34_sf25_arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of one day count, and a camera forgets after two. Candidates are made once and by all tasks, before a camera's readings go in order.
    Tested by a plain loop."""
    d = kept(candidates(noisy(spark, sf_dir).repartition("event_id")).select("event_id", "camera_id", "sec", "candidates")).where("size(candidates) > 0")
    schema = "event_id long, source string, text string, confidence double, score double"
    return stepped(d, ["camera_id"], lambda: Arbiter(86400, 172800), ["candidates"], schema, lambda e, got: (e.event_id, *got))
