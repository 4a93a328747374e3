"""Correction of plate readings as Column functions: context, place, score and neighbours of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.plates import PROVINCES, SERIES

# Groups of small letters read for a capital, in order; look-alikes by place; the form of a plate.
CONTEXT = [("rn", "M"), ("vv", "W"), ("cl", "D"), ("cI", "D"), ("ll", "H"), ("lI", "H"), ("Vv", "W"), ("VV", "W")]
DIGITS = ("ODQILZSBG", "000112586")
SERIAL = ("ODQILZSBGTJYAV", "00011258677747")
FIRST_LETTER = ("018654", "DTBGSA")
LETTERS = ("8654", "BGSA")
FORM = "^[1-9][0-9][A-Z]{1,2}[0-9]?[0-9]{4,6}$"
#: Digits that look like a digit.
ALIKE = {"0": "86", "1": "7", "2": "7", "3": "8", "5": "68", "6": "805", "7": "12", "8": "063", "9": "8"}


def char(c: Column, at: int) -> Column:
    return F.substring(c, at, 1)


def in_context(raw: Column) -> tuple[Column, Column]:
    """The text with groups of letters set right, and how many kinds of groups were."""
    text, n = raw, F.lit(0)
    for old, new in CONTEXT:
        n = n + F.contains(text, F.lit(old)).cast("int")
        text = F.replace(text, F.lit(old), F.lit(new))
    return text, n


def two_series(c: Column) -> Column:
    """Whether the series has two characters: a letter comes fourth, or a digit in nine characters or more."""
    fourth = char(c, 4)
    return fourth.rlike("[A-Z]") | ((F.length(c) >= 9) & fourth.rlike("[0-9]"))


def placed(c: Column) -> Column:
    """Look-alikes set right by place: digits, a series letter, perhaps another, digits. Under four characters nothing changes."""
    n, fourth = F.length(c), char(c, 4)
    letter = F.when(fourth.rlike("[865]") & (n >= 9), F.translate(fourth, *LETTERS)).when((fourth == "4") & (n >= 10), "A").otherwise(fourth)
    two = letter.rlike("[A-Z]") | (n >= 9)
    head = F.concat(F.translate(F.substring(c, 1, 2), *DIGITS), F.translate(char(c, 3), *FIRST_LETTER))
    rest = F.when(two, F.concat(letter, F.translate(F.substring(c, 5, 1000), *SERIAL))).otherwise(F.translate(F.substring(c, 4, 1000), *SERIAL))
    return F.when(n >= 4, F.concat(head, rest)).otherwise(c)


def changes(a: Column, b: Column) -> Column:
    """Characters in which two texts of one length differ."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda z: z["x"] != z["y"]))


def score(c: Column) -> Column:
    """How well a text fits a plate, in hundredths: less for form, province, series, serial and length."""
    third, fourth = ~char(c, 3).rlike(f"[{SERIES}]"), char(c, 4).rlike("[A-Z]") & ~char(c, 4).rlike(f"[{SERIES}]")
    serial = F.when(two_series(c), F.substring(c, 5, 1000)).otherwise(F.substring(c, 4, 1000))
    parts = [(~c.rlike(FORM), 20), (~F.substring(c, 1, 2).isin(PROVINCES), 50), (third | fourth, 30), (third & fourth, 10), (serial.rlike("[^0-9]"), 40), (~F.length(c).isin(8, 9), 20)]
    total = F.lit(100)
    for bad, less in parts:
        total = total - F.when(bad, less).otherwise(0)
    return F.when(F.length(c) < 7, 0).otherwise(F.greatest(total, F.lit(0)))


def neighbours(c: Column) -> Column:
    """Texts of a plate's form, one look-alike away from ``c``; 11 for the series is an H too. None under seven characters."""
    series_end = F.when(two_series(c), 4).otherwise(3)

    def other(i: Column) -> Column:
        x = F.substr(c, i, F.lit(1))
        alt = (
            F.when(i <= 2, F.translate(x, *DIGITS))
            .when(i > series_end, F.translate(x, *SERIAL))
            .when(x.rlike("[0-9]"), F.translate(x, *LETTERS))
            .when((i == 4) & (series_end == 4), F.translate(x, *DIGITS))
            .otherwise(x)
        )
        return F.when(alt != x, F.concat(F.substr(c, F.lit(1), i - 1), alt, F.substr(c, i + 1)))

    every = F.concat(F.transform(F.sequence(F.lit(1), F.length(c)), other), F.array(F.when(F.substring(c, 3, 2) == "11", F.concat(F.substring(c, 1, 2), F.lit("H"), F.substring(c, 5, 1000)))))
    fit = F.filter(every, lambda x: x.isNotNull() & x.rlike(FORM))
    return F.when(F.length(c) >= 7, F.array_distinct(fit)).otherwise(F.array().cast("array<string>"))


def other_province(c: Column) -> Column:
    """The text with the smallest province in use that is one look-alike digit away; null if there is none."""
    first, second = ({d: [x for x in alike] for d, alike in ALIKE.items()} for _ in range(2))
    near = {p: min((q for q in [x + p[1] for x in first.get(p[0], [])] + [p[0] + x for x in second.get(p[1], [])] if q in PROVINCES), default=None) for p in (f"{k:02d}" for k in range(100))}
    table = F.create_map(*[F.lit(x) for p, q in near.items() if q for x in (p, q)])
    return F.concat(table[F.substring(c, 1, 2)], F.substring(c, 3, 1000))


def syntax(c: Column) -> Column:
    """A multiplier by form: 1.2 with a province in use, 1.1 with one from 11 to 99, 0.8 else; without the form 0.9 or 0.7."""
    form = c.rlike("^[0-9]{2}([A-Z]{1,2}[0-9]{4,6}|[A-Z][0-9]{5,6})$")
    named = F.when(F.substring(c, 1, 2).isin(PROVINCES), 1.2).when(F.substring(c, 1, 2).try_cast("int") >= 11, 1.1).otherwise(0.8)
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 5, 0.7).when(form, named).when((F.length(c) >= 7) & c.rlike("^[0-9]{2}"), 0.9).otherwise(0.7)


def halves(top: Column, bottom: Column) -> Column:
    """Whether two lines make a plate: province and series above, four characters or more below, four in five of them digits."""
    digits = F.length(F.regexp_replace(bottom, "[^0-9]", ""))
    return top.rlike("^[0-9]{2}[A-Z]{1,2}[0-9]?$") & (F.length(bottom) >= 4) & (digits * 5 >= F.length(bottom) * 4)


def reduced(short: Column, long: Column) -> Column:
    """Whether ``short`` is ``long`` without one or two characters, the first five and last two of it kept."""
    gap = F.length(long) - F.length(short)
    kept = F.regexp_like(long, F.concat(F.lit("^.*"), F.regexp_replace(short, "(.)", "$1.*")))
    return gap.between(1, 2) & ((F.length(short) < 5) | (F.substring(short, 1, 5) == F.substring(long, 1, 5))) & ((F.length(short) < 2) | (F.right(short, F.lit(2)) == F.right(long, F.lit(2)))) & kept
