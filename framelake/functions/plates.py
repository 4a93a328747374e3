"""Plate strings as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alikes of digits and of series letters, province codes in use, series letters.
TO_DIGIT = ("OQDILZSBGTA", "00011258674")
TO_SERIES = ("85264710", "BSZGATTD")
PROVINCES = """
11 12 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40 41 43 47 48 49 50 51 52 53 54 55 56 57 58 59
60 61 62 63 64 65 66 67 68 69 70 71 72 73 74 75 76 77 78 79 80 81 82 83 84 85 86 88 89 90 91 92 93 94 95 97 98 99
""".split()
SERIES = "ABCDEFGHJKLMNPRSTUVWXYZ"


def basic(c: str | Column) -> Column:
    """Upper case, A-Z and 0-9 only; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "[^A-Z0-9]", "")


def positional(c: str | Column) -> Column:
    """Look-alikes set right by place: two digits, a series letter (two, if the plate has nine characters or more and the fourth looks like one), digits."""
    p = basic(c)
    head = F.translate(F.substring(p, 1, 2), *TO_DIGIT)
    third, fourth = F.substring(p, 3, 1), F.substring(p, 4, 1)
    series = F.when(third.rlike("[A-Z]"), third).otherwise(F.translate(third, *TO_SERIES))
    two = fourth.rlike("[A-Z]") | ((F.length(p) >= 9) & fourth.rlike(f"[{TO_SERIES[0]}]"))
    second = F.when(fourth.rlike("[A-Z]"), fourth).otherwise(F.translate(fourth, *TO_SERIES))
    rest = F.when(two, F.concat(second, F.translate(F.substring(p, 5, 100), *TO_DIGIT))).otherwise(F.translate(F.substring(p, 4, 100), *TO_DIGIT))
    return F.concat(head, series, rest)


def valid(c: str | Column) -> Column:
    """Seven to ten characters: a province in use, one or two series letters, four to six digits."""
    p = basic(c)
    return p.rlike(f"^[0-9]{{2}}[{SERIES}]{{1,2}}[0-9]{{4,6}}$") & F.length(p).between(7, 10) & F.substring(p, 1, 2).isin(PROVINCES)


def motorcycle(c: str | Column) -> Column:
    """Two digits, a letter, six digits, and no dash or slash in what was read."""
    raw = F.col(c) if isinstance(c, str) else c
    return basic(raw).rlike("^[0-9]{2}[A-Z][0-9]{6}$") & ~raw.rlike("[-/]")


def collapsed(labels: str | Column, blank: int = 0) -> Column:
    """Greedy alignment decoding of an array of labels: repeats fall together, then blanks go."""
    changes = F.filter(labels, lambda x, i: (i == 0) | (x != F.col(labels)[i - 1] if isinstance(labels, str) else x != labels[i - 1]))
    return F.filter(changes, lambda x: x != blank)


def sampled(camera: Column, identity: Column, seconds: Column, ratio: float) -> Column:
    """Deterministic sampling: the first 32 bits of an md5 of camera, identity and half second, as a share, under ``ratio``."""
    key = F.concat_ws(":", camera, identity.cast("string"), F.floor(seconds * 2).cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 < ratio
