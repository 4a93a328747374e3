"""Fields of messages as Column functions: text to numbers, times and boxes, with the defaults of each reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def number(c: Column, otherwise: Column | float = 0.0) -> Column:
    """A decimal number; blank, missing and malformed text give ``otherwise``."""
    return F.coalesce(c.try_cast("double"), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def whole(c: Column) -> Column:
    """A whole number written as one; null otherwise."""
    return F.when(F.trim(c).rlike("^[+-]?[0-9]+$"), F.trim(c).try_cast("long"))


def seconds(c: Column, otherwise: Column) -> Column:
    """Epoch seconds with a fraction, as a time; ``otherwise`` where it can't be read."""
    return F.coalesce(F.timestamp_millis(F.floor(c.try_cast("double") * 1000).cast("long")).cast("timestamp_ntz"), otherwise)


def corners(c: Column) -> Column:
    """Four numbers with commas between, cut to whole ones; null for any other text."""
    parts = F.transform(F.split(c, ","), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), F.transform(parts, lambda x: x.cast("int")))


def field(entries: Column, name: str) -> Column:
    """The value of the first entry (name, value) of that name in any case; null if there is none."""
    return F.get(F.filter(entries, lambda e: F.lower(e["name"]) == name.lower()), 0)["value"]
