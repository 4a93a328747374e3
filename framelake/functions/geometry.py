"""Boxes and points as Column functions; all stay in generated code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Shared over joint area; 0 where the joint area isn't above 0."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(joint > 0, w * h / joint).otherwise(0.0)


def inside(x: Column, y: Column, polygon: list[tuple[float, float]] | None) -> Column:
    """Whether a point lies in a polygon, by counting the edges right of it; without a polygon every point does."""
    if not polygon or len(polygon) < 3:
        return F.lit(True)
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ya != yb:
            crosses = (F.lit(ya) > y) != (F.lit(yb) > y)
            crossings = crossings + F.when(crosses & (x < F.lit(float(xb - xa)) * (y - ya) / F.lit(float(yb - ya)) + xa), 1).otherwise(0)
    return crossings % 2 == 1


def suppressed(boxes: Column, most: float, inclusive: bool = False) -> Column:
    """Non-maximum suppression of an array of structs (score, id, x1, y1, x2, y2): the greedy survivors, best first.

    A box goes if it overlaps a survivor by more than ``most``, or by as much where ``inclusive``.
    """

    def corners(s: Column) -> list[Column]:
        return [s[c].cast("double") for c in ("x1", "y1", "x2", "y2")]

    def over(a: Column, b: Column) -> Column:
        x = iou(corners(a), corners(b))
        return x >= most if inclusive else x > most

    ranked = F.array_sort(boxes, lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0))
    none = F.slice(ranked, 1, 0)
    return F.aggregate(ranked, none, lambda kept, b: F.when(F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two arrays of doubles; 0 where a norm is under 1e-9."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.sqrt(dot(a, a)) < 1e-9) | (F.sqrt(dot(b, b)) < 1e-9), 0.0).otherwise(dot(a, b) / norm)
