"""Box arithmetic on ``x0,y0,x1,y1`` double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")


def cols(prefix: str = "") -> list[Column]:
    return [F.col(prefix + e) for e in EDGES]


def width(p: str = "") -> Column:
    return F.col(p + "x1") - F.col(p + "x0")


def height(p: str = "") -> Column:
    return F.col(p + "y1") - F.col(p + "y0")


def area(p: str = "") -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, width(p)) * F.greatest(zero, height(p))


def overlap_x(a: str, b: str) -> Column:
    return F.least(F.col(a + "x1"), F.col(b + "x1")) - F.greatest(F.col(a + "x0"), F.col(b + "x0"))


def overlap_y(a: str, b: str) -> Column:
    return F.least(F.col(a + "y1"), F.col(b + "y1")) - F.greatest(F.col(a + "y0"), F.col(b + "y0"))


def gap_x(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), -overlap_x(a, b))


def gap_y(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), -overlap_y(a, b))


def intersects(a: str, b: str) -> Column:
    return (overlap_x(a, b) > 0) & (overlap_y(a, b) > 0)


def intersection_area(a: str, b: str) -> Column:
    return F.when(intersects(a, b), overlap_x(a, b) * overlap_y(a, b)).otherwise(F.lit(0.0))


def contains(outer: str, inner: str, tolerance: float = 0.0) -> Column:
    t = F.lit(float(tolerance))
    return (
        (F.col(inner + "x0") >= F.col(outer + "x0") - t)
        & (F.col(inner + "y0") >= F.col(outer + "y0") - t)
        & (F.col(inner + "x1") <= F.col(outer + "x1") + t)
        & (F.col(inner + "y1") <= F.col(outer + "y1") + t)
    )


def l1_distance(a: str, b: str) -> Column:
    return sum((F.abs(F.col(a + e) - F.col(b + e)) for e in EDGES[1:]), F.abs(F.col(a + "x0") - F.col(b + "x0")))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")]
