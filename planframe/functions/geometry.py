"""Column expressions of plane geometry. All are built-in functions, so they stay in generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes with columns <prefix>x1 .. <prefix>y2; 0 without overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    inter = w * h
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / (area(a) + area(b) - inter))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def nearest(values: Column, x: Column) -> Column:
    """The value of an array nearest to x; the first of equals; null for an empty array."""
    best = F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"), v.alias("v"))))
    return best["v"]


def nearest_ascending(values: Column, x: Column) -> Column:
    """``nearest`` of an ascending array: the last value up to x or the first beyond it, the lower of equals."""
    low, high = F.array_max(F.filter(values, lambda v: v <= x)), F.array_min(F.filter(values, lambda v: v > x))
    return F.when(high.isNull() | (F.abs(low - x) <= F.abs(high - x)), low).otherwise(high)


def axis(dx: Column, dy: Column) -> Column:
    return F.when(F.abs(dx) >= F.abs(dy), "x").otherwise("y")


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting over an array of struct<x,y>; false for fewer than three points."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(points, i), F.element_at(points, F.when(i == 1, n).otherwise(i - 1))
        span = q["y"] - p["y"]
        at = p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / F.when(span == 0, 1e-12).otherwise(span)
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    odd = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses)) % 2 == 1
    return F.when(n >= 3, odd).otherwise(False)


def cell_world(lines: Column, world: Column, x: Column) -> Column:
    """Piecewise linear map of a pixel to millimetres: clamps past the last line and extrapolates before the first.

    ``lines`` are ascending pixel positions and ``world`` their millimetres.
    """
    n = F.size(lines)
    i = F.size(F.filter(F.slice(lines, 2, F.greatest(n - 2, F.lit(0))), lambda v: v <= x)) + 1
    p0, p1 = F.element_at(lines, i), F.element_at(lines, i + 1)
    w0, w1 = F.element_at(world, i), F.element_at(world, i + 1)
    inside = w0 + (x - p0) / F.when(p1 == p0, 1.0).otherwise(p1 - p0) * (w1 - w0)
    return F.when(n < 2, F.lit(0.0)).when(x >= F.element_at(lines, -1), F.element_at(world, -1)).otherwise(inside)


def interpolate(lines: Column, world: Column, x: Column) -> Column:
    """Piecewise linear map through (lines, world), extrapolated at both ends; 0 without lines, the one value of a single line."""
    n = F.size(lines)
    i = F.size(F.filter(F.slice(lines, 2, F.greatest(n - 2, F.lit(0))), lambda v: v <= x)) + 1
    at = lambda a, k: F.try_element_at(a, k)
    p0, p1, w0, w1 = at(lines, i), at(lines, i + 1), at(world, i), at(world, i + 1)
    return F.when(n == 0, 0.0).when(n == 1, at(world, F.lit(1))).when(p1 == p0, w0).otherwise(w0 + (w1 - w0) * (x - p0) / F.nullif(p1 - p0, F.lit(0.0)))


def to_px(points: Column, dpi: Column) -> Column:
    return points * dpi / 72.0


def to_pt(pixels: Column, dpi: Column) -> Column:
    return pixels * 72.0 / dpi
