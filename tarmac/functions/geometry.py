"""Box arithmetic as column expressions. Boxes are half-open: touching edges don't intersect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def _c(p: str, k: str) -> Column:
    return F.col(f"{p}{k}")


def inter_sides(a: str, b: str) -> tuple[Column, Column]:
    w = F.least(_c(a, "x1"), _c(b, "x1")) - F.greatest(_c(a, "x0"), _c(b, "x0"))
    h = F.least(_c(a, "y1"), _c(b, "y1")) - F.greatest(_c(a, "y0"), _c(b, "y0"))
    return w, h


def area(p: str) -> Column:
    return (_c(p, "x1") - _c(p, "x0")) * (_c(p, "y1") - _c(p, "y0"))


def iou(a: str, b: str) -> Column:
    """Double precision, no epsilon, 0 without intersection. a, b: column prefixes of x0, y0, x1, y1."""
    w, h = inter_sides(a, b)
    i = w * h
    return F.when((w > 0) & (h > 0), i.cast("double") / (area(a) + area(b) - i)).otherwise(0.0)


def iou_single(a: str, b: str) -> Column:
    """Single precision throughout and an epsilon below the line, as detectors score."""
    f = lambda p, k: _c(p, k).cast("float")
    zero = F.lit(0).cast("float")
    w = F.greatest(F.least(f(a, "x1"), f(b, "x1")) - F.greatest(f(a, "x0"), f(b, "x0")), zero)
    h = F.greatest(F.least(f(a, "y1"), f(b, "y1")) - F.greatest(f(a, "y0"), f(b, "y0")), zero)
    i = (w * h).cast("float")
    ar = lambda p: ((f(p, "x1") - f(p, "x0")) * (f(p, "y1") - f(p, "y0"))).cast("float")
    return i / ((ar(a) + ar(b)).cast("float") - i + F.lit(EPS).cast("float")).cast("float")


def over_smaller(a: str, b: str) -> Column:
    """Intersection over the smaller area, 0 without intersection."""
    w, h = inter_sides(a, b)
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), (w * h).cast("double") / least).otherwise(0.0)


def clamp(v: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0).cast("double"), F.least(v, hi))


def canvas(side: Column, longest: Column, imgsz: int = 640, stride: int = 32) -> Column:
    """Letterbox side: the aspect-normalised side rounded up to whole strides with half a stride of room."""
    return (F.ceil(side / longest * imgsz / stride + 0.5) * stride).cast("int")
