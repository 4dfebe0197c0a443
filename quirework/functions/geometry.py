"""Bounding-box arithmetic as column expressions; a box is a struct of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area of what two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for an empty box."""
    return F.coalesce(F.try_divide(overlap(inner, outer), area(inner)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(overlap(a, b), area(a) + area(b) - overlap(a, b)), F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower box."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return F.coalesce(F.try_divide(w, F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])), F.lit(0.0))


def expand(b: Column, by: float) -> Column:
    return F.struct((b["x0"] - by).alias("x0"), (b["y0"] - by).alias("y0"), (b["x1"] + by).alias("x1"), (b["y1"] + by).alias("y1"))


def centre_inside(a: Column, b: Column) -> Column:
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def valid(b: Column) -> Column:
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def inside_page(b: Column, width: Column, height: Column, slack: float = 2.0) -> Column:
    return (b["x0"] >= -slack) & (b["y0"] >= -slack) & (b["x1"] <= width + slack) & (b["y1"] <= height + slack)


def alignment(b: Column, left: Column, right: Column, tolerance: float = 6.0) -> Column:
    """centered, left, right or other, within a container from ``left`` to ``right``."""
    centred = F.abs((b["x0"] + b["x1"]) / 2 - (left + right) / 2) <= tolerance
    return F.when(centred, "centered").when(F.abs(b["x0"] - left) <= tolerance, "left").when(F.abs(b["x1"] - right) <= tolerance, "right").otherwise("other")


def nominal_size(size: Column, near: float = 0.25) -> Column:
    """The whole size within ``near`` of a measured one, else the size to a tenth."""
    whole = F.bround(size)
    return F.when(F.abs(size - whole) <= near, whole).otherwise(F.bround(size, 1))


def font_name(name: Column) -> Column:
    """Without the subset prefix."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def is_bold(name: Column, flags: Column) -> Column:
    return F.lower(name).rlike("bold|black|heavy") | (flags.bitwiseAND(16) > 0)
