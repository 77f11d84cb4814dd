"""Box and size arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sane_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)


def clip(value: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, limit))


def polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners of a box, clockwise from the upper left."""
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def capped_side(side: Column, longest: Column, cap: int) -> Column:
    """A side after the longest is scaled down to the cap; halves go to even, never below 1."""
    return F.when(longest <= cap, side).otherwise(F.greatest(F.lit(1), F.bround(side * cap / longest, 0).cast("int")))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def intersection_over_union(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes [x0, y0, x1, y1]; 0 if both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.coalesce(w * h / F.nullif(union, F.lit(0.0)), F.lit(0.0))


def rotated_bounds(x: Column, y: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """A point's coordinates along a direction and across it."""
    n = F.sqrt(dx * dx + dy * dy)
    return (x * dx + y * dy) / n, (-x * dy + y * dx) / n


def shift_keys(numbered: Column, delta: int) -> Column:
    """A map with numeric string keys, each moved by delta."""
    return F.transform_keys(numbered, lambda k, _: (k.cast("int") + delta).cast("string"))


def diagonal_degrees(width: Column, height: Column) -> Column:
    return F.degrees(F.atan2(height, width))


def boundary_class(teacher: Column, continuous: Column, painted: Column) -> Column:
    """solid, dash_ink, dash_gap or null of a pixel: of those the teacher marks (at least one half), pixels no dashed line
    covers (less than one half of it drawn through) are solid, those its dashes cover by a half are ink, and those its
    dashes leave free (a hundredth at most) are gaps. One pixel has one class."""
    line = continuous >= 0.5
    return F.when(teacher >= 0.5, F.when(~line, "solid").when(painted >= 0.5, "dash_ink").when(painted <= 0.01, "dash_gap"))
