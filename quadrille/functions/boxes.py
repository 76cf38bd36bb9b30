"""Axis-aligned boxes as Column expressions: areas, overlaps, coordinates and tile windows.

A box is four columns x0, y0, x1, y1. Sides are clamped at 0, so boxes with swapped corners have no area, and ratios
with an empty denominator are 0: predicates that the optimizer reorders cannot divide by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))


def span(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b - a)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def area(a: Box) -> Column:
    return span(a[0], a[2]) * span(a[1], a[3])


def intersection(a: Box, b: Box) -> Column:
    return span(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * span(F.greatest(a[1], b[1]), F.least(a[3], b[3]))


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    return ratio(shared, area(a) + area(b) - shared)


def visible(a: Box, window: Box) -> Column:
    """The share of a box's area inside a window."""
    return ratio(intersection(a, window), area(a))


def overlap_share(a: Box, b: Box, tile_area: float) -> Column:
    return intersection(a, b) / F.lit(float(tile_area))


def overlaps(a: Box, b: Box, closed: bool = False) -> Column:
    """Boxes share area; closed: or touch."""
    if closed:
        return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def covers(outer: Box, inner: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def within(inner: Box, outer: Box) -> Column:
    """The inner box lies in the outer one and not on its edge alone: covers() without contact of the boundary only."""
    return covers(outer, inner) & (inner[0] < outer[2]) & (outer[0] < inner[2]) & (inner[1] < outer[3]) & (outer[1] < inner[3])


def holds_point(a: Box, x: Column, y: Column) -> Column:
    return (a[0] <= x) & (x <= a[2]) & (a[1] <= y) & (y <= a[3])


def centre(a: Box) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def crosses(low: Column, high: Column, boundary: Column) -> Column:
    """Strictly on both sides of a boundary."""
    return (low < boundary) & (boundary < high)


def pixel_to_map(a: Box, left: Column, top: Column, resolution: float) -> Box:
    """Tile pixels, y down, to map coordinates, y up."""
    r = F.lit(float(resolution))
    return left + a[0] * r, top - a[3] * r, left + a[2] * r, top - a[1] * r


def map_to_unit(a: Box, window: Box) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of a window, y down."""
    w, h = window[2] - window[0], window[3] - window[1]
    x, y = centre(a)
    return ratio(x - window[0], w), ratio(window[3] - y, h), ratio(a[2] - a[0], w), ratio(a[3] - a[1], h)


def unit_to_pixel(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Box:
    """Shares of an image to corner pixels."""
    return (x - w / 2) * width, (y - h / 2) * height, (x + w / 2) * width, (y + h / 2) * height


def clip_unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def clip_label(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A label line's centre and size cut to the image, as a struct; null where nothing of it is left."""
    x0, y0, x1, y1 = (clip_unit(c) for c in unit_to_pixel(x, y, w, h, 1.0, 1.0))
    cut = F.struct(((x0 + x1) / 2).alias("x_center"), ((y0 + y1) / 2).alias("y_center"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    return F.when((x1 > x0) & (y1 > y0), cut)


def clip(a: Box, window: Box) -> Box:
    return F.greatest(a[0], window[0]), F.greatest(a[1], window[1]), F.least(a[2], window[2]), F.least(a[3], window[3])


def window_bounds(row: Column, col: Column, size: Column | int, left: float, top: float, resolution: float) -> Box:
    """Map bounds of a raster window from its first row and column."""
    n = size if isinstance(size, Column) else F.lit(size)
    r = F.lit(float(resolution))
    return F.lit(float(left)) + col * r, F.lit(float(top)) - (row + n) * r, F.lit(float(left)) + (col + n) * r, F.lit(float(top)) - row * r


def starts(first: Column, end: Column, size: int, step: int) -> Column:
    """First pixels of windows along an axis: every step, and one flush with the end; none where the axis is too short."""
    last = end - size
    regular = F.sequence(first, F.greatest(last, first), F.lit(step).cast("bigint"))
    return F.when(last >= first, F.array_distinct(F.concat(regular, F.array(last)))).otherwise(F.array().cast("array<bigint>"))


def columns_of(low: Column, high: Column, left: float, resolution: float, width: int) -> tuple[Column, Column]:
    """First and end column of a raster that a range of map x takes."""
    first = F.greatest(F.lit(0), F.floor((low - left) / resolution)).cast("bigint")
    return first, F.least(F.lit(width), F.ceil((high - left) / resolution)).cast("bigint")


def pixel_centre(col: Column, left: float, resolution: float) -> Column:
    return F.lit(float(left)) + (col + 0.5) * resolution


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def null_nan(c: Column) -> Column:
    """NaN as null, at the boundary to data that mark what is missing by NaN."""
    return F.when(~F.isnan(c), c)
