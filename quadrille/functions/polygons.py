"""Polygons in well-known binary: area, centroid and the area inside a box, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.sources.files import rings

Ring = list[tuple[float, float]]


def shoelace(ring: Ring) -> float:
    """Signed area of a ring, closed or not."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def ring_area(all_rings: list[Ring]) -> float:
    """Area of rings whose holes turn the other way than the ring around them, whichever way that is."""
    areas = [shoelace(r) for r in all_rings]
    return abs(sum(areas)) if areas else 0.0


def clipped(ring: Ring, box: tuple[float, float, float, float]) -> Ring:
    """A ring cut at the four edges of a box in turn; its area is exact, also where the ring is concave."""
    x0, y0, x1, y1 = box
    for axis, bound, keep_low in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        inside = lambda p: p[axis] <= bound if keep_low else p[axis] >= bound  # noqa: B023, E731
        out: Ring = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if inside(a):
                out.append(a)
            if inside(a) != inside(b):
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                out.append((bound, cut[1]) if axis == 0 else (cut[0], bound))
        ring = out
    return ring


@F.pandas_udf(T.DoubleType())
def polygon_area(wkb: pd.Series) -> pd.Series:
    return wkb.map(lambda b: None if b is None else ring_area(rings(bytes(b))))


@F.pandas_udf(T.DoubleType())
def area_inside(wkb: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Area of a polygon inside a box."""
    rows = zip(wkb, x0, y0, x1, y1, strict=True)
    return pd.Series([None if b is None else ring_area([clipped(r, box) for r in rings(bytes(b))]) for b, *box in rows], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def centroid(wkb: pd.Series) -> pd.DataFrame:
    """Centre of a polygon's area."""

    def of(b) -> tuple[float | None, float | None]:
        if b is None:
            return None, None
        sx = sy = sa = 0.0
        for ring in rings(bytes(b)):
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                w = p[0] * q[1] - q[0] * p[1]
                sx, sy, sa = sx + (p[0] + q[0]) * w, sy + (p[1] + q[1]) * w, sa + w
        return (sx / (3 * sa), sy / (3 * sa)) if sa else (None, None)

    return pd.DataFrame([of(b) for b in wkb], columns=["x", "y"])


Edge = tuple[float, float, float, float]


def edges_of(all_rings: list[Ring]) -> list[Edge]:
    """Edges of rings from left to right; vertical ones bound no area between two x and are left out."""
    out = []
    for ring in all_rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ax != bx:
                out.append((ax, ay, bx, by) if ax < bx else (bx, by, ax, ay))
    return out


def height(edge: Edge, x: float) -> float:
    return edge[1] + (edge[3] - edge[1]) * (x - edge[0]) / (edge[2] - edge[0])


def crossing(a: Edge, b: Edge) -> float | None:
    """The x at which two edges cross inside both."""
    low, high = max(a[0], b[0]), min(a[2], b[2])
    if low >= high:
        return None
    left, right = height(a, low) - height(b, low), height(a, high) - height(b, high)
    return low + (high - low) * left / (left - right) if left * right < 0 else None


def common_area(a: list[Ring], b: list[Ring]) -> float:
    """The area two polygons share, holes and all, by even-odd rule.

    Between two neighbouring x at which an edge ends or two edges cross, edges do not cross, so each piece between two
    of them is a trapezoid, which counts if it is inside both.
    """
    ea, eb = edges_of(a), edges_of(b)
    every = [(e, 0) for e in ea] + [(e, 1) for e in eb]
    cuts = {x for e, _ in every for x in (e[0], e[2])}
    for i, (e, _) in enumerate(every):
        cuts |= {x for f, _ in every[:i] if (x := crossing(e, f)) is not None}
    total, xs = 0.0, sorted(cuts)
    for left, right in zip(xs, xs[1:], strict=False):
        middle = (left + right) / 2
        inside, below = [False, False], None
        for y, side in sorted((height(e, middle), side) for e, side in every if e[0] <= left and right <= e[2]):
            if inside[0] and inside[1]:
                total += (y - below) * (right - left)
            inside[side], below = not inside[side], y
    return total


def fault(all_rings: list[Ring]) -> str | None:
    """Why a polygon is not valid: empty, a ring of under three corners, no area, or edges that cross; None if it is."""
    if not all_rings:
        return "empty"
    for ring in all_rings:
        corners = ring[:-1] if ring[0] == ring[-1] else ring
        if len(set(corners)) < 3:
            return "too few corners"
        if shoelace(ring) == 0:
            return "no area"
    edges = edges_of(all_rings)
    if any(crossing(e, f) is not None for i, e in enumerate(edges) for f in edges[:i]):
        return "edges cross"
    return None


@F.pandas_udf(T.DoubleType())
def shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """The area that two polygons share."""
    return pd.Series([None if p is None or q is None else common_area(rings(bytes(p)), rings(bytes(q))) for p, q in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def polygon_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shared area over that of the union; 0.0 where neither has any."""

    def of(p, q) -> float | None:
        if p is None or q is None:
            return None
        p, q = rings(bytes(p)), rings(bytes(q))
        both = common_area(p, q)
        union = common_area(p, p) + common_area(q, q) - both
        return both / union if union else 0.0

    return pd.Series([of(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def polygon_fault(wkb: pd.Series) -> pd.Series:
    """See fault(); null is empty."""
    return wkb.map(lambda b: "empty" if b is None else fault(rings(bytes(b))))
