"""Planar geometry over rings held as `array<struct<x, y>>` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371008.8


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs; the ring repeats its first vertex at the end."""
    return F.transform(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: F.struct(
            F.element_at(ring, i)["x"].alias("x1"), F.element_at(ring, i)["y"].alias("y1"),
            F.element_at(ring, i + 1)["x"].alias("x2"), F.element_at(ring, i + 1)["y"].alias("y2"),
        ),
    )


def row_crossings(ring: Column, y: Column) -> Column:
    """Sorted x positions where the ring crosses the horizontal line at `y`."""
    straddles = lambda e: (e["y1"] > y) != (e["y2"] > y)
    position = lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    return F.array_sort(F.transform(F.filter(ring_edges(ring), straddles), position))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring."""
    right_of = F.filter(row_crossings(ring, y), lambda c: c > x)
    return F.size(right_of) % 2 == 1


def covered_area(ring: Column, x: Column, y: Column, half: float) -> Column:
    """Area that a ring shares with the axis-parallel square of half-width `half` around (x, y).

    Every edge adds the signed area below it, cut off at the sides, the floor and the ceiling of the square; what does
    not lie inside the ring cancels out. Rings may be concave and turn either way.
    """
    left, low, high = x - F.lit(half), y - F.lit(half), y + F.lit(half)
    side = 2.0 * half

    def primitive(t: Column) -> Column:
        # Integral of the height above the floor, which stops growing at the ceiling.
        up = F.least(F.greatest(t - low, F.lit(0.0)), F.lit(side))
        return up * up / 2.0 + F.greatest(t - high, F.lit(0.0)) * side

    def under(e: Column) -> Column:
        cut = lambda v: F.least(F.greatest(v, left), left + side)
        xa, xb = cut(e["x1"].cast("double")), cut(e["x2"].cast("double"))
        slope = (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        ya, yb = e["y1"] + (xa - e["x1"]) * slope, e["y1"] + (xb - e["x1"]) * slope
        middle = F.least(F.greatest((ya + yb) / 2.0 - low, F.lit(0.0)), F.lit(side))
        height = F.when(F.abs(yb - ya) > 1e-9 * side, (primitive(yb) - primitive(ya)) / (yb - ya)).otherwise(middle)
        return F.when(xa == xb, 0.0).otherwise((xb - xa) * height)

    return F.abs(F.aggregate(ring_edges(ring), F.lit(0.0), lambda total, e: total + under(e)))


def covered_share(ring: Column, x: Column, y: Column, size: float) -> Column:
    """Share of the pixel of width `size` around (x, y) that lies inside the ring, 0 to 1."""
    return F.least(covered_area(ring, x, y, size / 2.0) / F.lit(size * size), F.lit(1.0))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a: Column, b: Column) -> Column:
    """True if two edges cross or touch."""

    def beside(e: Column, px: Column, py: Column) -> Column:
        within = lambda v, s, t: v.between(F.least(s, t), F.greatest(s, t))
        return within(px, e["x1"], e["x2"]) & within(py, e["y1"], e["y2"])

    side = lambda e, px, py: _turn(e["x1"], e["y1"], e["x2"], e["y2"], px, py)
    a1, a2 = side(b, a["x1"], a["y1"]), side(b, a["x2"], a["y2"])
    b1, b2 = side(a, b["x1"], b["y1"]), side(a, b["x2"], b["y2"])
    return (
        ((a1 * a2 < 0) & (b1 * b2 < 0))
        | ((a1 == 0) & beside(b, a["x1"], a["y1"]))
        | ((a2 == 0) & beside(b, a["x2"], a["y2"]))
        | ((b1 == 0) & beside(a, b["x1"], b["y1"]))
        | ((b2 == 0) & beside(a, b["x2"], b["y2"]))
    )


def rings_meet(a: Column, b: Column) -> Column:
    """True if two polygons share a point: an edge meets an edge, or one holds the other."""
    crossing = F.exists(ring_edges(a), lambda e: F.exists(ring_edges(b), lambda f: segments_meet(e, f)))
    first = lambda r: F.element_at(r, 1)
    return crossing | contains(a, first(b)["x"], first(b)["y"]) | contains(b, first(a)["x"], first(a)["y"])


def inside_box(x: Column, y: Column, prefix: str = "") -> Column:
    return x.between(F.col(f"{prefix}minx"), F.col(f"{prefix}maxx")) & y.between(
        F.col(f"{prefix}miny"), F.col(f"{prefix}maxy")
    )


def boxes_overlap(a: str, b: str) -> Column:
    """Overlap of two bounding boxes whose columns carry the prefixes `a` and `b`."""
    return (
        (F.col(f"{a}minx") <= F.col(f"{b}maxx"))
        & (F.col(f"{a}maxx") >= F.col(f"{b}minx"))
        & (F.col(f"{a}miny") <= F.col(f"{b}maxy"))
        & (F.col(f"{a}maxy") >= F.col(f"{b}miny"))
    )


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {
        "minx": F.array_min(xs), "miny": F.array_min(ys),
        "maxx": F.array_max(xs), "maxy": F.array_max(ys),
    }


def _edge_sum(ring: Column, term) -> Column:
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + term(e))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid by the shoelace sums."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    doubled = _edge_sum(ring, cross)
    cx = _edge_sum(ring, lambda e: (e["x1"] + e["x2"]) * cross(e))
    cy = _edge_sum(ring, lambda e: (e["y1"] + e["y2"]) * cross(e))
    return F.try_divide(cx, 3.0 * doubled), F.try_divide(cy, 3.0 * doubled)


def within_planar(x1: Column, y1: Column, x2: Column, y2: Column, radius: float) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy <= radius * radius


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between two lon/lat points in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M)


def hectares(area_m2: Column) -> Column:
    return area_m2 / F.lit(10000.0)
