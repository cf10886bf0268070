"""Column expressions over rings (arrays of points x, y) and boxes (xmin, ymin, xmax, ymax)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def closed(ring: Column) -> Column:
    """The ring with its first point at the end too."""
    open_ = (F.element_at(ring, 1)["x"] != F.element_at(ring, -1)["x"]) | (F.element_at(ring, 1)["y"] != F.element_at(ring, -1)["y"])
    return F.when((F.size(ring) > 0) & open_, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def segments(ring: Column) -> Column:
    """Successive pairs (a, b) of the closed ring."""
    c = closed(ring)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, s: acc + of(s))


def area(ring: Column) -> Column:
    """Shoelace area, always positive."""
    return F.abs(_sum(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def perimeter(ring: Column) -> Column:
    return _sum(segments(ring), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def circularity(ring: Column) -> Column:
    p = perimeter(ring)
    return F.when(p > 0, 4 * math.pi * area(ring) / (p * p)).otherwise(F.lit(0.0))


def vertex_mean(ring: Column, axis: str) -> Column:
    """Mean of the ring's points as given, a closing point included."""
    return _sum(ring, lambda p: p[axis]) / F.size(ring)


def eccentricity(ring: Column) -> Column:
    """From the second moments of the vertices (not a fitted ellipse); null below five points."""
    mx, my = vertex_mean(ring, "x"), vertex_mean(ring, "y")
    n = F.size(ring)
    xx = _sum(F.transform(ring, lambda p: p["x"] * p["x"]), lambda v: v) / n - mx * mx
    yy = _sum(F.transform(ring, lambda p: p["y"] * p["y"]), lambda v: v) / n - my * my
    xy = _sum(F.transform(ring, lambda p: p["x"] * p["y"]), lambda v: v) / n - mx * my
    half, spread = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return F.when((n >= 5) & (half + spread > 0), F.sqrt(F.greatest(F.lit(0.0), 1 - (half - spread) / (half + spread))))


def box_ring(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> Column:
    """The box as a closed ring of five points."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in (xmin, ymin, xmax, ymax))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))


def rounded_ring(ring: Column, digits: int) -> Column:
    """Half-even rounding of every coordinate."""
    return F.transform(ring, lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def translated(ring: Column, dx, dy) -> Column:
    """dx and dy are taken off every point."""
    return F.transform(ring, lambda p: point(p["x"] - dx, p["y"] - dy))


def scaled(ring: Column, factor) -> Column:
    return F.transform(ring, lambda p: point(p["x"] * factor, p["y"] * factor))


def any_vertex_in(ring: Column, x0, x1, y0, y1) -> Column:
    return F.exists(ring, lambda p: (p["x"] >= x0) & (p["x"] < x1) & (p["y"] >= y0) & (p["y"] < y1))


def thinned(ring: Column, tolerance: float) -> Column:
    """Without points that lie within tolerance of the last kept one; the ring itself if fewer than four remain."""
    far = lambda a, p: F.hypot(p["x"] - a["x"], p["y"] - a["y"]) > tolerance
    kept = F.aggregate(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1), lambda acc, p: F.when(far(F.element_at(acc, -1), p), F.concat(acc, F.array(p))).otherwise(acc))
    return F.when(F.size(kept) >= 4, kept).otherwise(ring)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test; points on the border do not count reliably and should be avoided."""
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.aggregate(segments(ring), F.lit(False), lambda acc, s: F.when(s["a"]["y"] == s["b"]["y"], acc).otherwise(acc != crosses(s)))


def box_intersection(a: str = "a", b: str = "b") -> Column:
    """Area shared by the boxes of two structs; 0 if they only touch."""
    w = F.least(F.col(f"{a}.xmax"), F.col(f"{b}.xmax")) - F.greatest(F.col(f"{a}.xmin"), F.col(f"{b}.xmin"))
    h = F.least(F.col(f"{a}.ymax"), F.col(f"{b}.ymax")) - F.greatest(F.col(f"{a}.ymin"), F.col(f"{b}.ymin"))
    return (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")


def box_area(a: str) -> Column:
    return ((F.col(f"{a}.xmax") - F.col(f"{a}.xmin")) * (F.col(f"{a}.ymax") - F.col(f"{a}.ymin"))).cast("double")


def box_iou(a: str = "a", b: str = "b") -> Column:
    i = box_intersection(a, b)
    union = box_area(a) + box_area(b) - i
    return F.when(union > 0, i / union).otherwise(F.lit(0.0))


def deaugmented(ring: Column, view: str, width: int, height: int) -> Column:
    """A ring found on a flipped view, back on the upright image; view: none, h or v."""
    if view == "h":
        return F.transform(ring, lambda p: point(F.lit(width - 1) - p["x"], p["y"]))
    if view == "v":
        return F.transform(ring, lambda p: point(p["x"], F.lit(height - 1) - p["y"]))
    return ring


# Polygons with parts and holes: an array of parts, each an array of rings, the outer one first.


def part_area(part: Column) -> Column:
    """The outer ring's area without the holes'."""
    return 2 * area(part[0]) - _sum(F.transform(part, area), lambda a: a)


def parts_area(parts: Column) -> Column:
    return _sum(F.transform(parts, part_area), lambda a: a)


def largest_part(parts: Column) -> Column:
    """Place and area of the largest part, the first of equals; null without parts."""
    best = F.array_max(F.transform(parts, lambda p, k: F.struct(part_area(p).alias("area"), (-k).alias("k"))))
    return F.when(best.isNotNull(), F.struct((-best["k"]).alias("part_idx"), best["area"].alias("area")))


def parts_contain(parts: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings of a part: a point in a hole is outside."""
    return F.exists(parts, lambda part: F.aggregate(part, F.lit(False), lambda acc, ring: acc != contains(ring, x, y)))


def any_part_vertex_in(parts: Column, x0, x1, y0, y1) -> Column:
    """Whether a vertex of any ring of any part lies in the window."""
    return F.exists(parts, lambda part: F.exists(part, lambda ring: any_vertex_in(ring, x0, x1, y0, y1)))


def translated_parts(parts: Column, dx, dy) -> Column:
    return F.transform(parts, lambda part: F.transform(part, lambda ring: translated(ring, dx, dy)))
