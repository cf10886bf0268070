"""Helpers of tasks that work on many rings as numpy arrays: areas, clipping, tests for crossings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def padded_rings(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rings x points x 2, number of points) of a list column of points, without closing points; what is beyond the number
    repeats the last point. Null and empty rings have no points."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    count = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], 1) if len(flat) else np.zeros((0, 2))
    start = np.cumsum(count) - count
    many = count > 1
    last, first = xy[(start + count - 1)[many]], xy[start[many]]
    count[many] -= (last == first).all(1)
    if not len(xy):
        return np.zeros((len(count), 1, 2)), count
    at = start[:, None] + np.minimum(np.arange(max(1, int(count.max(initial=1)))), np.maximum(count - 1, 0)[:, None])
    return xy[np.minimum(at, len(xy) - 1)], count


def _next(p: np.ndarray, n: np.ndarray, step: int = 1) -> np.ndarray:
    """The point after (or before) each of a ring's points."""
    k = np.arange(p.shape[1])[None, :]
    to = np.where(k < n[:, None], (k + step) % np.maximum(n, 1)[:, None], k)
    return np.take_along_axis(p, to[:, :, None], 1)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def signed_areas(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of padded rings; measured from each ring's first point, so that far-away rings lose no digits."""
    q = p - p[:, :1]
    valid = np.arange(p.shape[1])[None, :] < n[:, None]
    return (_cross(q, _next(q, n)) * valid).sum(1) / 2


def turned(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rings counter-clockwise."""
    k = np.arange(p.shape[1])[None, :]
    back = np.where(k < n[:, None], n[:, None] - 1 - k, k)
    return np.where((signed_areas(p, n) < 0)[:, None, None], np.take_along_axis(p, back[:, :, None], 1), p)


def are_convex(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of simple counter-clockwise rings: no turn to the right."""
    valid = np.arange(p.shape[1])[None, :] < n[:, None]
    after = _next(p, n)
    return ((_cross(after - p, _next(after, n) - after) >= 0) | ~valid).all(1)


def clip_convex(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex counter-clockwise rings p cut down to the rings q, row by row, all rows at once (Sutherland-Hodgman).

    A crossing is one quotient of products, so it is exact where coordinates are integers and it is one.
    """
    rows = np.arange(len(p))
    for e in range(q.shape[1]):
        a, b = q[:, e], q[rows, (e + 1) % np.maximum(m, 1)]
        used = e < m
        valid = np.arange(p.shape[1])[None, :] < n[:, None]
        side = _cross((b - a)[:, None], p - a[:, None])
        side[~used] = 1
        before, other = _next(p, n, -1), _next(side[:, :, None], n, -1)[:, :, 0]
        inside = (side >= 0) & valid
        crossed = valid & ((side >= 0) != (other >= 0))
        part = np.where(crossed, side - other, 1.0)
        cut = (before * side[:, :, None] - p * other[:, :, None]) / part[:, :, None]
        points = np.stack([cut, p], 2).reshape(len(p), -1, 2)
        kept = np.stack([crossed, inside], 2).reshape(len(p), -1)
        n = kept.sum(1)
        new = np.zeros((len(p), max(1, int(n.max(initial=0))), 2))
        row, at = np.nonzero(kept)
        new[row, (np.cumsum(kept, 1) - 1)[row, at]] = points[row, at]
        p = new
    return p, n


def intersection_areas(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared areas of simple rings, row by row. Convex rings are clipped as they are; others fall into signed triangles
    from their first point. Coordinates are taken from a corner near by."""
    out = np.zeros(len(p))
    live = (n > 2) & (m > 2)
    if not live.any():
        return out
    p, n, q, m = p[live], n[live], q[live], m[live]
    corner = np.floor(np.minimum(p.min(1), q.min(1)))[:, None]
    p, q = turned(p - corner, n), turned(q - corner, m)
    convex = are_convex(p, n) & are_convex(q, m)
    area = np.zeros(len(p))
    if convex.any():
        area[convex] = np.abs(signed_areas(*clip_convex(p[convex], n[convex], q[convex], m[convex])))
    rest = np.flatnonzero(~convex)
    for i in range(1, p.shape[1] - 1):
        for j in range(1, q.shape[1] - 1):
            some = rest[(n[rest] > i + 1) & (m[rest] > j + 1)]
            if len(some):
                s, t, three = p[some][:, [0, i, i + 1]], q[some][:, [0, j, j + 1]], np.full(len(some), 3)
                sign = np.sign(signed_areas(s, three)) * np.sign(signed_areas(t, three))
                area[some] += sign * np.abs(signed_areas(*clip_convex(turned(s, three), three, turned(t, three), three)))
    out[live] = np.abs(area)
    return out


def are_simple(p: np.ndarray, n: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Of padded rings: the ring does not cross itself, within edges, at a point or along a stretch, and has an area above
    zero. It may touch itself. Rings of one length are tested together."""
    area = signed_areas(p, n)
    out = (n > 2) & (area != 0)
    for size in np.unique(n[out]).tolist():
        rows = np.flatnonzero(out & (n == size))
        step = max(1, at_once // (size * size))
        k = np.arange(size)
        other = (k[:, None] != k) & ((k[:, None] + 1) % size != k)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a = p[part, :size]
            b = np.roll(a, -1, 1)
            # The side of each point on the line of each edge; an edge's own ends are on it.
            side = np.sign(_cross((b - a)[:, :, None], a[:, None] - a[:, :, None]))
            parted = side * np.roll(side, -1, 2) < 0
            out[part] = ~(parted & parted.transpose(0, 2, 1)).any((1, 2))
            lo, hi = np.minimum(a, b)[:, :, None], np.maximum(a, b)[:, :, None]
            touch = other & (side == 0) & ((a[:, None] >= lo) & (a[:, None] <= hi)).all(3)
            some = np.flatnonzero(out[part] & touch.any((1, 2)))
            less = max(1, step // 9)
            for first in range(0, len(some), less):
                these = some[first : first + less]
                out[part[these]] = _wind_once(a[these], touch[these], np.sign(area[part[these]]))
    return out


def _wind_once(a: np.ndarray, touch: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Of rings none of whose edges cross within both: every place that is not on the ring is wound around once, by the turn of
    the ring's area, or not at all. touch: by ring, edge and point. A crossing at a point, or along a stretch that is passed
    twice, leaves places on its sides that are wound around otherwise."""
    rings, size = a.shape[:2]
    b = np.roll(a, -1, 1)
    # Edges are cut at the points that they touch, so that two of them share all, an end or nothing.
    r, e, k = np.nonzero(touch)
    along = ((a[r, k] - a[r, e]) * (b - a)[r, e]).sum(1)
    ring = np.concatenate([np.repeat(np.arange(rings), size), r])
    edge = np.concatenate([np.tile(np.arange(size), rings), e])
    points = np.concatenate([a.reshape(-1, 2), a[r, k]]) + 0.0
    order = np.lexsort((np.concatenate([np.zeros(rings * size), along]), edge, ring))
    ring, points = ring[order], points[order]
    first = np.searchsorted(ring, np.arange(rings + 1))
    after = np.arange(1, len(ring) + 1)
    after[first[1:] - 1] = first[:-1]
    ends = points[after]
    # Each edge once, upwards (level ones to the right), with how often it is passed that way and not the other.
    up = (points[:, 1] < ends[:, 1]) | ((points[:, 1] == ends[:, 1]) & (points[:, 0] < ends[:, 0]))
    real = (points != ends).any(1)
    rows = np.concatenate([ring[:, None], np.where(up[:, None], points, ends), np.where(up[:, None], ends, points)], 1)[real]
    rows, where = np.unique(rows, axis=0, return_inverse=True)
    net = np.bincount(where.ravel(), np.where(up[real], 1, -1), len(rows))
    rows, net = rows[net != 0], net[net != 0]
    ring = rows[:, 0].astype(int)
    count = np.bincount(ring, minlength=rings)
    at = np.arange(len(ring)) - (np.cumsum(count) - count)[ring]
    most = max(1, int(count.max(initial=0)))
    (c, d), times = np.zeros((2, rings, most, 2)), np.zeros((rings, most))
    c[ring, at], d[ring, at], times[ring, at] = rows[:, 1:3], rows[:, 3:], net
    # What is to the right of an edge's middle (above a level one) counts the edges that a ray to the right meets.
    middle = (c + d)[:, :, None]
    met = (2 * c[:, None, :, 1] <= middle[..., 1]) & (middle[..., 1] < 2 * d[:, None, :, 1]) & (_cross((d - c)[:, None], middle - 2 * c[:, None]) > 0)
    met &= ~np.eye(most, dtype=bool)
    here = (met * times[:, None]).sum(2)
    beside = here + np.where(c[:, :, 1] == d[:, :, 1], -times, times)
    good = lambda w: (w == 0) | (w == turn[:, None])
    return ((good(here) & good(beside)) | (times == 0)).all(1)


def is_simple(p: np.ndarray) -> bool:
    return bool(are_simple(p[None], np.array([len(p)]))[0]) if len(p) else False
