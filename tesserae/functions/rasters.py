"""Helpers of tasks that work on many tiles or rings at once: filling, connected parts, tissue, hulls and simplification."""

from __future__ import annotations

import numpy as np

from .polygons import _cross, _next


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... of counts[k] places for each k."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def fill_rings(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (ring, y, first x, last x) of whole pixels whose centres lie inside or on the border of padded rings, whose coordinates are
    cut to whole numbers: one table of edges, crossings in order of (ring, y), runs by their parity. Runs of a ring may overlap."""
    p = np.trunc(p)
    ring, k = np.nonzero((np.arange(p.shape[1])[None, :] < n[:, None]) & (n[:, None] > 2))
    a, b = p[ring, k], _next(p, n)[ring, k]
    flat = a[:, 1] == b[:, 1]
    low, high = np.minimum(a[:, 1], b[:, 1]).astype(np.int64), np.maximum(a[:, 1], b[:, 1]).astype(np.int64)
    rows = high - low
    edge = np.repeat(np.arange(len(a)), rows)
    y = spread(low, rows)
    (ax, ay), (bx, by) = a[edge].T, b[edge].T
    x = ax + (y - ay) * (bx - ax) / (by - ay)
    order = np.lexsort((x, y, ring[edge]))
    x, owner, y = x[order], ring[edge][order], y[order]
    first, last = np.ceil(x[::2] - 1e-9).astype(np.int64), np.floor(x[1::2] + 1e-9).astype(np.int64)
    sides = np.stack([a[flat, 0], b[flat, 0]])
    out = [np.concatenate(v) for v in ((owner[::2], ring[flat]), (y[::2], low[flat]), (first, sides.min(0).astype(np.int64)), (last, sides.max(0).astype(np.int64)))]
    kept = out[2] <= out[3]
    return tuple(v[kept] for v in out)


def label_tiles(masks: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Labels 1 to n of the connected parts of each of many masks (tiles x rows x columns), in row order of their first pixels.

    Neighbouring pixels of all tiles are one list of links; each round hangs the greater of two roots under the lesser, and
    follows parents to their ends."""
    place = np.cumsum(masks.ravel()).reshape(masks.shape) - 1
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    links = []
    h, w = masks.shape[1:]
    for dy, dx in steps:
        here, there = (slice(None), slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))), (slice(None), slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = masks[here] & masks[there]
        links.append(np.stack([place[here][both], place[there][both]], 1))
    u, v = np.concatenate(links).T
    parent = np.arange(int(masks.sum()))
    while len(u):
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    # A root is its part's first pixel; roots are numbered within each tile.
    tile = np.nonzero(masks)[0]
    root = parent == np.arange(len(parent))
    number = np.cumsum(root)
    ahead = np.concatenate([[0], np.cumsum(np.bincount(tile[root], minlength=len(masks)))])[:-1]
    labels = np.zeros(masks.shape, np.int64)
    labels[masks] = number[parent] - ahead[tile]
    return labels


# Weights of a blur over seven pixels, in 256ths.
BLUR = (8, 28, 56, 72, 56, 28, 8)
# Red, green and blue in grey, in 16,384ths.
GREY = (4899, 9617, 1868)


def blurred(images: np.ndarray) -> np.ndarray:
    """Images (tiles x rows x columns, whole numbers) blurred along both axes with reflected borders, rounded."""
    half = len(BLUR) // 2
    for axis in (1, 2):
        padded = np.pad(images, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        images = sum(w * np.take(padded, range(i, i + images.shape[axis]), axis) for i, w in enumerate(BLUR))
    return (images + (1 << 15)) >> 16


def grey(images: np.ndarray) -> np.ndarray:
    """Tiles x channels x rows x columns as tiles x rows x columns: three channels are weighted as colours, else the first is taken."""
    if images.shape[1] != 3:
        return images[:, 0]
    return (sum(w * images[:, c] for c, w in enumerate(GREY)) + (1 << 13)) >> 14


# Hulls


def lower_chains(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of points, their number) of the lower hull of each of many rows of points, padded and in order of (x, y): the monotone chain, a
    point of all rows at a time."""
    rows = np.arange(len(p))
    stack, size = np.zeros(p.shape[:2], np.int64), np.zeros(len(p), np.int64)
    for i in range(p.shape[1]):
        live = i < n
        while True:
            pop = live & (size > 1)
            a, b = p[rows, stack[rows, size - 2]], p[rows, stack[rows, size - 1]]
            pop &= _cross(b - a, p[:, i] - a) <= 0
            if not pop.any():
                break
            size[pop] -= 1
        stack[rows[live], size[live]] = i
        size[live] += 1
    return stack, size


def hull_areas(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas of the convex hulls of padded rings."""
    valid = np.arange(p.shape[1])[None, :] < n[:, None]
    base = np.where(valid[:, :1], p[:, 0], 0)
    q = np.where(valid[:, :, None], p - base[:, None], np.inf)
    order = np.lexsort((q[..., 1], q[..., 0]), axis=1)
    q = np.take_along_axis(q, order[:, :, None], 1)
    q[~valid] = 0
    total = np.zeros(len(p))
    for sign in (1, -1):
        side = q * [1, sign]
        stack, size = lower_chains(side, n)
        c = np.take_along_axis(side, stack[:, :, None], 1)
        step = (c[:, 1:, 0] - c[:, :-1, 0]) * (c[:, 1:, 1] + c[:, :-1, 1]) / 2
        total -= (step * (np.arange(1, p.shape[1])[None, :] < size[:, None])).sum(1)
    return np.maximum(total, 0)


def hull_rows(y: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (region, y, first x, last x) of the pixels whose centres lie in the convex hull of a region's pixels, which are given as
    padded rows: y ascending, with the least and the greatest x of each."""
    out = []
    for x, sign in ((low, 1), (high, -1)):
        stack, size = lower_chains(np.stack([y, sign * x], 2).astype(float), n)
        region, k = np.nonzero(np.arange(y.shape[1])[None, :] < size[:, None])
        at = stack[region, k]
        last = k + 1 == size[region]
        after = stack[region, np.minimum(k + 1, y.shape[1] - 1)]
        y0, x0 = y[region, at], x[region, at]
        y1, x1 = np.where(last, y0 + 1, y[region, after]), np.where(last, x0, x[region, after])
        rows = y1 - y0
        which = np.repeat(np.arange(len(region)), rows)
        ys = spread(y0, rows)
        value = x0[which] + (ys - y0[which]) * (x1 - x0)[which] / rows[which]
        out.append((region[which], ys, np.ceil(value - 1e-9) if sign > 0 else np.floor(value + 1e-9)))
    (region, ys, first), (_, _, last) = out
    first, last = first.astype(np.int64), last.astype(np.int64)
    kept = first <= last
    return region[kept], ys[kept], first[kept], last[kept]


# Simplification


def simplified_rings(p: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    """Which points of padded rings stay (Douglas-Peucker), for rings of four points or more; others stay whole. A ring is split at its
    first point and the one farthest from it; each round splits all open stretches of all rings at once."""
    kept = np.arange(p.shape[1])[None, :] < n[:, None]
    rows = np.flatnonzero(n > 3)
    if not len(rows):
        return kept
    count = n[rows]
    # All rings behind each other, each closed by its first point.
    begin = np.cumsum(count + 1) - (count + 1)
    at = spread(np.zeros(len(rows), np.int64), count)
    flat = np.zeros((int((count + 1).sum()), 2))
    place = np.repeat(begin, count) + at
    flat[place] = p[np.repeat(rows, count), at]
    flat[begin + count] = flat[begin]
    away = ((flat - np.repeat(flat[begin], count + 1, 0)) ** 2).sum(1)
    far = _first_of_greatest(away, begin)[0]
    keep = np.zeros(len(flat), bool)
    keep[begin] = keep[far] = True
    left, right = np.concatenate([begin, far]), np.concatenate([far, begin + count])
    while True:
        inner = right - left - 1
        left, right, inner = left[inner > 0], right[inner > 0], inner[inner > 0]
        if not len(left):
            break
        k = spread(left + 1, inner)
        a, line = np.repeat(flat[left], inner, 0), np.repeat(flat[right] - flat[left], inner, 0)
        length = np.hypot(line[:, 0], line[:, 1])
        off = flat[k] - a
        gap = np.where(length > 0, np.abs(_cross(line, off)) / np.where(length > 0, length, 1), np.hypot(off[:, 0], off[:, 1]))
        start = np.cumsum(inner) - inner
        top, most = _first_of_greatest(gap, start)
        split = most > eps
        mid = k[top[split]]
        keep[mid] = True
        left, right = np.concatenate([left[split], mid]), np.concatenate([mid, right[split]])
    kept[rows] = False
    kept[np.repeat(rows, count), at] = keep[place]
    return kept


def _first_of_greatest(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first greatest value of each stretch, and the value."""
    most = np.maximum.reduceat(values, starts)
    hits = np.flatnonzero(values == np.repeat(most, np.diff(np.append(starts, len(values)))))
    return hits[np.searchsorted(hits, starts)], most
