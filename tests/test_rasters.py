"""Work on many rings and tiles at once against plain Python."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import rasters
from tesserae.operators import scores, tiles


def padded(rings):
    n = np.array([len(r) for r in rings])
    p = np.zeros((len(rings), max(n), 2))
    for k, r in enumerate(rings):
        p[k, : len(r)] = r
        p[k, len(r) :] = r[-1]
    return p, n


def random_rings(seed, count=60, size=12):
    r = random.Random(seed)
    return [[(r.randint(-size, size), r.randint(-size, size)) for _ in range(r.randint(1, 9))] for _ in range(count)]


def plain_fill(ring):
    """Pixels between crossings of an odd and the next even number on each line, and on level edges."""
    out = set()
    for y in range(-20, 21):
        xs = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if min(y1, y2) <= y < max(y1, y2))
        for a, b in zip(xs[::2], xs[1::2]):
            out |= {(y, x) for x in range(-20, 21) if a - 1e-9 <= x <= b + 1e-9}
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 == y2 == y:
                out |= {(y, x) for x in range(min(x1, x2), max(x1, x2) + 1)}
    return out


def test_filled_rings():
    rings = random_rings(1)
    found = [set() for _ in rings]
    for k, y, a, b in zip(*(v.tolist() for v in rasters.fill_rings(*padded(rings))), strict=True):
        found[k] |= {(y, x) for x in range(a, b + 1)}
    assert found == [plain_fill(r) if len(r) > 2 else set() for r in rings]


def plain_labels(m, connectivity):
    out = np.zeros(m.shape, int)
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    for y, x in itertools.product(*map(range, m.shape)):
        if m[y, x] and not out[y, x]:
            label, todo = out.max() + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not out[a, b]:
                    out[a, b] = label
                    todo += [(a + i, b + j) for i, j in near]
    return out


@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_labels_of_many_tiles(h, w, count, rng):
    masks = np.array([[[rng.random() < 0.55 for _ in range(w)] for _ in range(h)] for _ in range(count)])
    for c in (4, 8):
        assert (rasters.label_tiles(masks, c) == np.stack([plain_labels(m, c) for m in masks])).all()


def plain_hull(points):
    """Andrew's chain, one point after the other."""
    def half(pts):
        out = []
        for q in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    pts = sorted(set(points))
    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if len(pts) > 2 else 0.0


def test_hull_areas():
    rings = random_rings(2, 200)
    assert rasters.hull_areas(*padded(rings)).tolist() == [plain_hull(r) for r in rings]


def test_hulls_of_pixels(spark):
    r = random.Random(4)
    regions = {k: {(r.randint(0, 15), r.randint(0, 15)) for _ in range(r.randint(1, 12))} for k in range(40)}
    rows = [(k, y, x) for k, s in regions.items() for y, x in s]
    got = {}
    for p in tiles.hull_pixels(spark.createDataFrame(rows, "k long, y long, x long"), ["k"]).collect():
        got.setdefault(p["k"], set()).add((p["y"], p["x"]))
    for k, s in regions.items():
        # A pixel is in the hull if adding it does not make it larger.
        size = plain_hull(list(s))
        inside = lambda q: plain_hull([*s, q]) == size and (size > 0 or q in s or on_line(s, q))  # noqa: B023, E731
        assert got[k] == {q for q in itertools.product(range(16), range(16)) if inside(q)}, s


def on_line(s, q):
    """Whether q lies on the stretch that points in one line span."""
    (y0, x0), (y1, x1) = min(s), max(s)
    return (y1 - y0) * (q[1] - x0) == (x1 - x0) * (q[0] - y0) and min(s) <= q <= max(s) and min(x0, x1) <= q[1] <= max(x0, x1)


def plain_simplify(ring, eps):
    """Douglas-Peucker by recursion, split at the first point and the one farthest from it."""
    if len(ring) < 4:
        return ring
    closed = [np.array(q, float) for q in ring + ring[:1]]

    def walk(a, b):
        best, far = None, -1.0
        for k in range(a + 1, b):
            line, off = closed[b] - closed[a], closed[k] - closed[a]
            length = np.hypot(*line)
            gap = abs(line[0] * off[1] - line[1] * off[0]) / length if length else np.hypot(*off)
            if gap > far:
                best, far = k, gap
        return [*walk(a, best), best, *walk(best, b)] if best is not None and far > eps else []

    far = max(range(len(ring)), key=lambda k: (((closed[k] - closed[0]) ** 2).sum(), -k))
    keep = sorted({0, far, *walk(0, far), *walk(far, len(ring))} - {len(ring)})
    return [ring[k] for k in keep]


@pytest.mark.parametrize("eps", [0.5, 3.0, 8.0])
def test_simplified_rings(eps):
    rings = random_rings(5, 150)
    p, n = padded(rings)
    kept = rasters.simplified_rings(p, n, eps)
    assert [[r[k] for k in np.flatnonzero(kept[i])] for i, r in enumerate(rings)] == [plain_simplify(r, eps) for r in rings]


def plain_tissue(image, deep):
    """One pixel after the other."""
    c, h, w = image.shape
    g = [[int((4899 * image[0][y][x] + 9617 * image[1][y][x] + 1868 * image[2][y][x] + 8192) // 16384) if c == 3 else int(image[0][y][x]) for x in range(w)] for y in range(h)]
    flat = [v for row in g for v in row]
    bright, low, high = sum(flat) / len(flat) > 100, min(flat), max(flat)
    if bright:
        g = [[v % 256 for v in row] for row in g]
    else:
        g = [[(v - low) * 255 // (high - low) if high - low > (100 if deep else 15) else 0 for v in row] for row in g]
    back = lambda i, n: n - 1 - abs(n - 1 - abs(i))
    weights = [8, 28, 56, 72, 56, 28, 8]
    hits = 0
    for y, x in itertools.product(range(h), range(w)):
        total = sum(a * b * g[back(y + i - 3, h)][back(x + j - 3, w)] for i, a in enumerate(weights) for j, b in enumerate(weights))
        v = (total + 32768) // 65536
        hits += v <= 210 if bright else v > 40
    return hits / (h * w)


def test_tissue_of_colour_and_deep_tiles():
    r = np.random.default_rng(3)
    cases = [(r.integers(0, 256, (3, 9, 9)), False), (r.integers(150, 256, (3, 9, 9)), False), (r.integers(0, 90, (1, 9, 9)), False), (r.integers(0, 12, (2, 9, 9)), False), (r.integers(0, 95, (1, 9, 9)), True), (r.integers(0, 180, (1, 9, 9)), True), (r.integers(0, 4000, (1, 9, 9)), True)]
    for image, deep in cases:
        assert tiles.tissue_shares(image[None], np.array([deep]))[0] == plain_tissue(image, deep)


def test_percentiles_are_exact(spark):
    r = random.Random(6)
    rows = [(t, k, float(r.randint(-5, 40))) for t in range(4) for k in range(r.randint(1, 30))]
    df = spark.createDataFrame(rows, "t long, k long, value double")
    for positive in (False, True):
        got = {(x["t"], x["k"]): x["value"] for x in tiles.percentile_normalize(df, ["t"], 0.1, 0.9, positive_only=positive).collect()}
        for t in range(4):
            values = [v for s, _, v in rows if s == t]
            a, b = np.percentile([v for v in values if v > 0 or not positive], [10, 90])
            for s, k, v in rows:
                if s == t:
                    assert got[t, k] == pytest.approx(min(max((v - a) / (b - a + 1e-8), 0), 1), abs=1e-12)


# Assignment


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_assignment_is_the_best(rows, cols, rng):
    pairs = [(r, c, rng.choice([0.1, 0.3, 0.5, rng.random()])) for r in range(rows) for c in range(cols) if rng.random() < 0.6]
    kept = scores.best_assignment(*zip(*pairs)) if pairs else []
    chosen = [pairs[k] for k in kept]
    assert len({r for r, *_ in chosen}) == len({c for _, c, _ in chosen}) == len(chosen)
    weight = {(r, c): w for r, c, w in pairs}
    most = max(sum(weight.get((r, p[r]), 0) for r in range(rows)) for p in itertools.permutations(range(max(rows, cols)), rows))
    assert sum(w for *_, w in chosen) == pytest.approx(most)


def test_a_tile_of_many_small_parts_is_solved_part_by_part(spark):
    """5,000 by 5,000 objects in parts of two by two: a dense matrix would have 25 million places."""
    n = 2_500
    ids = spark.range(n).withColumn("k", F.explode(F.array(*[F.struct(F.lit(a).alias("g"), F.lit(b).alias("p"), F.lit(w).alias("w")) for a, b, w in ((1, 1, 5), (1, 2, 6), (2, 1, 6), (2, 2, 1))])))
    pairs = ids.select(F.lit(0).alias("t"), (F.col("id") * 2 + F.col("k.g")).alias("g"), (F.col("id") * 2 + F.col("k.p")).alias("p"), (F.col("k.w") / 10).alias("iou"))
    began = time.perf_counter()
    got = scores.assigned(pairs, ["t"]).collect()
    assert time.perf_counter() - began < 60 and len(got) == 2 * n and {r["iou"] for r in got} == {0.6}
