"""Hand-made cases of scores, tiles, edges and formats, and properties on random input."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import polygons as P
from tesserae.operators import corpus, expression, parts
from tesserae.operators import instances as I
from tesserae.operators import scores as S
from tesserae.operators import spatial, tiles
from tesserae.sources import formats


def shared_area(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return P.intersection_areas(a[None], np.array([len(a)]), b[None], np.array([len(b)]))[0]


def counts(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "tile_id long, g long, p long, n long")


def one(df):
    return df.first().asDict()


def test_both_empty(spark):
    c = counts(spark, [(0, 0, 100)])
    assert [one(S.panoptic_quality(c, ["tile_id"]))[k] for k in ("pq", "dq", "sq")] == [1, 1, 1]
    assert one(S.aggregated_jaccard(c, ["tile_id"]))["aji"] == 1
    assert one(S.aggregated_jaccard_plus(c, ["tile_id"]))["aji_plus"] == 1
    assert [one(S.detection_scores(c, ["tile_id"]))[k] for k in ("det_f1", "det_precision", "det_recall")] == [1, 1, 1]
    assert one(S.prediction_first_quality(c, ["tile_id"]))["pq"] == 0


@pytest.mark.parametrize(("rows", "f1"), [([(0, 0, 90), (0, 1, 10)], (0, 0, 1)), ([(0, 0, 90), (1, 0, 10)], (0, 1, 0))])
def test_one_side_empty(spark, rows, f1):
    c = counts(spark, rows)
    assert one(S.panoptic_quality(c, ["tile_id"]))["pq"] == 0
    assert one(S.aggregated_jaccard(c, ["tile_id"]))["aji"] == 0
    d = one(S.detection_scores(c, ["tile_id"]))
    assert (d["det_f1"], d["det_precision"], d["det_recall"]) == f1


def test_a_good_pair_can_lose_the_optimal_assignment(spark):
    c = counts(spark, [(0, 0, 1000), (1, 1, 153), (1, 2, 47), (2, 1, 100)])
    assert one(S.panoptic_quality(c, ["tile_id"]))["tp"] == 1
    assert one(S.panoptic_quality(c, ["tile_id"], method="optimal"))["tp"] == 0


def test_edge_codes(spark):
    cases = [((0, 0, 50, 50), 1), ((100, 0, 150, 50), 2), ((1000, 0, 1020, 50), 3), ((1000, 100, 1020, 150), 4), ((1000, 1000, 1020, 1020), 5), ((100, 1000, 150, 1020), 6), ((0, 1000, 50, 1020), 7), ((0, 100, 50, 150), 8), ((100, 100, 150, 150), 0)]
    df = spark.createDataFrame([(*b, c) for b, c in cases], "xmin int, ymin int, xmax int, ymax int, code int")
    assert df.filter(I.edge_status(1024) != F.col("code")).count() == 0


def test_tile_plans(spark):
    slide = spark.createDataFrame([(1, 1000, 1000)], "slide_id int, width int, height int")
    assert sorted({r["x1"] for r in tiles.plan_tiles(slide).collect()}) == [0, 448, 488]
    assert sorted({r["x1"] for r in tiles.plan_tiles_edge_aligned(slide).collect()}) == [0, 488]


def test_run_lengths_go_down_the_columns(spark):
    m = spark.createDataFrame([("a", 1, "1 3 6 2")], "image_id string, row_idx int, encoded string")
    assert sorted((r["y"], r["x"]) for r in formats.rle_pixels(m, 4).collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_two_disks_have_targets_in_range(spark):
    px = [(1, y, x, 1 if (y - 30) ** 2 + (x - 30) ** 2 <= 225 else 2 if (y - 70) ** 2 + (x - 70) ** 2 <= 400 else 0) for y in range(100) for x in range(100)]
    df = I.hv_targets(spark.createDataFrame(px, "tile_id int, y int, x int, label int"), ["tile_id"])
    r = df.agg(F.min("h"), F.max("h"), F.min("v"), F.max("v")).first()
    assert tuple(r) == (-1, 1, -1, 1)


boxes = st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(1, 120), st.integers(1, 120)), min_size=1, max_size=25)


@given(boxes, st.sampled_from([16, 64, 500]))
@settings(max_examples=6, deadline=None)
def test_box_pairs_equal_brute_force(spark, bs, cell):
    rows = [(1, k, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate(bs)]
    df = spark.createDataFrame(rows, "slide_id int, inst_id int, xmin int, ymin int, xmax int, ymax int")
    got = sorted((r["a"]["inst_id"], r["b"]["inst_id"]) for r in spatial.box_pairs(df, ["slide_id"], cell=cell).collect())
    want = sorted((a[1], b[1]) for a, b in itertools.combinations(rows, 2) if min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]))
    assert got == want


def test_suppression_leaves_no_pair_and_every_loss_has_a_keeper(spark):
    links = [(1, 2, 5.0, 9.0), (2, 3, 9.0, 7.0), (3, 4, 7.0, 6.0), (5, 6, 4.0, 4.0)]
    objects = spark.createDataFrame([(k,) for k in range(1, 8)], "inst_id long")
    kept = {r["inst_id"] for r in spatial.suppress(objects, spark.createDataFrame(links, "a_id long, b_id long, a_area double, b_area double")).collect()}
    assert kept == {2, 4, 5, 7}


rects = st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 15), st.integers(1, 15))


def corners(r):
    x, y, w, h = r
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)


@given(rects, rects)
@settings(max_examples=80, deadline=None)
def test_intersection_of_rectangles(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    assert shared_area(corners(a), corners(b)) == pytest.approx(w * h, abs=1e-6)


def test_intersection_is_exact_at_ties():
    # Far from the origin, with an overlap of 12 x 15 in boxes whose IoU is just 0.3.
    a, b = corners((4_000_001, 3_999_990, 20, 19)), corners((4_000_009, 3_999_994, 20, 21))
    assert shared_area(a, b) == 12 * 15
    rng = np.random.default_rng(4)
    p = np.stack([corners((x, y, w, h)) for x, y, w, h in rng.integers(1, 30, (300, 4))]).astype(float)
    q = np.stack([corners((x, y, w, h)) for x, y, w, h in rng.integers(1, 30, (300, 4))]).astype(float)
    four = np.full(300, 4)
    want = np.maximum(np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0]), 0).prod(1)
    assert (P.intersection_areas(p, four, q, four) == want).all()


def test_intersection_of_any_simple_rings():
    rng = np.random.default_rng(7)
    grid = np.stack(np.meshgrid(np.arange(0.05, 20, 0.1), np.arange(0.05, 20, 0.1)), -1).reshape(-1, 2)

    def inside(ring):
        out = np.zeros(len(grid), bool)
        for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
            out ^= ((a[1] > grid[:, 1]) != (b[1] > grid[:, 1])) & (grid[:, 0] < (b[0] - a[0]) * (grid[:, 1] - a[1]) / (b[1] - a[1] or 1) + a[0])
        return out

    for _ in range(12):
        rings = []
        for _ in range(2):
            n = int(rng.integers(3, 12))
            t, r, c = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(1, 7, n), rng.uniform(7, 13, 2)
            rings.append(np.stack([np.cos(t), np.sin(t)], 1) * r[:, None] + c)
        if all(P.is_simple(r) for r in rings):
            assert shared_area(*rings) == pytest.approx((inside(rings[0]) & inside(rings[1])).sum() / 100, abs=1.0)
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 3)], float)
    touching = np.array([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)], float)
    assert not P.is_simple(bow) and P.is_simple(touching) and P.is_simple(corners((0, 0, 2, 2)))


def test_rings_that_cross_at_a_point_are_not_simple(spark):
    """Small integer rings against winding numbers on a fine grid; f11's own case goes through a point of another edge."""
    fine = np.stack(np.meshgrid(np.arange(-0.487, 4.6, 0.05), np.arange(-0.489, 4.6, 0.05)), -1).reshape(-1, 1, 2)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]

    def expected(a):
        b = np.roll(a, -1, 0)
        side = cross((b - a)[:, None], a[None] - a[:, None])
        parted = side * np.roll(side, -1, 1) < 0
        left = cross(b - a, fine - a) > 0
        wound = ((a[:, 1] <= fine[..., 1]) & (fine[..., 1] < b[:, 1]) & left).sum(1) - ((b[:, 1] <= fine[..., 1]) & (fine[..., 1] < a[:, 1]) & ~left).sum(1)
        turn = np.sign(cross(a, b).sum())
        return bool(turn and not (parted & parted.T).any() and set(wound.tolist()) <= {0, int(turn)})

    rng = np.random.default_rng(3)
    rings = [rng.integers(0, 5, (int(rng.integers(3, 9)), 2)).astype(float) for _ in range(1500)]
    through = [(0, 0), (8, 8), (8, 0), (4, 4), (0, 9)]
    retraced = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    twice = [(0, 0), (4, 0), (4, 4), (0, 4)] * 2
    twisted = [(0, 0), (1, 0), (1, 1), (3, 1), (3, 0), (4, 0), (4, 2), (3, 2), (3, 1), (1, 1), (1, 2), (0, 2)]
    other_way = [(0, 0), (1, 0), (1, 1), (3, 1), (3, 2), (4, 2), (4, 0), (3, 0), (3, 1), (1, 1), (1, 2), (0, 2)]
    named = [np.array(r, float) for r in (through, retraced, twice, twisted, other_way)]
    found = [P.is_simple(r) for r in named]
    assert found == [False, True, False, True, False]
    want = [expected(r) for r in rings]
    assert [P.is_simple(r) for r in rings] == want and 100 < sum(want) < 1400
    count = np.array([len(r) for r in rings])
    padded = np.stack([np.concatenate([r, np.repeat(r[-1:], 8 - len(r), 0)]) for r in rings])
    assert P.are_simple(padded, count, 500).tolist() == want
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r.tolist()]) for k, r in enumerate(named)], "inst_id long, ring array<struct<x:double,y:double>>")
    assert [r["simple_"] for r in spatial.measured_rings(df).orderBy("inst_id").collect()] == found


def test_intersection_of_concave_polygons():
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    assert shared_area(ell, ell) == pytest.approx(7)
    assert shared_area(ell, corners((1, 1, 3, 3))) == pytest.approx(0, abs=1e-9)
    assert P.is_simple(ell) and not P.is_simple(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float))


def test_geojson_collection_with_multipolygon(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[%s]},"properties":{"id":7,"classification":{"name":"Nucleus"}}},{"type":"Feature","id":"z","geometry":{"type":"MultiPolygon","coordinates":[[%s],[%s]]},"properties":{"classification":"Cytoplasm"}}]}' % (square, square, square)
    (tmp_path / "a.geojson").write_text(text)
    got = sorted((r["cell_id"], len(r["ring"])) for r in formats.read_geojson_cells(spark, str(tmp_path / "a.geojson")).collect())
    assert got == [("7", 5), ("z", 5)]
    kinds = sorted(r["type"] for r in formats.read_geojson_annotations(spark, str(tmp_path / "a.geojson")).collect())
    assert kinds == ["Cell", "Cell", "Nucleus"]


def test_registry_falls_back_to_latin(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("Dataset,Organ\nA,Utérus\n".encode("latin-1"))
    r = formats.read_registry_csv(spark, str(tmp_path / "r.csv")).first()
    assert (r["dataset"], r["organ"]) == ("A", "Utérus")


def test_tiles_by_count_with_missing_counts(spark):
    rows = spark.createDataFrame([(1, 5, 0), (2, 3, 3), (3, None, None), (4, None, 9)], "tile_id long, a long, b long")
    ids = lambda df: sorted(r["tile_id"] for r in df.collect())
    assert ids(corpus.filter_tiles_by_count(rows, counts=("a", "b"))) == [1, 2, 3, 4]
    assert ids(corpus.filter_tiles_by_count(rows, 6, counts=("a", "b"))) == [2, 4]
    assert ids(corpus.filter_tiles_by_count(rows, drop_empty=True, counts=("a", "b"))) == [2]


def test_greedy_takes_the_free_prediction_and_optimal_the_best_sum(spark):
    from tesserae.operators import scores

    rows = [(1, 1, 1, 0.6), (1, 1, 2, 0.5), (1, 2, 1, 0.55), (1, 2, 3, 0.1), (2, 1, 1, 0.4), (2, 2, 1, 0.4), (3, 7, 7, 0.3)]
    pairs = spark.createDataFrame(rows, "tile long, g long, p long, iou double")
    got = lambda df: sorted((r["tile"], r["g"], r["p"]) for r in df.collect())
    assert got(scores.greedy_matches(pairs, ["tile"])) == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (3, 7, 7)]
    assert got(scores.greedy_matches(pairs, ["tile"], 0.5)) == [(1, 1, 1)]
    assert got(scores.assigned(pairs, ["tile"]))[:2] == [(1, 1, 2), (1, 2, 1)] and len(got(scores.assigned(pairs, ["tile"]))) == 4
    assert not got(scores.greedy_matches(pairs.limit(0), ["tile"])) and not got(scores.assigned(pairs.limit(0), ["tile"]))


def test_slides_by_extension(spark, tmp_path):
    for n in ("a.svs", "b.svs", "c.txt"):
        (tmp_path / n).write_text("x")
    assert formats.slide_manifest(spark, str(tmp_path), ".svs").count() == 2


def test_short_counts_have_ties_and_no_separators(spark):
    rows = [(k,) for k in (0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 999_949, 999_999, 1_000_000, 1_250_000, 1_350_000, 12_350_000, 999_999_999, 1_234_500_000, 12_350_000_001)]
    got = {r["n"]: r["s"] for r in spark.createDataFrame(rows, "n long").select("n", corpus.short_count(F.col("n")).alias("s")).collect()}
    assert got == {n: f"{n / 1e6:.1f}M" if n >= 1e6 else f"{n / 1e3:.1f}K" if n >= 1e3 else str(n) for (n,) in rows}


def test_matrix_has_all_genes_and_cells(spark):
    from tesserae import plans

    from .conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    m = plans.QUERIES["x3_expression_matrix"](spark, DATA).toPandas().set_index("cell_id")
    assert m.to_numpy().sum() == events.count() and not m.isna().any().any()
    assert len(m) == events.select("user_id").distinct().count() and m.shape[1] == 40
    with pytest.raises(ValueError, match="more than 3 genes"):
        expression.gene_names(spark.createDataFrame([(f"G{k}",) for k in range(4)], "feature_name string"), most=3)


def test_aperio_documents_stay_small(spark, tmp_path):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])
    cells = spark.range(0, 40_000).select("id", ring.alias("ring"), F.lit("he_cell").alias("type"))
    docs = formats.aperio_documents(cells, 1000)
    r = docs.agg(F.count("*").alias("n"), F.max(F.size(F.split("value", "<Annotation "))).alias("most")).first()
    assert (r["n"], r["most"]) == (40, 1001)
    formats.write_documents(docs, str(tmp_path / "xml"))
    found = formats.read_aperio_xml(spark, str(tmp_path / "xml"))
    assert found.count() == 40_000 and found.filter(F.size("ring") != 4).count() == 0


def test_aperio_query_writes_no_line_that_grows(spark):
    import glob

    from tesserae import plans

    from .conftest import DATA

    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/xml-*"))
    plans.QUERIES["s7_aperio_xml"](spark, DATA).collect()
    (path,) = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/xml-*")) - before
    lines = spark.read.text(path)
    assert lines.count() > 0
    ids = lines.select(F.expr("transform(regexp_extract_all(value, 'Region Id=\"([0-9]+)\"', 1), x -> cast(x as long))").alias("ids"))
    assert ids.filter(F.array_max("ids") - F.array_min("ids") >= 10_000).count() == 0


def scanned(links, rounds):
    """The scan itself: in id order a seed and its open neighbours make a cluster, of which the largest stays."""
    near, size, removed = {}, {}, set()
    for a, b, sa, sb in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        size[a], size[b] = sa, sb
    for _ in range(rounds):
        done = set()
        for seed in sorted(near):
            if seed not in done | removed:
                cluster = {seed, *(x for x in near[seed] if x not in done | removed)}
                done |= cluster
                removed |= cluster - {max(cluster, key=lambda x: (size[x], x == seed, -x))}
    return removed


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_replay_equals_the_scan(spark, rounds):
    rng = np.random.default_rng(rounds)
    size = rng.integers(1, 6, 60).astype(float)
    pairs = sorted({tuple(sorted(int(x) for x in rng.choice(60, 2, replace=False))) for _ in range(90)})
    links = [(a, b, float(size[a]), float(size[b])) for a, b in pairs]
    df = spark.createDataFrame(links, "a_id long, b_id long, a_area double, b_area double")
    assert {r["id"] for r in parts.removed_by_scan(df, rounds, 0).collect()} == scanned(links, rounds)
    assert parts.removed_by_scan(df.limit(0), rounds, 0).count() == 0


def test_replay_of_a_long_chain(spark):
    """A component of diameter 239, whose ids don't rise along it."""
    ids = np.random.default_rng(1).permutation(240).tolist()
    links = [(min(a, b), max(a, b), 1.0 + min(a, b) % 7, 1.0 + max(a, b) % 7) for a, b in itertools.pairwise(ids)]
    df = spark.createDataFrame(links, "a_id long, b_id long, a_area double, b_area double")
    assert {r["id"] for r in parts.removed_by_scan(df, 1, 0).collect()} == scanned(links, 1)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_dilation_on_a_grid_with_holes(spark, radius):
    rng = np.random.default_rng(radius)
    rows = [(int(s), int(r), int(c), bool(rng.random() < 0.1)) for s in range(3) for r in range(12) for c in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame([(*r, "x") for r in rows], "slide_id long, tile_row int, tile_col int, keep boolean, other string")
    got = tiles.dilate_tiles(df, ["slide_id"], radius)
    assert got.columns == df.columns
    want = [(s, r, c, any(k and s == t and abs(r - q) <= radius and abs(c - e) <= radius for t, q, e, k in rows), "x") for s, r, c, _ in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_labels_are_renumbered_with_nulls_and_negatives(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([0, 7, 7, 3, None, -2, 12])] + [(2, 0, 5), (3, 0, 0)], "tile_id long, x int, label long")
    got = I.remap_labels(df, ["tile_id"])
    assert sorted((r["tile_id"], r["x"], r["label"]) for r in got.collect()) == [(1, 0, 0), (1, 1, 2), (1, 2, 2), (1, 3, 1), (1, 4, 0), (1, 5, 0), (1, 6, 3), (2, 0, 1), (3, 0, 0)]
