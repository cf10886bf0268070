"""Whole groups in batches, and what is done on them, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions.rasters import fill_rings
from tesserae.operators import groups, tiles


def test_groups_are_whole_however_batches_fall(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE concat('k', cast(sqrt(id) as int)) END AS k", "id % 2 AS j", "id")

    def work(batch, starts):
        ends = np.append(starts[1:], batch.num_rows)
        ids = batch.column("id").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(starts)), batch.column("j").take(pa.array(starts)), pa.array([int(ids[a:b].sum()) for a, b in zip(starts, ends)])], names=["k", "j", "s"])

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = groups.by_group(df, ["k", "j"], work, "k string, j long, s long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = df.groupBy("k", "j").agg(F.sum("id").alias("s")).collect()
    key = lambda r: (str(r["k"]), r["j"], r["s"])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_missing_value_has_no_part_in_percentiles(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([4.0, None, 0.0, 2.0, None, 1.0, 3.0])] + [(2, 0, None)], "t long, x int, value double")
    got = {(r["t"], r["x"]): r["value"] for r in tiles.percentile_normalize(df, ["t"], 0.0, 1.0).collect()}
    want = {(1, k): (v or 0.0) / 4 for k, v in enumerate([4.0, None, 0.0, 2.0, None, 1.0, 3.0])} | {(2, 0): 0.0}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_marker_shares_by_role_of_sparse_channels(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(5):
        labels = rng.integers(0, 4, (2, 9, 11)) * (rng.random((2, 9, 11)) < 0.5)
        for y in range(9):
            for x in range(11):
                for c in ("a", "b", "c"):
                    if rng.random() < 0.8:
                        rows.append((t, y + 100 * t - 150, x - 5, int(labels[0, y, x]), int(labels[1, y, x]), c, [True, False, None][rng.integers(0, 3)]))
    df = spark.createDataFrame(rows, "t long, y int, x int, nucleus int, cell int, channel string, positive boolean")
    got = tiles.marker_calls_by_role(df, ["t"], ["a"], {"c": 0.2})
    regions = df.selectExpr("t", "y", "x", "inline(array(struct('nucleus' AS role, nucleus AS label), struct('cell' AS role, cell AS label)))").filter("label > 0").distinct()
    asked = df.selectExpr("t", "y", "x", "channel", "CASE WHEN channel = 'a' THEN 'nucleus' ELSE 'cell' END AS role", "positive AND CASE WHEN channel = 'a' THEN nucleus ELSE cell END > 0 AS positive")
    want = tiles.marker_calls(tiles.hull_pixels(regions, ["t", "role", "label"]).join(asked, ["t", "role", "y", "x"]), ["t", "role", "label"], {"c": 0.2}).filter("ratio IS NOT NULL")
    assert dict(got.dtypes) == dict(want.dtypes)
    key = lambda r: (r["t"], r["role"], r["label"], r["channel"], round(r["ratio"], 9), r["called"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("pixels", [500, 1 << 22])
def test_painted_rings_across_blocks(spark, monkeypatch, pixels):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(tiles, "PIXELS", pixels)
    corners = [(int(rng.integers(-40, 1060)), int(rng.integers(-40, 1060)), int(rng.integers(1, 90)), int(rng.integers(1, 90))) for _ in range(120)] + [(-30, -30, 1200, 700)]
    rings = [[(x, y), (x + w, y + h // 3), (x + w // 2, y + h), (x, y + h // 2)] for x, y, w, h in corners]
    ranks = rng.permutation(len(rings)).tolist()
    p = np.array(rings, float)
    ring, y, first, last = fill_rings(p, np.full(len(p), 4))
    want = {}
    for k in sorted(range(len(ring)), key=lambda k: ranks[ring[k]]):
        for x in range(first[k], last[k] + 1):
            want[int(y[k]), x] = int(ring[k])
    df = spark.createDataFrame([(1, k, r, [(float(a), float(b)) for a, b in g]) for k, (r, g) in enumerate(zip(ranks, rings))], "s long, id long, rank long, ring array<struct<x:double,y:double>>").repartition(5)
    runs = tiles.rasterized_runs(df, ["s"], "id", "rank").collect()
    got = [((r["y"], x), r["label"]) for r in runs for x in range(r["x1"], r["x2"] + 1)]
    assert len(got) == len(want) and dict(got) == want
    if pixels > 500:
        assert {((r["y"], r["x"]), r["label"]) for r in tiles.rasterize(df, ["s"], "id", "rank").collect()} == set(got)


def test_painted_runs_by_small_steps(monkeypatch):
    monkeypatch.setattr(tiles, "PIXELS", 3)
    run, y, first, last = tiles.painted_runs(np.array([0, 1, 2]), np.array([4, 4, 4]), np.array([0, 2, 8]), np.array([9, 5, 8]), np.array([0, 0, 0]))
    assert sorted(zip(run.tolist(), first.tolist(), last.tolist())) == [(0, 0, 1), (0, 6, 7), (0, 9, 9), (1, 2, 5), (2, 8, 8)]
    assert set(y.tolist()) == {4}
