"""k-means against plain numpy from the same first centres, and the number of clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import expression as X
from tesserae.operators.corpus import keyed_hash

from .conftest import DATA


def plain_kmeans(ids, vectors, order, k):
    v = dict(zip(ids, vectors, strict=True))
    centres, before = np.array([v[i] for i in order[:k]]), None
    while True:
        near = np.array([np.argmin([((x - c) ** 2).sum() for c in centres]) for x in vectors])
        if before is not None and (near == before).all():
            return dict(zip(ids, near.tolist(), strict=True))
        before = near
        centres = np.array([np.mean(vectors[near == j], 0) if (near == j).any() else centres[j] for j in range(k)])


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_plain_numpy(spark, parts):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").repartition(parts)
    order = [r[0] for r in df.orderBy(keyed_hash(F.col("vec_id"), 42), "vec_id").select("vec_id").collect()]
    rows = sorted(df.collect())
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    got = {r["vec_id"]: r["cluster"] for r in X.cluster(df, "vec_id").collect()}
    assert got == plain_kmeans(ids, vectors, order, 8)


def test_small_tables_nulls_and_equal_vectors(spark):
    df = spark.createDataFrame([(k, [float(k % 3), 0.0]) for k in range(21)] + [(None, [0.0, 0.0]), (99, None)], "vec_id long, embedding array<double>")
    got = X.cluster(df, "vec_id").collect()
    assert len(got) == 21 and len({(r["vec_id"] % 3, r["cluster"]) for r in got}) == 3
    assert {r["cluster"] for r in X.cluster(df.limit(19), "vec_id").collect()} == {None}
    assert X.cluster(df.limit(0), "vec_id").count() == 0
    assert [X.cluster_count(n) for n in (0, 19, 20, 23, 24, 1000)] == [0, 0, 6, 7, 8, 8]


@pytest.mark.parametrize("at_once", [1000, 2])
def test_silhouettes_of_many_clusters(spark, at_once):
    rng = np.random.default_rng(1)
    v, label = rng.normal(size=(60, 3)), rng.integers(0, 9, 60)
    df = spark.createDataFrame([(k, int(c), x.tolist()) for k, (c, x) in enumerate(zip(label, v, strict=True))], "id long, label int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in X.silhouette_squared(df, "id", "label", "v", at_once, salts=3).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    for i in range(60):
        same = (label == label[i]) & (np.arange(60) != i)
        a, b = d[i, same].mean() if same.any() else 0, min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b) if same.any() else 0, abs=1e-9)
