"""Numbers within groups by ranges, against plain Python."""

from collections import defaultdict

import pytest

from tesserae.operators.ranges import numbered


@pytest.mark.parametrize("per_range", [3, 1_000_000])
def test_numbers_within_groups(spark, per_range):
    rows = [(None if k % 5 == 0 else "ab"[k % 2], (k * 7) % 11 if k % 9 else None, k) for k in range(200)] + [("hot", 1, 0)] * 300
    df = spark.createDataFrame(rows, "g string, o long, x long")
    got = numbered(df, ["g"], ["o", "x"], size="of", rows_per_range=per_range).collect()
    assert sorted(map(repr, ((r["g"], r["o"], r["x"]) for r in got))) == sorted(map(repr, rows))
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["number"], r["o"], r["x"], r["of"]))
    for found in groups.values():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and {f[3] for f in found} == {len(found)}
        keys = [(f[1] is not None, f[1] or 0, f[2]) for f in found]
        assert keys == sorted(keys)


def test_equal_rows_spread_over_ranges(spark):
    df = spark.range(4000).selectExpr("'one' AS g", "1 AS o")
    got = numbered(df, ["g"], ["o"], rows_per_range=100)
    assert sorted(r["number"] for r in got.collect()) == list(range(4000))
    assert len(set(got.inputFiles())) > 20


def test_numbers_of_a_whole_table_and_of_none(spark):
    df = spark.range(50).withColumnRenamed("id", "x")
    assert all(r["number"] == r["x"] for r in numbered(df, [], ["x"], rows_per_range=10).collect())
    assert numbered(df.limit(0), ["x"], ["x"]).count() == 0
