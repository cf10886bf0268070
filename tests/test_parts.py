"""Scans of connected parts: packed parts and rounds of joins against plain Python; chains, hubs and ties."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import parts, spatial

LINKS = "a_id long, b_id long, a_area double, b_area double"


def graph(seed, nodes=60, links=90):
    r = random.Random(seed)
    area = {k: float(r.randint(1, 4)) for k in range(nodes)}
    pairs = {tuple(sorted(r.sample(range(nodes), 2))) for _ in range(links)}
    return [(a, b, area[a], area[b]) for a, b in pairs]


def plain_parts(links):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b, *_ in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def plain_scan(links, rounds):
    area = {k: v for a, b, x, y in links for k, v in ((a, x), (b, y))}
    near = lambda i, left: {b if a == i else a for a, b, *_ in links if i in (a, b)} & left
    left = set(area)
    for _ in range(rounds):
        done, keep = set(), set()
        for i in sorted(left):
            if i not in done:
                group = [i, *sorted(j for j in near(i, left) if j not in done)]
                done.update(group)
                keep.add(min(group, key=lambda j: (-area[j], j != i, j)))
        if keep == left:
            break
        left = keep
    return set(area) - left


def plain_rank(links):
    area = {k: v for a, b, x, y in links for k, v in ((a, x), (b, y))}
    stay = set()
    for i in sorted(area, key=lambda k: (-area[k], k)):
        if not any({a, b} - {i} & stay for a, b, *_ in links if i in (a, b)):
            stay.add(i)
    return set(area) - stay


@pytest.mark.parametrize("largest", [100_000, 5, 0])
def test_scans_equal_plain_python(spark, largest):
    links = graph(1) + [(100 + a, 100 + b, x, y) for a, b, x, y in graph(2, 40, 20)]
    df = spark.createDataFrame(links, LINKS)
    assert {r["node"]: r["part"] for r in parts.connected_parts(df).collect()} == plain_parts(links)
    for rounds in (1, 5):
        assert {r["id"] for r in parts.removed_by_scan(df, rounds, largest).collect()} == plain_scan(links, rounds)
    assert {r["id"] for r in parts.removed_by_rank(df, largest).collect()} == plain_rank(links)
    assert parts.removed_by_scan(df.limit(0), 5, largest).count() == parts.removed_by_rank(df.limit(0), largest).count() == 0


def plain_choice(pairs):
    used, out = set(), set()
    for _, a, b in sorted((-w, a, b) for a, b, w in pairs):
        if not used & {("a", a), ("b", b)}:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("largest", [100_000, 4, 0])
def test_one_to_one_with_ties(spark, largest):
    r = random.Random(3)
    pairs = list({(r.randrange(60), r.randrange(60)): (r.randrange(60), r.randrange(60)) for _ in range(140)})
    pairs = [(a, b, float(r.randint(1, 3))) for a, b in pairs] + [(1000, b, 2.0) for b in range(1000, 1050)] + [(a, 2000, 2.0) for a in range(2000, 2050)]
    df = spark.createDataFrame(pairs, "a long, b long, weight double")
    assert {tuple(x) for x in parts.one_to_one(df, largest).collect()} == plain_choice(pairs)
    assert parts.one_to_one(df.limit(0), largest).count() == 0


def test_a_long_chain_takes_a_bounded_number_of_jobs(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"), F.lit(1.0).alias("a_area"), F.lit(1.0).alias("b_area"))
    spark.sparkContext.setJobGroup("chain", "a long chain")
    gone = {r["id"] for r in parts.removed_by_scan(chain, 5).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert gone == set(range(1, n + 1, 2)) and jobs < 250, jobs


def test_nuclei_and_cells_of_dense_tissue(spark):
    r = random.Random(7)
    box = lambda k: (k, 0, *(x := r.randrange(80), y := r.randrange(80)), x + r.choice([4, 8, 8, 12]), y + 8)
    made = {"n": [box(k) for k in range(250)], "c": [box(k) for k in range(100, 400)]}
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"))
    df = {k: spark.createDataFrame(v, "inst_id long, slide_id int, xmin long, ymin long, xmax long, ymax long").withColumn("ring", ring) for k, v in made.items()}
    links, orphans = spatial.link_nuclei(df["n"], df["c"], ["slide_id"], cell=16)
    area = {(a[0], b[0]): (min(a[4], b[4]) - max(a[2], b[2])) * (min(a[5], b[5]) - max(a[3], b[3])) for a in made["n"] for b in made["c"] if a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    want = plain_choice([(a, b, w) for (a, b), w in area.items()])
    got = links.collect()
    assert len(got) == 250 and {(x["nucleus_id"], x["cell_id"]) for x in got if x["cell_id"] is not None} == want
    assert all(x["shared"] == area[x["nucleus_id"], x["cell_id"]] for x in got if x["cell_id"] is not None)
    assert {x["inst_id"] for x in orphans.collect()} == {b[0] for b in made["c"] if (b[4] - b[2]) * 8 > 30} - {c for _, c in want}
