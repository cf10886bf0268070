"""Spatial transcriptomics: from assigned transcripts to counts, quality, normalised expression and clusters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .corpus import keyed_hash
from .tables import saved

# Fixed value: microns in a pixel.
PIXEL = 0.2125
#: Columns of a matrix of cells and genes: above the largest panels in use, below what a plan can hold.
MAX_GENES = 10_000


def um_to_px(value: Column, pixel: float = PIXEL, area: bool = False) -> Column:
    return value / (pixel * pixel if area else pixel)


def px_to_um(value: Column, pixel: float = PIXEL, area: bool = False) -> Column:
    return value * (pixel * pixel if area else pixel)


def crop_transcripts(points: DataFrame, x0: float, x1: float, y0: float, y1: float, pixel: float | None = None, fraction: float | None = None, seed: int = 42, sample_first: bool = False) -> DataFrame:
    """Points in a half-open window, in the window's coordinates; pixel: microns in a pixel if x and y are microns. A
    fraction is drawn after the window is cut, or before."""
    df = points if pixel is None else points.withColumns({"x": um_to_px(F.col("x"), pixel), "y": um_to_px(F.col("y"), pixel)})
    df = df.sample(fraction, seed) if fraction and sample_first else df
    df = df.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    df = df.sample(fraction, seed) if fraction and not sample_first else df
    return df.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def sample_by_hash(df: DataFrame, id: str, fraction: float, steps: int = 1000, factor: int = 7919) -> DataFrame:
    """The same rows in every run and engine: an integer hash of the id below a share."""
    return df.filter(F.pmod(F.col(id) * factor, F.lit(steps)) < int(fraction * steps))


def assignment_rate(points: DataFrame, cells: Sequence[str]) -> DataFrame:
    """For each column of assigned cells: total, assigned and rate in percent."""
    one = [F.struct(F.lit(c).alias("segmentation"), F.count("*").alias("total"), F.count(c).alias("assigned"), (F.count(c) / F.count("*") * 100).alias("rate")).alias(f"s{k}") for k, c in enumerate(cells)]
    return points.agg(*one).select(F.inline(F.array(*[f"s{k}" for k in range(len(cells))])))


def expression_counts(points: DataFrame, cell: str = "cell_id", gene: str = "feature_name") -> DataFrame:
    return points.filter(F.col(cell).isNotNull()).groupBy(cell, gene).agg(F.count("*").alias("count"))


def expression_matrix(counts: DataFrame, genes: Sequence[str], cell: str = "cell_id", gene: str = "feature_name") -> DataFrame:
    """A column for each of the given genes, 0 where a cell has none."""
    return counts.groupBy(cell).pivot(gene, list(genes)).agg(F.sum("count")).fillna(0)


def gene_names(counts: DataFrame, gene: str = "feature_name", most: int = MAX_GENES) -> list[str]:
    """All genes of the table in order, for the columns of a matrix; an error if there are more than most."""
    found = sorted(r[0] for r in counts.filter(F.col(gene).isNotNull()).select(gene).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} genes: a matrix has a column for each")
    return found


def per_cell(counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    return counts.groupBy(cell).agg(F.sum("count").alias("transcripts"), F.count("*").alias("genes"))


def per_cell_summary(cells: DataFrame) -> DataFrame:
    """Cells, mean and sample deviation of transcripts."""
    return cells.agg(F.count("*").alias("cells"), F.avg("transcripts").alias("mean"), F.stddev_samp("transcripts").alias("std"))


def keep_rich_cells(counts: DataFrame, least: int = 20, min_cells: int = 50, cell: str = "cell_id") -> DataFrame:
    """Counts of cells with at least so many transcripts; nothing if fewer than min_cells are left."""
    rich = per_cell(counts, cell).filter(F.col("transcripts") >= least).select(cell)
    if rich.limit(min_cells).count() < min_cells:
        return counts.limit(0)
    return counts.join(rich, cell, "left_semi")


def detect_doublets(counts: DataFrame, markers: Mapping[str, Sequence[str]], threshold: int = 3, cell: str = "cell_id", gene: str = "feature_name") -> DataFrame:
    """cell, lineages (with more than threshold transcripts of their marker genes) and doublet (two lineages or more)."""
    spark = counts.sparkSession
    table = spark.createDataFrame([(lineage, g) for lineage, genes in markers.items() for g in genes], f"lineage string, {gene} string")
    high = counts.join(F.broadcast(table), gene).groupBy(cell, "lineage").agg(F.sum("count").alias("n")).filter(F.col("n") > threshold)
    lineages = high.groupBy(cell).agg(F.count("*").alias("lineages"))
    return counts.select(cell).distinct().join(lineages, cell, "left").select(cell, F.coalesce("lineages", F.lit(0)).alias("lineages"), (F.coalesce("lineages", F.lit(0)) >= 2).alias("doublet"))


def markers_present(counts: DataFrame, markers: Sequence[str], gene: str = "feature_name") -> DataFrame:
    """Those of the markers that were observed."""
    wanted = counts.sparkSession.createDataFrame([(m,) for m in markers], f"{gene} string")
    return wanted.join(counts.select(gene).distinct(), gene, "left_semi")


def cpm_log1p(counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    total = per_cell(counts, cell).select(cell, F.col("transcripts").alias("total_"))
    return counts.join(total, cell).withColumn("value", F.log1p(F.col("count") / F.col("total_") * 1e6)).drop("total_")


def gene_moments(values: DataFrame, n_cells: int, gene: str = "feature_name") -> DataFrame:
    """Mean and population deviation of each gene over all cells, cells without the gene as zeros."""
    sums = values.groupBy(gene).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    return sums.select(gene, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / n_cells - mean * mean, F.lit(0.0))).alias("std"))


def standardize(values: DataFrame, gene: str = "feature_name", cell: str = "cell_id") -> DataFrame:
    """(value - mean) / deviation of the rows that are there, and zero_value: what a cell without the gene would get. A
    deviation of zero divides by one."""
    n = values.select(cell).distinct().count()
    m = gene_moments(values, n, gene)
    by = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    return values.join(F.broadcast(m) if m.count() <= 100_000 else m, gene).withColumn("zero_value", -F.col("mean") / by).withColumn("value", (F.col("value") - F.col("mean")) / by).drop("mean", "std")


def top_genes(points: DataFrame, k: int = 20, gene: str = "feature_name") -> DataFrame:
    return points.groupBy(gene).agg(F.count("*").alias("n")).orderBy(F.desc("n"), gene).limit(k)


def _assigned(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, the first of equals."""
    return np.stack([((vectors - c) ** 2).sum(1) for c in centres], 1).argmin(1)


def _stacked(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def cluster_count(n: int, most: int = 8, least_rows: int = 20) -> int:
    """Clusters for so many rows: a third of them, most at most; none below least_rows."""
    return 0 if n < least_rows else min(most, n // 3)


def cluster(vectors: DataFrame, id: str, column: str = "embedding", most: int = 8, least_rows: int = 20, seed: int = 42) -> DataFrame:
    """id and cluster (0 to k - 1, nearest centre) by k-means over rows of one length; null below least_rows. k is min(most, rows / 3).

    The first centres are the vectors of the k ids that a keyed hash puts first. A round is one pass over the table: batches add up
    their vectors by nearest centre and count those whose nearest centre is another than in the round before; rounds end when
    none is. Only centres (k vectors) and their sums meet on the driver. A centre that nothing is nearest to stays where it is.
    """
    spark = vectors.sparkSession
    rows = saved(vectors.select(F.col(id).alias("id"), F.col(column).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    k = cluster_count(rows.count(), most, least_rows)
    if not k:
        return rows.select(F.col("id").alias(id), F.lit(None).cast("int").alias("cluster"))
    first = rows.orderBy(keyed_hash(F.col("id").cast("long"), seed), "id").limit(k).select("v").collect()
    centres, before = np.array([r["v"] for r in first]), None
    while True:
        now, old = centres, before

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, moved = np.zeros(now.shape), np.zeros(len(now), np.int64), 0
            for batch in batches:
                v = _stacked(batch.column("v"))
                near = _assigned(v, now)
                np.add.at(total, near, v)
                count += np.bincount(near, minlength=len(now))
                moved += len(v) if old is None else int((near != _assigned(v, old)).sum())
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(now)), pa.int32()), "n": count, "total": total.tolist(), "moved": [moved] * len(now)})

        parts = rows.select("v").mapInArrow(summed, "cluster int, n long, total array<double>, moved long")
        sums = parts.select("cluster", "n", "moved", F.posexplode("total").alias("p", "x")).groupBy("cluster", "p").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("moved").alias("moved"))
        found = sums.orderBy("cluster", "p").collect()
        if not found[0]["moved"]:
            break
        size = np.array([r["n"] for r in found]).reshape(now.shape)
        total = np.array([r["x"] for r in found]).reshape(now.shape)
        centres, before = np.where(size > 0, total / np.maximum(size, 1), now), now

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_assigned(_stacked(batch.column("v")), centres).astype(np.int32))], names=["id", "cluster"])

    return rows.mapInArrow(named, f"id {kind}, cluster int").withColumnRenamed("id", id)


def silhouette(vectors: DataFrame, id: str, label: str, column: str, block: int = 1024) -> DataFrame:
    """id, label, silhouette by exact Euclidean distances. Rows are packed into blocks, and each block meets each other
    one once (all distances are asked for); a task holds two blocks."""
    spark = vectors.sparkSession
    n = max(1, -(-vectors.count() // block))
    packed = vectors.select(F.pmod(F.xxhash64(id), F.lit(n)).cast("int").alias("b"), F.struct(F.col(id).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v")).alias("r"))
    blocks = packed.groupBy("b").agg(F.collect_list("r").alias("rows"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = dealt.join(blocks.select(F.col("b").alias("other"), F.col("rows").alias("others")), "other")
    kinds = {"id": vectors.schema[id].dataType.simpleString(), "label": vectors.schema[label].dataType.simpleString()}

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["rows"], batch["others"], strict=True):
                x, y = np.array([r["v"] for r in a]), np.array([r["v"] for r in b])
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
                own, other = np.array([r["label"] for r in a]), np.array([r["label"] for r in b])
                same = np.array([r["id"] for r in a])[:, None] == np.array([r["id"] for r in b])[None]
                d[same] = 0
                for c in np.unique(other):
                    yield pd.DataFrame({"id": [r["id"] for r in a], "label": own, "to": c, "total": d[:, other == c].sum(1)})

    sums = pairs.select("rows", "others").mapInPandas(distances, f"id {kinds['id']}, label {kinds['label']}, to {kinds['label']}, total double").groupBy("id", "label", "to").agg(F.sum("total").alias("total"))
    size = vectors.groupBy(F.col(label).alias("to")).agg(F.count("*").alias("n"))
    means = sums.join(size, "to").withColumn("mean", F.col("total") / F.when(F.col("to") == F.col("label"), F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("n")))
    ab = means.groupBy("id", "label").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("to") != F.col("label"), F.col("mean"))).alias("b"), F.max(F.when(F.col("to") == F.col("label"), F.col("n"))).alias("n"))
    s = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return ab.select(F.col("id").alias(id), F.col("label").alias(label), s.alias("silhouette"))


def silhouette_squared(vectors: DataFrame, id: str, label: str, column: str, at_once: int = 1000, salts: int = 64) -> DataFrame:
    """id, label, silhouette by squared Euclidean distances: linear in the rows, since the mean squared distance to a cluster
    follows from its size, sum and sum of squares. A different number than silhouette() gives. Clusters are dealt to blocks of about at_once,
    copied for each salt, and joined with the vectors of that salt, so neither their number nor a block's vectors go to one task."""
    v = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    sums = v.select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    clusters = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda t: t["s"]).alias("sum"), F.sum("q").alias("q"))
    clusters = saved(clusters.join(v.groupBy("label").agg(F.count("*").alias("n")), "label").withColumnRenamed("label", "to"), "clusters")
    blocks = max(1, -(-clusters.count() // at_once))
    dealt = clusters.withColumns({"block_": F.pmod(F.xxhash64("to"), F.lit(blocks)), "salt_": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))})
    each = v.withColumns({"block_": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")), "salt_": F.pmod(F.xxhash64("id"), F.lit(salts))}).join(dealt, ["block_", "salt_"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    total = F.col("n") * dot("v", "v") - 2 * dot("v", "sum") + F.col("q")
    own = F.col("to") == F.col("label")
    each = each.withColumn("mean", total / F.when(own, F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("n")))
    ab = each.groupBy("id", "label").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    s = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return ab.select(F.col("id").alias(id), F.col("label").alias(label), s.alias("silhouette"))


def boundaries_to_polygons(boundaries: DataFrame, cell: str = "cell_id", index: str = "vertex_idx", pixel: float = PIXEL) -> DataFrame:
    """cell, ring (pixels, closed), area_px and area_um of vertices in microns; cells without area are skipped."""
    point = F.struct(F.col(index).alias("i"), um_to_px(F.col("vertex_x"), pixel).alias("x"), um_to_px(F.col("vertex_y"), pixel).alias("y"))
    rings = boundaries.groupBy(cell).agg(F.array_sort(F.collect_list(point)).alias("v"))
    ring = G.closed(F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return rings.select(cell, ring.alias("ring")).withColumn("area_px", G.area(F.col("ring"))).withColumn("area_um", px_to_um(F.col("area_px"), pixel, area=True)).filter((F.size("ring") > 3) & (F.col("area_px") > 0))


def polygons_to_boundaries(cells: DataFrame, cell: str = "cell_id", pixel: float = PIXEL) -> DataFrame:
    """Vertex rows in microns, with their place in the ring."""
    return cells.select(cell, F.posexplode("ring").alias("vertex_idx", "p")).select(cell, "vertex_idx", px_to_um(F.col("p.x"), pixel).alias("vertex_x"), px_to_um(F.col("p.y"), pixel).alias("vertex_y"))


def cells_metadata(cells: DataFrame, pixel: float = PIXEL) -> DataFrame:
    """x_centroid, y_centroid (microns, mean of the ring's points, the closing one included), cell_area and area_pixels from
    the first area column that is there."""
    first = lambda names: F.coalesce(*[F.col(c).cast("double") for c in names if c in cells.columns], F.lit(0.0))
    return cells.select("cell_id", px_to_um(G.vertex_mean(F.col("ring"), "x"), pixel).alias("x_centroid"), px_to_um(G.vertex_mean(F.col("ring"), "y"), pixel).alias("y_centroid"), first(["area_um", "area_um2"]).alias("cell_area"), first(["area_pixels", "area_px"]).alias("area_pixels"))


def doublet_rates(doublets: Mapping[str, DataFrame]) -> DataFrame:
    """segmentation, cells and doublet_rate (percent) of tables made by detect_doublets."""
    out = None
    for name, d in doublets.items():
        one = d.agg(F.lit(name).alias("segmentation"), F.count("*").alias("cells"), (F.avg(F.col("doublet").cast("double")) * 100).alias("doublet_rate"))
        out = one if out is None else out.unionByName(one)
    return out


def comparison_report(rates: DataFrame, doublets: DataFrame, silhouettes: DataFrame, first: str, second: str) -> DataFrame:
    """One row that compares two segmentations: assignment rates (segmentation, rate) with their difference in points and in percent, doublet
    rates (segmentation, cells, doublet_rate) and their reduction in points, mean silhouettes (segmentation, silhouette) and their gain in
    percent of the first, and cells. What a table lacks is null; a gain on nothing is 0."""
    facts = rates.select("segmentation", "rate").join(doublets, "segmentation", "full").join(silhouettes.select("segmentation", "silhouette"), "segmentation", "full")
    pick = lambda n, c: F.max(F.when(F.col("segmentation") == n, F.col(c)))
    one = facts.agg(*[pick(n, c).alias(f"{p}_{c}") for c in ("rate", "doublet_rate", "silhouette", "cells") for p, n in (("first", first), ("second", second))])
    gain = lambda c: F.when(F.col(f"first_{c}") == 0, 0.0).otherwise((F.col(f"second_{c}") - F.col(f"first_{c}")) / F.abs(f"first_{c}") * 100)
    return one.withColumns({"difference": F.col("second_rate") - F.col("first_rate"), "gain_percent": gain("rate"), "doublet_reduction": F.col("first_doublet_rate") - F.col("second_doublet_rate"), "silhouette_gain_percent": gain("silhouette")})
