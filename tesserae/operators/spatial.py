"""Spatial joins as equi-joins on grid cells, and removal of duplicate objects by overlap.

A box is dealt to every cell of a grid that it meets. Two boxes that meet share the cell of the lower corner of their
intersection, and the pair is taken only there, so no distinct is needed. Points lie in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.polygons import are_simple, intersection_areas, padded_rings, signed_areas
from ..functions.rasters import hull_areas
from .parts import one_to_one, removed_by_rank, removed_by_scan
from .tables import saved

#: Side of a grid cell: about twice the largest object, so that most objects meet one to four cells.
CELL = 64


def _cells(box: DataFrame, cell: float) -> DataFrame:
    """Rows of box (with a struct column o) for each cell they meet."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"o.{lo}") / cell), F.floor(F.col(f"o.{hi}") / cell))
    return box.withColumn("gx_", F.explode(span("xmin", "xmax"))).withColumn("gy_", F.explode(span("ymin", "ymax")))


def box_meetings(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """keys, a, b: structs of the rows of both tables whose boxes share area, within equal keys."""
    dealt = lambda df, name: _cells(df.select(*keys, F.struct(*df.columns).alias("o")), cell).withColumnRenamed("o", name)
    pairs = dealt(left, "a").join(dealt(right, "b"), [*keys, "gx_", "gy_"])
    lower = lambda c, g: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell) == F.col(g)
    return pairs.filter(lower("xmin", "gx_") & lower("ymin", "gy_") & (G.box_intersection() > 0)).select(*keys, "a", "b")


def box_pairs(objects: DataFrame, keys: Sequence[str], id: str = "inst_id", cell: float = CELL) -> DataFrame:
    """keys, a, b: structs of the rows of objects whose boxes share area, a.id < b.id, within equal keys."""
    return box_meetings(objects, objects, keys, cell).filter(F.col(f"a.{id}") < F.col(f"b.{id}"))


def measured_rings(objects: DataFrame, ring: str = "ring", hull: bool = False) -> DataFrame:
    """objects with simple_ (the ring does not cross itself, and has an area) and area_; with hull, hull_area_ too."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = padded_rings(batch.column(ring))
            made = {"simple_": are_simple(p, n), "area_": np.abs(signed_areas(p, n)), **({"hull_area_": hull_areas(p, n)} if hull else {})}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made.values())], names=[*batch.schema.names, *made])

    return objects.mapInArrow(run, f"{kinds}, simple_ boolean, area_ double" + (", hull_area_ double" if hull else ""))


def _simple_rings(objects: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    return measured_rings(objects.select(*dict.fromkeys([*keys, id, "xmin", "ymin", "xmax", "ymax", "ring"]))).filter("simple_")


def _shared_areas(pairs: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    flat = pairs.select(*keys, F.col(f"a.{id}").alias("a_id"), F.col(f"b.{id}").alias("b_id"), F.col("a.area_").alias("a_area"), F.col("b.area_").alias("b_area"), F.col("a.ring").alias("ra"), F.col("b.ring").alias("rb"))
    kept = [f for f in flat.schema.fields if f.name not in ("ra", "rb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = intersection_areas(*padded_rings(batch.column("ra")), *padded_rings(batch.column("rb")))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(shared)], names=[*[f.name for f in kept], "shared"])

    return flat.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", shared double").filter("shared > 0")


def ring_pairs(objects: DataFrame, keys: Sequence[str], id: str = "inst_id", cell: float = CELL) -> DataFrame:
    """keys, a_id, b_id, a_area, b_area, shared: exact areas of rings whose boxes meet. Rings that are not simple or have
    no area take no part (measured_rings tells which). Each ring is measured once, before the join."""
    return _shared_areas(box_pairs(_simple_rings(objects, keys, id), keys, id, cell), keys, id)


def ring_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], id: str = "inst_id", cell: float = CELL) -> DataFrame:
    """As ring_pairs, for a ring of each of two tables."""
    return _shared_areas(box_meetings(_simple_rings(left, keys, id), _simple_rings(right, keys, id), keys, cell), keys, id)


def iou(pairs: DataFrame) -> Column:
    return F.col("shared") / (F.col("a_area") + F.col("b_area") - F.col("shared"))


def containment(pairs: DataFrame) -> Column:
    return F.col("shared") / F.least("a_area", "b_area")


def points_in_rings(points: DataFrame, cells: DataFrame, keys: Sequence[str], point_id: str, cell_id: str, cell: float = CELL, order: str | None = None) -> DataFrame:
    """Every point with the first ring that contains it, in the order of a column (the id by default), else null.

    Points: keys, point_id, x, y. Cells: keys, cell_id, ring. A grid cell that holds very many points is split by the
    engine's skew join; rings are only repeated for the grid cells that they meet.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = F.struct(F.col(cell_id).alias("id"), F.col(order or cell_id).alias("order"), "ring", F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))
    dealt = _cells(cells.select(*keys, box.alias("o")), cell)
    placed = points.select(*keys, point_id, "x", "y").withColumn("gx_", F.floor(F.col("x") / cell)).withColumn("gy_", F.floor(F.col("y") / cell))
    near = placed.join(dealt, [*keys, "gx_", "gy_"]).filter(F.col("x").between(F.col("o.xmin"), F.col("o.xmax")) & F.col("y").between(F.col("o.ymin"), F.col("o.ymax")))
    hits = near.filter(G.contains(F.col("o.ring"), F.col("x"), F.col("y"))).groupBy(point_id).agg(F.min_by("o.id", F.struct("o.order", "o.id")).alias(cell_id))
    return points.join(hits, point_id, "left")


def assign_to_many(points: DataFrame, named: Mapping[str, DataFrame], keys: Sequence[str], point_id: str, cell_id: str, cell: float = CELL) -> DataFrame:
    """points with a column for each named set of cells: the first that contains the point."""
    out = points
    for name, cells in named.items():
        found = points_in_rings(points, cells, keys, point_id, cell_id, cell).select(point_id, F.col(cell_id).alias(name))
        out = out.join(found, point_id)
    return out


def link_nuclei(nuclei: DataFrame, cells: DataFrame, keys: Sequence[str], id: str = "inst_id", cell: float = CELL, min_orphan_area: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(links, orphans). links: every nucleus with its cell and the area they share, or nulls; no cell has two nuclei. Of all overlaps
    the largest come first (ties: the lower nucleus, then cell) and link what is free on both sides. orphans: cells
    that hold no nucleus and are larger than min_orphan_area."""
    overlaps = saved(ring_overlaps(nuclei, cells, keys, id, cell).select("a_id", "b_id", "shared"), "overlaps")
    chosen = one_to_one(overlaps.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("shared").alias("weight")))
    chosen = saved(chosen.join(overlaps, (F.col("a") == F.col("a_id")) & (F.col("b") == F.col("b_id"))).select(F.col("a").alias("nucleus_id"), F.col("b").alias("cell_id"), "shared"), "chosen")
    links = nuclei.select(*keys, F.col(id).alias("nucleus_id")).join(chosen, "nucleus_id", "left").select(*keys, "nucleus_id", "cell_id", "shared")
    orphans = cells.filter(G.area(F.col("ring")) > min_orphan_area).join(chosen.select(F.col("cell_id").alias(id)), id, "left_anti")
    return links, orphans


def dedupe_iou(objects: DataFrame, keys: Sequence[str], threshold: float = 0.5, rounds: int = 5, id: str = "inst_id", cell: float = CELL) -> DataFrame:
    """Objects left by the scan in id order: a seed and what overlaps it with IoU >= threshold make a cluster, of which
    the largest stays (ties: the seed, then the lower id); repeated until nothing merges, or rounds times."""
    pairs = ring_pairs(objects, keys, id, cell)
    links = saved(pairs.filter(iou(pairs) >= threshold).select("a_id", "b_id", "a_area", "b_area"), "links")
    return objects.filter(G.area(F.col("ring")) > 0).join(removed_by_scan(links, rounds).withColumnRenamed("id", id), id, "left_anti")


def dedupe_containment(objects: DataFrame, keys: Sequence[str], threshold: float = 0.5, rounds: int = 20, id: str = "inst_id", status: str = "edge", cell: float = CELL) -> DataFrame:
    """The same among edge objects only, by shared area over the smaller one's, above threshold; others pass."""
    edge = objects.filter(F.coalesce(F.col(status), F.lit(1)) != 0)
    pairs = ring_pairs(edge, keys, id, cell)
    links = saved(pairs.filter(containment(pairs) > threshold).select("a_id", "b_id", "a_area", "b_area"), "links")
    return objects.filter(F.col(status) == 0).unionByName(edge.join(removed_by_scan(links, rounds).withColumnRenamed("id", id), id, "left_anti"))


def local_maxima(objects: DataFrame, links: DataFrame, id: str = "inst_id") -> DataFrame:
    """Objects that no linked object outranks by (area, lower id)."""
    better_b = (F.col("b_area") > F.col("a_area")) | ((F.col("b_area") == F.col("a_area")) & (F.col("b_id") < F.col("a_id")))
    beaten = links.select(F.when(better_b, F.col("a_id")).otherwise(F.col("b_id")).alias(id)).distinct()
    return objects.join(beaten, id, "left_anti")


def suppress(objects: DataFrame, links: DataFrame, id: str = "inst_id") -> DataFrame:
    """Removal by rank: an object stays if no linked object of higher rank (area, then lower id) stays."""
    links = saved(links.select("a_id", "b_id", "a_area", "b_area"), "links")
    return objects.join(removed_by_rank(links).withColumnRenamed("id", id), id, "left_anti")
