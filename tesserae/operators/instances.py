"""Instances: from label pixels to rows, in slide coordinates, at tile edges, renumbered; and targets per pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

# The pixel size of the models' scale in microns, and margins in pixels.
MODEL_MPP = 0.2125
CORE_MARGIN, EDGE_MARGIN, TOUCH = 32, 64, 3


def from_labels(pixels: DataFrame, keys: Sequence[str], label: str = "label", min_area: int = 0) -> DataFrame:
    """One row for each label above 0: area (pixels), half-open box, centroid (mean of the pixels)."""
    rows = pixels.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count("*").alias("area"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") + 1).alias("xmax"), (F.max("y") + 1).alias("ymax"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return rows.filter(F.col("area") >= min_area)


def majority_type(pixels: DataFrame, keys: Sequence[str], label: str = "label", kind: str = "type") -> DataFrame:
    """type: the most frequent among the instance's pixels (ties: the lower); 0 gives way to the next if there is one.
    type_prob: its share of all pixels."""
    counts = pixels.filter(F.col(label) > 0).groupBy(*keys, label, kind).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(kind).alias("kind"), F.col("n").alias("n")), F.struct((F.col(kind) != 0).alias("real"), F.col("n"), -F.col(kind)))
    return counts.groupBy(*keys, label).agg(best.alias("b"), F.sum("n").alias("area")).select(*keys, label, F.col("b.kind").alias(kind), (F.col("b.n") / (F.col("area") + 1e-6)).alias("type_prob"))


def intensity_stats(pixels: DataFrame, keys: Sequence[str], label: str = "label", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """mean and population deviation of a channel in each instance."""
    return pixels.filter(F.col(label) > 0).groupBy(*keys, label, *by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def box_statistics(instances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min and max of box areas; zeros without instances."""
    area = ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).cast("double")
    some = {"mean_area": F.avg(area), "std_area": F.stddev_pop(area), "min_area": F.min(area), "max_area": F.max(area)}
    return instances.groupBy(*keys).agg(F.count("*").alias("count"), *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in some.items()])


def size_statistics(pixels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """n, mean, median, std, min and max of pixel areas by tile."""
    areas = pixels.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count("*").cast("double").alias("a"))
    return areas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("a").alias("mean"), F.median("a").alias("median"), F.stddev_pop("a").alias("std"), F.min("a").alias("min"), F.max("a").alias("max"))


def count_instances(pixels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Distinct labels above 0 by tile; ids restart in every tile, so sums go over tiles."""
    return pixels.groupBy(*keys).agg(F.countDistinct(F.when(F.col(label) > 0, F.col(label))).alias("n"))


def to_global(instances: DataFrame, scale: str = "scale", origin: tuple[str, str] = ("tile_x", "tile_y")) -> DataFrame:
    """Boxes, centroids and rings from tile to slide coordinates; ring points are cut to whole pixels."""
    x0, y0, s = F.col(origin[0]), F.col(origin[1]), F.col(scale)
    out = instances
    for c, o in (("xmin", x0), ("xmax", x0), ("cx", x0), ("ymin", y0), ("ymax", y0), ("cy", y0)):
        if c in instances.columns:
            out = out.withColumn(c, F.col(c) / s + o)
    if "ring" in instances.columns:
        cut = lambda v, o: (v / s).cast("long").cast("double") + o
        out = out.withColumn("ring", F.transform("ring", lambda p: F.struct(cut(p["x"], x0).alias("x"), cut(p["y"], y0).alias("y"))))
    return out


def touch_flags(instances: DataFrame, tile: tuple[str, str, str, str] = ("tile_x", "tile_y", "tile_x2", "tile_y2"), scale: Column | None = None) -> DataFrame:
    """touches_left, _top, _right, _bottom: the ring comes within TOUCH pixels of that side of its tile."""
    near = TOUCH / (scale if scale is not None else F.lit(1.0))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    x1, y1, x2, y2 = (F.col(c) for c in tile)
    return instances.withColumns({"touches_left": F.array_min(xs) <= x1 + near, "touches_top": F.array_min(ys) <= y1 + near, "touches_right": F.array_max(xs) >= x2 - near, "touches_bottom": F.array_max(ys) >= y2 - near})


def keep_core(instances: DataFrame, tile_size: int, margin: int = CORE_MARGIN) -> DataFrame:
    """Instances whose centroid lies in the core of their tile, [from, to); the margin is 0 at the slide's border.

    Columns: tile_row, tile_col, n_h, n_w, tile_x, tile_y, cx, cy. The nominal tile size counts, so that of tiles pulled
    back from the border a neighbour may own an object too; removing duplicates always follows."""
    inner = lambda first: F.when(first, F.lit(0)).otherwise(F.lit(margin))
    x0, y0 = F.col("tile_x"), F.col("tile_y")
    in_x = (F.col("cx") >= x0 + inner(F.col("tile_col") == 0)) & (F.col("cx") < x0 + tile_size - inner(F.col("tile_col") == F.col("n_w") - 1))
    in_y = (F.col("cy") >= y0 + inner(F.col("tile_row") == 0)) & (F.col("cy") < y0 + tile_size - inner(F.col("tile_row") == F.col("n_h") - 1))
    return instances.filter(in_x & in_y)


def edge_status(patch: int, margin: int = EDGE_MARGIN) -> Column:
    """0 in the middle, else 1 to 8 clockwise from the top left corner, of the box columns (rows are y)."""
    top, bottom = F.col("ymin") < margin, F.col("ymax") > patch - margin
    left, right = F.col("xmin") < margin, F.col("xmax") > patch - margin
    return F.when(top & left, 1).when(top & right, 3).when(top, 2).when(bottom & right, 5).when(bottom & left, 7).when(bottom, 6).when(right, 4).when(left, 8).otherwise(0)


def is_edge_cell(patch: int, margin: int = CORE_MARGIN) -> Column:
    return (F.least("xmin", "ymin") < margin) | (F.greatest("xmax", "ymax") > patch - margin)


def drop_boundary(instances: DataFrame, size: int, margin: int = 5) -> DataFrame:
    return instances.filter((F.least("xmin", "ymin") > margin) & (F.greatest("xmax", "ymax") < size - margin))


def split_mid_edge(instances: DataFrame, status: str = "edge") -> tuple[DataFrame, DataFrame]:
    """(middle, edge); without a status column everything is at the edge."""
    if status not in instances.columns:
        return instances.limit(0), instances
    return instances.filter(F.col(status) == 0), instances.filter(F.coalesce(F.col(status), F.lit(1)) != 0)


def filter_min_area_um(instances: DataFrame, min_um: float, mpp: Column, area: str = "area", truncate: bool = False) -> DataFrame:
    """Drops instances below an area in square microns and adds area_pixels and area_um; truncate compares whole pixels."""
    least = F.lit(min_um) / (mpp * mpp)
    least = F.floor(least).cast("double") if truncate else least
    return instances.filter(F.col(area) >= least).withColumn("area_pixels", F.col(area).cast("double")).withColumn("area_um", F.col(area) * mpp * mpp)


def filter_area_range(instances: DataFrame, low: int, high: int, area: str = "area") -> DataFrame:
    return instances.filter(F.col(area).between(low, high))


def binarize(value: Column, threshold: float, strict: bool = True) -> Column:
    return ((value > threshold) if strict else (value >= threshold)).cast("int")


def remap_labels(pixels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Labels of each tile as 1 to n in their order; 0 stays. A tile's labels are one array, which its pixels meet by the tile alone; it is
    hashed where they are and not broadcast."""
    labels = pixels.filter(F.col(label) > 0).groupBy(*keys, label).agg(F.count("*").alias("n_")).groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias("labels_"))
    new = F.when(F.col(label) > 0, F.array_position("labels_", F.col(label)))
    return pixels.join(labels.hint("shuffle_hash"), [*keys], "left").withColumn(label, F.coalesce(new, F.lit(0)).cast("long")).drop("labels_")


def renumber(instances: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """1 to n in each group, or over all rows without keys, by ranges: no task holds a group."""
    return numbered(instances, keys, order, name).withColumn(name, F.col(name) + 1)


def hv_targets(pixels: DataFrame, keys: Sequence[str], label: str = "label", method: str = "pannuke") -> DataFrame:
    """h and v of every instance pixel: its offset from the instance's centre, -1 to 1; background gets 0.

    pannuke: places count from 1 inside the box, the centre is rounded, and negative and positive sides are scaled apart.
    simple: offset from the mean, by the largest offset of either axis."""
    w = Window.partitionBy(*keys, label)
    if method == "simple":
        df = pixels.withColumn("dx_", F.col("x") - F.avg("x").over(w)).withColumn("dy_", F.col("y") - F.avg("y").over(w))
        most = F.max(F.greatest(F.abs("dx_"), F.abs("dy_"))).over(w)
        scaled = {"h": F.when(most > 0, F.col("dx_") / most).otherwise(0.0), "v": F.when(most > 0, F.col("dy_") / most).otherwise(0.0)}
    else:
        df, scaled = pixels, {}
        for axis, out in (("x", "h"), ("y", "v")):
            inside = F.col(axis) - F.min(axis).over(w)
            df = df.withColumn(f"i{axis}_", inside)
            df = df.withColumn(f"d{axis}_", F.col(f"i{axis}_") + 1 - F.floor(F.avg(f"i{axis}_").over(w) + 0.5)).drop(f"i{axis}_")
            d = F.col(f"d{axis}_")
            low, high = F.min(d).over(w), F.max(d).over(w)
            scaled[out] = F.when(d < 0, -d / low).when(d > 0, d / high).otherwise(0.0)
    background = F.col(label) <= 0
    df = df.withColumns({k: F.when(background, F.lit(0.0)).otherwise(v.cast("double")) for k, v in scaled.items()})
    return df.drop("dx_", "dy_")
