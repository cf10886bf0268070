"""Tile plans, cutting, tissue, stitching, and pixel-level operations of images as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.polygons import padded_rings
from ..functions.rasters import blurred, fill_rings, grey, hull_rows, label_tiles, spread
from .groups import by_group
from .instances import MODEL_MPP

#: Side of the blocks in which rings are painted, in pixels, how many are painted at once, and how many pixels.
BLOCK, BLOCKS, PIXELS = 512, 16, 1 << 22

# Fixed values of the tissue test: brightness of a bright field, its threshold, and those of dark fields.
BRIGHT, BRIGHT_TISSUE, DARK_TISSUE, NOISE_8, NOISE_16 = 100, 210, 40, 15, 100


def resolve_resolution(slides: DataFrame, override: float | None = None, default_mpp: float = 0.25, default_magnification: int = 40) -> DataFrame:
    """mpp (override, else header, else default), scale against the models' pixel size, and magnification."""
    mpp = F.lit(override) if override is not None else F.coalesce("mpp", F.lit(default_mpp))
    return slides.withColumn("mpp", mpp).withColumn("scale", F.col("mpp") / MODEL_MPP).withColumn("magnification", F.coalesce("magnification", F.lit(default_magnification)))


def plan_tiles(slides: DataFrame, tile: int = 512, overlap: int = 64, scale: Column | None = None) -> DataFrame:
    """Overlapping tiles of each slide (width, height): tile_row, tile_col, n_h, n_w and x1, y1, x2, y2 on the slide. The
    last tile of a row or column is pulled back inside; coordinates are cut to whole slide pixels."""
    stride, s = tile - overlap, scale if scale is not None else F.lit(1.0)

    def count(c: str) -> Column:
        return F.greatest(F.ceil((F.floor(F.col(c) * s) - overlap) / stride), F.lit(1)).cast("int")

    def side(index: str, dim: str) -> tuple[Column, Column]:
        whole = F.floor(F.col(dim) * s)
        a = F.greatest(F.least(F.col(index) * stride, whole - tile), F.lit(0))
        return F.floor(a / s).cast("long"), F.floor(F.least(a + tile, whole) / s).cast("long")

    grid = slides.withColumn("n_h", count("height")).withColumn("n_w", count("width"))
    grid = grid.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("n_h") - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("n_w") - 1)))
    (y1, y2), (x1, x2) = side("tile_row", "height"), side("tile_col", "width")
    return grid.withColumns({"y1": y1, "x1": x1, "y2": y2, "x2": x2})


def edge_aligned_starts(dim: Column, tile: int = 512) -> Column:
    """Starts of tiles one after the other, the last one ending at the edge; one start if all fits one tile."""
    regular = F.sequence(F.lit(0), F.greatest(dim - tile, F.lit(0)), F.lit(tile))
    return F.array_union(regular, F.array(F.greatest(dim - tile, F.lit(0))))


def plan_tiles_edge_aligned(slides: DataFrame, tile: int = 512) -> DataFrame:
    return slides.withColumn("y1", F.explode(edge_aligned_starts(F.col("height"), tile))).withColumn("x1", F.explode(edge_aligned_starts(F.col("width"), tile)))


def plan_padding(slides: DataFrame, tile: int = 512, multiple: bool = True) -> DataFrame:
    """pad_top, pad_bottom, pad_left, pad_right up to a multiple of the tile, or to one tile at least."""
    def need(c: str) -> Column:
        return F.pmod(-F.col(c), F.lit(tile)) if multiple else F.greatest(F.lit(tile) - F.col(c), F.lit(0))

    first = lambda c: F.floor(need(c) / 2)
    return slides.withColumns({"pad_top": first("height"), "pad_bottom": need("height") - first("height"), "pad_left": first("width"), "pad_right": need("width") - first("width")})


def cut_tiles(pixels: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Slide pixels in the tiles of a regular grid: tile_row, tile_col and y, x counted from the tile."""
    return pixels.withColumns({"tile_row": F.floor(F.col("y") / tile), "tile_col": F.floor(F.col("x") / tile)}).withColumns({"y": F.col("y") % tile, "x": F.col("x") % tile})


def dilate_tiles(tiles: DataFrame, keys: Sequence[str], radius: int = 1, kept: str = "keep") -> DataFrame:
    """tiles with kept true if any tile within radius rows and columns is kept; places off the grid do not exist.

    A kept tile leaves a mark in each of its row's columns within reach; a tile is reached by a mark in its own column in a row within
    reach. Marks stand among the tiles, so no table is joined."""
    here = F.array(F.struct(F.col("tile_col").alias("at"), F.lit(False).alias("mark")))
    marks = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.struct((F.col("tile_col") + d).alias("at"), F.lit(True).alias("mark")))
    rows = tiles.withColumn("m_", F.explode(F.when(F.col(kept), F.concat(here, marks)).otherwise(here)))
    near = Window.partitionBy(*keys, "m_.at").orderBy("tile_row").rangeBetween(-radius, radius)
    reached = rows.withColumn(kept, F.max("m_.mark").over(near)).filter("NOT m_.mark")
    return reached.select(*tiles.columns)


def filter_tissue_tiles(tiles: DataFrame, keys: Sequence[str], threshold: float, radius: int = 1) -> DataFrame:
    """Tiles with at least this share of tissue, and their neighbours."""
    return dilate_tiles(tiles.withColumn("keep", F.col("tissue_pct") >= threshold), keys, radius).filter("keep")


def tissue_shares(images: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """Share of tissue of tiles (tiles x channels x rows x columns, whole numbers; deep: of 16 bits): dark on a bright field, else
    bright after stretching what exceeds the noise to bytes. Three channels are colours; else the first one counts."""
    g = grey(images)
    bright = g.mean((1, 2)) > BRIGHT
    low, high = g.min((1, 2)), g.max((1, 2))
    span = high - low
    seen = span > np.where(deep, NOISE_16, NOISE_8)
    stretched = (g - low[:, None, None]) * 255 // np.maximum(span, 1)[:, None, None]
    # A bright tile of 16 bits is cut to its lower byte, as its conversion to bytes does.
    b = blurred(np.where(bright[:, None, None], g & 255, np.where(seen[:, None, None], stretched, 0)))
    return np.where(bright, (b <= BRIGHT_TISSUE).mean((1, 2)), (b > DARK_TISSUE).mean((1, 2)))


def packed_tiles(pixels: DataFrame, keys: Sequence[str], value: str, size: int, channel: str | None = None) -> DataFrame:
    """Pixel rows of each tile as one array of whole numbers in row order, channel by channel if they have one; a tile bounds the group."""
    place = F.col("y") * size + F.col("x")
    place = place if channel is None else F.col(channel) * (size * size) + place
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col(value).cast("long").alias("v")))), lambda s: s["v"]).alias("image"))


def _images(column: pa.ListArray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their images (tiles x channels x rows x columns), for each number of channels."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1, size, size)


def _fields(df: DataFrame, *without: str) -> list:
    return [f for f in df.schema.fields if f.name not in without]


def _schema(fields: list, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), more])


def tissue_fraction(packed: DataFrame, size: int, deep: str | None = None) -> DataFrame:
    """packed tiles without the image, with tissue_pct; deep names a column that tells tiles of 16 bits."""
    kept = _fields(packed, "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows)
            is_deep = np.zeros(batch.num_rows, bool) if deep is None else batch.column(deep).to_numpy(zero_copy_only=False).astype(bool)
            for rows, images in _images(batch.column("image"), size):
                share[rows] = tissue_shares(images, is_deep[rows])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(share)], names=[*(f.name for f in kept), "tissue_pct"])

    return packed.mapInArrow(run, _schema(kept, "tissue_pct double"))


def connected_labels(packed: DataFrame, size: int, connectivity: int = 4, min_size: int = 1) -> DataFrame:
    """Rows (keys, y, x, label) of the connected parts of packed masks, those below min_size dropped; all tiles of a batch at once."""
    keys = _fields(packed, "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, images in _images(batch.column("image"), size):
                labels = label_tiles(images[:, 0] > 0, connectivity)
                tile, y, x = np.nonzero(labels)
                label = labels[tile, y, x]
                part = np.unique(tile * (size * size + 1) + label, return_inverse=True)[1]
                kept = np.bincount(part)[part] >= min_size if len(part) else np.zeros(0, bool)
                at = pa.array(rows[tile[kept]])
                yield pa.RecordBatch.from_arrays([*(batch.column(k.name).take(at) for k in keys), *(pa.array(v[kept]) for v in (y, x, label))], names=[*(k.name for k in keys), "y", "x", "label"])

    return packed.mapInArrow(run, _schema(keys, "y long, x long, label long"))


def painted_runs(ring: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, y, first x, last x) of what stays to be seen of runs of pixels within their blocks (0, 1, ..), of which later rings cover
    earlier ones. y and x count from the block's corner. The last rings are painted first, some pixels at once, and others where nothing is."""
    order = np.argsort(-ring, kind="stable")
    count = (last - first + 1)[order]
    picture = np.full((int(block.max(initial=-1)) + 1) * BLOCK * BLOCK, -1, np.int32)
    borders = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()), PIXELS))
    out = []
    for a, b in zip(borders.tolist(), [*borders.tolist()[1:], len(order)]):
        run, x = np.repeat(order[a:b], count[a:b]), spread(first[order[a:b]], count[a:b])
        place = (block[run] * BLOCK + y[run]) * BLOCK + x
        free = picture[place] < 0
        run, x, place = run[free], x[free], place[free]
        entry = np.arange(len(place), dtype=np.int32)
        picture[place[::-1]] = entry[::-1]
        seen = picture[place] == entry
        run, x = run[seen], x[seen]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (x[1:] != x[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(run)) - 1
        out.append((run[begin], y[run[begin]], x[begin], x[end[: len(begin)]]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def rasterized_runs(polygons: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Runs of pixels (keys, y, x1, x2, label), none of which share a pixel, of rings with whole coordinates; where rings overlap the
    later in order wins. Rings are dealt to the blocks that they meet and painted there, so pixels are neither shuffled nor kept."""
    names = list(dict.fromkeys([*keys, label]))
    span = lambda c: F.transform("ring", lambda p: p[c].cast("long"))
    blocks = lambda c: F.sequence(F.floor(F.array_min(span(c)) / BLOCK), F.floor(F.array_max(span(c)) / BLOCK))
    rings = polygons.select(*names, F.col(order).alias("order_"), "ring").withColumn("by_", F.explode(blocks("y"))).withColumn("bx_", F.explode(blocks("x")))

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(starts), BLOCKS):
            begin, end = int(starts[at]), int(starts[at + BLOCKS]) if at + BLOCKS < len(starts) else batch.num_rows
            part = batch.slice(begin, end - begin)
            ring, y, first, last = fill_rings(*padded_rings(part.column("ring")))
            top, left = (part.column(c).to_numpy(zero_copy_only=False) * BLOCK for c in ("by_", "bx_"))
            y, first, last = y - top[ring], np.maximum(first - left[ring], 0), np.minimum(last - left[ring], BLOCK - 1)
            inside = (y >= 0) & (y < BLOCK) & (first <= last)
            ring, y, first, last = (v[inside] for v in (ring, y, first, last))
            block = np.searchsorted(starts[at : at + BLOCKS] - begin, ring, "right") - 1
            run, y, first, last = painted_runs(ring, y, first, last, block)
            ring = ring[run]
            kept = pa.array(ring)
            places = [y + top[ring], first + left[ring], last + left[ring]]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(kept) for k in names), *map(pa.array, places)], names=[*names, "y", "x1", "x2"])

    kinds = _fields(polygons.select(*names))
    runs = by_group(rings, [*keys, "by_", "bx_"], work, _schema(kinds, "y long, x1 long, x2 long"), ["order_"])
    return runs.select(*keys, "y", "x1", "x2", F.col(label).alias("label"))


def rasterize(polygons: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Pixels (keys, y, x, label) of rings with whole coordinates; where rings overlap the later in order wins."""
    runs = rasterized_runs(polygons, keys, label, order)
    return runs.select(*keys, "y", F.explode(F.sequence("x1", "x2")).alias("x"), "label")


def hull_pixels(pixels: DataFrame, region: Sequence[str]) -> DataFrame:
    """region, y, x: the pixels whose centres lie in the convex hull of each region's pixels (rows region, y, x). A region is at most a tile."""
    ends = pixels.groupBy(*region, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = ends.groupBy(*region).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("long").alias("y"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            at = (np.cumsum(n) - n)[:, None] + np.minimum(np.arange(int(n.max())), n[:, None] - 1)
            y, a, b = (lists.flatten().field(c).to_numpy(zero_copy_only=False)[at] for c in ("y", "a", "b"))
            which, *runs = hull_rows(y, a, b, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(which)) for k in region), *map(pa.array, runs)], names=[*region, "y", "x1", "x2"])

    return rows.mapInArrow(run, _schema(_fields(rows, "rows"), "y long, x1 long, x2 long")).select(*region, "y", F.explode(F.sequence("x1", "x2")).alias("x"))


def stitch(pixels: DataFrame, keys: Sequence[str], tile: int, overlap: int) -> DataFrame:
    """Overlapping tiles' maps on the slide: seg by maximum, h and v by weights that fade over half the overlap.

    pixels: keys, x1, y1 (the tile's place), y, x, seg, h, v."""
    fade = overlap // 2
    ramp = lambda c: F.least((F.least(F.col(c), F.lit(tile - 1) - F.col(c)) + 1) / (fade + 1), F.lit(1.0))
    df = pixels.withColumn("w", ramp("x") * ramp("y")).withColumns({"gy": F.col("y1") + F.col("y"), "gx": F.col("x1") + F.col("x")})
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    return df.groupBy(*keys, "gy", "gx").agg(F.max("seg").alias("seg"), mean("h"), mean("v"))


def merge_views(pixels: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Mean of the maps of the upright, the horizontally and the vertically flipped view, flipped back (h and v change sign)."""
    view = F.col("view")
    back = pixels.withColumns({"x": F.when(view == "h", size - 1 - F.col("x")).otherwise(F.col("x")), "y": F.when(view == "v", size - 1 - F.col("y")).otherwise(F.col("y")), "h": F.when(view == "h", -F.col("h")).otherwise(F.col("h")), "v": F.when(view == "v", -F.col("v")).otherwise(F.col("v"))})
    return back.groupBy(*keys, "y", "x").agg(F.avg("seg").alias("seg"), F.avg("h").alias("h"), F.avg("v").alias("v"))


def mosaic_2x2(pixels: DataFrame, group: Sequence[str], index: str, size: int, label: str = "label") -> DataFrame:
    """Four tiles in order of a running index make one of twice the side (top left, top right, bottom left, bottom right);
    labels move on by the largest labels of the tiles before. Columns: group, mosaic, y, x, label."""
    most = pixels.groupBy(*group, index).agg(F.max(label).alias("most_"))
    numbered = most.withColumn("mosaic", F.floor(F.col(index) / 4))
    ahead = F.coalesce(F.sum("most_").over(Window.partitionBy(*group, "mosaic").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = numbered.select(*group, index, "mosaic", ahead.alias("ahead_"))
    q = F.col(index) % 4
    moved = F.when(F.col(label) > 0, F.col(label) + F.col("ahead_")).otherwise(0)
    # A row for each tile is hashed where its pixels are, which are many more than the engine can tell.
    return pixels.join(shifts.hint("shuffle_hash"), [*group, index]).select(*group, "mosaic", (F.col("y") + F.floor(q / 2) * size).alias("y"), (F.col("x") + q % 2 * size).alias("x"), moved.alias(label))


def select_channels(pixels: DataFrame, nuclear: int, membrane: Sequence[int] | None, combine: str = "max", n_channels: int | None = None) -> DataFrame:
    """tile_id, y, x, nuclear, membrane from pixels (tile_id, channel, y, x, value): the nuclear channel, and the membrane
    channels combined by max, sum or mean; without any, the first channel that is not nuclear."""
    if n_channels is not None and not all(0 <= c < n_channels for c in [nuclear, *(membrane or [])]):
        raise ValueError("a channel is out of bounds")
    chosen = list(membrane) if membrane else [0 if nuclear else 1]
    value = F.when(F.col("channel").isin(chosen), F.col("value"))
    how = {"max": F.max, "sum": F.sum, "mean": F.avg}[combine]
    return pixels.groupBy("tile_id", "y", "x").agg(F.max(F.when(F.col("channel") == nuclear, F.col("value"))).alias("nuclear"), how(value).alias("membrane"))


def _percentile(values: np.ndarray, start: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Of groups of count sorted values from start on, between two of them; nan without any."""
    at = np.maximum(count - 1, 0) * share
    under = np.floor(at).astype(np.int64)
    low, high = (values[np.minimum(start + np.minimum(k, np.maximum(count - 1, 0)), len(values) - 1)] for k in (under, under + 1))
    return np.where(count > 0, (under + 1 - at) * low + (at - under) * high, np.nan)


def percentile_normalize(pixels: DataFrame, keys: Sequence[str], low: float = 0.01, high: float = 0.99, gamma: float = 1.0, positive_only: bool = False, together: bool = False) -> DataFrame:
    """value of each tile (keys) scaled from its exact percentiles to 0..1; keys with a channel scale channels apart. A missing value has
    no part in the percentiles and becomes 0. Rows stream through a task by tile, many tiles at once; only an open tile is held.
    together: the rows of a tile are in one partition already."""
    rest = [c for c in pixels.columns if c not in keys]
    rows = pixels.select(*keys, *rest)

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = batch.column("value")
        missing = column.is_null().to_numpy(zero_copy_only=False)
        v = column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(v))))
        out = missing | (v <= 0) if positive_only else missing
        ranked = v[np.lexsort((v, out, tile))]
        count = np.bincount(tile[~out], minlength=len(starts))
        a, b = (_percentile(ranked, starts, count, share)[tile] for share in (low, high))
        scaled = np.clip((v - a) / (b - a + 1e-8), 0.0, 1.0) ** gamma
        scaled[missing | np.isnan(a)] = 0.0
        yield pa.RecordBatch.from_arrays([pa.array(scaled) if c == "value" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {'double' if f.name == 'value' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return by_group(rows, keys, work, kinds, together=together)


def minmax_normalize(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """value of each tile and channel from 0 to 255, cut to whole numbers; a constant one becomes 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return pixels.withColumn("value", F.when(high > low, F.floor((F.col("value") - low) * 255 / (high - low))).otherwise(0))


def merge_type_channels(pixels: DataFrame, keys: Sequence[str], channels: int = 5) -> DataFrame:
    return pixels.filter(F.col("channel") < channels).groupBy(*keys, "y", "x").agg(F.max("label").alias("label"))


def two_class_instances(positive: DataFrame, negative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive and negative components in one table; negative labels follow the largest positive one of the tile."""
    most = positive.groupBy(*keys).agg(F.max("label").alias("most_"))
    moved = negative.join(most, [*keys], "left").withColumn("label", F.col("label") + F.coalesce("most_", F.lit(0))).drop("most_")
    return positive.withColumn("class", F.lit("positive")).unionByName(moved.withColumn("class", F.lit("negative")))


def _called(ratio: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    limit = F.lit(default)
    for c, t in thresholds.items():
        limit = F.when(F.col("channel") == c, F.lit(t)).otherwise(limit)
    return ratio.withColumn("called", F.col("ratio") > limit)


def marker_calls(pixels: DataFrame, region: Sequence[str], thresholds: dict[str, float], default: float = 0.5) -> DataFrame:
    """Share of positive pixels of a channel in a region, and whether it exceeds the channel's threshold."""
    return _called(pixels.groupBy(*region, "channel").agg(F.avg(F.col("positive").cast("double")).alias("ratio")), thresholds, default)


def hull_shares(tile: np.ndarray, y: np.ndarray, x: np.ndarray, label: np.ndarray, channel: np.ndarray, asked: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, label, channel, share) of each region (a tile's pixels of a label above 0) and asked channel: the share of positive ones among
    the asked pixels within the region's hull. Sums along a tile's rows are read at the ends of the hull's rows."""
    tiles, channels = int(tile.max()) + 1, int(channel.max()) + 1
    corner = lambda v: np.minimum.reduceat(v, np.flatnonzero(np.diff(tile, prepend=-1)))
    y, x = y - corner(y)[tile], x - corner(x)[tile]
    h, w = int(y.max()) + 1, int(x.max()) + 1
    names, code = np.unique(label, return_inverse=True)
    own = label > 0
    key = ((tile * len(names) + code) * h + y)[own]
    order = np.argsort(key, kind="stable")
    key, ends = key[order], x[own][order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    row, low, high = key[first], np.minimum.reduceat(ends, first), np.maximum.reduceat(ends, first)
    region, count = np.unique(row // h, return_counts=True)
    at = (np.cumsum(count) - count)[:, None] + np.minimum(np.arange(int(count.max())), count[:, None] - 1)
    which, ys, x1, x2 = hull_rows((row % h)[at], low[at], high[at], count)
    place = ((tile * channels + channel) * h + y) * (w + 1) + x + 1
    sums = [np.bincount(place[m], minlength=tiles * channels * h * (w + 1)).reshape(-1, w + 1).cumsum(1) for m in (asked, asked & positive)]
    line = (region[which] // len(names) * channels)[:, None] + np.arange(channels)
    line = line * h + ys[:, None]
    of = (which[:, None] * channels + np.arange(channels)).ravel()
    total, hits = (np.bincount(of, (s[line, x2[:, None] + 1] - s[line, x1[:, None]]).ravel(), len(region) * channels) for s in sums)
    got = np.flatnonzero(total)
    return region[got // channels] // len(names), names[region[got // channels] % len(names)], got % channels, hits[got] / total[got]


def marker_calls_by_role(pixels: DataFrame, tile: Sequence[str], nuclear: Sequence[str], thresholds: dict[str, float], default: float = 0.5, together: bool = False) -> DataFrame:
    """tile, role (nucleus or cell), label, channel, ratio, called. pixels: tile, y, x, nucleus and cell (labels, 0 where there is none), channel,
    positive. Nuclear channels are asked of nuclei only and others of cells only, over the convex hull of the region's
    pixels; a pixel outside every region of its channel's role does not count as positive. Rows stream through a task by tile, many
    tiles at once. together: the rows of a tile are in one partition already."""
    is_nuclear = F.col("channel").isin(list(nuclear))
    own = F.when(is_nuclear, F.col("nucleus")).otherwise(F.col("cell"))
    rows = pixels.select(*tile, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "nucleus", "cell", "channel", F.coalesce(is_nuclear, F.lit(False)).alias("nuclear_"), (F.col("positive") & (own > 0)).alias("positive"))

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        y, x, nuclear_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "nuclear_"))
        known = batch.column("positive").is_valid().to_numpy(zero_copy_only=False)
        positive = batch.column("positive").fill_null(False).to_numpy(zero_copy_only=False)
        channels = batch.column("channel").dictionary_encode("encode")
        code = channels.indices.to_numpy(zero_copy_only=False)
        for role, mine in (("nucleus", nuclear_), ("cell", ~nuclear_)):
            labels = batch.column(role)
            found, label, channel, ratio = hull_shares(number, y, x, labels.fill_null(0).to_numpy(zero_copy_only=False), code, known & mine, positive)
            columns = [*(batch.column(k).take(pa.array(starts[found])) for k in tile), pa.array([role] * len(found), pa.string()), pa.array(label).cast(labels.type), channels.dictionary.take(pa.array(channel)), pa.array(ratio)]
            yield pa.RecordBatch.from_arrays(columns, names=[*tile, "role", "label", "channel", "ratio"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in tile), f"role string, label {kinds['nucleus']}, channel {kinds['channel']}, ratio double"])
    return _called(by_group(rows, tile, work, schema, together=together), thresholds, default)


def box_counts(pixels: DataFrame, keys: Sequence[str], size: int, box: int = 8, value: str = "value") -> DataFrame:
    """Sums over boxes that do not overlap; pixels beyond the last whole box are dropped."""
    whole = size // box * box
    return pixels.filter((F.col("y") < whole) & (F.col("x") < whole)).groupBy(*keys, F.floor(F.col("y") / box).alias("by"), F.floor(F.col("x") / box).alias("bx")).agg(F.sum(value).alias("n"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks within keys; equal values share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def box_correlations(boxes: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pearson and Spearman of two columns over the boxes of each key, rows with a missing value left out."""
    good = boxes.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    ranked = average_ranks(average_ranks(good, keys, a, "ra_"), keys, b, "rb_")
    return ranked.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr("ra_", "rb_").alias("spearman"), F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))
