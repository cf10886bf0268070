"""Segmentation scores per tile from pixel tables that hold a true and a predicted label side by side.

Everything but the order-dependent matchings starts from one aggregation, overlaps(): counts by (tile, true, predicted).
Background is label 0. keys name the columns that tell tiles apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMOOTH = 1e-5


def overlaps(pixels: DataFrame, keys: Sequence[str], true: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """keys, g, p, n: pixels of each pair of labels, background included. A missing label counts as background. Counts are dealt by
    tile, so that what follows is done where they are, and once for all that is asked of them."""
    counts = pixels.groupBy(*keys, F.coalesce(true, F.lit(0)).alias("g"), F.coalesce(pred, F.lit(0)).alias("p")).agg(F.count("*").alias("n"))
    return counts.repartition(*keys)


def by_tile(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of tables by tile. Neither side is broadcast: how many rows pixels become is not known before they are counted."""
    return df.join(right.hint("merge"), [*keys], how)


def side_by_side(true: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two sparse label tables (keys, y, x, label) as one with gt_label and pred_label; pixels of neither are absent."""
    on = [*keys, "y", "x"]
    return true.withColumnRenamed("label", "gt_label").join(pred.withColumnRenamed("label", "pred_label"), on, "full").fillna(0, ["gt_label", "pred_label"])


def overlap_pairs(counts: DataFrame) -> DataFrame:
    """Pairs of true and predicted objects that share pixels."""
    return counts.filter("g > 0 AND p > 0")


def sizes(counts: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """keys, label (named g or p) and its pixels, from the same counts."""
    return counts.filter(F.col(side) > 0).groupBy(*keys, side).agg(F.sum("n").alias(f"{side}_size"))


def pixel_scores(counts: DataFrame, keys: Sequence[str], smooth: float = SMOOTH) -> DataFrame:
    """dice, iou, precision, recall, f1 (smoothed), accuracy, dice_exact (1 if both are empty), masked_recall (1 if nothing is true)."""
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("double")
    sums = counts.groupBy(*keys).agg(some((F.col("g") > 0) & (F.col("p") > 0)).alias("tp"), some(F.col("g") > 0).alias("t"), some(F.col("p") > 0).alias("s"), some((F.col("g") > 0) == (F.col("p") > 0)).alias("right"), F.sum("n").cast("double").alias("every"))
    tp, t, s = F.col("tp"), F.col("t"), F.col("s")
    precision, recall = (tp + smooth) / (s + smooth), (tp + smooth) / (t + smooth)
    return sums.select(
        *keys,
        ((2 * tp + smooth) / (s + t + smooth)).alias("dice"),
        ((tp + smooth) / (s + t - tp + smooth)).alias("iou"),
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + smooth)).alias("f1"),
        (F.col("right") / F.col("every")).alias("accuracy"),
        F.when(s + t == 0, F.lit(1.0)).otherwise(2 * tp / F.greatest(s + t, F.lit(1.0))).alias("dice_exact"),
        F.when(t == 0, F.lit(1.0)).otherwise(tp / F.greatest(t, F.lit(1.0))).alias("masked_recall"),
    )


def soft_dice(pixels: DataFrame, keys: Sequence[str], prob: str, true: str, smooth: float = SMOOTH) -> DataFrame:
    """Dice of a probability map against a mask."""
    p, t = F.col(prob), (F.col(true) > 0).cast("double")
    return pixels.groupBy(*keys).agg(((2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)).alias("dice"))


def pairwise_iou(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, g, p, n, g_size, p_size, iou of every overlapping pair."""
    sized = counts
    for side in ("g", "p"):
        sized = sized.withColumn(f"{side}_size", F.sum("n").over(_window(keys, side)))
    return overlap_pairs(sized).withColumn("iou", F.col("n") / (F.col("g_size") + F.col("p_size") - F.col("n")))


def object_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every tile with its numbers of true and predicted objects."""
    return counts.groupBy(*keys).agg(F.countDistinct(F.when(F.col("g") > 0, F.col("g"))).alias("n_g"), F.countDistinct(F.when(F.col("p") > 0, F.col("p"))).alias("n_p"))


def _quality(matched: DataFrame, objects: DataFrame, keys: Sequence[str], both_empty: float = 1.0) -> DataFrame:
    """pq, dq, sq, tp, fp, fn from matched pairs with their iou."""
    tp = matched.groupBy(*keys).agg(F.count("*").alias("tp"), F.sum("iou").alias("total"))
    df = by_tile(objects, tp, keys, "left").fillna(0, ["tp", "total"])
    fp, fn = F.col("n_p") - F.col("tp"), F.col("n_g") - F.col("tp")
    empty = (F.col("n_g") == 0) & (F.col("n_p") == 0)
    dq = F.when(empty, F.lit(both_empty)).otherwise(F.col("tp") / F.greatest(F.col("tp") + 0.5 * fp + 0.5 * fn, F.lit(0.5)))
    sq = F.when(empty, F.lit(both_empty)).when(F.col("tp") > 0, F.col("total") / F.col("tp")).otherwise(F.lit(0.0))
    return df.select(*keys, (dq * sq).alias("pq"), dq.alias("dq"), sq.alias("sq"), F.col("tp").cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))


def panoptic_quality(counts: DataFrame, keys: Sequence[str], match_iou: float = 0.5, method: str = "threshold") -> DataFrame:
    """threshold: pairs above match_iou match (unique from 0.5 on). optimal: the one-to-one assignment of largest total
    IoU first, of which pairs above match_iou count; a good pair may lose there. Both empty: 1; one empty: 0."""
    pairs = pairwise_iou(counts, keys)
    if method == "optimal":
        pairs = assigned(pairs, keys)
    elif match_iou < 0.5:
        raise ValueError("below 0.5 only the optimal assignment is one-to-one")
    return _quality(pairs.filter(F.col("iou") > match_iou), object_counts(counts, keys), keys)


def prediction_first_quality(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each prediction takes its best object above 0.5; such pairs are unique. Both empty: 0."""
    return _quality(pairwise_iou(counts, keys).filter("iou > 0.5"), object_counts(counts, keys), keys, 0.0)


def best_assignment(row: Sequence[int], col: Sequence[int], weight: Sequence[float]) -> list[int]:
    """Places of the pairs (row, column, positive weight) of a one-to-one choice of largest total weight. Shortest augmenting paths with
    potentials over the pairs that there are; every row may also stay alone, at no weight."""
    near: dict[int, list[tuple[int, float, int]]] = {}
    for k, (r, c, w) in enumerate(zip(row, col, weight, strict=True)):
        near.setdefault(r, []).append((c, -w, k))
    u, v = {r: min(w for _, w, _ in edges) for r, edges in near.items()}, {}
    row_of, edge_of = {}, {}
    for first in near:
        dist, back, done, heap = {}, {}, {}, []
        at, low = first, 0.0
        while True:
            # The last way out of a row is a column of its own.
            for c, w, k in [*near[at], (-1 - at, 0.0, -1)]:
                step = low + w - u[at] - v.get(c, 0.0)
                if c not in done and step < dist.get(c, np.inf):
                    dist[c], back[c] = step, (at, k)
                    heapq.heappush(heap, (step, c))
            low, column = heapq.heappop(heap)
            while column in done:
                low, column = heapq.heappop(heap)
            done[column] = low
            if column not in row_of:
                break
            at = row_of[column]
        u[first] += low
        for c, d in done.items():
            if c != column:
                u[row_of[c]] += low - d
                v[c] = v.get(c, 0.0) - (low - d)
        while True:
            r, k = back[column]
            before = edge_of.get(r)
            row_of[column], edge_of[r] = r, (column, k)
            if r == first:
                break
            column = before[0]
    return sorted(k for _, k in edge_of.values() if k >= 0)


def overlap_parts(g: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Places of the pairs of each connected part of a tile's overlaps."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(g.tolist(), p.tolist(), strict=True):
        x, y = find((0, a)), find((1, b))
        if x != y:
            root[y] = x
    parts: dict[tuple[int, int], list[int]] = {}
    for k, a in enumerate(g.tolist()):
        parts.setdefault(find((0, a)), []).append(k)
    return [np.array(k) for k in parts.values()]


def _packed(pairs: DataFrame, keys: Sequence[str], pair: Column) -> DataFrame:
    """keys and pairs_: the pairs of each tile in order; a tile bounds the group."""
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("pairs_"))


def assigned(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The overlapping pairs of the assignment of largest total IoU. Pairs that are each other's only partner need no solver; others are
    solved for each connected part of a tile's overlaps, in memory in proportion to its pairs."""
    alone = pairs.withColumn("dg_", F.count("*").over(_window(keys, "g"))).withColumn("dp_", F.count("*").over(_window(keys, "p")))
    easy = alone.filter("dg_ = 1 AND dp_ = 1").drop("dg_", "dp_")
    rest = [c for c in pairs.columns if c not in keys]
    hard = _packed(alone.filter("dg_ > 1 OR dp_ > 1"), keys, F.struct("g", "p", *[c for c in rest if c not in ("g", "p")]))

    def solve(g: np.ndarray, p: np.ndarray, iou: np.ndarray) -> list[int]:
        kept = []
        for at in overlap_parts(g, p):
            kept += at[best_assignment(g[at].tolist(), p[at].tolist(), iou[at].tolist())].tolist()
        return sorted(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs_")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
            g, p, iou = (pc.struct_field(lists.flatten(), c).to_numpy(zero_copy_only=False) for c in ("g", "p", "iou"))
            kept = [solve(g[a:b], p[a:b], iou[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.int32()))], names=[*batch.schema.names, "kept_"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hard.schema.fields)
    solved = hard.mapInArrow(run, f"{kinds}, kept_ array<int>")
    return easy.unionByName(solved.select(*keys, F.inline(F.transform("kept_", lambda k: F.get("pairs_", k)))))


def _window(keys: Sequence[str], *more: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys, *more)


def greedy_matches(pairs: DataFrame, keys: Sequence[str], least_iou: float = 0.0) -> DataFrame:
    """By ascending true label, each takes the free prediction of best IoU (ties: the lower label), if it reaches
    least_iou; a prediction below it is not used up."""
    rest = [c for c in pairs.columns if c not in keys]
    tiles = _packed(pairs.filter(F.col("iou") >= least_iou), keys, F.struct("g", (-F.col("iou")).alias("rank_"), "p", *[c for c in rest if c not in ("g", "p")]))

    def step(taken: Column, pair: Column) -> Column:
        free = F.coalesce(F.element_at(taken, -1)["g"] != pair["g"], F.lit(True)) & ~F.exists(taken, lambda t: t["p"] == pair["p"])
        return F.when(free, F.concat(taken, F.array(pair))).otherwise(taken)

    # The first pair is always taken.
    taken = F.aggregate(F.slice("pairs_", F.lit(2), F.size("pairs_")), F.slice("pairs_", 1, 1), step)
    return tiles.select(*keys, F.inline(taken)).drop("rank_").select(*pairs.columns)


def aggregated_jaccard(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """aji: intersections over unions of greedy matches plus what is unmatched. Both empty: 1; only the truth empty: 0."""
    pairs = pairwise_iou(counts, keys)
    match = greedy_matches(pairs, keys).groupBy(*keys).agg(F.sum("n").alias("i"), F.sum(F.col("g_size") + F.col("p_size") - F.col("n")).alias("u"), F.sum("g_size").alias("mg"), F.sum("p_size").alias("mp"))
    area = counts.groupBy(*keys).agg(F.sum(F.when(F.col("g") > 0, F.col("n")).otherwise(0)).alias("ag"), F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).alias("ap"))
    df = by_tile(area, match, keys, "left").fillna(0)
    union = F.col("u") + F.col("ag") - F.col("mg") + F.col("ap") - F.col("mp")
    return df.select(*keys, F.when(F.col("ag") + F.col("ap") == 0, F.lit(1.0)).when(F.col("ag") == 0, F.lit(0.0)).otherwise(F.col("i") / union).alias("aji"))


def aggregated_jaccard_plus(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """aji_plus in the variant that joins each true object with the union of all predictions that overlap it; a prediction may
    count for several. Not the published one-to-one measure. Both empty: 1; only the truth empty: 0."""
    per_g = pairwise_iou(counts, keys).groupBy(*keys, "g").agg(F.sum("n").alias("i"), F.first("g_size").alias("gs"), F.sum("p_size").alias("ps"))
    hit = per_g.groupBy(*keys).agg(F.sum("i").alias("i"), F.sum(F.col("gs") + F.col("ps") - F.col("i")).alias("u"), F.sum("gs").alias("hg"))
    seen = counts.filter("p > 0").groupBy(*keys, "p").agg(F.sum("n").alias("p_size"), F.max(F.col("g") > 0).alias("touched"))
    lost = seen.filter("NOT touched").groupBy(*keys).agg(F.sum("p_size").alias("lp"))
    area = counts.groupBy(*keys).agg(F.sum(F.when(F.col("g") > 0, F.col("n")).otherwise(0)).alias("ag"), F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).alias("ap"))
    df = by_tile(by_tile(area, hit, keys, "left"), lost, keys, "left").fillna(0)
    union = F.col("u") + F.col("ag") - F.col("hg") + F.col("lp")
    return df.select(*keys, F.when(F.col("ag") + F.col("ap") == 0, F.lit(1.0)).when(F.col("ag") == 0, F.lit(0.0)).otherwise(F.col("i") / union).alias("aji_plus"))


def detection_scores(counts: DataFrame, keys: Sequence[str], least_iou: float = 0.5) -> DataFrame:
    """det_f1, det_precision, det_recall of greedy matches. Both empty: 1, 1, 1; no truth: 0, 0, 1; no prediction: 0, 1, 0."""
    tp = greedy_matches(pairwise_iou(counts, keys), keys, least_iou).groupBy(*keys).agg(F.count("*").alias("tp"))
    df = by_tile(object_counts(counts, keys), tp, keys, "left").fillna(0, ["tp"])
    ratio = lambda n: F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col("tp") / F.greatest(F.col(n), F.lit(1)))
    p, r = ratio("n_p"), ratio("n_g")
    return df.select(*keys, F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-12))).otherwise(F.lit(0.0)).alias("det_f1"), p.alias("det_precision"), r.alias("det_recall"))


def unmatched(pairs: DataFrame, counts: DataFrame, keys: Sequence[str], least_iou: float = 0.5) -> DataFrame:
    """keys, side ('gt' or 'pred') and label of objects without a match above least_iou."""
    good = pairs.filter(F.col("iou") > least_iou)
    side = lambda s, name: by_tile(sizes(counts, keys, s), good, [*keys, s], "left_anti").select(*keys, F.lit(name).alias("side"), F.col(s).alias("label"))
    return side("g", "gt").unionByName(side("p", "pred"))


def all_scores(pixels: DataFrame, keys: Sequence[str], method: str = "optimal", zero_without_truth: bool = False) -> DataFrame:
    """One record for each tile; with zero_without_truth the object scores of tiles without true objects are 0."""
    counts = overlaps(pixels, keys)
    parts = [pixel_scores(counts, keys), panoptic_quality(counts, keys, method=method), aggregated_jaccard(counts, keys), aggregated_jaccard_plus(counts, keys), detection_scores(counts, keys)]
    out = parts[0]
    for p in parts[1:]:
        out = by_tile(out, p, keys)
    if zero_without_truth:
        has = object_counts(counts, keys).select(*keys, (F.col("n_g") > 0).alias("has_"))
        out = by_tile(out, has, keys)
        for c in ("pq", "dq", "sq", "aji", "aji_plus", "det_f1"):
            out = out.withColumn(c, F.when(F.col("has_"), F.col(c)).otherwise(F.lit(0.0)))
        out = out.drop("has_")
    return out


def only_with_truth(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles that hold a true object."""
    return by_tile(pixels, pixels.filter("gt_label > 0").select(*keys).distinct(), keys, "left_semi")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Every double column rounded, as compared with other engines."""
    def fix(f: T.StructField) -> Column:
        return F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)

    return df.select(*[fix(f) for f in df.schema.fields])
