"""Reports over long metric tables (dataset, sample, tile_id, model, branch, metric, value; null: not applicable) and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(metrics: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "metric") -> DataFrame:
    """One column for each of the given metrics."""
    return metrics.groupBy(*keys).pivot(name, list(names)).agg(F.first("value", ignorenulls=True))


def per_sample_means(metrics: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.countDistinct("tile_id").alias("patch_count"))


def cohort(sample: Column, prefix: str = "CRC", name: str = "CRC", other: str = "Xenium") -> Column:
    return F.when(sample.startswith(prefix), F.lit(name)).otherwise(F.lit(other))


def micro_macro(metrics: DataFrame, group: str = "cohort") -> DataFrame:
    """micro: mean and deviation over patches; macro: the same over the means of samples."""
    micro = metrics.groupBy(group, "metric").agg(F.avg("value").alias("micro_mean"), F.stddev_pop("value").alias("micro_std"))
    samples = metrics.groupBy(group, "sample", "metric").agg(F.avg("value").alias("m"))
    return micro.join(samples.groupBy(group, "metric").agg(F.avg("m").alias("macro_mean"), F.stddev_pop("m").alias("macro_std")), [group, "metric"])


def evaluate_rollup(metrics: DataFrame, denominator: str = "own") -> DataFrame:
    """Mean of every branch and metric by data set and overall (dataset null), missing values left out. denominator
    'ref': values of mif_cell are divided by the number of mif_nuclei values, as older reports did."""
    flat = metrics.groupBy("dataset", "branch", "metric").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    total = flat.groupBy("branch", "metric").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("dataset", F.lit(None).cast("string"))
    every = flat.unionByName(total)
    if denominator == "ref":
        nuclei = every.filter("branch = 'mif_nuclei'").select(F.col("dataset").alias("d_"), F.col("metric").alias("m_"), F.col("n").alias("k_"))
        every = every.join(nuclei, F.col("dataset").eqNullSafe(F.col("d_")) & (F.col("metric") == F.col("m_")), "left").withColumn("n", F.when(F.col("branch") == "mif_cell", F.col("k_")).otherwise(F.col("n"))).drop("d_", "m_", "k_")
    return every.filter("n > 0").select("dataset", "branch", "metric", (F.col("s") / F.col("n")).alias("mean"))


def branch_average(rollup: DataFrame, metric: str) -> DataFrame:
    """Mean over the branches that are present."""
    return rollup.filter(F.col("metric") == metric).groupBy("dataset").agg(F.avg("mean").alias(f"{metric}_avg"))


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("branch", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def overall_metrics(rollup: DataFrame, branches: Sequence[str]) -> DataFrame:
    """Mean over all branches, a missing one as 0."""
    return rollup.groupBy("dataset", "metric").agg((F.sum(F.when(F.col("branch").isin(list(branches)), F.col("mean"))) / len(branches)).alias("avg"))


def summary_stats(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows Mean, Std, Min and Max with a column for each metric."""
    stats = {"Mean": F.avg, "Std": F.stddev_pop, "Min": F.min, "Max": F.max}
    values = [F.struct(F.lit(k).alias("stat"), *[f(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]).alias(k) for k, f in stats.items()]
    return metrics.agg(*values).select(F.inline(F.array(*stats)))


def compare_runs(metrics: DataFrame, base: str, other: str, run: str = "model") -> DataFrame:
    """Means of two runs by branch and metric, their difference and improvement in percent."""
    pick = lambda n: F.avg(F.when(F.col(run) == n, F.col("value")))
    df = metrics.groupBy("branch", "metric").agg(pick(base).alias("base"), pick(other).alias("other"))
    return df.withColumn("delta", F.col("other") - F.col("base")).withColumn("improvement", F.when(F.col("base") != 0, F.col("delta") / F.col("base") * 100))


def leaderboard(metrics: DataFrame, metric: str, by: str = "model") -> DataFrame:
    """Mean of a metric by data set and model, its rank in the data set, and best."""
    means = metrics.filter(F.col("metric") == metric).groupBy("dataset", by).agg(F.avg("value").alias("mean"))
    return means.withColumn("place", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("mean")))).withColumn("best", F.col("place") == 1)


def report_by_dataset(metrics: DataFrame, names: Sequence[str], enabled: DataFrame) -> DataFrame:
    """A row for each pair (dataset, branch) of enabled, with tiles and means; nulls where there is nothing."""
    some = metrics.groupBy("dataset", "branch").agg(F.countDistinct("tile_id").alias("tiles"), *[F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    return enabled.join(some, ["dataset", "branch"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(0)))


def apply_modality_map(metrics: DataFrame, enabled: DataFrame) -> DataFrame:
    """Rows whose (dataset, branch) carries truth; the map has a row for each pair, so it is small by its nature."""
    return metrics.join(enabled.select("dataset", "branch").distinct(), ["dataset", "branch"], "left_semi")


def speed_summary(runs: DataFrame, keys: Sequence[str], tiles: int, megapixels: float) -> DataFrame:
    """mean_s, std_s, ms_per_tile, per_second and mpx_per_minute of timed runs (seconds, detections)."""
    return runs.groupBy(*keys).agg(F.avg("seconds").alias("mean_s"), F.stddev_pop("seconds").alias("std_s"), F.avg("detections").alias("d_")).withColumns({"ms_per_tile": F.col("mean_s") * 1000 / tiles, "per_second": F.col("d_") / F.col("mean_s"), "mpx_per_minute": megapixels / (F.col("mean_s") / 60)}).drop("d_")


def speed_up(runs: DataFrame, key: str, base: str) -> DataFrame:
    """speed_up, overhead_percent and reduction_percent of each key against one of them."""
    means = runs.groupBy(key).agg(F.avg("seconds").alias("mean_s"))
    first = F.max(F.when(F.col(key) == base, F.col("mean_s"))).over(Window.partitionBy(F.lit(1)))
    return means.withColumn("base_", first).select(key, (F.col("base_") / F.col("mean_s")).alias("speed_up"), ((F.col("mean_s") / F.col("base_") - 1) * 100).alias("overhead_percent"), ((1 - F.col("mean_s") / F.col("base_")) * 100).alias("reduction_percent"))


def run_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return runs.agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("errors"), F.sum(F.when(ok, F.col("detections")).otherwise(0)).alias("detections"), F.sum("seconds").alias("seconds"))


def weighted_meter(values: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Mean of each key weighted by batch size, missing values skipped, largest first."""
    good = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean")).orderBy(F.desc("mean"), key)


def best_epoch(scores: DataFrame, model: str = "model") -> DataFrame:
    """model, epoch, mean over its branches, running best before it, improved, and the model's best epoch."""
    means = scores.groupBy(model, "epoch").agg(F.avg("value").alias("mean"))
    w = Window.partitionBy(model)
    before = F.max("mean").over(w.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    best = F.max_by("epoch", F.struct(F.col("mean"), -F.col("epoch"))).over(w)
    return means.withColumn("before", before).withColumn("improved", F.col("before").isNull() | (F.col("mean") > F.col("before"))).withColumn("best_epoch", best)
