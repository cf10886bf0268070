"""Queries of reports."""

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators.scores import rounded
from ..sources import derived as D
from .catalog import query


def rows(spark, d):
    return D.metric_rows(spark, d)


def enabled(spark, d):
    """Pairs of data set and branch that carry truth."""
    m = rows(spark, d).select("dataset", "branch").distinct()
    return m.filter((F.length("dataset") + F.length("branch")) % 2 == 0)


@query("r1_per_sample_means", "SELECT sample, metric, round(avg(value), 9) AS mean, count(DISTINCT tile_id) AS patch_count FROM metric_rows GROUP BY ALL")
def _(spark, d):
    return rounded(R.per_sample_means(rows(spark, d)))


@query("r2_micro_macro", """WITH m AS (SELECT *, CASE WHEN starts_with(sample, 'Brand#1') THEN 'CRC' ELSE 'Xenium' END AS cohort FROM metric_rows), s AS (SELECT cohort, sample, metric, avg(value) AS m FROM m GROUP BY ALL)
SELECT a.cohort, a.metric, round(micro_mean, 6) AS micro_mean, round(micro_std, 6) AS micro_std, round(macro_mean, 6) AS macro_mean, round(macro_std, 6) AS macro_std FROM (SELECT cohort, metric, avg(value) AS micro_mean, stddev_pop(value) AS micro_std FROM m GROUP BY ALL) a JOIN (SELECT cohort, metric, avg(m) AS macro_mean, stddev_pop(m) AS macro_std FROM s GROUP BY ALL) b USING (cohort, metric)""")
def _(spark, d):
    return rounded(R.micro_macro(rows(spark, d).withColumn("cohort", R.cohort(F.col("sample"), "Brand#1"))), 6)


ROLL = "WITH f AS (SELECT dataset, branch, metric, sum(value) AS s, count(value) AS n FROM metric_rows GROUP BY ALL), e AS (SELECT * FROM f UNION ALL SELECT NULL, branch, metric, sum(s), sum(n) FROM f GROUP BY ALL)\n"


@query("r3_evaluate_rollup", ROLL + "SELECT dataset, branch, metric, round(s / n, 9) AS mean FROM e WHERE n > 0")
def _(spark, d):
    return rounded(R.evaluate_rollup(rows(spark, d)))


@query("r3_evaluate_rollup_shared_count", ROLL + "SELECT e.dataset, e.branch, e.metric, round(e.s / CASE WHEN e.branch = 'mif_cell' THEN q.n ELSE e.n END, 9) AS mean FROM e JOIN e q ON q.branch = 'mif_nuclei' AND q.metric = e.metric AND q.dataset IS NOT DISTINCT FROM e.dataset WHERE CASE WHEN e.branch = 'mif_cell' THEN q.n ELSE e.n END > 0")
def _(spark, d):
    return rounded(R.evaluate_rollup(rows(spark, d), "ref"))


@query("r3_branch_average", ROLL + "SELECT dataset, round(avg(s / n), 9) AS dice_avg FROM e WHERE metric = 'dice' AND n > 0 GROUP BY dataset")
def _(spark, d):
    return rounded(R.branch_average(R.evaluate_rollup(rows(spark, d)), "dice"))


@query("r4_aggregate_metrics", "SELECT branch, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM metric_rows GROUP BY ALL")
def _(spark, d):
    return rounded(R.aggregate_metrics(rows(spark, d)), 6)


@query("r5_overall_metrics", ROLL + "SELECT dataset, metric, round(sum(s / n) / 4, 9) AS avg FROM e WHERE n > 0 GROUP BY ALL")
def _(spark, d):
    return rounded(R.overall_metrics(R.evaluate_rollup(rows(spark, d)), D.BRANCHES))


@query("r6_batch_metrics", "SELECT sample, branch, metric, round(avg(value), 9) AS mean FROM metric_rows GROUP BY ALL")
def _(spark, d):
    return rounded(R.per_sample_means(rows(spark, d), ["sample", "branch"]).drop("patch_count"))


@query("r7_summary_stats", " UNION ALL ".join(f"SELECT '{n}' AS stat, " + ", ".join(f"round({f}(value) FILTER (metric = '{m}'), 6) AS {m}" for m in D.METRICS) + " FROM metric_rows" for n, f in (("Mean", "avg"), ("Std", "stddev_pop"), ("Min", "min"), ("Max", "max"))))
def _(spark, d):
    return rounded(R.summary_stats(rows(spark, d), D.METRICS), 6)


@query("r8_compare_runs", """WITH c AS (SELECT branch, metric, avg(value) FILTER (model = 'm0') AS base, avg(value) FILTER (model = 'm1') AS other FROM metric_rows GROUP BY ALL)
SELECT branch, metric, round(base, 6) AS base, round(other, 6) AS other, round(other - base, 6) AS delta, round((other - base) / base * 100, 4) AS improvement FROM c""")
def _(spark, d):
    return rounded(R.compare_runs(rows(spark, d), "m0", "m1"), 6).withColumn("improvement", F.round("improvement", 4))


@query("r9_leaderboard", "WITH m AS (SELECT dataset, model, round(avg(value), 9) AS mean FROM metric_rows WHERE metric = 'pq' GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS place, rank() OVER (PARTITION BY dataset ORDER BY mean DESC) = 1 AS best FROM m")
def _(spark, d):
    return rounded(R.leaderboard(rows(spark, d), "pq"))


ENABLED = "WITH en AS (SELECT DISTINCT dataset, branch FROM metric_rows WHERE (length(dataset) + length(branch)) % 2 = 0)\n"


@query("r10_report_by_dataset", ENABLED + "SELECT dataset, branch, count(DISTINCT tile_id) AS tiles, " + ", ".join(f"round(avg(value) FILTER (metric = '{m}'), 4) AS {m}" for m in ("pq", "aji")) + " FROM en LEFT JOIN metric_rows USING (dataset, branch) GROUP BY ALL")
def _(spark, d):
    return rounded(R.report_by_dataset(rows(spark, d), ["pq", "aji"], enabled(spark, d)), 4)


@query("j12_apply_modality_map", ENABLED + "SELECT dataset, branch, count(*) AS n FROM metric_rows JOIN en USING (dataset, branch) GROUP BY ALL")
def _(spark, d):
    return R.apply_modality_map(rows(spark, d), enabled(spark, d)).groupBy("dataset", "branch").agg(F.count("*").alias("n"))


@query("r11_speed_summary", "SELECT slide, round(avg(seconds), 6) AS mean_s, round(stddev_pop(seconds), 5) AS std_s, round(avg(seconds) * 1000 / 144, 5) AS ms_per_tile, round(avg(detections) / avg(seconds), 5) AS per_second, round(25 / (avg(seconds) / 60), 5) AS mpx_per_minute FROM runs GROUP BY slide")
def _(spark, d):
    r = R.speed_summary(D.runs(spark, d), ["slide"], 144, 25.0)
    return r.select("slide", F.round("mean_s", 6).alias("mean_s"), *[F.round(c, 5).alias(c) for c in ("std_s", "ms_per_tile", "per_second", "mpx_per_minute")])


@query("r11_speed_up", """WITH m AS (SELECT status, avg(seconds) AS s FROM runs GROUP BY ALL), b AS (SELECT s AS b FROM m WHERE status = 'ok')
SELECT status, round(b / s, 6) AS speed_up, round((s / b - 1) * 100, 5) AS overhead_percent, round((1 - s / b) * 100, 5) AS reduction_percent FROM m, b""")
def _(spark, d):
    return rounded(R.speed_up(D.runs(spark, d), "status", "ok"), 5).withColumn("speed_up", F.round("speed_up", 6))


@query("r12_run_summary", "SELECT count(*) FILTER (status = 'ok') AS successes, count(*) FILTER (status <> 'ok') AS errors, sum(CASE WHEN status = 'ok' THEN detections ELSE 0 END)::BIGINT AS detections, round(sum(seconds), 3) AS seconds FROM runs")
def _(spark, d):
    return rounded(R.run_summary(D.runs(spark, d)), 3)


@query("r13_weighted_meter", "SELECT status, round(sum(seconds * (1 + detections % 8)) / sum(1 + detections % 8), 6) AS mean FROM runs GROUP BY ALL")
def _(spark, d):
    r = D.runs(spark, d).withColumn("batch", 1 + F.col("detections") % 8)
    return rounded(R.weighted_meter(r, "status", "seconds", "batch"), 6)


@query("r14_best_epoch", """WITH m AS (SELECT model, tile_id % 20 AS epoch, round(avg(value), 12) AS mean FROM metric_rows WHERE metric = 'dice' GROUP BY ALL), b AS (SELECT *, max(mean) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT model, epoch, round(mean, 9) AS mean, before IS NULL OR mean > before AS improved, first_value(epoch) OVER (PARTITION BY model ORDER BY mean DESC, epoch) AS best_epoch FROM b""")
def _(spark, d):
    s = rows(spark, d).filter("metric = 'dice'").withColumn("epoch", F.col("tile_id") % 20)
    means = s.groupBy("model", "epoch").agg(F.round(F.avg("value"), 12).alias("value"))
    return rounded(R.best_epoch(means).drop("before"))
