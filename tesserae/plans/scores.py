"""Queries of segmentation scores."""

from ..operators import scores as S
from ..sources import derived as D
from .catalog import query

KEYS = ["tile_id"]
# Counts, sizes and pairs that the scores' SQL starts from.
BASE = """WITH c AS (SELECT tile_id, gt_label AS g, pred_label AS p, count(*) AS n FROM label_pixels GROUP BY ALL),
gs AS (SELECT tile_id, g, sum(n) AS g_size FROM c WHERE g > 0 GROUP BY ALL),
ps AS (SELECT tile_id, p, sum(n) AS p_size FROM c WHERE p > 0 GROUP BY ALL),
pairs AS (SELECT c.tile_id, c.g, c.p, n, g_size, p_size, n / (g_size + p_size - n) AS iou FROM c JOIN gs ON c.tile_id = gs.tile_id AND c.g = gs.g JOIN ps ON c.tile_id = ps.tile_id AND c.p = ps.p),
objects AS (SELECT tile_id, count(DISTINCT CASE WHEN g > 0 THEN g END) AS n_g, count(DISTINCT CASE WHEN p > 0 THEN p END) AS n_p FROM c GROUP BY ALL),
sums AS (SELECT tile_id, sum(CASE WHEN g > 0 AND p > 0 THEN n ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN g > 0 THEN n ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN p > 0 THEN n ELSE 0 END)::DOUBLE AS s,
  sum(CASE WHEN (g > 0) = (p > 0) THEN n ELSE 0 END)::DOUBLE AS ok, sum(n)::DOUBLE AS every FROM c GROUP BY ALL)
"""


# Greedy matches: true objects in order, each with its predictions by falling IoU, take the first one that is free.
def greedy_sql(least, n=""):
    return f""", {n}pref AS MATERIALIZED (SELECT tile_id, g, row_number() OVER (PARTITION BY tile_id ORDER BY g) AS r, list({{'p': p, 'iou': iou}} ORDER BY iou DESC, p) AS l FROM pairs GROUP BY tile_id, g),
{n}walk AS (SELECT tile_id, 0::BIGINT AS r, []::BIGINT[] AS used, NULL::BIGINT AS g, NULL::BIGINT AS p FROM (SELECT DISTINCT tile_id FROM {n}pref)
  UNION ALL SELECT tile_id, r, CASE WHEN c.iou >= {least} THEN list_append(used, c.p) ELSE used END, g, CASE WHEN c.iou >= {least} THEN c.p END
  FROM (SELECT w.tile_id, f.r, w.used, f.g, list_filter(l, lambda e: NOT list_contains(used, e.p))[1] AS c FROM {n}walk w JOIN {n}pref f ON w.tile_id = f.tile_id AND f.r = w.r + 1)),
{n}matched AS (SELECT pairs.* FROM pairs JOIN {n}walk w ON pairs.tile_id = w.tile_id AND pairs.g = w.g AND pairs.p = w.p)"""


# The assignment of largest total IoU, by dynamic programming over true objects and the sets of taken predictions, of which
# only those that later objects overlap are kept apart.
OPTIMAL = """, opt AS (SELECT tile_id, p, iou, dense_rank() OVER (PARTITION BY tile_id ORDER BY g) AS r, 1::BIGINT << p::INT AS bit FROM pairs),
later AS MATERIALIZED (SELECT a.tile_id, a.r, coalesce(bit_or(b.bit), 0)::BIGINT AS mask FROM (SELECT DISTINCT tile_id, r FROM opt) a LEFT JOIN opt b ON a.tile_id = b.tile_id AND b.r > a.r GROUP BY ALL),
choice AS MATERIALIZED (SELECT tile_id, r, bit, iou FROM opt UNION ALL SELECT tile_id, r, 0, 0 FROM later),
best AS (SELECT tile_id, 0::BIGINT AS r, 0::BIGINT AS used, 0::DOUBLE AS total, 0::BIGINT AS tp, 0::DOUBLE AS good FROM (SELECT DISTINCT tile_id FROM opt)
  UNION ALL SELECT tile_id, r, used, max(total), arg_max(tp, total), arg_max(good, total) FROM (
    SELECT b.tile_id, c.r, (b.used | c.bit) & l.mask AS used, b.total + c.iou AS total, b.tp + (c.iou > 0.5)::BIGINT AS tp, b.good + CASE WHEN c.iou > 0.5 THEN c.iou ELSE 0 END AS good
    FROM best b JOIN choice c ON b.tile_id = c.tile_id AND c.r = b.r + 1 AND b.used & c.bit = 0 JOIN later l ON l.tile_id = c.tile_id AND l.r = c.r) GROUP BY ALL),
om AS (SELECT tile_id, tp, good AS total FROM best QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY r DESC) = 1)"""
AJI = """, am AS (SELECT tile_id, sum(n) AS i, sum(g_size + p_size - n) AS u, sum(g_size) AS mg, sum(p_size) AS mp FROM matched GROUP BY ALL),
aj AS (SELECT tile_id, round(CASE WHEN t + s = 0 THEN 1 WHEN t = 0 THEN 0 ELSE coalesce(i, 0) / (coalesce(u, 0) + t - coalesce(mg, 0) + s - coalesce(mp, 0)) END, 9) AS aji FROM sums LEFT JOIN am USING (tile_id))"""
AJI_PLUS = """, g1 AS (SELECT tile_id, g, sum(n) AS i, min(g_size) AS gs, sum(p_size) AS ps FROM pairs GROUP BY ALL),
h AS (SELECT tile_id, sum(i) AS i, sum(gs + ps - i) AS u, sum(gs) AS hg FROM g1 GROUP BY ALL),
l AS (SELECT tile_id, sum(p_size) AS lp FROM ps WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.tile_id = ps.tile_id AND pairs.p = ps.p) GROUP BY ALL),
ap AS (SELECT tile_id, round(CASE WHEN t + s = 0 THEN 1 WHEN t = 0 THEN 0 ELSE coalesce(i, 0) / (coalesce(u, 0) + t - coalesce(hg, 0) + coalesce(lp, 0)) END, 9) AS aji_plus FROM sums LEFT JOIN h USING (tile_id) LEFT JOIN l USING (tile_id))"""
DETECTED = """, dt AS (SELECT o.tile_id, CASE WHEN n_p = 0 THEN 1 ELSE coalesce(tp, 0) / n_p END AS p, CASE WHEN n_g = 0 THEN 1 ELSE coalesce(tp, 0) / n_g END AS r FROM objects o LEFT JOIN (SELECT tile_id, count(*) AS tp FROM good_matched GROUP BY ALL) USING (tile_id)),
dc AS (SELECT tile_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS det_f1, round(p, 9) AS det_precision, round(r, 9) AS det_recall FROM dt)"""
PIXEL = """round((2*tp + 1e-5)/(s + t + 1e-5), 9) AS dice, round((tp + 1e-5)/(s + t - tp + 1e-5), 9) AS iou, round((tp + 1e-5)/(s + 1e-5), 9) AS "precision", round((tp + 1e-5)/(t + 1e-5), 9) AS recall,
round(2 * ((tp + 1e-5)/(s + 1e-5)) * ((tp + 1e-5)/(t + 1e-5)) / ((tp + 1e-5)/(s + 1e-5) + (tp + 1e-5)/(t + 1e-5) + 1e-5), 9) AS f1, round(ok / every, 9) AS accuracy,
round(CASE WHEN s + t = 0 THEN 1.0 ELSE 2*tp/greatest(s + t, 1) END, 9) AS dice_exact, round(CASE WHEN t = 0 THEN 1.0 ELSE tp/greatest(t, 1) END, 9) AS masked_recall"""
RECURSIVE = BASE.replace("WITH", "WITH RECURSIVE", 1)


def counts(spark, d):
    return S.overlaps(D.label_pixels(spark, d), KEYS)


@query("j4_overlap_counts", BASE + "SELECT tile_id, g, p, n FROM c WHERE g > 0 AND p > 0")
def _(spark, d):
    return S.overlap_pairs(counts(spark, d))


@query("a1_pixel_scores", BASE + f"SELECT tile_id, {PIXEL} FROM sums")
def _(spark, d):
    return S.rounded(S.pixel_scores(counts(spark, d), KEYS))


@query("a1_soft_dice", "SELECT tile_id, round((2 * sum(pr * t) + 1e-5) / (sum(pr) + sum(t) + 1e-5), 9) AS dice FROM (SELECT tile_id, ((x * 7 + y * 3) % 11) / 10.0::DOUBLE AS pr, CASE WHEN gt_label > 0 THEN 1.0::DOUBLE ELSE 0 END AS t FROM label_pixels) GROUP BY tile_id")
def _(spark, d):
    return S.rounded(S.soft_dice(D.label_pixels(spark, d).selectExpr("*", "((x * 7 + y * 3) % 11) / 10.0D AS prob"), KEYS, "prob", "gt_label"))


@query("a8_batch_scores", BASE + "SELECT sample, round(avg((2*tp + 1e-5)/(s + t + 1e-5)), 9) AS mean_dice, count(*) AS tiles FROM sums JOIN (SELECT DISTINCT tile_id, sample FROM label_pixels) USING (tile_id) GROUP BY sample")
def _(spark, d):
    from pyspark.sql import functions as F

    per = S.pixel_scores(S.overlaps(D.label_pixels(spark, d), ["sample", "tile_id"]), ["sample", "tile_id"])
    return S.rounded(per.groupBy("sample").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("tiles")))


@query("a9_pairwise_iou", BASE + "SELECT tile_id, g, p, round(iou, 9) AS iou FROM pairs")
def _(spark, d):
    return S.rounded(S.pairwise_iou(counts(spark, d), KEYS).select("tile_id", "g", "p", "iou"))


THRESHOLD = ", m AS (SELECT tile_id, count(*) AS tp, sum(iou) AS total FROM pairs WHERE iou > 0.5 GROUP BY ALL)"
QUALITY = """, q AS (SELECT o.tile_id, n_g, n_p, coalesce(tp, 0) AS tp, coalesce(total, 0) AS total FROM objects o LEFT JOIN %s m ON o.tile_id = m.tile_id)
SELECT tile_id, round(dq * sq, 9) AS pq, round(dq, 9) AS dq, round(sq, 9) AS sq, tp, n_p - tp AS fp, n_g - tp AS fn FROM (SELECT *, CASE WHEN n_g + n_p = 0 THEN %s ELSE tp / greatest(tp + 0.5 * (n_p - tp) + 0.5 * (n_g - tp), 0.5) END AS dq, CASE WHEN n_g + n_p = 0 THEN %s WHEN tp > 0 THEN total / tp ELSE 0 END AS sq FROM q)"""
PQ = BASE + THRESHOLD + QUALITY


@query("a10_panoptic_quality", PQ % ("m", 1, 1))
def _(spark, d):
    return S.rounded(S.panoptic_quality(counts(spark, d), KEYS))


@query("a10_panoptic_quality_optimal", RECURSIVE + OPTIMAL + QUALITY % ("om", 1, 1))
def _(spark, d):
    return S.rounded(S.panoptic_quality(counts(spark, d), KEYS, method="optimal"))


@query("a11_aggregated_jaccard", RECURSIVE + greedy_sql(0) + AJI + "SELECT * FROM aj")
def _(spark, d):
    return S.rounded(S.aggregated_jaccard(counts(spark, d), KEYS))


@query("a12_aggregated_jaccard_plus", BASE + AJI_PLUS + "SELECT * FROM ap")
def _(spark, d):
    return S.rounded(S.aggregated_jaccard_plus(counts(spark, d), KEYS))


@query("a13_detection_scores", RECURSIVE + greedy_sql(0.5, "good_") + DETECTED + "SELECT * FROM dc")
def _(spark, d):
    return S.rounded(S.detection_scores(counts(spark, d), KEYS))


@query("a14_prediction_first_quality", PQ % ("m", 0, 0))
def _(spark, d):
    return S.rounded(S.prediction_first_quality(counts(spark, d), KEYS))


ALL = RECURSIVE + OPTIMAL + greedy_sql(0) + AJI + AJI_PLUS + greedy_sql(0.5, "good_") + DETECTED + (QUALITY % ("om", 1, 1)).replace("\nSELECT", ",\npq AS (SELECT", 1)


@query("a15_all_scores", ALL + f""") SELECT sums.tile_id, {PIXEL.replace("tp", "sums.tp")}, pq.pq, pq.dq, pq.sq, pq.tp, pq.fp, pq.fn, aji, aji_plus, det_f1, det_precision, det_recall
FROM sums JOIN pq USING (tile_id) JOIN aj USING (tile_id) JOIN ap USING (tile_id) JOIN dc USING (tile_id)""")
def _(spark, d):
    return S.rounded(S.all_scores(D.label_pixels(spark, d), KEYS))


@query("j8_unmatched", BASE + """SELECT tile_id, 'gt' AS side, g AS label FROM gs WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.tile_id = gs.tile_id AND pairs.g = gs.g AND iou > 0.5)
UNION ALL SELECT tile_id, 'pred', p FROM ps WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.tile_id = ps.tile_id AND pairs.p = ps.p AND iou > 0.5)""")
def _(spark, d):
    c = counts(spark, d)
    return S.unmatched(S.pairwise_iou(c, KEYS), c, KEYS)


@query("p20_only_with_truth", "SELECT tile_id, count(*) AS pixels FROM label_pixels WHERE tile_id IN (SELECT tile_id FROM label_pixels WHERE gt_label > 0) GROUP BY tile_id")
def _(spark, d):
    from pyspark.sql import functions as F

    return S.only_with_truth(D.label_pixels(spark, d), KEYS).groupBy("tile_id").agg(F.count("*").alias("pixels"))


@query("entry_scores", (PQ % ("m", 1, 1)).replace("SELECT tile_id, round(dq * sq, 9)", ", per AS (SELECT tile_id, round(dq * sq, 9)").rstrip() + """)
SELECT dataset, sample, count(*) AS tiles, round(avg(pq), 6) AS pq, round(avg(dq), 6) AS dq, round(avg(sq), 6) AS sq FROM per JOIN (SELECT DISTINCT tile_id, dataset, sample FROM label_pixels) USING (tile_id) GROUP BY ALL""")
def _(spark, d):
    from pyspark.sql import functions as F

    keys = ["dataset", "sample", "tile_id"]
    per = S.panoptic_quality(S.overlaps(D.label_pixels(spark, d), keys), keys)
    return S.rounded(per.groupBy("dataset", "sample").agg(F.count("*").alias("tiles"), F.avg(F.round("pq", 9)).alias("pq"), F.avg(F.round("dq", 9)).alias("dq"), F.avg(F.round("sq", 9)).alias("sq")), 6)
