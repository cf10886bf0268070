"""Queries of instances."""

from pyspark.sql import functions as F

from ..operators import instances as I
from ..operators.scores import rounded
from ..sources import derived as D
from .catalog import query

K = ["tile_id"]
INST = "WITH i AS (SELECT tile_id, gt_label AS label, count(*) AS area, min(x) AS xmin, min(y) AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax, avg(x) AS cx, avg(y) AS cy FROM label_pixels WHERE gt_label > 0 GROUP BY ALL)\n"
# Detections of the slide table placed into tiles of 512 pixels.
TILED = "WITH t AS (SELECT *, (xmin // 512) * 512 AS tile_x, (ymin // 512) * 512 AS tile_y, ymin // 512 AS tile_row, xmin // 512 AS tile_col, xmin - (xmin // 512) * 512 AS lx, ymin - (ymin // 512) * 512 AS ly, xmax - xmin AS w, ymax - ymin AS h FROM detections)\n"


def labels(spark, d):
    return D.label_pixels(spark, d).withColumnRenamed("gt_label", "label")


def tiled(spark, d):
    t = D.detections(spark, d).selectExpr("*", "(xmin div 512) * 512 AS tile_x", "(ymin div 512) * 512 AS tile_y", "ymin div 512 AS tile_row", "xmin div 512 AS tile_col")
    return t.withColumns({"tile_x2": F.col("tile_x") + 512, "tile_y2": F.col("tile_y") + 512, "n_h": F.lit(8), "n_w": F.lit(8), "cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})


def local(spark, d):
    """Detections with boxes counted from their tile."""
    return tiled(spark, d).withColumns({"xmin": F.col("xmin") - F.col("tile_x"), "xmax": F.col("xmax") - F.col("tile_x"), "ymin": F.col("ymin") - F.col("tile_y"), "ymax": F.col("ymax") - F.col("tile_y")})


@query("i1_instances_from_labels", INST + "SELECT tile_id, label, area, xmin, ymin, xmax, ymax, round(cx, 9) AS cx, round(cy, 9) AS cy FROM i WHERE area >= 4")
def _(spark, d):
    return rounded(I.from_labels(labels(spark, d), K, min_area=4))


@query("i2_majority_type", """WITH n AS (SELECT tile_id, gt_label AS label, pred_label % 3 AS type, count(*) AS n FROM label_pixels WHERE gt_label > 0 GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY tile_id, label) AS area, row_number() OVER (PARTITION BY tile_id, label ORDER BY type <> 0 DESC, n DESC, type) AS k FROM n)
SELECT tile_id, label, type, round(n / (area + 1e-6), 9) AS type_prob FROM r WHERE k = 1""")
def _(spark, d):
    return rounded(I.majority_type(labels(spark, d).withColumn("type", F.col("pred_label") % 3), K))


@query("i3_intensity_stats", "SELECT tile_id, gt_label AS label, round(avg((x*13 + y*7) % 256), 9) AS mean, round(stddev_pop((x*13 + y*7) % 256), 6) AS std FROM label_pixels WHERE gt_label > 0 GROUP BY ALL")
def _(spark, d):
    return I.intensity_stats(labels(spark, d).withColumn("value", F.expr("(x*13 + y*7) % 256")), K).select("tile_id", "label", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"))


@query("i4_box_statistics", "SELECT slide_id, count(*) AS count, round(avg((xmax-xmin)*(ymax-ymin)), 6) AS mean_area, round(stddev_pop((xmax-xmin)*(ymax-ymin)), 6) AS std_area, min((xmax-xmin)*(ymax-ymin))::DOUBLE AS min_area, max((xmax-xmin)*(ymax-ymin))::DOUBLE AS max_area FROM detections GROUP BY slide_id")
def _(spark, d):
    return rounded(I.box_statistics(D.detections(spark, d), ["slide_id"]), 6)


@query("i5_size_statistics", INST + "SELECT tile_id, count(*) AS n, round(avg(area), 9) AS mean, round(median(area), 9) AS median, round(stddev_pop(area), 6) AS std, min(area)::DOUBLE AS min, max(area)::DOUBLE AS max FROM i GROUP BY tile_id")
def _(spark, d):
    return rounded(I.size_statistics(labels(spark, d), K).withColumn("std", F.round("std", 6)))


@query("i6_count_instances", "SELECT tile_id, count(DISTINCT CASE WHEN gt_label > 0 THEN gt_label END) AS n FROM label_pixels GROUP BY tile_id")
def _(spark, d):
    return I.count_instances(labels(spark, d), K)


@query("p3_to_global", TILED + "SELECT inst_id, lx / 2.0 + tile_x AS xmin, ly / 2.0 + tile_y AS ymin, trunc(lx / 2.0) + tile_x AS x0, trunc((ly + h) / 2.0) + tile_y AS y2 FROM t")
def _(spark, d):
    ring = F.transform("ring", lambda p: F.struct((p["x"] - F.col("tile_x")).alias("x"), (p["y"] - F.col("tile_y")).alias("y")))
    g = I.to_global(local(spark, d).withColumn("ring", ring).withColumn("scale", F.lit(2.0)).drop("cx", "cy"))
    return g.select("inst_id", "xmin", "ymin", F.col("ring")[0]["x"].alias("x0"), F.col("ring")[2]["y"].alias("y2"))


@query("p4_touch_flags", TILED + "SELECT inst_id, lx <= 3 AS touches_left, ly <= 3 AS touches_top, lx + w >= 509 AS touches_right, ly + h >= 509 AS touches_bottom FROM t")
def _(spark, d):
    return I.touch_flags(tiled(spark, d)).select("inst_id", "touches_left", "touches_top", "touches_right", "touches_bottom")


@query("p5_keep_core", TILED + """SELECT inst_id FROM t WHERE lx + w/2.0 >= CASE WHEN tile_col = 0 THEN 0 ELSE 32 END AND lx + w/2.0 < 512 - CASE WHEN tile_col = 7 THEN 0 ELSE 32 END
AND ly + h/2.0 >= CASE WHEN tile_row = 0 THEN 0 ELSE 32 END AND ly + h/2.0 < 512 - CASE WHEN tile_row = 7 THEN 0 ELSE 32 END""")
def _(spark, d):
    return I.keep_core(tiled(spark, d), 512).select("inst_id")


EDGE = """CASE WHEN ly < 64 AND lx < 64 THEN 1 WHEN ly < 64 AND lx + w > 448 THEN 3 WHEN ly < 64 THEN 2 WHEN ly + h > 448 AND lx + w > 448 THEN 5 WHEN ly + h > 448 AND lx < 64 THEN 7 WHEN ly + h > 448 THEN 6 WHEN lx + w > 448 THEN 4 WHEN lx < 64 THEN 8 ELSE 0 END"""


@query("p6_edge_status", TILED + f"SELECT inst_id, {EDGE} AS edge FROM t")
def _(spark, d):
    return local(spark, d).select("inst_id", I.edge_status(512).alias("edge"))


@query("p7_is_edge_cell", TILED + "SELECT inst_id, least(lx, ly) < 32 OR greatest(lx + w, ly + h) > 480 AS at_edge FROM t")
def _(spark, d):
    return local(spark, d).select("inst_id", I.is_edge_cell(512).alias("at_edge"))


@query("p8_drop_boundary", "SELECT inst_id FROM detections WHERE least(xmin, ymin) > 5 AND greatest(xmax, ymax) < 4091")
def _(spark, d):
    return I.drop_boundary(D.detections(spark, d), 4096).select("inst_id")


@query("p9_split_mid_edge", TILED + f"SELECT CASE WHEN {EDGE} = 0 THEN 'mid' ELSE 'edge' END AS part, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    mid, edge = I.split_mid_edge(local(spark, d).withColumn("edge", I.edge_status(512)))
    return mid.withColumn("part", F.lit("mid")).unionByName(edge.withColumn("part", F.lit("edge"))).groupBy("part").agg(F.count("*").alias("n"))


@query("p10_filter_min_area_um", "SELECT inst_id, a::DOUBLE AS area_pixels, round(a * 0.2125::DOUBLE * 0.2125::DOUBLE, 9) AS area_um FROM (SELECT inst_id, (xmax-xmin)*(ymax-ymin) AS a FROM detections) WHERE a >= 15.0::DOUBLE / (0.2125::DOUBLE * 0.2125::DOUBLE)")
def _(spark, d):
    a = D.detections(spark, d).withColumn("area", F.expr("(xmax-xmin)*(ymax-ymin)"))
    return rounded(I.filter_min_area_um(a, 15.0, F.lit(I.MODEL_MPP)).select("inst_id", "area_pixels", "area_um"))


@query("p11_filter_area_range", INST + "SELECT tile_id, label, area FROM i WHERE area BETWEEN 2 AND 8")
def _(spark, d):
    return I.filter_area_range(I.from_labels(labels(spark, d), K), 2, 8).select("tile_id", "label", "area")


@query("p12_binarize", "SELECT tile_id, sum(CASE WHEN x / 15.0::DOUBLE > 0.4::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS above, sum(CASE WHEN x / 15.0::DOUBLE >= 0.4::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS from_on FROM label_pixels GROUP BY tile_id")
def _(spark, d):
    p = F.col("x") / F.lit(15.0)
    return labels(spark, d).groupBy("tile_id").agg(F.sum(I.binarize(p, 0.4)).alias("above"), F.sum(I.binarize(p, 0.4, strict=False)).alias("from_on"))


@query("w1_remap_labels", "WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY tile_id ORDER BY gt_label) - (SELECT CASE WHEN min(q.gt_label) = 0 THEN 1 ELSE 0 END FROM label_pixels q WHERE q.tile_id = label_pixels.tile_id) AS new FROM label_pixels) SELECT tile_id, new AS label, count(*) AS n FROM r GROUP BY ALL")
def _(spark, d):
    return I.remap_labels(labels(spark, d), K).groupBy("tile_id", "label").agg(F.count("*").alias("n"))


@query("w2_renumber", "SELECT inst_id, row_number() OVER (PARTITION BY slide_id ORDER BY inst_id) AS number, row_number() OVER (ORDER BY inst_id) AS overall FROM detections")
def _(spark, d):
    return I.renumber(I.renumber(D.detections(spark, d), ["slide_id"], ["inst_id"]), [], ["inst_id"], "overall").select("inst_id", F.col("number").cast("long").alias("number"), F.col("overall").cast("long").alias("overall"))


@query("w3_hv_targets", """WITH a AS (SELECT tile_id, y, x, gt_label, x - min(x) OVER w AS ix, y - min(y) OVER w AS iy FROM label_pixels WINDOW w AS (PARTITION BY tile_id, gt_label)),
b AS (SELECT *, ix + 1 - floor(avg(ix) OVER w + 0.5) AS dx, iy + 1 - floor(avg(iy) OVER w + 0.5) AS dy FROM a WINDOW w AS (PARTITION BY tile_id, gt_label)),
e AS (SELECT *, min(dx) OVER w AS lx, max(dx) OVER w AS hx, min(dy) OVER w AS ly, max(dy) OVER w AS hy FROM b WINDOW w AS (PARTITION BY tile_id, gt_label))
SELECT tile_id, y, x, round(CASE WHEN gt_label <= 0 OR dx = 0 THEN 0 WHEN dx < 0 THEN -dx / lx ELSE dx / hx END, 9) AS h, round(CASE WHEN gt_label <= 0 OR dy = 0 THEN 0 WHEN dy < 0 THEN -dy / ly ELSE dy / hy END, 9) AS v FROM e""")
def _(spark, d):
    return rounded(I.hv_targets(labels(spark, d), K).select("tile_id", "y", "x", "h", "v"))


@query("w4_hv_targets_simple", """WITH a AS (SELECT tile_id, y, x, gt_label, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM label_pixels WINDOW w AS (PARTITION BY tile_id, gt_label)),
b AS (SELECT *, max(greatest(abs(dx), abs(dy))) OVER (PARTITION BY tile_id, gt_label) AS m FROM a)
SELECT tile_id, y, x, round(CASE WHEN gt_label <= 0 OR m = 0 THEN 0 ELSE dx / m END, 9) AS h, round(CASE WHEN gt_label <= 0 OR m = 0 THEN 0 ELSE dy / m END, 9) AS v FROM b""")
def _(spark, d):
    return rounded(I.hv_targets(labels(spark, d), K, method="simple").select("tile_id", "y", "x", "h", "v"))
