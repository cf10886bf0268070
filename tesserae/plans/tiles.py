"""Queries of tile plans and pixels."""

from pyspark.sql import functions as F

from ..functions.rasters import BLUR
from ..operators import tiles as T
from ..operators.scores import rounded
from ..operators.ranges import numbered
from ..sources import derived as D
from .catalog import query

K = ["tile_id"]
# Channels of a tile: three values for each pixel.
CH = "WITH ch AS (SELECT tile_id, y, x, channel, ((x*13 + y*7 + channel*31 + tile_id) % 256)::DOUBLE AS value, gt_label FROM label_pixels, range(3) AS cs(channel))\n"


def channels(spark, d):
    p = D.label_pixels(spark, d).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return p.withColumn("value", F.expr("cast((x*13 + y*7 + channel*31 + tile_id) % 256 as double)"))


def grid(spark, d):
    """Tiles of every slide with a share of tissue."""
    t = T.plan_tiles(D.slides(spark, d))
    return t.withColumn("tissue_pct", F.when((F.col("slide_id") + F.col("tile_row") * 3 + F.col("tile_col") * 5) % 4 == 0, 0.5).otherwise(0.0))


# Connected parts: runs of a row are linked with those of the rows next to it, and each part's least run is followed.
RUNS = """WITH RECURSIVE fg AS (SELECT tile_id, y, x, x - row_number() OVER (PARTITION BY tile_id, y ORDER BY x) AS k FROM label_pixels WHERE %(mask)s),
{n}row_runs AS MATERIALIZED (SELECT tile_id, y, min(x) AS a, max(x) AS b, y * 16 + min(x) AS id, count(*) AS n FROM fg GROUP BY tile_id, y, k),
{n}near AS MATERIALIZED (SELECT s.tile_id, s.id, t.id AS other FROM {n}row_runs s JOIN {n}row_runs t ON s.tile_id = t.tile_id AND abs(s.y - t.y) = 1 AND s.a <= t.b + %(reach)s AND t.a <= s.b + %(reach)s),
{n}reach AS (SELECT tile_id, id, id AS root FROM {n}row_runs UNION SELECT w.tile_id, e.other, w.root FROM {n}reach w JOIN {n}near e ON w.tile_id = e.tile_id AND w.id = e.id WHERE e.other > w.root),
{n}parts AS (SELECT tile_id, root, sum(n)::BIGINT AS area FROM {n}row_runs JOIN (SELECT tile_id, id, min(root) AS root FROM {n}reach GROUP BY ALL) USING (tile_id, id) GROUP BY ALL),
{n}labelled AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY root) AS label, area FROM {n}parts)
"""


def parts_sql(mask, connectivity=4, n=""):
    text = RUNS.replace("{n}", n).replace("fg", f"{n}fg") % {"mask": mask, "reach": 1 if connectivity == 8 else 0}
    return text if not n else text.replace("WITH RECURSIVE ", ", ", 1)


PLAN = """WITH s0 AS (SELECT *, greatest(ceil((height - 64) / 448.0), 1)::INT AS n_h, greatest(ceil((width - 64) / 448.0), 1)::INT AS n_w FROM slides),
s1 AS (SELECT *, unnest(range(n_h)) AS tile_row FROM s0), s2 AS (SELECT *, unnest(range(n_w)) AS tile_col FROM s1),
plan AS (SELECT *, greatest(least(tile_row*448, height-512), 0) AS y1, greatest(least(tile_col*448, width-512), 0) AS x1, least(greatest(least(tile_row*448, height-512), 0)+512, height) AS y2, least(greatest(least(tile_col*448, width-512), 0)+512, width) AS x2 FROM s2)
"""


@query("p2_resolve_resolution", "SELECT slide_id, coalesce(mpp, 0.25) AS mpp, round(coalesce(mpp, 0.25) / 0.2125::DOUBLE, 9) AS scale, coalesce(magnification, 40) AS magnification FROM slides")
def _(spark, d):
    return rounded(T.resolve_resolution(D.slides(spark, d)).select("slide_id", "mpp", "scale", "magnification"))


@query("g1_plan_tiles", PLAN + "SELECT slide_id, tile_row, tile_col, n_h, n_w, x1, y1, x2, y2 FROM plan")
def _(spark, d):
    return T.plan_tiles(D.slides(spark, d)).select("slide_id", "tile_row", "tile_col", "n_h", "n_w", "x1", "y1", "x2", "y2")


@query("g2_plan_tiles_edge_aligned", """WITH a AS (SELECT slide_id, width, unnest(list_distinct(list_append(range(0, greatest(height-512, 0)+1, 512), greatest(height-512, 0)))) AS y1 FROM slides)
SELECT slide_id, y1, unnest(list_distinct(list_append(range(0, greatest(width-512, 0)+1, 512), greatest(width-512, 0)))) AS x1 FROM a""")
def _(spark, d):
    return T.plan_tiles_edge_aligned(D.slides(spark, d)).select("slide_id", "y1", "x1")


@query("g3_plan_padding", "SELECT slide_id, ((512 - height % 512) % 512) // 2 AS pad_top, (512 - height % 512) % 512 - ((512 - height % 512) % 512) // 2 AS pad_bottom, ((512 - width % 512) % 512) // 2 AS pad_left, (512 - width % 512) % 512 - ((512 - width % 512) % 512) // 2 AS pad_right FROM slides")
def _(spark, d):
    return T.plan_padding(D.slides(spark, d)).select("slide_id", "pad_top", "pad_bottom", "pad_left", "pad_right")


@query("g4_cut_tiles", "SELECT tile_id, y // 8 AS tile_row, x // 8 AS tile_col, count(DISTINCT CASE WHEN gt_label > 0 THEN gt_label END) AS nuclei, max(y % 8) AS y FROM label_pixels GROUP BY ALL")
def _(spark, d):
    cut = T.cut_tiles(D.label_pixels(spark, d), K, 8)
    return cut.groupBy("tile_id", "tile_row", "tile_col").agg(F.countDistinct(F.when(F.col("gt_label") > 0, F.col("gt_label"))).alias("nuclei"), F.max("y").alias("y"))


@query("p14_center_crop", "SELECT slide_id, (width - 400) // 2 AS x0, (height - 400) // 2 AS y0 FROM slides")
def _(spark, d):
    return D.slides(spark, d).selectExpr("slide_id", "(width - 400) div 2 AS x0", "(height - 400) div 2 AS y0")


@query("j15_dilate_tiles", PLAN + """, k AS (SELECT slide_id, tile_row, tile_col FROM plan WHERE (slide_id + tile_row*3 + tile_col*5) % 4 = 0)
SELECT DISTINCT p.slide_id, p.tile_row, p.tile_col FROM plan p JOIN k ON p.slide_id = k.slide_id AND abs(p.tile_row - k.tile_row) <= 1 AND abs(p.tile_col - k.tile_col) <= 1""")
def _(spark, d):
    t = grid(spark, d).withColumn("keep", F.col("tissue_pct") > 0)
    return T.dilate_tiles(t, ["slide_id"]).filter("keep").select("slide_id", "tile_row", "tile_col")


@query("i17_filter_tissue_tiles", PLAN + """, k AS (SELECT slide_id, tile_row, tile_col FROM plan WHERE (slide_id + tile_row*3 + tile_col*5) % 4 = 0)
SELECT slide_id, count(*) AS tiles FROM (SELECT DISTINCT p.slide_id, p.tile_row, p.tile_col FROM plan p JOIN k ON p.slide_id = k.slide_id AND abs(p.tile_row - k.tile_row) <= 2 AND abs(p.tile_col - k.tile_col) <= 2) GROUP BY slide_id""")
def _(spark, d):
    return T.filter_tissue_tiles(grid(spark, d), ["slide_id"], 0.25, 2).groupBy("slide_id").agg(F.count("*").alias("tiles"))


def blur_sql(along):
    """The weighted sum along y or x at place q of a tile of 16 x 16 in rows (img), in whole numbers."""
    at = {"y": "(15 - abs(15 - abs(q // 16 + {j}))) * 16 + q % 16", "x": "q // 16 * 16 + 15 - abs(15 - abs(q % 16 + {j}))"}[along]
    return " + ".join(f"{w} * img[1 + {at.format(j=i - len(BLUR) // 2)}]" for i, w in enumerate(BLUR))


# Four kinds of tiles: colours of 8 bits; two channels of 8 bits, the first dark; bright ones of 16 bits; dark ones of 16 bits, every other one below the noise.
KINDS = """CASE tile_id % 4 WHEN 0 THEN (x*13 + y*7 + channel*31 + tile_id) % 256 WHEN 1 THEN CASE channel WHEN 0 THEN (x*13 + y*7 + tile_id) % 90 ELSE 250 END
  WHEN 2 THEN (x*131 + y*977 + tile_id*7) % 3000 ELSE (x*31 + y*17 + tile_id) % (90 + (tile_id // 4) % 2 * 100) END"""
TISSUE = f"""WITH px AS (SELECT tile_id, y * 16 + x AS q, channel, {KINDS} AS v FROM label_pixels, range(3) AS cs(channel) WHERE channel = 0 OR tile_id % 4 = 0 OR tile_id % 4 = 1 AND channel = 1),
g AS (SELECT tile_id, q, CASE WHEN tile_id % 4 = 0 THEN (4899 * max(v) FILTER (channel = 0) + 9617 * max(v) FILTER (channel = 1) + 1868 * max(v) FILTER (channel = 2) + 8192) // 16384 ELSE max(v) FILTER (channel = 0) END AS v FROM px GROUP BY tile_id, q),
st AS (SELECT tile_id, avg(v) > {T.BRIGHT} AS bright, min(v) AS lo, max(v) AS hi, CASE WHEN tile_id % 4 >= 2 THEN {T.NOISE_16} ELSE {T.NOISE_8} END AS noise FROM g GROUP BY tile_id),
i0 AS (SELECT tile_id, bright, list(CASE WHEN bright THEN v % 256 WHEN hi - lo > noise THEN (v - lo) * 255 // (hi - lo) ELSE 0 END ORDER BY q) AS img FROM g JOIN st USING (tile_id) GROUP BY ALL),
i1 AS (SELECT tile_id, bright, list({blur_sql("y")} ORDER BY q) AS img FROM (SELECT *, unnest(range(256)) AS q FROM i0) GROUP BY ALL),
i2 AS (SELECT tile_id, bright, ({blur_sql("x")} + 32768) // 65536 AS v FROM (SELECT *, unnest(range(256)) AS q FROM i1))
SELECT tile_id, round(avg(CASE WHEN bright THEN (v <= {T.BRIGHT_TISSUE})::INT ELSE (v > {T.DARK_TISSUE})::INT END), 9) AS tissue_pct FROM i2 GROUP BY tile_id"""


@query("i16_tissue_fraction", TISSUE)
def _(spark, d):
    p = D.label_pixels(spark, d).withColumn("channel", F.explode(F.expr("CASE tile_id % 4 WHEN 0 THEN array(0, 1, 2) WHEN 1 THEN array(0, 1) ELSE array(0) END")))
    p = p.withColumn("value", F.expr(KINDS.replace("//", "div"))).withColumn("deep", F.col("tile_id") % 4 >= 2)
    return rounded(T.tissue_fraction(T.packed_tiles(p, ["tile_id", "deep"], "value", 16, "channel"), 16, "deep").select("tile_id", "tissue_pct"))


@query("i21_connected_components", parts_sql("pred_label > 0", 8) + "SELECT * FROM labelled")
def _(spark, d):
    packed = T.packed_tiles(D.label_pixels(spark, d), K, "pred_label", 16)
    return T.connected_labels(packed, 16, 8).groupBy("tile_id", "label").agg(F.count("*").alias("area"))


@query("i22_remove_small_objects", parts_sql("pred_label > 0") + "SELECT * FROM labelled WHERE area >= 10")
def _(spark, d):
    packed = T.packed_tiles(D.label_pixels(spark, d), K, "pred_label", 16)
    return T.connected_labels(packed, 16, 4, min_size=10).groupBy("tile_id", "label").agg(F.count("*").alias("area"))


@query("i23_rasterize", """WITH px AS (SELECT slide_id, branch, unnest(range(ymin, ymax + 1)) AS y, xmin, xmax, inst_id FROM detections), q AS (SELECT slide_id, branch, y, unnest(range(xmin, xmax + 1)) AS x, inst_id FROM px)
SELECT label, count(*) AS pixels FROM (SELECT slide_id, branch, y, x, max(inst_id) AS label FROM q GROUP BY ALL) GROUP BY label""")
def _(spark, d):
    runs = T.rasterized_runs(D.detections(spark, d), ["slide_id", "branch"], "inst_id", "inst_id")
    return runs.groupBy("label").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("pixels"))


# A slide of 32 x 32 tiles that overlap by four pixels, for each 1,024 tiles.
STITCH = """WITH w AS (SELECT tile_id // 1024 AS slide, tile_id % 32 * 12 + x AS gx, tile_id // 32 % 32 * 12 + y AS gy, least((least(x, 15-x) + 1) / 3.0::DOUBLE, 1) * least((least(y, 15-y) + 1) / 3.0::DOUBLE, 1) AS w, pred_label::DOUBLE AS seg, x / 15.0::DOUBLE AS h, y / 15.0::DOUBLE AS v FROM label_pixels)
SELECT slide, gy, gx, max(seg) AS seg, round(sum(w*h)/sum(w), 6) AS h, round(sum(w*v)/sum(w), 6) AS v FROM w GROUP BY ALL"""


@query("i18_stitch_predictions", STITCH)
def _(spark, d):
    p = D.label_pixels(spark, d).selectExpr("tile_id div 1024 AS slide", "tile_id % 32 * 12 AS x1", "tile_id div 32 % 32 * 12 AS y1", "y", "x", "cast(pred_label as double) AS seg", "x / 15.0D AS h", "y / 15.0D AS v")
    return rounded(T.stitch(p, ["slide"], 16, 4), 6)


@query("i19_merge_views", """WITH v3 AS (SELECT tile_id, y, CASE view WHEN 'h' THEN 15 - x ELSE x END AS x, CASE view WHEN 'v' THEN 15 - y ELSE y END AS yy, pred_label::DOUBLE AS seg, CASE view WHEN 'h' THEN -(x / 15.0::DOUBLE) ELSE x / 15.0::DOUBLE END AS h, CASE view WHEN 'v' THEN -(y / 15.0::DOUBLE) ELSE y / 15.0::DOUBLE END AS v FROM label_pixels, (SELECT unnest(['none', 'h', 'v']) AS view))
SELECT tile_id, yy AS y, x, round(avg(seg), 6) AS seg, round(avg(h), 6) AS h, round(avg(v), 6) AS v FROM v3 GROUP BY ALL""")
def _(spark, d):
    p = D.label_pixels(spark, d).withColumn("view", F.explode(F.array(F.lit("none"), F.lit("h"), F.lit("v")))).selectExpr("tile_id", "view", "y", "x", "cast(pred_label as double) AS seg", "x / 15.0D AS h", "y / 15.0D AS v")
    return rounded(T.merge_views(p, K, 16), 6)


@query("w5_mosaic_2x2", """WITH m AS (SELECT sample, tile_id, dense_rank() OVER (PARTITION BY sample ORDER BY tile_id) - 1 AS k, y, x, gt_label FROM label_pixels),
mx AS (SELECT sample, k, max(gt_label) AS m FROM m GROUP BY ALL), sh AS (SELECT sample, k, coalesce(sum(m) OVER (PARTITION BY sample, k // 4 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM mx)
SELECT sample, k // 4 AS mosaic, y + (k % 4) // 2 * 16 AS y, x + (k % 4) % 2 * 16 AS x, (CASE WHEN gt_label > 0 THEN gt_label + a ELSE 0 END)::BIGINT AS label FROM m JOIN sh USING (sample, k)""")
def _(spark, d):
    p = D.label_pixels(spark, d)
    number = numbered(D.tiles(spark, d).select("sample", "tile_id").distinct(), ["sample"], ["tile_id"], "k")
    return T.mosaic_2x2(p.join(number.hint("shuffle_hash"), ["sample", "tile_id"]).withColumnRenamed("gt_label", "label"), ["sample"], "k", 16)


@query("i13_select_channels", CH + "SELECT tile_id, y, x, max(CASE WHEN channel = 0 THEN value END) AS nuclear, avg(CASE WHEN channel IN (1, 2) THEN value END) AS membrane FROM ch GROUP BY ALL")
def _(spark, d):
    return T.select_channels(channels(spark, d), 0, [1, 2], "mean", 3)


@query("i14_percentile_normalize", CH + ", p AS (SELECT tile_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM ch GROUP BY ALL) SELECT tile_id, y, x, channel, round(least(greatest((value - a) / (b - a + 1e-8), 0), 1), 6) AS value FROM ch JOIN p USING (tile_id)")
def _(spark, d):
    return rounded(T.percentile_normalize(channels(spark, d).select("tile_id", "y", "x", "channel", "value"), K, together=True), 6)


@query("i15_minmax_normalize", CH + "SELECT tile_id, y, x, channel, floor((value - min(value) OVER w) * 255 / (max(value) OVER w - min(value) OVER w))::BIGINT AS value FROM ch WINDOW w AS (PARTITION BY tile_id, channel)")
def _(spark, d):
    return T.minmax_normalize(channels(spark, d), ["tile_id", "channel"]).select("tile_id", "y", "x", "channel", F.col("value").cast("long").alias("value"))


@query("i24_merge_type_channels", "SELECT tile_id, y, x, greatest(gt_label, pred_label) AS label FROM label_pixels")
def _(spark, d):
    p = D.label_pixels(spark, d)
    both = p.selectExpr("tile_id", "y", "x", "0 AS channel", "gt_label AS label").unionByName(p.selectExpr("tile_id", "y", "x", "1 AS channel", "pred_label AS label"))
    return T.merge_type_channels(both, K)


@query("i25_two_class_instances", parts_sql("gt_label > 0") + parts_sql("gt_label = 0 AND pred_label > 0", n="other_") + """SELECT tile_id, label, 'positive' AS class, area FROM labelled
UNION ALL SELECT tile_id, label + coalesce(most, 0), 'negative', area FROM other_labelled LEFT JOIN (SELECT tile_id, max(label) AS most FROM labelled GROUP BY ALL) USING (tile_id)""")
def _(spark, d):
    p = D.label_pixels(spark, d)
    pos = T.connected_labels(T.packed_tiles(p, K, "gt_label", 16), 16)
    neg = T.connected_labels(T.packed_tiles(p.withColumn("m", F.when(F.col("gt_label") == 0, F.col("pred_label")).otherwise(0)), K, "m", 16), 16)
    return T.two_class_instances(pos, neg, K).groupBy("tile_id", "label", "class").agg(F.count("*").alias("area"))


@query("i26_marker_calls", CH + "SELECT tile_id, gt_label, 'c' || channel AS channel, round(avg(CASE WHEN value > 128 THEN 1.0::DOUBLE ELSE 0 END), 9) AS ratio, avg(CASE WHEN value > 128 THEN 1.0::DOUBLE ELSE 0 END) > CASE WHEN channel = 2 THEN 0.2 ELSE 0.5 END AS called FROM ch WHERE gt_label > 0 GROUP BY tile_id, gt_label, ch.channel")
def _(spark, d):
    p = channels(spark, d).filter("gt_label > 0").withColumn("positive", F.col("value") > 128).withColumn("channel", F.concat(F.lit("c"), F.col("channel").cast("string")))
    return rounded(T.marker_calls(p, ["tile_id", "gt_label"], {"c2": 0.2}))


# A row of a hull goes from the least to the greatest of all lines between two rows of the region, above and below it.
ROLES = CH + """, lab AS (SELECT tile_id, y, x, gt_label AS nucleus, pred_label AS cell FROM label_pixels),
reg AS (SELECT tile_id, 'nucleus' AS role, nucleus AS label, y, min(x) AS a, max(x) AS b FROM lab WHERE nucleus > 0 GROUP BY ALL UNION ALL SELECT tile_id, 'cell', cell, y, min(x), max(x) FROM lab WHERE cell > 0 GROUP BY ALL),
line AS (SELECT p.tile_id, p.role, p.label, p.y AS y0, q.y AS y1, p.a AS a0, q.a AS a1, p.b AS b0, q.b AS b1, unnest(range(p.y, q.y + 1)) AS y FROM reg p JOIN reg q USING (tile_id, role, label) WHERE p.y <= q.y),
rows_ AS (SELECT tile_id, role, label, y, ceil(min(a0 + (y - y0) * (a1 - a0) / greatest(y1 - y0, 1)::DOUBLE) - 1e-9) AS a, floor(max(b0 + (y - y0) * (b1 - b0) / greatest(y1 - y0, 1)::DOUBLE) + 1e-9) AS b FROM line GROUP BY ALL),
asked AS (SELECT c.tile_id, c.y, c.x, channel, CASE WHEN channel = 0 THEN 'nucleus' ELSE 'cell' END AS role, value > 128 AND CASE WHEN channel = 0 THEN nucleus ELSE cell END > 0 AS positive FROM ch c JOIN lab USING (tile_id, y, x))
SELECT r.tile_id, r.role, r.label, 'c' || channel AS channel, round(avg(positive::INT), 9) AS ratio, avg(positive::INT) > CASE WHEN channel = 2 THEN 0.2 ELSE 0.5 END AS called
FROM rows_ r JOIN asked p ON r.tile_id = p.tile_id AND r.role = p.role AND r.y = p.y AND p.x BETWEEN r.a AND r.b GROUP BY r.tile_id, r.role, r.label, p.channel"""


@query("i26_marker_roles", ROLES)
def _(spark, d):
    p = channels(spark, d).withColumnsRenamed({"gt_label": "nucleus", "pred_label": "cell"}).withColumn("positive", F.col("value") > 128).withColumn("channel", F.concat(F.lit("c"), F.col("channel").cast("string")))
    return rounded(T.marker_calls_by_role(p, K, ["c0"], {"c2": 0.2}, together=True))


@query("i27_box_counts", CH + "SELECT tile_id, channel, y // 5 AS by, x // 5 AS bx, sum(value) AS n FROM ch WHERE y < 15 AND x < 15 GROUP BY ALL")
def _(spark, d):
    return T.box_counts(channels(spark, d), ["tile_id", "channel"], 16, 5)


@query("i29_box_correlations", """WITH b AS (SELECT tile_id, y // 4 AS by, x // 4 AS bx, sum((x*13 + y*7 + tile_id) % 256)::DOUBLE AS a, sum((x*5 + y*3 + pred_label) % 17)::DOUBLE AS b FROM label_pixels GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY tile_id ORDER BY a) + (count(*) OVER (PARTITION BY tile_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY tile_id ORDER BY b) + (count(*) OVER (PARTITION BY tile_id, b) - 1) / 2.0 AS rb FROM b)
SELECT tile_id, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(pow(a - b, 2)), 4) AS mse FROM r GROUP BY tile_id""")
def _(spark, d):
    p = D.label_pixels(spark, d)
    b = T.box_counts(p.withColumn("value", F.expr("(x*13 + y*7 + tile_id) % 256")), K, 16, 4).withColumn("a", F.col("n").cast("double")).drop("n")
    c = T.box_counts(p.withColumn("value", F.expr("(x*5 + y*3 + pred_label) % 17")), K, 16, 4).withColumn("b", F.col("n").cast("double")).drop("n")
    return T.box_correlations(b.join(c, ["tile_id", "by", "bx"]), K).select("tile_id", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), F.round("mse", 4).alias("mse"))


@query("f20_intensity_scaling", CH + "SELECT tile_id, round(sum(least(greatest(value / 200.0::DOUBLE, 0), 1)), 6) AS scaled, sum(CASE WHEN gt_label > 0 THEN 1 ELSE 0 END)::BIGINT AS mask FROM ch GROUP BY tile_id")
def _(spark, d):
    return rounded(channels(spark, d).groupBy("tile_id").agg(F.sum(F.least(F.greatest(F.col("value") / 200.0, F.lit(0.0)), F.lit(1.0))).alias("scaled"), F.sum((F.col("gt_label") > 0).cast("int")).alias("mask")), 6)
