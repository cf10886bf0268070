"""Queries of geometry, spatial joins and duplicate removal."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as P
from ..operators.scores import rounded
from ..sources import derived as D
from ..sources.formats import simplified
from .catalog import query

K = ["slide_id", "branch"]
PAIRS = """WITH pr AS (SELECT a.slide_id, a.branch, a.inst_id AS a_id, b.inst_id AS b_id, ((a.xmax-a.xmin)*(a.ymax-a.ymin))::DOUBLE AS a_area, ((b.xmax-b.xmin)*(b.ymax-b.ymin))::DOUBLE AS b_area,
  ((least(a.xmax,b.xmax) - greatest(a.xmin,b.xmin)) * (least(a.ymax,b.ymax) - greatest(a.ymin,b.ymin)))::DOUBLE AS shared
  FROM detections a JOIN detections b ON a.slide_id = b.slide_id AND a.branch = b.branch AND a.inst_id < b.inst_id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax)
"""
INSIDE = """WITH hits AS (SELECT t.transcript_id, min(c.inst_id) AS cell_id FROM transcripts t JOIN detections c ON t.slide_id = c.slide_id AND c.branch = '%s' AND t.x > c.xmin AND t.x < c.xmax AND t.y > c.ymin AND t.y < c.ymax GROUP BY ALL)
"""


def cells(spark, d, branch="he_cell"):
    return D.detections(spark, d).filter(F.col("branch") == branch).select("slide_id", F.col("inst_id").alias("cell_id"), "ring")


def octagons(spark, d, cut=3):
    """Rings with the corners cut, by three pixels if not told otherwise."""
    c = [("xmin", 1, "ymin", 0), ("xmax", -1, "ymin", 0), ("xmax", 0, "ymin", 1), ("xmax", 0, "ymax", -1), ("xmax", -1, "ymax", 0), ("xmin", 1, "ymax", 0), ("xmin", 0, "ymax", -1), ("xmin", 0, "ymin", 1)]
    return D.detections(spark, d).withColumn("ring", F.array(*[F.struct((F.col(x) + dx * cut).cast("double").alias("x"), (F.col(y) + dy * cut).cast("double").alias("y")) for x, dx, y, dy in c]))


def dented(spark, d, crossed=False):
    """Rings with a dent of 1 to 11 pixels in the lower side; with crossed, one in three goes through its points crosswise."""
    at = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    a, b, c, dent, e = at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("(xmin + xmax) div 2", "ymax - 1 - inst_id % 11"), at("xmin", "ymax")
    return D.detections(spark, d).withColumn("ring", F.when(F.lit(crossed) & (F.col("inst_id") % 3 == 0), F.array(a, c, b, dent, e)).otherwise(F.array(a, b, c, dent, e)))


@query("f1_ring_measures", """SELECT inst_id, (w*h - 18)::DOUBLE AS area, round(2*(w-6) + 2*(h-6) + 4*sqrt(18.0::DOUBLE), 6) AS perimeter,
round(4*pi()*(w*h - 18) / pow(2*(w-6) + 2*(h-6) + 4*sqrt(18.0::DOUBLE), 2), 6) AS circularity, 9 AS closed_points, 5 AS box_points, w::DOUBLE AS box_width, h::DOUBLE AS box_height FROM (SELECT inst_id, xmax-xmin AS w, ymax-ymin AS h FROM detections)""")
def _(spark, d):
    r = F.col("ring")
    return rounded(octagons(spark, d).select("inst_id", G.area(r).alias("area"), G.perimeter(r).alias("perimeter"), G.circularity(r).alias("circularity"), F.size(G.closed(r)).alias("closed_points"), F.size(G.box_ring()).alias("box_points"), (F.col("xmax") - F.col("xmin")).cast("double").alias("box_width"), (F.col("ymax") - F.col("ymin")).cast("double").alias("box_height")), 6)


@query("f6_solidity", "SELECT inst_id, round(1 - (1 + inst_id % 11) / (2.0::DOUBLE * (ymax - ymin)), 9) AS solidity FROM detections")
def _(spark, d):
    m = P.measured_rings(dented(spark, d).select("inst_id", "ring"), hull=True)
    return rounded(m.select("inst_id", F.when(F.col("hull_area_") > 0, F.col("area_") / F.col("hull_area_")).otherwise(0.0).alias("solidity")))


@query("f7_eccentricity", """WITH pt AS (SELECT inst_id, unnest([xmin+3, xmax-3, xmax, xmax, xmax-3, xmin+3, xmin, xmin])::DOUBLE AS x, unnest([ymin, ymin, ymin+3, ymax-3, ymax, ymax, ymax-3, ymin+3])::DOUBLE AS y FROM detections),
m AS (SELECT inst_id, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM pt GROUP BY ALL),
e AS (SELECT *, (xx+yy)/2 AS hh, sqrt((xx-yy)*(xx-yy)/4 + xy*xy) AS s FROM m) SELECT inst_id, round(sqrt(greatest(0, 1 - (hh-s)/(hh+s))), 3) AS eccentricity FROM e""")
def _(spark, d):
    return octagons(spark, d).select("inst_id", F.round(G.eccentricity(F.col("ring")), 3).alias("eccentricity"))


@query("f8_simplify", "SELECT inst_id, CASE WHEN inst_id % 11 + 1 > 4 THEN 5 ELSE 4 END AS points FROM detections")
def _(spark, d):
    return simplified(dented(spark, d).select("inst_id", "ring"), 4.0).select("inst_id", F.size("ring").alias("points"))


@query("f9_rounded_ring", "SELECT inst_id, round_even(xmin / 8.0::DOUBLE, 1) AS x0, round_even(ymin / 8.0::DOUBLE, 1) AS y0 FROM detections")
def _(spark, d):
    return D.detections(spark, d).withColumn("ring", G.rounded_ring(G.scaled(F.col("ring"), 0.125), 1)).select("inst_id", F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"))


THINNED = """WITH RECURSIVE pts AS (SELECT inst_id, [xmin+c, xmax-c, xmax, xmax, xmax-c, xmin+c, xmin, xmin] AS xs, [ymin, ymin, ymin+c, ymax-c, ymax, ymax, ymax-c, ymin+c] AS ys FROM (SELECT *, 3 + inst_id % 3 AS c FROM detections)),
walk AS (SELECT inst_id, 1 AS k, 1 AS last, 1 AS n, xs, ys FROM pts
  UNION ALL SELECT inst_id, k + 1, CASE WHEN far THEN k + 1 ELSE last END, n + far::INT, xs, ys FROM (SELECT *, pow(xs[k+1] - xs[last], 2) + pow(ys[k+1] - ys[last], 2) > 25 AS far FROM walk WHERE k < 8))
SELECT inst_id, CASE WHEN n >= 4 THEN n ELSE 8 END AS points FROM walk WHERE k = 8"""


@query("f10_thinned_ring", THINNED)
def _(spark, d):
    return octagons(spark, d, 3 + F.col("inst_id") % 3).select("inst_id", F.size(G.thinned(F.col("ring"), 5.0)).alias("points"))


@query("f11_valid_rings", "SELECT inst_id, inst_id % 3 <> 0 AS valid FROM detections")
def _(spark, d):
    return P.measured_rings(dented(spark, d, crossed=True).select("inst_id", "ring")).select("inst_id", F.col("simple_").alias("valid"))


@query("j1_bbox_pairs", PAIRS + "SELECT slide_id, branch, a_id, b_id FROM pr")
def _(spark, d):
    return P.box_pairs(D.detections(spark, d), K).select(*K, F.col("a.inst_id").alias("a_id"), F.col("b.inst_id").alias("b_id"))


@query("j2_bbox_iou", PAIRS + "SELECT a_id, b_id, round(shared / (a_area + b_area - shared), 9) AS iou FROM pr")
def _(spark, d):
    return rounded(P.box_pairs(D.detections(spark, d), K).select(F.col("a.inst_id").alias("a_id"), F.col("b.inst_id").alias("b_id"), G.box_iou().alias("iou")))


@query("j3_polygon_overlap", PAIRS + "SELECT a_id, b_id, round(shared / (a_area + b_area - shared), 6) AS iou, round(shared / least(a_area, b_area), 6) AS containment FROM pr")
def _(spark, d):
    p = P.ring_pairs(D.detections(spark, d), K)
    return rounded(p.select("a_id", "b_id", P.iou(p).alias("iou"), P.containment(p).alias("containment")), 6)


@query("j5_points_in_polygons", INSIDE % "he_cell" + "SELECT t.transcript_id, h.cell_id FROM transcripts t LEFT JOIN hits h USING (transcript_id)")
def _(spark, d):
    return P.points_in_rings(D.transcripts(spark, d), cells(spark, d), ["slide_id"], "transcript_id", "cell_id").select("transcript_id", "cell_id")


@query("j6_assign_to_many", INSIDE % "he_cell" + ", " + (INSIDE % "he_nuclei").removeprefix("WITH ").replace("hits AS", "hits2 AS") + "SELECT t.transcript_id, h.cell_id AS by_cell, g.cell_id AS by_nucleus FROM transcripts t LEFT JOIN hits h USING (transcript_id) LEFT JOIN hits2 g USING (transcript_id)")
def _(spark, d):
    sets = {"by_cell": cells(spark, d), "by_nucleus": cells(spark, d, "he_nuclei")}
    return P.assign_to_many(D.transcripts(spark, d), sets, ["slide_id"], "transcript_id", "cell_id").select("transcript_id", *sets)


def links(spark, d, t):
    p = P.ring_pairs(D.detections(spark, d), K)
    return p.filter(P.iou(p) >= t)


def kept_sql(links, n, order="node"):
    """SQL tables of the objects that a scan in order keeps (n_kept): those linked with none that was kept before. Each
    connected part is walked for itself."""
    return f""", {n}_both AS MATERIALIZED (SELECT a_id AS node, b_id AS other, a_area AS area FROM {links} UNION SELECT b_id, a_id, b_area FROM {links}),
{n}_reach AS (SELECT DISTINCT node, node AS root FROM {n}_both UNION SELECT e.other, w.root FROM {n}_reach w JOIN {n}_both e ON w.node = e.node WHERE e.other > w.root),
{n}_order AS MATERIALIZED (SELECT node, part, others, area, row_number() OVER (PARTITION BY part ORDER BY {order}) AS r
  FROM (SELECT node, min(root) AS part FROM {n}_reach GROUP BY node) JOIN (SELECT node, area, list(other) AS others FROM {n}_both GROUP BY ALL) USING (node)),
{n}_walk AS (SELECT part, 0::BIGINT AS r, []::BIGINT[] AS kept FROM {n}_order WHERE r = 1
  UNION ALL SELECT part, o.r, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, node) END FROM {n}_walk w JOIN {n}_order o USING (part) WHERE o.r = w.r + 1),
{n}_kept AS MATERIALIZED (SELECT unnest(k) AS node FROM (SELECT arg_max(kept, r) AS k FROM {n}_walk GROUP BY part))"""


def rounds_sql(rounds):
    """SQL tables of the scan in id order, so many times: seeds own what they are first to reach, and of each cluster the
    largest stays (ties: the seed, then the lower id). gone: what was removed."""
    text = ""
    for k in range(rounds):
        n = f"s{k}"
        text += kept_sql(f"l{k}", n) + f""",
{n}_own AS (SELECT o.node, o.area, min(k.node) AS seed FROM {n}_order o JOIN {n}_both b ON b.node = o.node JOIN {n}_kept k ON b.other = k.node WHERE o.node NOT IN (SELECT node FROM {n}_kept) AND k.node < o.node GROUP BY ALL),
{n}_members AS (SELECT seed, node, area, 0 AS is_seed FROM {n}_own UNION ALL SELECT DISTINCT seed, o.node, o.area, 1 FROM {n}_own w JOIN {n}_order o ON w.seed = o.node),
{n}_gone AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT node FROM {n}_members QUALIFY row_number() OVER (PARTITION BY seed ORDER BY area DESC, is_seed DESC, node) > 1)),
l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} WHERE a_id NOT IN (SELECT node FROM {n}_gone) AND b_id NOT IN (SELECT node FROM {n}_gone))"""
    return text + ", gone AS (" + " UNION ".join(f"SELECT node FROM s{k}_gone" for k in range(rounds)) + ")"


SCANS = PAIRS.replace("WITH", "WITH RECURSIVE", 1)


def linked(spark, d):
    det = D.detections(spark, d)
    return P.link_nuclei(det.filter("branch = 'he_nuclei'"), det.filter("branch = 'he_cell'"), ["slide_id"])


# The heaviest overlaps first: a candidate is kept if it shares no end with one that was kept before.
CHOICE = PAIRS.replace("WITH", "WITH RECURSIVE", 1).replace("a.branch = b.branch AND a.inst_id < b.inst_id", "a.branch = 'he_nuclei' AND b.branch = 'he_cell'") + """, cand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY shared DESC, a_id, b_id) AS k, a_id AS nucleus, b_id AS cell, shared FROM pr),
clash AS MATERIALIZED (SELECT a.k AS a_id, b.k AS b_id, 0.0 AS a_area, 0.0 AS b_area FROM cand a JOIN cand b USING (nucleus) WHERE a.k < b.k UNION SELECT a.k, b.k, 0.0, 0.0 FROM cand a JOIN cand b USING (cell) WHERE a.k < b.k)""" + kept_sql("clash", "s") + """,
lk AS (SELECT nucleus, cell, shared FROM cand WHERE k NOT IN (SELECT node FROM s_order) OR k IN (SELECT node FROM s_kept))
"""


@query("j7_nucleus_links", CHOICE + "SELECT inst_id AS nucleus_id, cell AS cell_id, shared FROM detections d LEFT JOIN lk ON d.inst_id = lk.nucleus WHERE branch = 'he_nuclei'")
def _(spark, d):
    return linked(spark, d)[0].select("nucleus_id", "cell_id", "shared")


@query("j7_orphan_cells", CHOICE + "SELECT inst_id FROM detections WHERE branch = 'he_cell' AND (xmax-xmin)*(ymax-ymin) > 30 AND inst_id NOT IN (SELECT cell FROM lk)")
def _(spark, d):
    return linked(spark, d)[1].select("inst_id")


# Slides as dense as in one growing region: all objects on four slides, whatever their number.
DENSE = PAIRS.replace("FROM detections a JOIN detections b ON a.slide_id = b.slide_id", "FROM detections a JOIN detections b ON a.slide_id % 4 = b.slide_id % 4").replace("a.slide_id, a.branch", "a.slide_id % 4 AS slide_id, a.branch")


def dense(spark, d):
    return D.detections(spark, d).withColumn("slide_id", F.col("slide_id") % 4)


@query("j3_polygon_overlap_dense", DENSE + "SELECT slide_id, branch, count(*) AS pairs, round(sum(shared), 3) AS shared, round(sum(shared / (a_area + b_area - shared)), 6) AS iou FROM pr GROUP BY ALL")
def _(spark, d):
    p = P.ring_pairs(dense(spark, d), K)
    return p.groupBy(*K).agg(F.count("*").alias("pairs"), F.round(F.sum("shared"), 3).alias("shared"), F.round(F.sum(P.iou(p)), 6).alias("iou"))


@query("d3_suppress_dense", DENSE.replace("WITH", "WITH RECURSIVE", 1) + ", l AS MATERIALIZED (SELECT * FROM pr WHERE shared / (a_area + b_area - shared) >= 0.3::DOUBLE)" + kept_sql("l", "s", "area DESC, node") + " SELECT inst_id FROM detections WHERE inst_id NOT IN (SELECT node FROM s_order) OR inst_id IN (SELECT node FROM s_kept)")
def _(spark, d):
    p = P.ring_pairs(dense(spark, d), K)
    return P.suppress(dense(spark, d), p.filter(P.iou(p) >= 0.3)).select("inst_id")


@query("d1_dedupe_iou", SCANS + ", l0 AS MATERIALIZED (SELECT * FROM pr WHERE shared / (a_area + b_area - shared) >= 0.5)" + rounds_sql(5) + " SELECT inst_id FROM detections WHERE inst_id NOT IN (SELECT node FROM gone)")
def _(spark, d):
    return P.dedupe_iou(D.detections(spark, d), K).select("inst_id")


@query("d2_dedupe_containment", SCANS + """, edge AS (SELECT inst_id FROM detections WHERE xmin % 512 >= 256),
l0 AS MATERIALIZED (SELECT * FROM pr WHERE shared / least(a_area, b_area) > 0.5 AND a_id IN (SELECT inst_id FROM edge) AND b_id IN (SELECT inst_id FROM edge))""" + rounds_sql(20) + " SELECT inst_id FROM detections WHERE inst_id NOT IN (SELECT node FROM gone)")
def _(spark, d):
    det = D.detections(spark, d).withColumn("edge", F.when(F.expr("xmin % 512 < 256"), 0).otherwise(1))
    return P.dedupe_containment(det, K).select("inst_id")


@query("d3_local_maxima", PAIRS + """, l AS (SELECT * FROM pr WHERE shared / (a_area + b_area - shared) >= 0.3::DOUBLE)
SELECT inst_id FROM detections WHERE inst_id NOT IN (SELECT CASE WHEN b_area > a_area THEN a_id ELSE b_id END FROM l)""")
def _(spark, d):
    return P.local_maxima(D.detections(spark, d), links(spark, d, 0.3)).select("inst_id")


@query("d3_suppress", SCANS + ", l AS MATERIALIZED (SELECT * FROM pr WHERE shared / (a_area + b_area - shared) >= 0.3::DOUBLE)" + kept_sql("l", "s", "area DESC, node") + """
SELECT inst_id FROM detections WHERE inst_id NOT IN (SELECT node FROM s_order) OR inst_id IN (SELECT node FROM s_kept)""")
def _(spark, d):
    return P.suppress(D.detections(spark, d), links(spark, d, 0.3)).select("inst_id")


def shapes(spark, d):
    """Objects of one or two parts: the box, every other one with a hole three pixels inside; for one in three a second box to its right."""
    at = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    box = lambda a, b, c, e: F.array(at(a, b), at(c, b), at(c, e), at(a, e))
    outer, hole, second = box("xmin", "ymin", "xmax", "ymax"), box("xmin + 3", "ymin + 3", "xmax - 3", "ymax - 3"), box("xmin + 40", "ymin", "xmin + 45 + inst_id % 40", "ymin + 20")
    first = F.when(F.col("inst_id") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return D.detections(spark, d).withColumn("parts", F.when(F.col("inst_id") % 3 == 0, F.array(first, F.array(second))).otherwise(F.array(first)))


SHAPES = """WITH sh AS (SELECT *, ((xmax-xmin)*(ymax-ymin) - CASE WHEN inst_id % 2 = 0 THEN (xmax-xmin-6)*(ymax-ymin-6) ELSE 0 END)::DOUBLE AS first_area, CASE WHEN inst_id % 3 = 0 THEN ((5 + inst_id % 40) * 20)::DOUBLE END AS second_area FROM detections)
"""


@query("t1_largest_part", SHAPES + """SELECT inst_id, CASE WHEN second_area > first_area THEN 1 ELSE 0 END AS part_idx, greatest(first_area, coalesce(second_area, 0)) AS area, CASE WHEN second_area > first_area THEN xmin + 40 ELSE xmin END::DOUBLE AS x0,
CASE WHEN second_area <= first_area OR second_area IS NULL THEN 1 + (inst_id % 2 = 0)::INT ELSE 1 END AS rings FROM sh""")
def _(spark, d):
    best = shapes(spark, d).withColumn("best", G.largest_part(F.col("parts"))).withColumn("kept", F.get("parts", F.col("best.part_idx")))
    return best.select("inst_id", "best.part_idx", "best.area", F.col("kept")[0][0]["x"].alias("x0"), F.size("kept").alias("rings"))


# The window is so narrow that it often holds a vertex of a hole or of a second part only.
P13 = " OR ".join(f"({c} AND (({x1}) % 256 >= 100 AND ({x1}) % 256 < 110 OR ({x2}) % 256 >= 100 AND ({x2}) % 256 < 110) AND (({y1}) >= 1000 AND ({y1}) < 2000 OR ({y2}) >= 1000 AND ({y2}) < 2000))" for c, x1, x2, y1, y2 in [("true", "xmin", "xmax", "ymin", "ymax"), ("inst_id % 2 = 0", "xmin + 3", "xmax - 3", "ymin + 3", "ymax - 3"), ("inst_id % 3 = 0", "xmin + 40", "xmin + 45 + inst_id % 40", "ymin", "ymin + 20")])


@query("p13_crop_any_vertex", f"SELECT inst_id, (xmin - xmin // 256 * 256 - 100)::DOUBLE AS x0, (ymin - 1000)::DOUBLE AS y0, 1 + (inst_id % 3 = 0)::INT AS parts FROM detections WHERE {P13.replace('xmin + 45 + inst_id % 40', 'xmin + 45 + inst_id % 40')}")
def _(spark, d):
    # A window in each column of 256 pixels, told by the object's own column or the next one.
    s = shapes(spark, d)
    column = F.floor(F.col("xmin") / 256) * 256
    near = F.lit(False)
    for k in (0, 256):
        near = near | G.any_part_vertex_in(F.col("parts"), column + k + 100, column + k + 110, 1000, 2000)
    roi = s.filter(near).withColumn("parts", G.translated_parts(F.col("parts"), column + 100, 1000))
    first = F.col("parts")[0][0][0]
    return roi.select("inst_id", first["x"].alias("x0"), first["y"].alias("y0"), F.size("parts").alias("parts"))


@query("f4_points_in_parts", SHAPES + """SELECT inst_id, inst_id % 2 = 1 AS centre, inst_id % 3 = 0 AS second FROM sh""")
def _(spark, d):
    s = shapes(spark, d)
    inside = lambda x, y: G.parts_contain(F.col("parts"), F.expr(x), F.expr(y))
    return s.select("inst_id", inside("(xmin + xmax) / 2 + 0.25D", "(ymin + ymax) / 2 + 0.25D").alias("centre"), inside("xmin + 42.5D", "ymin + 10.25D").alias("second"))


@query("i20_deaugment_contours", "SELECT inst_id, (4095 - xmin)::DOUBLE AS hx, (4095 - ymin)::DOUBLE AS vy, round((xmin % 7 + ymin % 5 + 1) / 3.0::DOUBLE, 9) AS score FROM detections")
def _(spark, d):
    r = F.col("ring")
    return rounded(D.detections(spark, d).select("inst_id", G.deaugmented(r, "h", 4096, 4096)[0]["x"].alias("hx"), G.deaugmented(r, "v", 4096, 4096)[0]["y"].alias("vy"), ((F.col("xmin") % 7 + F.col("ymin") % 5 + 1) / 3).alias("score")))
