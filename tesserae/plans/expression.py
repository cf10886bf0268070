"""Queries of spatial transcriptomics."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import expression as X
from ..operators.scores import rounded
from ..operators.spatial import assign_to_many
from ..sources import derived as D
from .catalog import query
from .spatial import INSIDE, cells

MARKERS = {"a": ["G1", "G2", "G3", "G4", "G5"], "b": ["G11", "G12", "G13"], "c": ["G21", "G99"]}
#: The panel of genes, whose columns a matrix has.
GENES = [f"G{k}" for k in range(40)]


def every_cell(spark, d):
    """Objects of all branches."""
    return D.detections(spark, d).select("slide_id", F.col("inst_id").alias("cell_id"), "ring")


def assigned(spark, d):
    return assign_to_many(D.transcripts(spark, d), {"by_cell": cells(spark, d), "by_nucleus": cells(spark, d, "he_nuclei")}, ["slide_id"], "transcript_id", "cell_id")


@query("p1_unit_change", "SELECT transcript_id, round(x / 0.2125::DOUBLE, 6) AS px, round(y * 0.2125::DOUBLE, 6) AS um, round(x * 0.2125::DOUBLE * 0.2125::DOUBLE, 6) AS area_um FROM transcripts")
def _(spark, d):
    return rounded(D.transcripts(spark, d).select("transcript_id", X.um_to_px(F.col("x")).alias("px"), X.px_to_um(F.col("y")).alias("um"), X.px_to_um(F.col("x"), area=True).alias("area_um")), 6)


@query("p17_crop_transcripts", "SELECT transcript_id, x - 512 AS x, y - 512 AS y FROM transcripts WHERE x >= 512 AND x < 2560 AND y >= 512 AND y < 2560")
def _(spark, d):
    return X.crop_transcripts(D.transcripts(spark, d), 512, 2560, 512, 2560).select("transcript_id", "x", "y")


@query("g6_sample_fraction", "SELECT transcript_id FROM transcripts WHERE (transcript_id * 7919) % 1000 < 300")
def _(spark, d):
    return X.sample_by_hash(D.transcripts(spark, d), "transcript_id", 0.3).select("transcript_id")


RATE = INSIDE % "he_cell" + ", " + (INSIDE % "he_nuclei").removeprefix("WITH ").replace("hits AS", "hits2 AS").rstrip() + ", rt AS (SELECT (SELECT count(*) FROM transcripts) AS n, (SELECT count(*) FROM hits) AS a, (SELECT count(*) FROM hits2) AS b)\n"


@query("x1_assignment_rate", RATE + "SELECT 'by_cell' AS segmentation, n AS total, a AS assigned, round(a / n * 100, 6) AS rate FROM rt UNION ALL SELECT 'by_nucleus', n, b, round(b / n * 100, 6) FROM rt")
def _(spark, d):
    return rounded(X.assignment_rate(assigned(spark, d), ["by_cell", "by_nucleus"]), 6)


@query("x2_expression_counts", INSIDE % "he_cell" + "SELECT cell_id, feature_name, count(*) AS count FROM transcripts JOIN hits USING (transcript_id) GROUP BY ALL")
def _(spark, d):
    return X.expression_counts(assigned(spark, d).withColumnRenamed("by_cell", "cell_id"))


# The same over every transcript, each user a cell: no transcript is left out and cells grow with the table.
EX_ALL = "WITH ex AS (SELECT cell_key AS cell_id, feature_name, count(*) AS count FROM transcripts GROUP BY ALL), tot AS (SELECT cell_id, sum(count) AS total, count(*) AS genes FROM ex GROUP BY ALL)\n"
CPM_ALL = EX_ALL.rstrip() + ", cpm AS (SELECT ex.cell_id, feature_name, ln(1 + count / total * 1e6) AS value FROM ex JOIN tot ON ex.cell_id = tot.cell_id)\n"


def all_counts(spark, d):
    return X.expression_counts(D.transcripts(spark, d).withColumnRenamed("cell_key", "cell_id"))


@query("x3_expression_matrix", EX_ALL + "SELECT cell_id, " + ", ".join(f"coalesce(sum(count) FILTER (feature_name = '{g}'), 0)::BIGINT AS {g}" for g in GENES) + " FROM ex GROUP BY cell_id")
def _(spark, d):
    return X.expression_matrix(all_counts(spark, d), GENES)


@query("x4_transcripts_per_cell", EX_ALL + "SELECT count(*) AS cells, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std FROM tot")
def _(spark, d):
    return rounded(X.per_cell_summary(X.per_cell(all_counts(spark, d))), 6)


@query("p23_keep_rich_cells", EX_ALL + "SELECT cell_id, feature_name, count FROM ex WHERE cell_id IN (SELECT cell_id FROM tot WHERE total >= 60) AND (SELECT count(*) FROM tot WHERE total >= 60) >= 5")
def _(spark, d):
    return X.keep_rich_cells(all_counts(spark, d), 60, 5)


@query("x5_detect_doublets", EX_ALL + """, mk AS (SELECT unnest(['a','a','a','a','a','b','b','b','c','c']) AS lineage, unnest(['G1','G2','G3','G4','G5','G11','G12','G13','G21','G99']) AS feature_name),
hi AS (SELECT cell_id, lineage FROM ex JOIN mk USING (feature_name) GROUP BY ALL HAVING sum(count) > 3), ln AS (SELECT cell_id, count(*) AS lineages FROM hi GROUP BY ALL)
SELECT t.cell_id, coalesce(lineages, 0) AS lineages, coalesce(lineages, 0) >= 2 AS doublet FROM tot t LEFT JOIN ln USING (cell_id)""")
def _(spark, d):
    return X.detect_doublets(all_counts(spark, d), MARKERS)


@query("u4_markers_present", EX_ALL + "SELECT DISTINCT feature_name FROM ex WHERE feature_name IN ('G1', 'G21', 'G99')")
def _(spark, d):
    return X.markers_present(all_counts(spark, d), ["G1", "G21", "G99"])


@query("x6_cpm_log1p", CPM_ALL + "SELECT cell_id, feature_name, round(value, 6) AS value FROM cpm")
def _(spark, d):
    return rounded(X.cpm_log1p(all_counts(spark, d)).select("cell_id", "feature_name", "value"), 6)


@query("x7_standardize", CPM_ALL + """, n AS (SELECT count(*) AS n FROM tot), m AS (SELECT feature_name, sum(value) / n AS mean, sqrt(greatest(sum(value*value) / n - pow(sum(value) / n, 2), 0)) AS std FROM cpm, n GROUP BY feature_name, n)
SELECT cell_id, feature_name, round((value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 5) AS value, round(-mean / CASE WHEN std > 0 THEN std ELSE 1 END, 5) AS zero_value FROM cpm JOIN m USING (feature_name)""")
def _(spark, d):
    return rounded(X.standardize(X.cpm_log1p(all_counts(spark, d))).select("cell_id", "feature_name", "value", "zero_value"), 5)


@query("x8_cluster")
def _(spark, d):
    return X.cluster(D.read(spark, d, "embeddings"), "vec_id")


@query("x9_silhouette", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), dd AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a, e b GROUP BY ALL),
nn AS (SELECT label AS other, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT vec_id, label, other, n, s / CASE WHEN label = other THEN greatest(n - 1, 1) ELSE n END AS m FROM dd JOIN nn USING (other)),
ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM m GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 4) AS silhouette FROM ab GROUP BY label""")
def _(spark, d):
    s = X.silhouette(D.read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


@query("x9_silhouette_squared", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), dd AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s FROM e a, e b GROUP BY ALL),
nn AS (SELECT label AS other, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT vec_id, label, other, n, s / CASE WHEN label = other THEN greatest(n - 1, 1) ELSE n END AS m FROM dd JOIN nn USING (other)),
ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM m GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 4) AS silhouette FROM ab GROUP BY label""")
def _(spark, d):
    s = X.silhouette_squared(D.read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


@query("x10_top_genes", "SELECT feature_name, count(*) AS n FROM transcripts GROUP BY ALL ORDER BY n DESC, feature_name LIMIT 20")
def _(spark, d):
    return X.top_genes(D.transcripts(spark, d))


# Doublets of cells and of nuclei by their transcripts; clusters of vectors by label and, for the second, by every third id.
REPORT = RATE.rstrip() + """, mk AS (SELECT unnest(['a','a','a','a','a','b','b','b','c','c']) AS lineage, unnest(['G1','G2','G3','G4','G5','G11','G12','G13','G21','G99']) AS feature_name),
own AS (SELECT 'first' AS seg, cell_id, feature_name FROM transcripts JOIN hits USING (transcript_id) UNION ALL SELECT 'second', cell_id, feature_name FROM transcripts JOIN hits2 USING (transcript_id)),
lin AS (SELECT seg, cell_id, count(DISTINCT lineage) AS n FROM own LEFT JOIN mk USING (feature_name) GROUP BY ALL),
db AS (SELECT seg, count(*) AS cells, avg((n >= 2)::INT) * 100 AS dr FROM lin GROUP BY seg),
e AS (SELECT 'first' AS seg, vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT 'second', vec_id, (vec_id % 3)::VARCHAR, embedding::DOUBLE[] FROM embeddings),
dd AS (SELECT a.seg, a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s FROM e a JOIN e b USING (seg) GROUP BY ALL),
nn AS (SELECT seg, label AS other, count(*) AS n FROM e GROUP BY ALL), me AS (SELECT seg, vec_id, label, other, n, s / CASE WHEN label = other THEN greatest(n - 1, 1) ELSE n END AS m FROM dd JOIN nn USING (seg, other)),
ab AS (SELECT seg, vec_id, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM me GROUP BY seg, vec_id, label),
si AS (SELECT seg, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s FROM ab GROUP BY seg),
f AS (SELECT a / n * 100 AS first_rate, b / n * 100 AS second_rate, d1.dr AS first_doublet_rate, d2.dr AS second_doublet_rate, s1.s AS first_silhouette, s2.s AS second_silhouette, d1.cells AS first_cells, d2.cells AS second_cells
  FROM rt, db d1, db d2, si s1, si s2 WHERE d1.seg = 'first' AND d2.seg = 'second' AND s1.seg = 'first' AND s2.seg = 'second')
SELECT first_cells, second_cells, """ + ", ".join(f"round({v}, 4) AS {n}" for n, v in {"first_rate": "first_rate", "second_rate": "second_rate", "difference": "second_rate - first_rate", "gain_percent": "(second_rate - first_rate) / first_rate * 100", "first_doublet_rate": "first_doublet_rate", "second_doublet_rate": "second_doublet_rate", "doublet_reduction": "first_doublet_rate - second_doublet_rate", "first_silhouette": "first_silhouette", "second_silhouette": "second_silhouette", "silhouette_gain_percent": "(second_silhouette - first_silhouette) / abs(first_silhouette) * 100"}.items()) + " FROM f"


@query("x11_comparison_report", REPORT)
def _(spark, d):
    own = assigned(spark, d)
    doublets = {n: X.detect_doublets(X.expression_counts(own.withColumnRenamed(n, "cell_id")), MARKERS, 0) for n in ("by_cell", "by_nucleus")}
    vectors = D.read(spark, d, "embeddings").withColumn("label", F.col("label").cast("string")).withColumn("third", (F.col("vec_id") % 3).cast("string"))
    means = [X.silhouette_squared(vectors, "vec_id", c, "embedding").agg(F.lit(n).alias("segmentation"), F.avg("silhouette").alias("silhouette")) for n, c in (("by_cell", "label"), ("by_nucleus", "third"))]
    report = X.comparison_report(X.assignment_rate(own, ["by_cell", "by_nucleus"]), X.doublet_rates(doublets), means[0].unionByName(means[1]), "by_cell", "by_nucleus")
    return rounded(report, 4)


@query("s16_polygons_to_boundaries", "SELECT inst_id AS cell_id, unnest([0, 1, 2, 3]) AS vertex_idx, round(unnest([xmin, xmax, xmax, xmin]) * 0.2125::DOUBLE, 6) AS vertex_x, round(unnest([ymin, ymin, ymax, ymax]) * 0.2125::DOUBLE, 6) AS vertex_y FROM detections")
def _(spark, d):
    return rounded(X.polygons_to_boundaries(every_cell(spark, d)), 6)


@query("i12_boundaries_to_polygons", "SELECT inst_id AS cell_id, 5 AS points, round(((xmax-xmin)*(ymax-ymin))::DOUBLE, 8) AS area_px, round((xmax-xmin)*(ymax-ymin) * 0.2125::DOUBLE * 0.2125::DOUBLE, 8) AS area_um FROM detections")
def _(spark, d):
    p = X.boundaries_to_polygons(X.polygons_to_boundaries(every_cell(spark, d)))
    return rounded(p.select("cell_id", F.size("ring").alias("points"), "area_px", "area_um"), 8)


@query("s17_cells_metadata", "SELECT inst_id AS cell_id, round((3*xmin + 2*xmax) / 5.0::DOUBLE * 0.2125::DOUBLE, 6) AS x_centroid, round((3*ymin + 2*ymax) / 5.0::DOUBLE * 0.2125::DOUBLE, 6) AS y_centroid, 0.0::DOUBLE AS cell_area, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area_pixels FROM detections")
def _(spark, d):
    c = every_cell(spark, d).withColumn("ring", G.closed(F.col("ring"))).withColumn("area_px", G.area(F.col("ring")))
    return rounded(X.cells_metadata(c), 6)
