"""Queries of readers and writers: what is written and read back, and what is decoded from texts."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.expression import polygons_to_boundaries
from ..operators.scores import rounded
from ..operators.tables import saved, shared_path
from ..operators.tiles import plan_tiles_edge_aligned
from ..sources import derived as D
from ..sources import formats as S
from ..sources import geojson as J
from .catalog import query
from .spatial import SHAPES, dented, shapes


def cells(spark, d):
    return D.detections(spark, d).select(F.col("inst_id").alias("id"), "ring", F.col("branch").alias("type"), "slide_id")


CORNERS = "concat_ws(' ', xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax)"


def corners(ring):
    """The whole coordinates of a ring without its closing point, as text."""
    open_ = F.when(ring[0] == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return F.array_join(F.transform(open_, lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), " ")


AREA = "SELECT inst_id, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area, (2*(xmax-xmin) + 2*(ymax-ymin))::DOUBLE AS perimeter, (xmin+xmax)/2.0 AS cx FROM detections"


@query("s1_geojson_cells", f"SELECT inst_id::VARCHAR AS cell_id, {CORNERS} AS corners FROM detections")
def _(spark, d):
    path = shared_path(spark, "geojson")
    J.write_collections(S.polygon_features(cells(spark, d)), path, documents=2)
    return S.read_geojson_cells(spark, path).select("cell_id", corners(F.col("ring")).alias("corners"))


@query("s19_one_document", f"SELECT inst_id::VARCHAR AS id, branch AS classification, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area, {CORNERS} AS corners FROM detections")
def _(spark, d):
    path = shared_path(spark, "document")
    J.write_collections(S.polygon_features(cells(spark, d)), path, metadata={"made": "[by] {tests} \\" + '"'})
    f = J.read_features(spark, path, range_bytes=1 << 20).select("value", F.from_json("value", "properties struct<id:string,classification:string,area:double>, geometry struct<coordinates:array<array<array<double>>>>").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("f.properties.id", "f.properties.classification", "f.properties.area", corners(ring).alias("corners"))


@query("s2_geojson_annotations", SHAPES + """SELECT CASE WHEN branch = 'he_cell' THEN 'Cell' ELSE 'Nucleus' END AS type, 0 AS part_idx, 1 + (inst_id % 2 = 0)::INT AS rings, first_area AS area, xmin::DOUBLE AS x0, ymin::DOUBLE AS y0 FROM sh
UNION ALL SELECT CASE WHEN branch = 'he_cell' THEN 'Cell' ELSE 'Nucleus' END, 1, 1, second_area, (xmin + 40)::DOUBLE, ymin::DOUBLE FROM sh WHERE second_area IS NOT NULL""")
def _(spark, d):
    path = shared_path(spark, "annotations")
    J.write_collections(S.multipolygon_features(shapes(spark, d).select(F.col("inst_id").alias("id"), "parts", F.col("branch").alias("type"))), path, documents=4, gzip=True)
    a = S.read_geojson_annotations(spark, path)
    return a.select("type", "part_idx", F.size("rings").alias("rings"), G.part_area(F.col("rings")).alias("area"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"))


@query("s2_polygons_with_parts", SHAPES + "SELECT inst_id::VARCHAR AS id, branch AS classification, 1 + (inst_id % 3 = 0)::INT AS parts, first_area + coalesce(second_area, 0) AS area FROM sh")
def _(spark, d):
    path = shared_path(spark, "polygons")
    J.write_collections(S.multipolygon_features(shapes(spark, d).select(F.col("inst_id").alias("id"), "parts", F.col("branch").alias("type"))), path)
    return S.read_geojson_polygons(spark, path).select("id", "classification", F.size("parts").alias("parts"), G.parts_area(F.col("parts")).alias("area"))


def stored_transcripts(spark, d):
    t = saved(D.transcripts(spark, d).select(F.col("x").alias("x_location"), F.col("y").alias("y_location"), "feature_name"), "transcripts")
    return S.read_transcripts(spark, t.inputFiles()[0].rsplit("/", 1)[0])


@query("s3_read_transcripts", "SELECT feature_name, count(*) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, count(*) FILTER (x < 1024) AS n_left FROM transcripts GROUP BY ALL")
def _(spark, d):
    left = F.count(F.when(F.col("x") < 1024, 1))
    return stored_transcripts(spark, d).groupBy("feature_name").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"), left.alias("n_left"))


@query("s3_read_boundaries", "SELECT inst_id AS cell_id, 4 AS vertices, round(4 * 0.2125::DOUBLE * (xmin + xmax) / 2, 6) AS sx, round(ymin * 0.2125::DOUBLE, 6) AS first_y FROM detections")
def _(spark, d):
    path = shared_path(spark, "boundaries")
    polygons_to_boundaries(cells(spark, d).withColumnRenamed("id", "cell_id")).write.parquet(path)
    b = S.read_boundaries(spark, path)
    return b.groupBy("cell_id").agg(F.count("*").cast("int").alias("vertices"), F.round(F.sum("vertex_x"), 6).alias("sx"), F.round(F.min_by("vertex_y", "vertex_idx"), 6).alias("first_y"))


@query("s4_read_registry_csv", "SELECT row_id, slide_id, diagnosis, count_text FROM registry")
def _(spark, d):
    path = shared_path(spark, "registry")
    D.registry(spark, d).select("row_id", F.col("slide_id").alias(" Slide_ID"), F.col("diagnosis").alias("Diagnosis"), "count_text").write.option("header", True).csv(path)
    return S.read_registry_csv(spark, path).withColumn("row_id", F.col("row_id").cast("long"))


@query("s5_rle_masks", """WITH px AS (SELECT p_partkey // 3 AS image_id, dense_rank() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS label, unnest(range((p_partkey * 7919) % 4000, (p_partkey * 7919) % 4000 + 5)) AS p FROM part)
SELECT image_id, p % 64 AS y, p // 64 AS x, max(label) AS label FROM px GROUP BY ALL""")
def _(spark, d):
    m = D.read(spark, d, "part").selectExpr("p_partkey div 3 AS image_id", "p_partkey AS row_idx", "concat(cast((p_partkey * 7919) % 4000 + 1 as string), ' 2 ', cast((p_partkey * 7919) % 4000 + 3 as string), ' 3') AS encoded")
    return S.rle_pixels(m, 64).select("image_id", "y", "x", F.col("label").cast("long").alias("label"))


@query("s6_polyline_csv", "SELECT inst_id, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area FROM detections WHERE branch = 'he_cell'")
def _(spark, d):
    join = lambda c: F.array_join(F.transform("ring", lambda p: p[c].cast("string")), ",")
    rows = cells(spark, d).select(F.col("id").alias("inst_id"), F.when(F.col("type") == "he_cell", "polyline").otherwise("rectangle").alias("type"), join("x").alias("coords_x"), join("y").alias("coords_y"))
    return S.polyline_rings(rows).select("inst_id", G.area(F.col("ring")).alias("area"))


@query("s7_aperio_xml", f"SELECT inst_id::VARCHAR AS id, branch AS class_name, row_number() OVER (PARTITION BY inst_id // 10000 ORDER BY inst_id) AS region_id, {CORNERS} AS corners FROM detections")
def _(spark, d):
    path = shared_path(spark, "xml")
    S.write_documents(S.aperio_documents(cells(spark, d)), path)
    return S.read_aperio_xml(spark, path).select("id", "class_name", "region_id", corners(F.col("ring")).alias("corners"))


@query("s8_decode_color_ids", "SELECT tile_id, max((x * 16 + y) % 256 * 256 + (x + y) % 256) AS id FROM label_pixels GROUP BY tile_id")
def _(spark, d):
    p = D.label_pixels(spark, d)
    return p.groupBy("tile_id").agg(F.max(S.color_id(F.expr("(x * 16 + y) % 256"), F.expr("(x + y) % 256"))).alias("id"))


@query("s9_slide_manifest", "SELECT 'slide' || slide_id || '.svs' AS path FROM slides WHERE slide_id % 3 <> 0")
def _(spark, d):
    path = shared_path(spark, "manifest")
    name = F.concat(F.lit("slide"), F.col("slide_id").cast("string"), F.lit(".svs"))
    D.slides(spark, d).select(F.when(F.col("slide_id") % 3 == 0, F.concat(F.lit("# "), name)).otherwise(name).alias("value")).write.text(path)
    return S.slide_manifest(spark, path, is_list=True)


@query("s11_detection_records", "SELECT inst_id AS id, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area, branch AS type, (xmin+xmax)/2.0 AS cx, (ymin+ymax)/2.0 AS cy, concat_ws(' ', xmin, ymin, xmax, ymax) AS box FROM detections")
def _(spark, d):
    path = shared_path(spark, "records")
    S.detection_records(cells(spark, d)).write.json(path)
    r = spark.read.schema("id long, centroid array<double>, area double, type string, bbox struct<min:array<double>,max:array<double>>").json(path)
    box = F.array_join(F.transform(F.concat("bbox.min", "bbox.max"), lambda v: v.cast("long").cast("string")), " ")
    return r.select("id", "area", "type", F.col("centroid")[0].alias("cx"), F.col("centroid")[1].alias("cy"), box.alias("box"))


@query("s12_segmentation_records", AREA.replace("SELECT inst_id, ", "SELECT inst_id AS id, ").replace(", (xmin+xmax)/2.0 AS cx", f", branch AS type, {CORNERS} AS corners"))
def _(spark, d):
    path = shared_path(spark, "contours")
    S.detection_records(cells(spark, d), contour=True).write.json(path)
    return spark.read.schema("id long, type string, area double, perimeter double, contour array<array<double>>").json(path).select("id", "area", "perimeter", "type", corners(F.transform("contour", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("corners"))


@query("s13_points_geojson", "SELECT inst_id AS id, branch AS classification, (xmin+xmax)/2.0 AS x, (ymin+ymax)/2.0 AS y, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area, (xmax-xmin)::DOUBLE AS width, (ymax-ymin)::DOUBLE AS height FROM detections")
def _(spark, d):
    path = shared_path(spark, "points")
    J.write_collections(S.point_features(cells(spark, d)), path, documents=3)
    p = J.read_features(spark, path).select(F.from_json("value", "geometry struct<type:string,coordinates:array<double>>, properties struct<id:long,classification:string,area:double,bbox_width:double,bbox_height:double>").alias("f")).filter("f.geometry.type = 'Point'")
    at = F.col("f.geometry.coordinates")
    return p.select("f.properties.id", "f.properties.classification", at[0].alias("x"), at[1].alias("y"), "f.properties.area", F.col("f.properties.bbox_width").alias("width"), F.col("f.properties.bbox_height").alias("height"))


# The dent is a corner of its own where it is deeper than the tolerance.
@query("s14_simplified_polygons", """SELECT inst_id::VARCHAR AS cell_id, branch AS type, concat_ws(' ', xmin, ymin, xmax, ymin, xmax, ymax, CASE WHEN inst_id % 11 + 1 > 4 THEN concat_ws(' ', (xmin + xmax) // 2, ymax - 1 - inst_id % 11) END, xmin, ymax) AS corners FROM detections""")
def _(spark, d):
    path = shared_path(spark, "polygons")
    J.write_collections(S.polygon_features(dented(spark, d).select(F.col("inst_id").alias("id"), "ring", F.col("branch").alias("type")), eps=4.0, digits=0), path, documents=3)
    f = J.read_features(spark, path).select(F.from_json("value", S.FEATURE).alias("f"))
    ring = F.transform(F.from_json("f.geometry.coordinates", S.RING)[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select(F.get_json_object("f.properties", "$.id").alias("cell_id"), F.get_json_object("f.properties", "$.classification").alias("type"), corners(ring).alias("corners"))


@query("s15_cells_parquet", "SELECT inst_id AS id, slide_id, ((xmax-xmin)*(ymax-ymin))::DOUBLE AS area, (2*(xmax-xmin) + 2*(ymax-ymin))::DOUBLE AS perimeter, branch AS classification FROM detections")
def _(spark, d):
    path = shared_path(spark, "cells")
    S.write_cells_parquet(cells(spark, d), path, ("slide_id",))
    return spark.read.parquet(path).select("id", F.col("slide_id").cast("long").alias("slide_id"), "area", "perimeter", "classification")


@query("s18_split_parts", f"SELECT ((row_number() OVER (ORDER BY inst_id)) - 1) // CAST(ceil((SELECT count(*) FROM detections) / 7.0) AS BIGINT) AS part, inst_id::VARCHAR AS cell_id, {CORNERS} AS corners FROM detections")
def _(spark, d):
    path = shared_path(spark, "parts")
    features = S.polygon_features(cells(spark, d)).withColumn("id", F.get_json_object("value", "$.properties.id").cast("long"))
    J.write_collections(features, path, documents=7, order="id", gzip=True)
    f = J.read_features(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), F.from_json("value", S.FEATURE).alias("f"))
    ring = F.transform(F.from_json("f.geometry.coordinates", S.RING)[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("part", F.get_json_object("f.properties", "$.id").alias("cell_id"), corners(ring).alias("corners"))


@query("s20_report_csv", "SELECT sample, count(*) AS tiles, round(avg(value), 3) AS mean FROM metric_rows GROUP BY ALL")
def _(spark, d):
    path = shared_path(spark, "report")
    S.write_report_csv(rounded(D.metric_rows(spark, d).groupBy("sample").agg(F.count("*").alias("tiles"), F.avg("value").alias("mean")), 3), path)
    return spark.read.schema("sample string, tiles long, mean double").option("header", True).csv(path)


# Nuclei are counted in the tile of a regular grid that holds their box's upper left corner; slides are planned at 4,096 pixels.
@query("s20_tile_metadata", """WITH t AS (SELECT slide_id, r AS tile_row, c AS tile_col, r * 512 AS y1, c * 512 AS x1 FROM (SELECT DISTINCT slide_id FROM detections), range(8) AS rs(r), range(8) AS cs(c)),
n AS (SELECT slide_id, ymin // 512 AS tile_row, xmin // 512 AS tile_col, count(*) AS n FROM detections WHERE branch = 'he_nuclei' GROUP BY ALL)
SELECT slide_id, 'slide' || slide_id || '.svs' AS original_file, 'patient' || slide_id AS patient_id, CASE WHEN slide_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, tile_row AS tile_y, tile_col AS tile_x, y1 AS y_start, x1 AS x_start, coalesce(n, 0) AS num_nuclei FROM t LEFT JOIN n USING (slide_id, tile_row, tile_col)""")
def _(spark, d):
    path = shared_path(spark, "metadata")
    det = D.detections(spark, d)
    plan = plan_tiles_edge_aligned(det.select("slide_id").distinct().withColumns({"width": F.lit(4096), "height": F.lit(4096)})).withColumns({"tile_row": F.floor(F.col("y1") / 512), "tile_col": F.floor(F.col("x1") / 512)})
    counts = det.filter("branch = 'he_nuclei'").groupBy("slide_id", F.floor(F.col("ymin") / 512).alias("tile_row"), F.floor(F.col("xmin") / 512).alias("tile_col")).agg(F.count("*").alias("n"))
    S.write_tile_metadata(S.tile_metadata(plan, counts, F.when(F.col("slide_id") % 5 == 0, "test").otherwise("train")), path)
    return spark.read.schema("original_file string, patient_id string, split string, tile_y long, tile_x long, y_start long, x_start long, num_nuclei long, slide_id long").option("header", True).csv(path)


@query("p24_require", "SELECT inst_id, branch AS type FROM detections WHERE inst_id % 3 <> 0")
def _(spark, d):
    det = cells(spark, d).withColumn("bbox", F.when(F.col("id") % 3 != 0, F.col("ring"))).withColumn("centroid", F.lit(1))
    return S.require(det).select(F.col("id").alias("inst_id"), "type")
