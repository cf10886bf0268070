"""Readers and writers of annotation formats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.polygons import padded_rings
from ..functions.rasters import simplified_rings
from ..operators.ranges import numbered
from .geojson import read_features

FEATURE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    T.StructField("properties", T.StringType()),
])
RING = "array<array<array<double>>>"


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _polygons(kind: Column, text: Column) -> Column:
    """The parts of a Polygon's or MultiPolygon's coordinates, each with all its rings, as points."""
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, RING))).when(kind == "MultiPolygon", F.from_json(text, f"array<{RING}>"))
    return F.transform(parts, lambda part: F.transform(part, _points))


def _parts(df: DataFrame) -> DataFrame:
    """A row for each polygon: part_idx, ring (the outer one) and rings (with the holes), from the coordinates of a Polygon or MultiPolygon."""
    parts = df.select("*", F.posexplode(_polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("part_idx", "rings"))
    return parts.withColumn("ring", F.col("rings")[0]).filter(F.size("ring") > 2)


def _features(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """One feature in each row: of FeatureCollections (a document in each file), or of a feature in each line."""
    if whole:
        return read_features(spark, path).select(F.from_json("value", FEATURE).alias("f"))
    return spark.read.schema(FEATURE).json(path).select(F.struct("id", "geometry", "properties").alias("f"))


def read_geojson_cells(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """cell_id (properties.id, else properties.cell_id, else id), ring: exterior ring of the first polygon, three points at
    least. Documents are read by many tasks; whole=False is for files with a feature in each line."""
    prop = lambda k: F.get_json_object("f.properties", f"$.{k}")
    return _parts(_features(spark, path, whole)).filter("part_idx = 0").select(F.coalesce(prop("id"), prop("cell_id"), F.col("f.id")).alias("cell_id"), "ring")


def read_geojson_annotations(spark: SparkSession, path: str, kind: str | None = None, whole: bool = True) -> DataFrame:
    """type (canonical), part_idx, ring (the outer one) and rings (with holes) of every polygon part; the classification may be an object or a text."""
    from ..operators.corpus import canonical_type

    name = F.coalesce(F.get_json_object("f.properties", "$.classification.name"), F.get_json_object("f.properties", "$.classification"))
    typed = canonical_type(name, F.get_json_object("f.properties", "$.objectType"))
    df = _parts(_features(spark, path, whole)).select(typed.alias("type"), "part_idx", "ring", "rings")
    return df if kind is None else df.filter(F.col("type") == kind)


def read_geojson_polygons(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """id, classification and parts (each an array of rings, the outer one first) of every Polygon and MultiPolygon, as they stand."""
    f = _features(spark, path, whole)
    prop = lambda k: F.get_json_object("f.properties", f"$.{k}")
    parts = _polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return f.select(F.coalesce(prop("id"), prop("cell_id"), F.col("f.id")).alias("id"), F.coalesce(prop("classification.name"), prop("classification")).alias("classification"), parts.alias("parts")).filter("parts IS NOT NULL")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("x_location").alias("x"), F.col("y_location").alias("y"), "feature_name")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, vertex_idx, vertex_x, vertex_y. A table without vertex_idx has no order that a cluster keeps; it is refused."""
    df = spark.read.parquet(path)
    if "vertex_idx" not in df.columns:
        raise ValueError("boundaries need vertex_idx: rows of a table have no order")
    return df.select("cell_id", "vertex_idx", "vertex_x", "vertex_y")


def read_registry_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV with lower-case column names; the second encoding is taken if the first leaves broken characters."""
    for e in encodings:
        df = spark.read.option("header", True).option("encoding", e).option("multiLine", False).csv(path)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
        if e == encodings[-1]:
            return df
        broken = F.lit(False)
        for c in df.columns:
            broken = broken | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
        if not df.filter(broken).limit(1).count():
            return df
    raise AssertionError


def rle_pixels(masks: DataFrame, height: int, image: str = "image_id", runs: str = "encoded", order: str = "row_idx") -> DataFrame:
    """image, y, x, label of run-length texts 'start length ...' (from 1, down the columns). A row's label is its place in
    the image's order; later rows overwrite."""
    from pyspark.sql import Window

    label = F.row_number().over(Window.partitionBy(image).orderBy(order))
    numbers = F.transform(F.split(F.trim(runs), r"\s+"), lambda v: v.cast("long"))
    df = masks.filter(F.length(F.trim(runs)) > 0).withColumn("label", label).withColumn("n_", numbers)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("n_") / 2).cast("int") - 1), lambda i: F.struct(F.get("n_", 2 * i).alias("s"), F.get("n_", 2 * i + 1).alias("k")))
    df = df.select(image, "label", F.explode(pairs).alias("r")).filter("r.k > 0").select(image, "label", F.explode(F.sequence(F.col("r.s") - 1, F.col("r.s") + F.col("r.k") - 2)).alias("p"))
    return df.groupBy(image, (F.col("p") % height).alias("y"), F.floor(F.col("p") / height).alias("x")).agg(F.max("label").alias("label"))


def polyline_rings(rows: DataFrame) -> DataFrame:
    """Rows of type polyline with coords_x and coords_y (comma lists) as ring of whole numbers."""
    part = lambda c: F.transform(F.split(c, ","), lambda v: F.trim(v).cast("double").cast("long").cast("double"))
    ring = F.zip_with(part("coords_x"), part("coords_y"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return rows.filter("type = 'polyline'").withColumn("ring", ring).drop("coords_x", "coords_y")


APERIO = "_Name string, Regions struct<Region:array<struct<_Id:string,Vertices:struct<Vertex:array<struct<_X:double,_Y:double>>>>>>"


def aperio_documents(cells: DataFrame, ids: int = 10_000) -> DataFrame:
    """One text column: documents of the annotations of at most so many following ids (about 2 MB), so that no text grows with
    the table. id is an integer and unique."""
    vertex = F.array_join(F.transform("ring", lambda p: F.concat(F.lit('<Vertex X="'), p["x"].cast("string"), F.lit('" Y="'), p["y"].cast("string"), F.lit('"/>'))), "")
    row = F.concat(F.lit('<Annotation Name="'), F.col("type"), F.lit('"><Regions><Region Id="'), F.col("id").cast("string"), F.lit('"><Vertices>'), vertex, F.lit("</Vertices></Region></Regions></Annotation>"))
    groups = cells.groupBy(F.floor(F.col("id") / ids).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    return groups.select(F.concat(F.lit("<Annotations>"), "rows", F.lit("</Annotations>")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """A file for each document: readers of XML stop at the end of the first root."""
    documents.write.option("maxRecordsPerFile", 1).text(path)


def read_aperio_xml(spark: SparkSession, path: str) -> DataFrame:
    """file, region_id, id, class_name and ring of every region with three vertices or more; region_id counts a file's regions from 1, as
    they stand there, by ranges, so a large file is no group of one task."""
    df = spark.read.format("xml").option("rowTag", "Annotation").schema(APERIO).load(path)
    # Annotations of a file come in order within each block that is read, and blocks tell where they begin.
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("row_"), F.col("_Name").alias("class_name"), "Regions")
    df = df.select("file", "block_", "row_", "class_name", F.posexplode("Regions.Region").alias("region_", "r"))
    ring = F.transform("r.Vertices.Vertex", lambda v: F.struct(v["_X"].alias("x"), v["_Y"].alias("y")))
    regions = df.select("file", "block_", "row_", "region_", F.col("r._Id").alias("id"), "class_name", ring.alias("ring")).filter(F.size("ring") > 2)
    counted = numbered(regions, ["file"], ["block_", "row_", "region_"], "region_id")
    return counted.select("file", (F.col("region_id") + 1).alias("region_id"), "id", "class_name", "ring")


def color_id(green: Column, blue: Column) -> Column:
    return green * 256 + blue


def slide_manifest(spark: SparkSession, path: str, extension: str | None = None, is_list: bool = False) -> DataFrame:
    """path of each slide: files of a folder by extension, or lines of a list without blanks and # lines."""
    if is_list:
        return spark.read.text(path).select(F.trim("value").alias("path")).filter((F.length("path") > 0) & ~F.col("path").startswith("#"))
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", f"*{extension}") if extension else reader).load(path).select("path")


def _measured(cells: DataFrame) -> DataFrame:
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return cells.withColumns({"area": G.area(F.col("ring")), "perimeter": G.perimeter(F.col("ring")), "centroid_x": G.vertex_mean(F.col("ring"), "x"), "centroid_y": G.vertex_mean(F.col("ring"), "y"), "box": F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))})


def detection_records(cells: DataFrame, contour: bool = False) -> DataFrame:
    """id, centroid, area, type, bbox; with contour also contour and perimeter. cells: id, ring, type."""
    m = _measured(cells)
    columns = [F.col("id"), F.array("centroid_x", "centroid_y").alias("centroid"), F.col("area"), F.col("type"), F.struct(F.array("box.xmin", "box.ymin").alias("min"), F.array("box.xmax", "box.ymax").alias("max")).alias("bbox")]
    return m.select(*columns, *([F.transform("ring", lambda p: F.array(p["x"], p["y"])).alias("contour"), F.col("perimeter")] if contour else []))


def point_features(cells: DataFrame) -> DataFrame:
    """One text column: a Point feature of each cell."""
    m = _measured(cells)
    geometry = F.struct(F.lit("Point").alias("type"), F.array("centroid_x", "centroid_y").alias("coordinates"))
    properties = F.struct("id", F.array("centroid_x", "centroid_y").alias("centroid"), "area", F.col("type").alias("classification"), (F.col("box.xmax") - F.col("box.xmin")).alias("bbox_width"), (F.col("box.ymax") - F.col("box.ymin")).alias("bbox_height"))
    return m.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def simplified(cells: DataFrame, eps: float) -> DataFrame:
    """cells with rings simplified to within eps, all rings of a batch at once; a closing point is dropped."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)

    def run(batches):
        for batch in batches:
            p, n = padded_rings(batch.column("ring"))
            kept = simplified_rings(p, n, eps)
            points = pa.StructArray.from_arrays([pa.array(p[kept][:, 0]), pa.array(p[kept][:, 1])], names=["x", "y"])
            rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32()), points)
            yield pa.RecordBatch.from_arrays([rings if name == "ring" else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

    return cells.mapInArrow(run, kinds)


def polygon_features(cells: DataFrame, eps: float = 0.0, digits: int = 2) -> DataFrame:
    """One text column: a Polygon feature of each cell with three points or more, simplified, rounded and closed."""
    cells = simplified(cells, eps) if eps > 0 else cells
    m = _measured(cells.filter(F.size("ring") >= 3)).withColumn("ring", G.closed(G.rounded_ring(F.col("ring"), digits)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    properties = F.struct("id", F.array("centroid_x", "centroid_y").alias("centroid"), "area", "perimeter", F.col("type").alias("classification"))
    return m.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def multipolygon_features(objects: DataFrame, digits: int = 2) -> DataFrame:
    """One text column: a MultiPolygon feature of each object (id, parts, type), all rings rounded and closed."""
    rings = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(G.closed(G.rounded_ring(ring, digits)), lambda p: F.array(p["x"], p["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates"))
    properties = F.struct("id", G.parts_area(F.col("parts")).alias("area"), F.col("type").alias("classification"))
    return objects.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def write_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    """A feature or record in each line; compact by nature."""
    writer = lines.write
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def write_cells_parquet(cells: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """id, centroid_x, centroid_y, area, perimeter, classification, geometry; a folder for each value of by."""
    out = _measured(cells).select("id", "centroid_x", "centroid_y", "area", "perimeter", F.col("type").alias("classification"), F.col("ring").alias("geometry"), *by)
    out.write.option("compression", "snappy").partitionBy(*by).parquet(path) if by else out.write.option("compression", "snappy").parquet(path)


def tile_metadata(tiles: DataFrame, counts: DataFrame, split: Column, tile: int = 512) -> DataFrame:
    """A row for each planned tile (slide_id, tile_row, tile_col, y1, x1): original_file, patient_id, split, tile_y, tile_x, y_start, x_start and
    num_nuclei, from counts (slide_id, tile_row, tile_col, n); tiles without one have 0."""
    found = tiles.join(counts, ["slide_id", "tile_row", "tile_col"], "left")
    slide = F.col("slide_id").cast("string")
    return found.select("slide_id", F.concat(F.lit("slide"), slide, F.lit(".svs")).alias("original_file"), F.concat(F.lit("patient"), slide).alias("patient_id"), split.alias("split"), F.col("tile_row").alias("tile_y"), F.col("tile_col").alias("tile_x"), F.col("y1").alias("y_start"), F.col("x1").alias("x_start"), F.coalesce("n", F.lit(0)).alias("num_nuclei"))


def write_tile_metadata(metadata: DataFrame, path: str, by: str = "slide_id", files_per_slide: int = 1) -> None:
    """A folder of CSV for each slide, whose tiles are in order. Rows are dealt by slide and range, so that slides share tasks but none writes
    more files than asked for by each task."""
    dealt = metadata.repartition(by) if files_per_slide == 1 else metadata.repartition(by, F.pmod(F.xxhash64("tile_y"), F.lit(files_per_slide)))
    dealt.sortWithinPartitions(by, "tile_y", "tile_x").write.option("header", True).partitionBy(by).csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def require(df: DataFrame, columns: tuple[str, ...] = ("bbox", "centroid")) -> DataFrame:
    """df without rows that lack one of the columns; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"detections need {', '.join(missing)}")
    return df.dropna(subset=list(columns))
