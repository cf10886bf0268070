"""Tables of the tissue-image domain that Spark derives from the star-schema tables, with the same rows in DuckDB's SQL.

Integer arithmetic only, so both engines agree. Slides are as dense at every size: their number grows with the rows. TABLES_SQL is a WITH list; queries' SQL is put behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tiles or slides of a task.
GROUPS_PER_TASK = 4096


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key over as many tasks as its rows need, before each row becomes hundreds. What is made of a key's row stays in its task, and
    Spark knows; it does not know how much that is, so joins of such tables ask for no broadcast."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // GROUPS_PER_TASK))
    return df.repartition(n, key)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inst_id, slide_id, branch, xmin, ymin, xmax, ymax (longs), class_name, and ring, the box's corners."""
    u = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("pk"), F.max("l_suppkey").alias("sk"), F.floor(F.max("l_quantity")).alias("qt"), F.max("l_linestatus").alias("ls"), F.max("l_returnflag").alias("sm"))
    box = u.select(
        F.expr("cast(l_orderkey * 8 + l_linenumber as bigint)").alias("inst_id"),
        F.expr("cast(4 * (l_orderkey div 16384) + sk % 4 as bigint)").alias("slide_id"),
        F.expr("CASE WHEN ls = 'O' THEN 'he_nuclei' ELSE 'he_cell' END").alias("branch"),
        F.expr("cast((l_orderkey * 7919 + l_linenumber * 104729) % 4096 as bigint)").alias("xmin"),
        F.expr("cast((pk * 6151 + sk * 3571 + l_linenumber * 12289) % 4096 as bigint)").alias("ymin"),
        F.expr("cast(12 + qt % 17 as bigint)").alias("w"),
        F.expr("cast(12 + pk % 17 as bigint)").alias("h"),
        F.col("sm").alias("class_name"),
    )
    box = box.withColumn("xmax", F.expr("xmin + w")).withColumn("ymax", F.expr("ymin + h")).drop("w", "h")
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return box.withColumn("ring", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax")))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, slide_id, x, y (between pixels), feature_name, cell_key."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("transcript_id"),
        F.expr("cast(4 * (event_id div 16384) + event_id % 4 as bigint)").alias("slide_id"),
        F.expr("cast((event_id * 2654435761) % 4096 as double) + 0.5D").alias("x"),
        F.expr("cast((event_id * 40503 + user_id * 7919) % 4096 as double) + 0.5D").alias("y"),
        F.expr("concat('G', cast(user_id % 40 as string))").alias("feature_name"),
        F.col("user_id").cast("long").alias("cell_key"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, ps, sample, dataset: a row for each part."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("tile_id"), F.col("p_size").cast("long").alias("ps"), F.col("p_brand").alias("sample"), F.split("p_type", " ")[0].alias("dataset"))


def label_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, y, x, gt_label, pred_label, sample, dataset: a 16 x 16 tile for each part, background included."""
    p = dealt(tiles(spark, sf_dir), "tile_id")
    grid = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
    return grid.select(
        "tile_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"),
        F.expr("cast(CASE WHEN (tile_id * 31 + (x div 5) * 7 + (y div 5) * 13) % 4 <> 0 AND x % 5 < 4 AND y % 5 < 4 THEN 1 + (x div 5) + 4 * (y div 5) ELSE 0 END as bigint)").alias("gt_label"),
        F.expr("cast(CASE WHEN (tile_id * 17 + ((x + tile_id % 3) div 5) * 11 + ((y + ps % 2) div 5) * 5) % 5 <> 0 AND (x + tile_id % 3) % 5 < 4 THEN 1 + ((x + tile_id % 3) div 5) + 4 * ((y + ps % 2) div 5) ELSE 0 END as bigint)").alias("pred_label"),
        "sample", "dataset",
    )


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_id, width, height, mpp (null for some), magnification (null for some)."""
    s = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("slide_id"),
        F.expr("cast(600 + o_orderkey % 5000 as bigint)").alias("width"),
        F.expr("cast(600 + (o_custkey * 37) % 5000 as bigint)").alias("height"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0.2125D WHEN o_orderkey % 3 = 1 THEN 0.25D ELSE 0.5D END").alias("mpp"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(20 + 20 * (o_orderkey % 2) as bigint) END").alias("magnification"),
    )
    return dealt(s, "slide_id")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, slide_id (repeats on purpose), diagnosis, organ_text, count_text."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("row_id"),
        F.expr("concat('MOS', lpad(cast(p_partkey % 1000 as string), 3, '0'), 'S1')").alias("slide_id"),
        F.col("p_type").alias("diagnosis"),
        F.col("p_name").alias("organ_text"),
        F.expr("concat('~', cast(p_partkey as string), ' (', cast(p_size as string), ')')").alias("count_text"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, slide, status, seconds, detections."""
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("slide"), F.expr("CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END").alias("status"), F.col("value").cast("double").alias("seconds"), F.expr("cast(event_id % 997 as bigint)").alias("detections"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, dataset, sample, model, branch, metric, value (hundredths as double; null where not applicable)."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("tile_id"), F.split("p_type", " ")[0].alias("dataset"), F.col("p_brand").alias("sample"), F.expr("concat('m', cast(p_size % 3 as string))").alias("model"))
    p = p.select("*", F.explode(F.array(*[F.lit(b) for b in BRANCHES])).alias("branch")).select("*", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    return p.withColumn("value", F.expr("CASE WHEN (tile_id + length(branch)) % 11 = 0 THEN NULL ELSE cast((tile_id * 37 + length(branch) * 17 + length(metric) * 29) % 101 as double) / 100 END"))


# The four branches and the metrics of a record.
BRANCHES = ("he_nuclei", "he_cell", "mif_nuclei", "mif_cell")
METRICS = ("dice", "iou", "pq", "aji")

TABLES_SQL = r"""
WITH detections AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS inst_id, CAST(4 * (l_orderkey // 16384) + sk % 4 AS BIGINT) AS slide_id,
    CASE WHEN ls = 'O' THEN 'he_nuclei' ELSE 'he_cell' END AS branch,
    CAST((l_orderkey * 7919 + l_linenumber * 104729) % 4096 AS BIGINT) AS xmin,
    CAST((pk * 6151 + sk * 3571 + l_linenumber * 12289) % 4096 AS BIGINT) AS ymin,
    CAST((l_orderkey * 7919 + l_linenumber * 104729) % 4096 + 12 + qt % 17 AS BIGINT) AS xmax,
    CAST((pk * 6151 + sk * 3571 + l_linenumber * 12289) % 4096 + 12 + pk % 17 AS BIGINT) AS ymax, sm AS class_name
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS pk, max(l_suppkey) AS sk, CAST(floor(max(l_quantity)) AS BIGINT) AS qt, max(l_linestatus) AS ls, max(l_returnflag) AS sm
        FROM lineitem GROUP BY l_orderkey, l_linenumber)),
transcripts AS (
  SELECT CAST(event_id AS BIGINT) AS transcript_id, CAST(4 * (event_id // 16384) + event_id % 4 AS BIGINT) AS slide_id,
    CAST((event_id * 2654435761) % 4096 AS DOUBLE) + 0.5 AS x, CAST((event_id * 40503 + user_id * 7919) % 4096 AS DOUBLE) + 0.5 AS y,
    'G' || CAST(user_id % 40 AS VARCHAR) AS feature_name, CAST(user_id AS BIGINT) AS cell_key FROM events),
label_pixels AS (
  SELECT tile_id, y, x,
    CAST(CASE WHEN (tile_id * 31 + (x // 5) * 7 + (y // 5) * 13) % 4 <> 0 AND x % 5 < 4 AND y % 5 < 4 THEN 1 + (x // 5) + 4 * (y // 5) ELSE 0 END AS BIGINT) AS gt_label,
    CAST(CASE WHEN (tile_id * 17 + ((x + tile_id % 3) // 5) * 11 + ((y + ps % 2) // 5) * 5) % 5 <> 0 AND (x + tile_id % 3) % 5 < 4 THEN 1 + ((x + tile_id % 3) // 5) + 4 * ((y + ps % 2) // 5) ELSE 0 END AS BIGINT) AS pred_label,
    sample, dataset
  FROM (SELECT CAST(p_partkey AS BIGINT) AS tile_id, CAST(p_size AS BIGINT) AS ps, p_brand AS sample, split_part(p_type, ' ', 1) AS dataset FROM part), range(16) AS ys(y), range(16) AS xs(x)),
slides AS (
  SELECT CAST(o_orderkey AS BIGINT) AS slide_id, CAST(600 + o_orderkey % 5000 AS BIGINT) AS width, CAST(600 + (o_custkey * 37) % 5000 AS BIGINT) AS height,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0.2125::DOUBLE WHEN o_orderkey % 3 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS mpp,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(20 + 20 * (o_orderkey % 2) AS BIGINT) END AS magnification FROM orders),
registry AS (
  SELECT CAST(p_partkey AS BIGINT) AS row_id, 'MOS' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || 'S1' AS slide_id, p_type AS diagnosis, p_name AS organ_text,
    '~' || CAST(p_partkey AS VARCHAR) || ' (' || CAST(p_size AS VARCHAR) || ')' AS count_text FROM part),
runs AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS slide, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(value AS DOUBLE) AS seconds, CAST(event_id % 997 AS BIGINT) AS detections FROM events),
metric_rows AS (
  SELECT *, CASE WHEN (tile_id + length(branch)) % 11 = 0 THEN NULL ELSE CAST((tile_id * 37 + length(branch) * 17 + length(metric) * 29) % 101 AS DOUBLE) / 100 END AS value
  FROM (SELECT CAST(p_partkey AS BIGINT) AS tile_id, split_part(p_type, ' ', 1) AS dataset, p_brand AS sample, 'm' || CAST(p_size % 3 AS VARCHAR) AS model FROM part),
    (SELECT unnest(['he_nuclei', 'he_cell', 'mif_nuclei', 'mif_cell']) AS branch), (SELECT unnest(['dice', 'iou', 'pq', 'aji']) AS metric)),
"""
