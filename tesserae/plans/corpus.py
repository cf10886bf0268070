"""Queries of corpora and registries."""

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.scores import rounded
from ..sources import derived as D
from .catalog import query
from .tiles import channels

ALIASES = {"ring": "Kidney", "bolt": "Liver", "widget": "Lung", "gear": "Colon"}
# Tiles with four counts, as a table of pixels gives them.
TILES = """WITH ti AS (SELECT tile_id, dataset, sample, count(DISTINCT gt_label) FILTER (gt_label > 0) AS he_nuclei, count(DISTINCT pred_label) FILTER (pred_label > 0 AND tile_id % 2 = 0) AS he_cell,
  count(DISTINCT pred_label) FILTER (pred_label > 0 AND tile_id % 3 = 0) AS mif_nuclei, (tile_id % 5) AS mif_cell FROM label_pixels GROUP BY ALL)
"""
SPLIT = "((row_id * 2654435761 + 0) % 1000003)"


def tiles(spark, d):
    some = lambda c, cond: F.countDistinct(F.when((F.col(c) > 0) & cond, F.col(c)))
    t = F.col("tile_id")
    return D.label_pixels(spark, d).groupBy("tile_id", "dataset", "sample").agg(some("gt_label", F.lit(True)).alias("he_nuclei"), some("pred_label", t % 2 == 0).alias("he_cell"), some("pred_label", t % 3 == 0).alias("mif_nuclei")).withColumn("mif_cell", t % 5)


def reg(spark, d):
    return D.registry(spark, d)


@query("q14_filter_tiles_by_count", TILES + "SELECT tile_id, he_nuclei + he_cell + mif_nuclei + mif_cell AS n, he_cell FROM ti WHERE he_nuclei + he_cell + mif_nuclei + mif_cell >= 20 AND he_nuclei > 0 AND he_cell > 0")
def _(spark, d):
    kept = C.filter_tiles_by_count(C.filter_tiles_by_count(tiles(spark, d), least=20), drop_empty=True, counts=("he_nuclei", "he_cell"))
    return kept.select("tile_id", F.expr("he_nuclei + he_cell + mif_nuclei + mif_cell").alias("n"), "he_cell")


@query("w6_dedupe_keep_first", "SELECT slide_id, row_id, diagnosis FROM registry QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY row_id) = 1")
def _(spark, d):
    return C.dedupe_keep_first(reg(spark, d), ["slide_id"], ["row_id"]).select("slide_id", "row_id", "diagnosis")


@query("w7_one_case_per_type", "SELECT row_id, diagnosis, min(row_id) OVER (PARTITION BY diagnosis) AS keeper, row_id <> min(row_id) OVER (PARTITION BY diagnosis) AS duplicate FROM registry")
def _(spark, d):
    return C.one_case_per_type(reg(spark, d), "row_id").select("row_id", "diagnosis", "keeper", "duplicate")


@query("u5_moved_cases", "SELECT row_id FROM registry EXCEPT SELECT min(row_id) FROM registry GROUP BY diagnosis")
def _(spark, d):
    keep = reg(spark, d).groupBy("diagnosis").agg(F.min("row_id").alias("row_id")).select("row_id")
    return reg(spark, d).select("row_id").exceptAll(keep)


@query("i30_case_type_counts", "SELECT diagnosis, count(*) AS cases FROM registry GROUP BY ALL")
def _(spark, d):
    return C.case_type_counts(reg(spark, d))


@query("w8_percent_of_total", "SELECT diagnosis, count(*) AS cases, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM registry GROUP BY ALL")
def _(spark, d):
    return C.percent_of_total(C.case_type_counts(reg(spark, d)), "cases")


@query("w9_head_middle_tail", "WITH c AS (SELECT sample, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sample) AS k FROM metric_rows GROUP BY sample) SELECT sample, n, CASE WHEN k <= 3 THEN 'head' WHEN k <= 8 THEN 'middle' ELSE 'tail' END AS bucket FROM c")
def _(spark, d):
    return C.head_middle_tail(D.metric_rows(spark, d).groupBy("sample").agg(F.count("*").alias("n")), "n", "sample")


@query("p25_exclude_controls", "SELECT row_id FROM registry WHERE lower(diagnosis) NOT LIKE '%small%' AND lower(diagnosis) NOT LIKE '%econ%'")
def _(spark, d):
    return C.exclude_controls(reg(spark, d), words=("small", "econ")).select("row_id")


@query("j13_case_to_type", """WITH t AS (SELECT substr(slide_id, 1, 6) AS p, arg_min(diagnosis, row_id) AS diagnosis FROM registry WHERE row_id % 3 <> 0 GROUP BY ALL)
SELECT row_id, coalesce(t.diagnosis, 'UNKNOWN') AS diagnosis FROM registry r LEFT JOIN t ON substr(r.slide_id, 1, 6) = t.p""")
def _(spark, d):
    cases = reg(spark, d).filter("row_id % 3 <> 0").withColumnRenamed("slide_id", "s_").groupBy(F.substring("s_", 1, 6).alias("slide_id")).agg(F.min_by("diagnosis", "row_id").alias("diagnosis"))
    return C.case_to_type(reg(spark, d).select("row_id", F.col("slide_id").alias("folder")), cases, "folder").select("row_id", "diagnosis")


@query("f12_parse_organs", """WITH p AS (SELECT row_id, trim(unnest(string_split(organ_text, ' '))) AS part FROM registry), q AS (SELECT row_id, lower(part) AS part FROM p WHERE part <> '' AND lower(part) <> 'small')
SELECT DISTINCT row_id, CASE WHEN part LIKE '%ring%' THEN 'Kidney' WHEN part LIKE '%bolt%' THEN 'Liver' WHEN part LIKE '%widget%' THEN 'Lung' WHEN part LIKE '%gear%' THEN 'Colon' ELSE upper(part[1]) || part[2:] END AS organ FROM q""")
def _(spark, d):
    r = reg(spark, d).withColumn("organ_text", F.replace("organ_text", F.lit(" "), F.lit(", ")))
    return C.organs(r, "organ_text", ALIASES, ["small"]).select("row_id", "organ")


@query("f13_parse_count", "SELECT row_id, coalesce(try_cast(nullif(regexp_replace(count_text, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS n FROM registry")
def _(spark, d):
    return reg(spark, d).select("row_id", C.parse_count(F.col("count_text")).alias("n"))


@query("f14_organ_systems", "SELECT split_part(organ_text, ' ', 2) AS organ, count(DISTINCT diagnosis) AS datasets, sum(row_id % 7)::BIGINT AS samples FROM registry GROUP BY ALL")
def _(spark, d):
    return reg(spark, d).groupBy(F.split("organ_text", " ")[1].alias("organ")).agg(F.countDistinct("diagnosis").alias("datasets"), F.sum(F.col("row_id") % 7).alias("samples"))


ORGANS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
HAS = {o: f"max((split_part(organ_text, ' ', 2) = '{o}')::INT)" for o in ORGANS}


@query("f15_organ_matrix", "SELECT diagnosis, " + ", ".join(f"{v} AS {o}" for o, v in HAS.items()) + ", " + " + ".join(HAS.values()) + " AS organs FROM registry GROUP BY diagnosis")
def _(spark, d):
    return C.organ_matrix(reg(spark, d).withColumn("organ", F.split("organ_text", " ")[1]), "diagnosis", ORGANS)


@query("f16_log_share", "SELECT row_id, round(least(greatest(log10(greatest(row_id, 1)) / log10(5000.0), 0), 1), 9) AS share FROM registry")
def _(spark, d):
    return rounded(reg(spark, d).select("row_id", C.log_share(F.col("row_id"), F.lit(5000.0)).alias("share")))


@query("f17_diagnosis_groups", "SELECT CASE WHEN lower(diagnosis) LIKE '%small%' THEN 'A' WHEN lower(diagnosis) LIKE '%st%' THEN 'B' WHEN lower(diagnosis) LIKE '%e%' THEN 'C' ELSE 'Other' END AS grp, count(*) AS n FROM registry GROUP BY ALL")
def _(spark, d):
    return reg(spark, d).groupBy(C.diagnosis_group(F.col("diagnosis"), [("small", "A"), ("st", "B"), ("e", "C")]).alias("grp")).agg(F.count("*").alias("n"))


SHORT = "CASE WHEN %(n)s >= 1000000 THEN printf('%%.1fM', %(n)s / 1e6) WHEN %(n)s >= 1000 THEN printf('%%.1fK', %(n)s / 1e3) ELSE (%(n)s)::VARCHAR END"


# Every row; small holds ties of the K form, large ties of the M form and numbers beyond 999.9M.
@query("f18_short_count", f"SELECT row_id, {SHORT % {'n': 'row_id * 50'}} AS small, {SHORT % {'n': 'row_id * 1000'}} AS label, {SHORT % {'n': 'row_id * 12350000'}} AS large FROM registry")
def _(spark, d):
    n = F.col("row_id")
    return reg(spark, d).select("row_id", C.short_count(n * 50).alias("small"), C.short_count(n * 1000).alias("label"), C.short_count(n * 12350000).alias("large"))


@query("f19_channel_name", "SELECT row_id, organ_text AS name FROM registry")
def _(spark, d):
    return reg(spark, d).select("row_id", C.channel_name(F.concat(F.lit("img - "), "organ_text", F.lit(".ome.tif"))).alias("name"))


@query("p18_canonical_type", "SELECT row_id, CASE WHEN lower(diagnosis || ' ' || organ_text) LIKE '%cytoplasm%' OR lower(diagnosis || ' ' || organ_text) LIKE '%bolt%' THEN 'Cell' ELSE 'Nucleus' END AS kind FROM registry")
def _(spark, d):
    name = F.replace("organ_text", F.lit("bolt"), F.lit("cell"))
    return reg(spark, d).select("row_id", C.canonical_type(F.col("diagnosis"), name).alias("kind"))


@query("p19_match_dataset", "SELECT DISTINCT dataset FROM metric_rows WHERE lower(dataset) = 'small' OR lower(dataset) LIKE '%small%'")
def _(spark, d):
    return D.metric_rows(spark, d).filter(C.same_dataset(F.col("dataset"), " SMALL_test")).select("dataset").distinct()


@query("p21_route_dataset", "SELECT sample, CASE WHEN starts_with(sample, 'Brand#1') THEN 'one' WHEN starts_with(sample, 'Brand#2') THEN 'two' WHEN sample = 'Brand#3' THEN 'three' ELSE 'xenium' END AS routed FROM (SELECT DISTINCT sample FROM metric_rows)")
def _(spark, d):
    s = D.metric_rows(spark, d).select("sample").distinct()
    return s.select("sample", C.route_dataset(F.col("sample"), [("Brand#1", "one"), ("Brand#2", "two")], {"Brand#3": "three"}).alias("routed"))


# Names that the default routes meet: each prefix alone and with a number, older names, and others.
SAMPLES = ["tissuenet", "pannuke", "lizard", "monuseg", "monusac", "tnbc", "nuinsseg", "cryonuseg", "bc", "consep", "kumar", "cpm17", "CRC", "cpm15", "he_dsb2018", "fluorescence_dsb2018", "panoptils", "Fold", "train", "val", "test", "Lizard", "crc", "Xenium"]
ROUTED = """SELECT row_id, name, CASE
  WHEN name IN ('train', 'val', 'test') THEN 'tissuenet' WHEN starts_with(name, 'Fold') THEN 'pannuke' WHEN starts_with(name, 'CRC') THEN 'crc'
  ELSE coalesce(nullif(regexp_extract(name, '^(tissuenet|pannuke|lizard|monuseg|monusac|tnbc|nuinsseg|cryonuseg|bc|consep|kumar|cpm17|cpm15|he_dsb2018|fluorescence_dsb2018|panoptils)', 1), ''), 'xenium') END AS routed
FROM (SELECT row_id, list_extract([%s], (row_id %% 24 + 1)::INT) || CASE WHEN row_id %% 3 = 0 THEN '' ELSE '_' || row_id END AS name FROM registry)""" % ", ".join(f"'{s}'" for s in SAMPLES)


@query("p21_route_defaults", ROUTED)
def _(spark, d):
    name = F.concat(F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("row_id") % len(SAMPLES) + 1).cast("int")), F.when(F.col("row_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.col("row_id").cast("string"))))
    return reg(spark, d).select("row_id", name.alias("name")).withColumn("routed", C.route_dataset(F.col("name")))


MOD = "CASE WHEN he_nuclei + he_cell > 0 AND mif_nuclei + mif_cell > 0 THEN 'Mixed' WHEN mif_nuclei + mif_cell > 0 THEN 'MIF Only' WHEN he_nuclei + he_cell > 0 THEN 'HE Only' ELSE 'none' END"


@query("p22_classify_modality", TILES + f"SELECT tile_id, {MOD} AS modality FROM ti")
def _(spark, d):
    return tiles(spark, d).select("tile_id", C.classify_modality().alias("modality"))


@query("i7_dataset_statistics", TILES + f""", s AS (SELECT dataset, sample, count(*) AS tiles, sum(he_nuclei)::BIGINT AS he_nuclei, sum(he_cell)::BIGINT AS he_cell, sum(mif_nuclei)::BIGINT AS mif_nuclei, sum(mif_cell)::BIGINT AS mif_cell FROM ti GROUP BY ALL)
SELECT *, {MOD} AS modality, he_nuclei + he_cell + mif_nuclei + mif_cell AS total, round(log10(he_nuclei + he_cell + mif_nuclei + mif_cell + 1), 9) AS log_total FROM s""")
def _(spark, d):
    return rounded(C.dataset_statistics(tiles(spark, d)))


@query("t2_sorted_totals", TILES + "SELECT dataset, sum(he_nuclei)::BIGINT AS total, count(*) AS tiles FROM ti GROUP BY dataset")
def _(spark, d):
    return tiles(spark, d).groupBy("dataset").agg(F.sum("he_nuclei").alias("total"), F.count("*").alias("tiles")).orderBy(F.desc("total"), "dataset")


@query("i8_image_statistics", """WITH b AS (SELECT tile_id // 50 AS batch, channel, avg(((x*13 + y*7 + channel*31 + tile_id) % 256)::DOUBLE) AS m, stddev_samp(((x*13 + y*7 + channel*31 + tile_id) % 256)::DOUBLE) AS s FROM label_pixels, range(3) AS cs(channel) GROUP BY ALL)
SELECT channel, round(avg(m), 6) AS mean, round(avg(s), 6) AS std FROM b GROUP BY channel""")
def _(spark, d):
    return rounded(C.image_statistics(channels(spark, d), F.expr("tile_id div 50")), 6)


@query("i9_split_summary", TILES + "SELECT CASE WHEN tile_id % 10 = 0 THEN 'test' WHEN tile_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(DISTINCT sample) AS slides, count(*) AS patches, sum(he_nuclei)::BIGINT AS nuclei, round(avg(he_nuclei), 9) AS per_patch FROM ti GROUP BY ALL")
def _(spark, d):
    t = tiles(spark, d).withColumn("split", F.expr("CASE WHEN tile_id % 10 = 0 THEN 'test' WHEN tile_id % 10 = 1 THEN 'val' ELSE 'train' END")).withColumnsRenamed({"sample": "slide_id", "he_nuclei": "nuclei"})
    return rounded(C.split_summary(t))


@query("i10_image_inventory", "SELECT count(*) AS total, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, count(*) FILTER (width <> 1024 OR height <> 1024) AS odd_size, count(*) FILTER (slide_id % 9 = 0) AS missing_xml, 3 AS classes FROM slides")
def _(spark, d):
    s = D.slides(spark, d).withColumn("xml", F.when(F.col("slide_id") % 9 != 0, F.lit("x"))).withColumn("classes", F.array(F.concat(F.lit("c"), (F.col("slide_id") % 3).cast("string"))))
    return C.image_inventory(s, 1024).withColumn("classes", F.size("classes"))


def files(spark, d):
    s = D.slides(spark, d)
    return s.filter("slide_id % 4 <> 0").select("slide_id", F.lit("i").alias("image")), s.filter("slide_id % 6 <> 0").select("slide_id", F.lit("m").alias("mask"))


@query("j9_pair_files", "SELECT slide_id FROM slides WHERE slide_id % 4 <> 0 AND slide_id % 6 <> 0")
def _(spark, d):
    return C.pair_files(*files(spark, d), "slide_id")[0].select("slide_id")


@query("j10_missing_annotations", "SELECT slide_id FROM slides WHERE slide_id % 4 <> 0 AND slide_id % 6 = 0")
def _(spark, d):
    return C.pair_files(*files(spark, d), "slide_id")[1].select("slide_id")


@query("j11_pair_modalities", "SELECT slide_id, 'h' || slide_id AS he_path, 'm' || slide_id AS mif_path FROM slides WHERE slide_id % 2 = 0 AND slide_id % 3 = 0")
def _(spark, d):
    s = D.slides(spark, d).withColumn("tile_id", F.lit(0))
    he = s.filter("slide_id % 2 = 0").select("slide_id", "tile_id", F.lit("he").alias("modality"), F.concat(F.lit("h"), F.col("slide_id").cast("string")).alias("path"))
    mif = s.filter("slide_id % 3 = 0").select("slide_id", "tile_id", F.lit("mif").alias("modality"), F.concat(F.lit("m"), F.col("slide_id").cast("string")).alias("path"))
    return C.pair_modalities(he.unionByName(mif)).drop("tile_id")


@query("j14_replace_masks", "SELECT slide_id, CASE WHEN slide_id % 6 <> 0 THEN 'replaced' ELSE 'kept' END AS status, CASE WHEN slide_id % 6 <> 0 THEN 'm' ELSE 'own' END AS mask FROM slides")
def _(spark, d):
    return C.replace_masks(D.slides(spark, d).select("slide_id", F.lit("own").alias("mask")), files(spark, d)[1], "slide_id")


@query("i11_integrity_issues", "SELECT sample, issue FROM (SELECT slide_id AS sample, unnest([CASE WHEN width <> 1024 OR height <> 1024 THEN 'wrong_size' END, CASE WHEN slide_id % 5 <> slide_id % 7 THEN 'count_mismatch' END, CASE WHEN slide_id % 8 = 0 THEN 'no_labels_in_first_10' END]) AS issue FROM slides) WHERE issue IS NOT NULL")
def _(spark, d):
    s = D.slides(spark, d).selectExpr("slide_id AS sample", "slide_id % 5 AS images", "slide_id % 7 AS masks", "width", "height", "slide_id % 8 AS labels_in_first")
    return C.integrity_issues(s, 1024)


@query("s10_choose_sample_files", "SELECT slide_id // 4 AS \"case\", min(CASE WHEN slide_id % 3 <> 0 THEN 's' || slide_id || '_he.tif' END) AS image, max('s' || slide_id || '.geojson') AS annotation FROM slides GROUP BY 1 HAVING min(CASE WHEN slide_id % 3 <> 0 THEN 's' || slide_id || '_he.tif' END) IS NOT NULL")
def _(spark, d):
    i = F.col("slide_id").cast("string")
    name = F.array(F.when(F.col("slide_id") % 3 != 0, F.concat(F.lit("s"), i, F.lit("_he.tif"))).otherwise(F.concat(F.lit("s"), i, F.lit("_he_mif.tif"))), F.concat(F.lit("s"), i, F.lit(".geojson")))
    return C.choose_sample_files(D.slides(spark, d).select(F.expr("slide_id div 4").alias("case"), F.explode(name).alias("name")))


@query("g5_build_patch_index", "SELECT dataset, sample, unnest(range(n)) AS patch_idx FROM (SELECT dataset, sample, least(count(*), count(*) FILTER (tile_id % 3 = 0)) // 8 AS n FROM metric_rows GROUP BY ALL) WHERE n > 0")
def _(spark, d):
    s = D.metric_rows(spark, d).groupBy("dataset", "sample").agg(F.expr("count(*) div 8").alias("n_images"), F.expr("count_if(tile_id % 3 = 0) div 8").alias("n_masks"))
    return C.patch_index(s).drop("sub_sample")


@query("p26_accept_dense_patches", TILES + "SELECT tile_id FROM ti WHERE he_nuclei >= 6 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY tile_id) <= 3")
def _(spark, d):
    return C.accept_dense_patches(tiles(spark, d).withColumn("cells", F.col("he_nuclei")), "sample", 6, 3, "tile_id").select("tile_id")


@query("g7_split_ratio", f"SELECT row_id, CASE WHEN row_id = 3 THEN 'test' WHEN {SPLIT} / 1000003.0::DOUBLE < 0.7::DOUBLE THEN 'train' WHEN {SPLIT} / 1000003.0::DOUBLE < 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM registry")
def _(spark, d):
    return C.split_ratio(reg(spark, d), "row_id", 0.7, 0.2, 0.1, explicit={3: "test"}).select("row_id", "split")


@query("g8_split_holdout", f"SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY diagnosis ORDER BY {SPLIT}, row_id) <= CASE WHEN count(*) OVER (PARTITION BY diagnosis) > 1 THEN greatest(1, floor(count(*) OVER (PARTITION BY diagnosis) * 0.1::DOUBLE)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM registry")
def _(spark, d):
    return C.split_holdout(reg(spark, d), "diagnosis", "row_id").select("row_id", "split")


def group_splits(spark, d):
    g = D.metric_rows(spark, d).select("sample").distinct()
    return g.withColumn("split", F.when(F.length("sample") % 2 == 0, "val").otherwise("test"))


@query("g9_split_by_group", "SELECT tile_id, sample, CASE WHEN length(sample) % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT tile_id, sample FROM metric_rows)")
def _(spark, d):
    t = D.metric_rows(spark, d).select("tile_id", "sample").distinct()
    out = C.split_by_group(t, "sample", group_splits(spark, d))
    return out.join(C.leaks(out, "sample"), "sample", "left_anti").select("tile_id", "sample", "split")


@query("g10_split_composition", f"SELECT CASE WHEN {SPLIT} / 1000003.0::DOUBLE < 0.8::DOUBLE THEN 'train' WHEN {SPLIT} / 1000003.0::DOUBLE < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split, diagnosis AS dataset, count(*) AS n FROM registry GROUP BY ALL")
def _(spark, d):
    return C.split_composition(C.split_ratio(reg(spark, d), "row_id", 0.8, 0.1, 0.1).withColumnRenamed("diagnosis", "dataset"))


@query("u1_union_mid_edge", "SELECT inst_id, branch FROM detections")
def _(spark, d):
    det = D.detections(spark, d).select("inst_id", "branch")
    return det.filter("branch = 'he_cell'").unionByName(det.filter("branch <> 'he_cell'")).orderBy("inst_id")


@query("u2_union_modalities", "SELECT slide_id, CASE WHEN slide_id % 2 = 0 THEN width END AS width, CASE WHEN slide_id % 2 = 1 THEN height END AS height FROM slides")
def _(spark, d):
    s = D.slides(spark, d)
    return s.filter("slide_id % 2 = 0").select("slide_id", "width").unionByName(s.filter("slide_id % 2 = 1").select("slide_id", "height"), allowMissingColumns=True)


@query("u3_union_classes", "SELECT class_name FROM detections UNION SELECT branch FROM detections")
def _(spark, d):
    det = D.detections(spark, d)
    return det.select("class_name").union(det.select("branch")).distinct()
