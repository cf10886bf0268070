"""Corpora of annotated data sets: statistics, registries, splits, integrity and the texts that describe them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

# Prefixes of sample names and their data set, first match wins, then exact names and a prefix of older sets.
ROUTES = (
    ("tissuenet", "tissuenet"), ("pannuke", "pannuke"), ("lizard", "lizard"), ("monuseg", "monuseg"), ("monusac", "monusac"), ("tnbc", "tnbc"),
    ("nuinsseg", "nuinsseg"), ("cryonuseg", "cryonuseg"), ("bc", "bc"), ("consep", "consep"), ("kumar", "kumar"), ("cpm17", "cpm17"), ("CRC", "crc"),
    ("cpm15", "cpm15"), ("he_dsb2018", "he_dsb2018"), ("fluorescence_dsb2018", "fluorescence_dsb2018"), ("panoptils", "panoptils"), ("Fold", "pannuke"),
)
LEGACY = {"train": "tissuenet", "val": "tissuenet", "test": "tissuenet"}
COUNTS = ("he_nuclei", "he_cell", "mif_nuclei", "mif_cell")


def keyed_hash(id: Column, seed: int = 0) -> Column:
    """An order that looks random and is the same in every engine that has integers."""
    return F.pmod(id * 2654435761 + seed * 40503, F.lit(1_000_003))


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order; rows with a null key are dropped."""
    good = df.dropna(subset=list(keys))
    return good.withColumn("k_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("k_ = 1").drop("k_")


def one_case_per_type(cases: DataFrame, case: str = "slide_id", kind: str = "diagnosis") -> DataFrame:
    """Every case with the keeper of its type (the smallest) and whether it is a duplicate."""
    keeper = F.min(case).over(Window.partitionBy(kind))
    return cases.withColumn("keeper", keeper).withColumn("duplicate", F.col(case) != F.col("keeper"))


def percent_of_total(counts: DataFrame, value: str) -> DataFrame:
    """Share in percent, two decimals. For aggregated tables: the total is taken over all rows."""
    return counts.withColumn("percent", F.round(F.col(value) * 100 / F.sum(value).over(Window.partitionBy(F.lit(1))), 2))


def head_middle_tail(counts: DataFrame, value: str, name: str, head: int = 3, middle: int = 5) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(value), name))
    return counts.withColumn("k_", k).withColumn("bucket", F.when(F.col("k_") <= head, "head").when(F.col("k_") <= head + middle, "middle").otherwise("tail")).drop("k_")


def case_type_counts(cases: DataFrame, kind: str = "diagnosis") -> DataFrame:
    return cases.groupBy(kind).agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), kind)


def exclude_controls(cases: DataFrame, kind: str = "diagnosis", words: Sequence[str] = ("control", "tonsil")) -> DataFrame:
    out = cases
    for w in words:
        out = out.filter(~F.coalesce(F.lower(kind).contains(w), F.lit(False)))
    return out


def case_to_type(files: DataFrame, cases: DataFrame, folder: str, case: str = "slide_id", kind: str = "diagnosis", prefix: int = 6) -> DataFrame:
    """The type of the case whose id begins with the folder's name; UNKNOWN without one."""
    types = cases.groupBy(F.substring(case, 1, prefix).alias("p_")).agg(F.min_by(kind, case).alias(kind))
    return files.join(types, F.substring(folder, 1, prefix) == F.col("p_"), "left").withColumn(kind, F.coalesce(kind, F.lit("UNKNOWN"))).drop("p_")


def diagnosis_group(text: Column, rules: Sequence[tuple[str, str]], other: str = "Other") -> Column:
    """The group of the first rule (part of the text, group) that fits."""
    out = F.lit(other)
    for part, group in reversed(rules):
        out = F.when(F.lower(text).contains(part.lower()), F.lit(group)).otherwise(out)
    return out


def organs(registry: DataFrame, text: str, aliases: Mapping[str, str], excluded: Sequence[str] = (), known: Sequence[str] = ()) -> DataFrame:
    """Rows (the registry's columns, organ) from free text: a prefix 'Human organs:' and brackets are unfolded, parts are
    cut at commas, aliases apply exactly, then by part in their order, else the part in title case; distinct by row."""
    flat = F.regexp_replace(F.regexp_replace(F.col(text), "(?i)^human organs:", ""), r"[()]", ",")
    df = registry.withColumn("part_", F.explode(F.split(flat, r"[,;/&]"))).withColumn("part_", F.trim("part_")).filter((F.col("part_") != "") & ~F.lower("part_").isin([e.lower() for e in excluded]))
    low, found = F.lower("part_"), F.initcap("part_")
    for a, o in reversed(list(aliases.items())):
        found = F.when(low.contains(a), F.lit(o)).otherwise(found)
    for a, o in aliases.items():
        found = F.when(low == a, F.lit(o)).otherwise(found)
    return df.withColumn("organ", found).drop("part_").distinct()


def parse_count(text: Column) -> Column:
    """The digits of a text as a number; 0 without any."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long"))


def organ_matrix(organ_rows: DataFrame, dataset: str, names: Sequence[str]) -> DataFrame:
    """0 or 1 for each data set and organ, and their number."""
    m = organ_rows.select(dataset, "organ").distinct().groupBy(dataset).pivot("organ", list(names)).agg(F.count(F.lit(1))).fillna(0)
    return m.withColumn("organs", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def log_share(n: Column, most: Column) -> Column:
    """log10 of a count by that of the largest, 0 to 1."""
    return F.least(F.greatest(F.log10(F.greatest(n, F.lit(1))) / F.log10(most), F.lit(0.0)), F.lit(1.0))


def short_count(n: Column) -> Column:
    """1.2M, 3.4K or the number; no separators of thousands, and ties of the double go to the even digit as in printf."""
    one = lambda v: F.replace(F.format_number(v, 1), F.lit(","), F.lit(""))
    return F.when(n >= 1_000_000, F.concat(one(n / 1e6), F.lit("M"))).when(n >= 1_000, F.concat(one(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def channel_name(text: Column) -> Column:
    """Without file endings, and only what follows the last ' - '."""
    return F.trim(F.substring_index(F.regexp_replace(text, r"(?i)\.(ome\.)?tiff?$", ""), " - ", -1))


def canonical_type(name: Column, kind: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, kind))
    return F.when(text.contains("cytoplasm") | text.contains("cell"), "Cell").otherwise("Nucleus")


def same_dataset(source: Column, target: str) -> Column:
    norm = F.replace(F.lower(F.trim(source)), F.lit("_test"), F.lit(""))
    want = target.strip().lower().replace("_test", "")
    return (norm == want) | norm.contains(want)


def route_dataset(sample: Column, routes: Sequence[tuple[str, str]] = ROUTES, legacy: Mapping[str, str] = LEGACY, other: str = "xenium") -> Column:
    out = F.lit(other)
    for name, d in legacy.items():
        out = F.when(sample == name, F.lit(d)).otherwise(out)
    for prefix, d in reversed(routes):
        out = F.when(sample.startswith(prefix), F.lit(d)).otherwise(out)
    return out


def classify_modality(he_nuclei: str = "he_nuclei", he_cell: str = "he_cell", mif_nuclei: str = "mif_nuclei", mif_cell: str = "mif_cell") -> Column:
    he, mif = (F.col(he_nuclei) + F.col(he_cell)) > 0, (F.col(mif_nuclei) + F.col(mif_cell)) > 0
    return F.when(he & mif, "Mixed").when(mif, "MIF Only").when(he, "HE Only").otherwise("none")


def dataset_statistics(tiles: DataFrame, keys: Sequence[str] = ("dataset", "sample")) -> DataFrame:
    """tiles: keys, tile_id and the four counts. Sums, modality, total and log10(total + 1), largest first."""
    sums = tiles.groupBy(*keys).agg(F.count("*").alias("tiles"), *[F.sum(c).alias(c) for c in COUNTS])
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return sums.withColumn("modality", classify_modality()).withColumn("total", total).withColumn("log_total", F.log10(F.col("total") + 1)).orderBy(F.desc("total"), *keys)


def image_statistics(pixels: DataFrame, batch: Column) -> DataFrame:
    """Mean and deviation of each channel in batches of tiles, averaged over batches."""
    per = pixels.groupBy(batch.alias("batch"), "channel").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return per.groupBy("channel").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def split_summary(tiles: DataFrame) -> DataFrame:
    """tiles: split, slide_id, nuclei."""
    return tiles.groupBy("split").agg(F.countDistinct("slide_id").alias("slides"), F.count("*").alias("patches"), F.sum("nuclei").alias("nuclei"), F.avg("nuclei").alias("per_patch"))


def image_inventory(images: DataFrame, size: int = 512) -> DataFrame:
    """One row: total, least and largest sides, images of another size, images without annotation, and classes."""
    return images.agg(F.count("*").alias("total"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.count_if((F.col("width") != size) | (F.col("height") != size)).alias("odd_size"), F.count_if(F.col("xml").isNull()).alias("missing_xml"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("classes")))).alias("classes"))


def pair_files(images: DataFrame, masks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, images without a mask)."""
    return images.join(masks, key), images.join(masks.select(key).distinct(), key, "left_anti")


def integrity_issues(samples: DataFrame, size: int = 512, first: int = 10) -> DataFrame:
    """samples: sample, images, masks, width, height, labels_in_first. One row for each issue."""
    checks = {
        "missing_file": F.col("images").isNull() | F.col("masks").isNull(),
        "count_mismatch": F.col("images") != F.col("masks"),
        "wrong_size": (F.col("width") != size) | (F.col("height") != size),
        f"no_labels_in_first_{first}": F.col("labels_in_first") == 0,
    }
    return samples.withColumn("issue", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))).select("sample", "issue")


def replace_masks(own: DataFrame, other: DataFrame, key: str, value: str = "mask") -> DataFrame:
    """The other table's mask where there is one; status says which was taken."""
    o = other.select(key, F.col(value).alias("other_"))
    return own.join(o, key, "left").withColumn("status", F.when(F.col("other_").isNotNull(), "replaced").otherwise("kept")).withColumn(value, F.coalesce("other_", value)).drop("other_")


def pair_modalities(tiles: DataFrame, keys: Sequence[str] = ("slide_id", "tile_id")) -> DataFrame:
    he, mif = tiles.filter("modality = 'he'"), tiles.filter("modality = 'mif'")
    return he.select(*keys, F.col("path").alias("he_path")).join(mif.select(*keys, F.col("path").alias("mif_path")), [*keys])


def patch_index(samples: DataFrame, layout: str = "flat") -> DataFrame:
    """dataset, sample, sub_sample, patch_idx of samples (n_images, n_masks; sub_sample in the nested layout) that have
    both images and masks; dual: only where both have the same number."""
    good = samples.filter("n_images > 0 AND n_masks > 0")
    good = good.filter("n_images = n_masks") if layout == "dual" else good
    sub = F.col("sub_sample") if layout == "nested" else F.lit(None).cast("string")
    return good.select("dataset", "sample", sub.alias("sub_sample"), F.explode(F.sequence(F.lit(0), F.least("n_images", "n_masks") - 1)).alias("patch_idx"))


def accept_dense_patches(patches: DataFrame, group: str, least: int = 300, n: int = 3, order: str = "patch_id") -> DataFrame:
    """The first n patches of each group with at least so many cells."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return patches.filter(F.col("cells") >= least).withColumn("k_", k).filter(F.col("k_") <= n).drop("k_")


def filter_tiles_by_count(tiles: DataFrame, least: int = 0, drop_empty: bool = False, counts: Sequence[str] = ("he_nuclei", "he_cell", "mif_nuclei", "mif_cell")) -> DataFrame:
    """Tiles with at least so many instances over all counts (a missing count is 0) and, with drop_empty, with none of the
    counts at 0. By default every tile stays."""
    n = [F.coalesce(F.col(c), F.lit(0)) for c in counts]
    kept = tiles.filter(sum(n[1:], n[0]) >= least)
    return kept.filter(F.least(*n, F.lit(1 << 62)) > 0) if drop_empty else kept


def split_ratio(df: DataFrame, id: str, train: float, val: float, test: float, seed: int = 0, explicit: Mapping[int, str] | None = None) -> DataFrame:
    """split of every row by a hash of its id, so shares hold approximately and no row needs another; explicit ids win."""
    if abs(train + val + test - 1) > 1e-3:
        raise ValueError("shares must sum to 1")
    h = keyed_hash(F.col(id), seed) / 1_000_003
    out = F.when(h < train, "train").when(h < train + val, "val").otherwise("test")
    for k, s in (explicit or {}).items():
        out = F.when(F.col(id) == k, F.lit(s)).otherwise(out)
    return df.withColumn("split", out)


def split_holdout(df: DataFrame, group: str, id: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Of each group's training rows a share by hash becomes val: one at least if there are several. Rows are numbered by ranges."""
    rows = numbered(df.withColumn("hash_", keyed_hash(F.col(id), seed)), [group], ["hash_", id], "k_", "n_")
    take = F.when(F.col("n_") > 1, F.greatest(F.lit(1), F.floor(F.col("n_") * share))).otherwise(0)
    return rows.withColumn("split", F.when(F.col("k_") < take, "val").otherwise("train")).drop("hash_", "k_", "n_")


def split_by_group(df: DataFrame, group: str, splits: DataFrame) -> DataFrame:
    """The split of each row's group (a table group, split); train without one."""
    return df.join(splits, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def leaks(df: DataFrame, group: str) -> DataFrame:
    """Groups that stand in several splits."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def split_composition(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "dataset").agg(F.count("*").alias("n"))


def choose_sample_files(files: DataFrame) -> DataFrame:
    """case, image (the first H&E image by name) and annotation (the last GeoJSON); cases that lack one are dropped."""
    image = F.lower("name").rlike(r"[_\-](he|hne)[_\-.]") & ~F.lower("name").contains("mif") & ~F.lower("name").endswith(".geojson")
    got = files.groupBy("case").agg(F.min(F.when(image, F.col("name"))).alias("image"), F.max(F.when(F.lower("name").endswith(".geojson"), F.col("name"))).alias("annotation"))
    return got.filter("image IS NOT NULL AND annotation IS NOT NULL")
