"""SimHash near-duplicates: fingerprints, links by deletion-variant signatures, and groups.

Fingerprints that differ in at most two of 64 bits differ in at most one bit in one of two segments of 32. So each
distinct fingerprint is indexed under its 64 variants with one bit of one segment left out, and those that meet under a
variant are compared. Under a variant that more than BUCKET fingerprints share (large groups of near copies), pairs are
not formed: such fingerprints are dealt out by every value within one bit of them instead. Two fingerprints are within two
bits exactly if they share such a value, at most 65 can share one, and each is linked only to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import ASCII_LOWER, SPACED, text_slices, word_bounds
from .common import bound_batches, drop_written, table, written
from .components import connected_components

BITS, SEGMENT, WITHIN, SHINGLE, SEED = 64, 32, 2, 3, 42
#: Fingerprints under one variant up to which they are compared with each other.
BUCKET = 16


def fingerprint(shingles: list[bytes]) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero without shingles."""
    if not shingles:
        return 0
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints_of(data: np.ndarray, starts: np.ndarray) -> list[int]:
    """Of each text in data."""
    low = ASCII_LOWER[data]
    begins, ends, first = word_bounds(low, starts, SPACED)
    sizes = np.diff(first)
    blob, at, to = _joined(low, begins, ends)
    out = []
    for k in range(len(sizes)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a > SHINGLE:
            out.append(fingerprint([blob[i:j] for i, j in zip(at[a : b - SHINGLE + 1], to[a + SHINGLE - 1 : b], strict=True)]))
        else:
            out.append(fingerprint([blob[at[a] : to[b - 1]]] if b > a else []))
    return out


def _joined(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """(all words with one space after each, begins, ends of the words in it); a shingle is a slice of it."""
    sizes = ends - begins
    to = np.cumsum(sizes + 1) - 1
    at = to - sizes
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    out[_inside(at, sizes)] = low[_inside(begins, sizes)]
    return out.tobytes(), at.tolist(), to.tolist()


def _inside(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places in the spans of these sizes."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begins - (total - sizes), sizes)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, starts in text_slices(batch.column("text")):
            f = np.array(fingerprints_of(data, starts), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(f)], names=["doc_id", "f"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long; null texts have fingerprint zero."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint, "doc_id long, f long")


def _bit(k: int) -> Column:
    return F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")


def links(prints: DataFrame) -> DataFrame:
    """prints: distinct longs f. Pairs a, b of different ones that link them all as 'within two bits' does: every
    linked pair is in the rows or connected through rows whose ends are within two bits."""
    keys = []
    for k in range(BITS):
        segment = F.col("f").bitwiseAND(F.lit((1 << SEGMENT) - 1)) if k < SEGMENT else F.call_function("shiftrightunsigned", F.col("f"), F.lit(SEGMENT))
        keys.append(segment.bitwiseAND(F.bitwise_not(_bit(k % SEGMENT))).bitwiseOR(F.lit(k << SEGMENT).cast("long")))
    variants = prints.select("f", F.explode(F.array(*keys)).alias("key"))
    # Counting combines on the map side, so a key of very many fingerprints is no group in one task. Both sides grow with
    # the input, so they are always joined by a shuffle, which can split such a key.
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    many = written(variants.join(sizes.hint("merge"), "key"), "buckets")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= WITHIN
    few = many.filter(f"n <= {BUCKET}").groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    ones = few.select(F.posexplode("fs").alias("i", "a"), "fs").select("a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b")).filter(near("a", "b"))
    hot = many.filter(f"n > {BUCKET}").select("f").distinct()
    around = [F.col("f"), *[F.col("f").bitwiseXOR(_bit(k)) for k in range(BITS)]]
    balls = hot.select("f", F.explode(F.array(*around)).alias("centre")).groupBy("centre").agg(F.sort_array(F.collect_list("f")).alias("fs")).filter(F.size("fs") > 1)
    stars = balls.select(F.element_at("fs", 1).alias("a"), F.explode(F.slice("fs", 2, BITS + 1)).alias("b"))
    found = written(ones.union(stars).distinct(), "links")
    drop_written(many)
    return found


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, f and component_id: the smallest doc_id that the fingerprint is linked with by steps of at most two bits.

    One row for each row of docs. Null texts and texts without words share the fingerprint zero; a text of fewer than
    three words is one shingle; long texts are read whole. A null doc_id is kept and never the component's; a component of
    null ids alone has none. An empty table gives no rows; other columns are not read, so none can clash.
    """
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = links(distinct.select("f"))
    found = connected_components(edges)
    drop_written(edges)
    joined = distinct.join(found, distinct["f"] == found["node"], "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    best = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    of_print = joined.join(best, "c").select("f", "component_id")
    return prints.join(of_print, "f").select("doc_id", "f", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id and, of rows that share it, the one of the least hash of
    all columns (rows of equal hash are equal).

    Rows without a doc_id can't be named as a group's first and all stay. Null texts and texts without words are one group.
    An empty table gives none. Columns may be of any type, maps included, and may be called as results.
    """
    groups = group_near_duplicates(docs.select("doc_id", "text"))
    stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("keep_")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row_"), F.col("doc_id").cast("long").alias("id_"))
    kept = rows.join(stay, F.col("id_") == F.col("keep_")).groupBy("keep_").agg(F.min_by("row_", F.xxhash64(F.to_json("row_"))).alias("row_"))
    return kept.select("row_.*").union(docs.filter("doc_id IS NULL"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
