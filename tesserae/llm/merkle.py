"""Manifest of a data set as a Merkle tree: a digest for every row, a root for every group and one for all.

Within a group rows are leaves in order; every two consecutive nodes of a level, or the last one alone, become the digest
of their concatenated digests until one is left. Levels are kept as strings: an aligned block of 1,024 nodes is one string
of their digests, hex digits one after the other; fixed-width pieces of it are hashed to give the next level's string, and
the pieces beside a node's own are its siblings. The roots of a group's blocks are the nodes of the next layer, in the same
way, and the groups' roots are the leaves of the last tree. A block is what one task holds, so no group is ever one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import table, written

#: Levels of a block of nodes, and its nodes.
LEVELS = 10
BLOCK = 1 << LEVELS
#: Characters of a digest.
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row's values, each `-` if null, else its bytes in UTF-8, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _levels_of(size: Column) -> Column:
    """Levels above so many nodes."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _first(levels: Column) -> Column:
    return F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), 1, levels)


def _piece(level: Column, at: Column, width: int) -> Column:
    return F.substring(level, (at * width + 1).cast("int"), F.lit(width))


def _parents(level: Column) -> Column:
    places = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (2 * DIGEST)).cast("int"))
    return F.array_join(F.transform(places, lambda i: digest(_piece(level, i, 2 * DIGEST))), "").cast("binary")


def _strings(nodes: Column, levels: Column) -> Column:
    """The strings of a block's levels, its nodes first, as bytes, which are cut without a scan."""
    lowest = F.array(F.array_join(nodes, "").cast("binary"))
    return F.aggregate(_first(levels), lowest, lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))))


def _siblings(levels: Column, at: Column) -> Column:
    """The digest beside a node's own at each level under the block's root, empty where the node stands alone."""
    below = F.slice(levels, 1, F.size(levels) - 1)
    return F.transform(below, lambda level, k: _piece(level, F.call_function("shiftright", at, k).bitwiseXOR(F.lit(1)), DIGEST).cast("string"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """group, block, members (structs of at, node and item, in order), levels, above (the digests beside the way of the
    block's root) and top (the group's root) for nodes (item, group, at, size, node), which at numbers from 0 in a group of that size."""
    number = F.floor(F.col("at") / BLOCK).cast("long")
    blocks = nodes.groupBy("group", number.alias("block")).agg(F.max("size").alias("size"), F.collect_list(F.struct("at", "node", "item")).alias("members"))
    ordered = F.array_sort("members", lambda a, b: F.sign(a["at"] - b["at"]).cast("int"))
    full = F.when(F.col("size") > BLOCK, LEVELS).otherwise(_levels_of(F.col("size")))
    blocks = blocks.withColumns({"members": ordered, "levels": full})
    root = F.element_at(_strings(F.col("members.node"), F.col("levels")), -1).cast("string")
    blocks = written(blocks.withColumn("own", root), "blocks")
    large = blocks.filter(F.col("size") > BLOCK)
    none = F.array().cast("array<string>")
    if large.isEmpty():
        return blocks.withColumns({"above": none, "top": F.col("own")})
    roots = large.select(F.lit(None).cast("boolean").alias("item"), "group", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("own").alias("node"))
    upper = _ways(_blocks(roots)).select(F.col("group").alias("group_"), F.col("at").alias("block_"), F.col("path").alias("above"), "top")
    match = F.col("group").eqNullSafe(F.col("group_")) & (F.col("block") == F.col("block_"))
    return blocks.join(upper, match, "left").withColumns({"above": F.coalesce("above", none), "top": F.coalesce("top", "own")}).drop("group_", "block_")


def _ways(blocks: DataFrame, *more: str) -> DataFrame:
    """item, group, at, node, path (the digests beside a node's way to its group's root), top and more columns of blocks, a row for each member."""
    strings = blocks.withColumn("strings", _strings(F.col("members.node"), F.col("levels")))
    way = F.transform("members", lambda m, k: F.struct(m["item"].alias("item"), m["at"].alias("at"), m["node"].alias("node"), F.concat(_siblings(F.col("strings"), k), F.col("above")).alias("path")))
    return strings.select("group", "top", *more, F.explode(way).alias("m")).select("m.item", "group", "m.at", "m.node", "m.path", "top", *more)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", keep: Sequence[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: row_ (a struct of the kept columns, all by default, and of more ones), leaf, at, path and
    subroot within its group, top_at and top_path of the group, and root.

    A null is a value of its own, also as a group. Rows of a group go by order, nulls first, and rows that tie by digest;
    repeated rows are leaves beside each other. Empty and long texts are hashed whole. A group of one row has its leaf as root
    and an empty path, as has a data set of one group. An empty table gives no row. Columns that are called as results
    stay in row_.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    leaves = docs.select(F.struct(*kept, *[c.alias(n) for n, c in (more or {}).items()]).alias("item"), F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("node"))
    leaves = written(leaves, "leaves")  # ranges are drawn from it, so that texts are hashed once
    lower = _blocks(numbered(leaves, ["group"], ["order", "node"], "at", "size"))
    subroots = lower.filter("block = 0").select(F.col("group").alias("item"), F.lit(0).alias("group"), F.col("top").alias("node"))
    upper = _ways(_blocks(numbered(subroots, [], ["item"], "at", "size"))).select(F.col("item").alias("group_"), F.col("at").alias("top_at"), F.col("path").alias("top_path"), F.col("top").alias("root"))
    joined = _ways(lower.join(upper, F.col("group").eqNullSafe(F.col("group_"))), "top_at", "top_path", "root")
    return joined.select(F.col("item").alias("row_"), F.col("node").alias("leaf"), "at", "path", F.col("top").alias("subroot"), "top_at", "top_path", "root")


def folded(node: Column, at: Column, path: Column) -> Column:
    """The root that a node and the digests beside its way lead to."""
    steps = F.transform(path, lambda s, k: F.struct(s.alias("beside"), F.getbit(at, k).alias("right")))
    return F.aggregate(steps, node, lambda h, s: digest(F.when(s["right"] == 1, F.concat(s["beside"], h)).otherwise(F.concat(h, s["beside"]))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The sum is a decimal, which the largest integer does not overflow.
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = leaf_digest([changed.get(f, F.col(f)) for f in FIELDS])
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered).otherwise(leaf_digest([F.col(f) for f in FIELDS]))
    made = manifest(docs, keep=["doc_id"], more={"claimed": claimed})
    root = folded(folded(F.col("row_.claimed"), F.col("at"), F.col("path")), F.col("top_at"), F.col("top_path"))
    proof = digest(F.array_join(F.concat("path", "top_path"), ""))
    rows = made.select("row_.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
