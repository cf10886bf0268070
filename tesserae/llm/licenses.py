"""License scans: fixed phrases by place, and templates by an exact set-similarity join over text blocks.

The main path uses DataFrame functions only, and templates are a table of any size. A text block is one line, or a window
of words across line ends, so that a wrapped notice is found: for templates of up to c words (c a power of two) windows
of 2 c words begin at every c-th word, so any run of c words lies in one. Tokens are ordered by how often the corpus holds
them, rarest first. A template of n tokens contained to the share t needs a = ceil(t n) shared tokens, so a block must
hold one of the template's n - a + 1 first tokens (prefix filter), at least a of the templates' tokens (length filter),
and from the first shared token on both sides must have enough tokens left (positional filter). Only texts that hold a
prefix token, by a table of bits that misses none, are cut into blocks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CLASS, ascii_lower, table, written

# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Licence notices; their words make the templates. A parameter: these, or a table of label and text.
TEMPLATES = {
    "apache-2": ["Licensed under the Apache License, Version 2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["This text is available under CC BY-NC 4.0"],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "proprietary": ["All rights reserved. No part of this text may be reproduced without permission"],
}
THRESHOLD = 0.8
#: Most bits of the table that tells texts without a prefix token; bits for each token.
MOST_BITS, BITS_PER_TOKEN = 1 << 20, 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP_CLASS + "+"), lambda w: w != "")


def spaced(words: Column) -> Column:
    """Each word with a space before and after it, so that phrases next to each other are both found."""
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise(F.lit(""))


def _units(words: Column) -> Column:
    """Number of words in text made by spaced()."""
    return F.expr("1").cast("long") * (F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2


def template_table(spark: SparkSession, templates: Mapping[str, Sequence[str]] | DataFrame, threshold: float) -> DataFrame:
    """label, tokens (distinct), need (how many of them a block must hold) and c, the least power of two that is not below
    the number of words. Templates without words are left out."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([(label, text) for label, texts in templates.items() for text in texts], "label string, text string")
    words = templates.select("label", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    tokens = F.array_distinct("words")
    c = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("words").cast("double")))).cast("int")
    return words.select("label", tokens.alias("tokens"), F.ceil(threshold * F.size(tokens) - 1e-9).cast("int").alias("need"), c.alias("c")).distinct()


def token_order(words: DataFrame, templates: DataFrame) -> DataFrame:
    """w and n: every token of a template with how often it stands in words (rows with a column w)."""
    known = written(templates.select(F.explode("tokens").alias("w")).distinct(), "license-words")
    found = words.join(known, "w").groupBy("w").agg(F.count("*").alias("n"))
    return written(known.join(found, "w", "left").select("w", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "license-order")


def prefix_index(templates: DataFrame, order: DataFrame) -> DataFrame:
    """For each prefix token of a template: w, c (its own, and 0 for lines), label, need, wanted (the tokens in order, as
    structs of n and w) and p, the token's place in it."""
    ordered = templates.withColumn("w", F.explode("tokens")).join(order, "w").groupBy("label", "tokens", "need", "c").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("wanted"))
    prefix = ordered.select("label", "need", "wanted", F.explode(F.array(F.lit(0), F.col("c"))).alias("c"), F.posexplode(F.slice("wanted", F.lit(1), F.size("wanted") - F.col("need") + 1)).alias("p", "token"))
    return written(prefix.select(F.col("token.w").alias("w"), "c", "label", "need", "wanted", "p"), "license-index")


def matching_blocks(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """tokens: key columns, c, block, n and w. Returns the key columns, label and containment of every pair of a block and a
    template whose containment reaches the threshold; a pair is met at its first shared token only."""
    keys = [k for k in tokens.columns if k not in ("c", "block", "n", "w")]
    blocks = tokens.groupBy(*keys, "c", "block").agg(F.array_sort(F.collect_set(F.struct("n", "w"))).alias("shared"))
    hits = blocks.select(*keys, "c", "shared", F.posexplode("shared").alias("q", "token")).withColumn("w", F.col("token.w")).join(index, ["w", "c"])
    left = F.least(F.size("wanted") - F.col("p"), F.size("shared") - F.col("q"))
    hits = hits.filter((F.size("shared") >= F.col("need")) & (left >= F.col("need") - F.least("p", "q")))
    hits = hits.withColumn("common", F.array_intersect("shared", "wanted")).filter((F.size("common") >= F.col("need")) & (F.element_at("common", 1) == F.col("token")))
    return hits.select(*keys, "label", (F.size("common") / F.size("wanted")).alias("containment"))


def template_blocks(blocks: DataFrame, templates: Mapping[str, Sequence[str]] | DataFrame, threshold: float) -> DataFrame:
    """blocks: key columns, which tell them apart, and tokens (an array of words). The same join for blocks that are given."""
    wanted = template_table(blocks.sparkSession, templates, threshold)
    words = blocks.withColumn("w", F.explode("tokens")).drop("tokens").withColumns({"c": F.lit(0), "block": F.lit(0).cast("long")})
    order = token_order(words.select("w"), wanted)
    return matching_blocks(words.join(order, "w"), prefix_index(wanted, order))


def _places(w: Column, bits: int) -> list[Column]:
    """Three bits of a word, as numbers below bits, a power of two of at most MOST_BITS."""
    return [F.call_function("shiftrightunsigned", F.xxhash64(w), F.lit(20 * k)).bitwiseAND(F.lit(bits - 1)) for k in range(3)]


def _may_hold(index: DataFrame):
    """A condition on a word that every prefix token meets: all its bits are set in a table of bounded size."""
    tokens = index.select("w").distinct()
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_TOKEN * tokens.count()).bit_length()))
    set_ = tokens.select(F.explode(F.array(*_places(F.col("w"), bits))).alias("b"))
    rows = set_.groupBy((F.col("b") / 64).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
    longs = [0] * (bits // 64)
    for r in rows:
        longs[r["k"]] = r["v"]
    table_ = F.from_json(F.lit(json.dumps(longs)), "array<bigint>")
    test = lambda b: F.get(table_, F.call_function("shiftrightunsigned", b, F.lit(6)).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return lambda w: test(_places(w, bits)[0]) & test(_places(w, bits)[1]) & test(_places(w, bits)[2])


def document_blocks(docs: DataFrame, order: DataFrame, index: DataFrame) -> DataFrame:
    """docs: key columns and text. The key columns, c, block, n and w of every template token in a line (c = 0) or a window
    (c = half its words) of a text that holds a prefix token."""
    keys = [k for k in docs.columns if k != "text"]
    near = docs.filter(F.exists(words_of(F.col("text")), _may_hold(index)))
    lines = near.select(*keys, F.posexplode(F.split("text", "\n")).alias("block", "line"))
    lines = lines.select(*keys, F.lit(0).alias("c"), F.col("block").cast("long"), F.explode(words_of(F.col("line"))).alias("w")).join(order, "w")
    # Powers of two, so a few at most.
    sizes = sorted(r["c"] for r in index.select("c").distinct().collect() if r["c"])
    words = near.select(*keys, F.posexplode(words_of(F.col("text"))).alias("at", "w")).join(order, "w")
    some = F.array(*[F.lit(c) for c in sizes]) if sizes else F.array().cast("array<int>")
    windows = words.withColumn("c", F.explode(some)).withColumn("block", F.explode(F.array(F.floor(F.col("at") / F.col("c")), F.floor(F.col("at") / F.col("c")) - 1))).filter("block >= 0")
    columns = [*keys, "c", "block", "n", "w"]
    return lines.select(*columns).union(windows.select(*columns))


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """docs: doc_id and text. Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty. Rows are told apart by doc_id and text, so rows that repeat get equal results and a null
    doc_id is kept. score is the largest containment of a template in a line or a window, 1 if a phrase stands in the text.
    labels are in order, so ties between templates need no choice. Long texts are scanned whole. An empty table gives no
    rows; an empty templates table gives the base labels alone. Other columns of docs are not read, so none can clash.
    """
    words = words_of(F.col("text"))
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), spaced(words).alias("s"), F.col("text"))
    n = _units(F.col("s")).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        unit = phrase.split()
        mark = " " + "  ".join(unit) + " "
        has = F.contains(F.col("s"), F.lit(mark))
        counts.append(F.when(has, F.size(F.split(F.col("s"), mark)) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, _units(F.substring_index("s", mark, 1)).cast("long")))
        lasts.append(F.when(has, n - len(unit) - _units(F.substring_index("s", mark, -1)).cast("long")))
        labels.append(F.when(has, F.lit(label)))
    base = rows.select("doc_id", "text_key", n.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"))
    keyed = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), F.col("text"))
    wanted = template_table(docs.sparkSession, templates, threshold)
    order = token_order(docs.select(F.explode(words_of(F.col("text"))).alias("w")), wanted)
    index = prefix_index(wanted, order)
    found = matching_blocks(document_blocks(keyed, order, index), index)
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("a.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
