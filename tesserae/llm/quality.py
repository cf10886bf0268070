"""Quality rules: every rule is measured once into a ledger of bits; policies and ablations only read the ledger.

ledger() is the one pass over the texts. A row holds the measurements and an integer whose bit k is set if rule k
failed. A policy is a mask of rules and a number of failures that it allows; applying one, or asking how many rows each
rule alone removes, is bit arithmetic and bitwise aggregation over the ledger and reads no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import SPACED, byte_class, span_hash, sums_by_text, text_slices, word_bounds
from .common import bound_batches, table, written

# Symbols, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def measure_slice(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text; starts bounds the texts in data."""
    begins, ends, first = word_bounds(data, starts, SPACED)
    n = np.diff(first)
    point = (data & 0xC0) != 0x80  # a byte that begins a code point
    inside = SPACED[data]
    out = {"n_words": n, "word_chars": sums_by_text(point & inside, starts), "n_symbols": sums_by_text(~byte_class(SYMBOLS)[data], starts)}
    # Lines: cut at \n; a line counts if it has a word.
    broken = data == 10
    breaks = np.flatnonzero(broken)
    line_begin = np.sort(np.concatenate([starts[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([starts[1:], breaks]), kind="stable")
    text = np.repeat(np.arange(len(n)), sums_by_text(broken, starts) + 1)
    words_in = np.searchsorted(begins, line_end) - np.searchsorted(begins, line_begin)
    full = words_in > 0
    out["n_lines"] = np.bincount(text[full], minlength=len(n))
    lines = np.stack([text[full].astype(np.uint64), span_hash(data, line_begin[full], line_end[full])], 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(_distinct(lines), minlength=len(n))
    # Windows of three words found twice or more in a text; a word counts once however many windows hold it.
    h, owner = span_hash(data, begins, ends), np.repeat(np.arange(len(n)), n)
    repeated = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        with np.errstate(over="ignore"):
            w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            at = np.flatnonzero(owner[:-2] == owner[2:])
            w = w[at] ^ (owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(w, kind="stable")
        same = np.zeros(len(w) + 1, bool)
        same[1:-1] = (w[order[1:]] == w[order[:-1]]) & (owner[at[order[1:]]] == owner[at[order[:-1]]])
        twice = at[order[same[1:] | same[:-1]]]
        for k in range(WINDOW):
            repeated[twice + k] = True
    out["n_repeat_words"] = sums_by_text(repeated, first)
    return out


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The first column of the distinct rows."""
    if not len(pairs):
        return np.zeros(0, np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])
    return pairs[new, 0].astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, starts in text_slices(batch.column("text")):
            found = measure_slice(data, starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *[pa.array(found[m].astype(np.int64)) for m in MEASURES]], names=["doc_id", *MEASURES])


#: When each rule fails, over the measurements; the order gives the bits of the ledger, so new rules go to the end.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines > 4 AND 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "many_words": "n_words > 100000",
}


@dataclass(frozen=True)
class Policy:
    """version names it; rules are those that count; a row is kept if at most allowed of them fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", tuple(RULES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed, a long with a bit for each rule.

    One row for each row of docs (repeated rows repeat); null and empty texts have no words; doc_id may be null; long texts
    are measured whole; an empty table gives none. Other columns are not read, so none can clash.
    """
    bound_batches(docs.sparkSession)
    measured = docs.select("doc_id", "text").mapInArrow(_measure, SCHEMA)
    bits = sum((F.when(F.expr(failure), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, failure in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measured.withColumn("failed", bits)


def passes(policy: Policy) -> Column:
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.allowed


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: version, rule, rows that fail it, rows that only it removes (they would be kept without it)
    and rows kept. Bits are counted by failure pattern, of which there are 2 ** rules at most, and the patterns are then
    asked bit by bit. An empty ledger gives zeros."""
    bits = {name: 1 << k for k, name in enumerate(RULES) if name in policy.rules}
    rules = book.sparkSession.createDataFrame([(name,) for name in bits], "rule string")
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = book.groupBy(failed.alias("pattern")).agg(F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(b).cast("long").alias("bit")) for name, b in bits.items()])
    each = patterns.select("pattern", "n", F.inline(asked))
    fails, others = F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.bit_count(F.col("pattern").bitwiseAND(F.bitwise_not("bit")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    found = each.groupBy("rule").agg(total(fails).alias("fails"), total(fails & (F.bit_count("pattern") > policy.allowed) & (others <= policy.allowed)).alias("removes_alone"), total(F.bit_count("pattern") <= policy.allowed).alias("kept"))
    zero = F.lit(0).cast("long")
    return rules.join(found, "rule", "left").select(F.lit(policy.version).alias("version"), "rule", *[F.coalesce(c, zero).alias(c) for c in ("fails", "removes_alone", "kept")])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", *MEASURES[:-1], (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(STRICT)).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies' ablations from one ledger, which is written once and read for each."""
    book = written(ledger(table(spark, sf_dir, "documents")), "ledger")
    return ablations(book, BASE).union(ablations(book, STRICT))
