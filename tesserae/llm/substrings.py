"""Substring deduplication by seed and extend, over words.

Documents meet at winnowed anchors: the seeds of shared windows. At an anchor each context is joined with the document of
the smallest id that has one of its windows there, and both are extended both ways from the anchor as far as they are equal.
A common run of at least WINDOW words makes the windows in it repeats, and runs of repeated windows are the maximal
repeats over the threshold. A context has at most WINDOW - GRAM + 1 windows, so it is joined with as many others at most,
however many meet at its anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import SPACED, span_hash, span_places, word_bounds
from .common import table
from .repeats import Contexts, Shape, Units, remove_repeats

WINDOW, GRAM = 13, 4


def word_units(data: np.ndarray, starts: np.ndarray) -> Units:
    """Every word with a space after it; the form has nothing else."""
    begins, ends, first = word_bounds(data, starts, SPACED)
    sizes = ends - begins
    to = np.cumsum(sizes + 1)
    form = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    form[span_places(to - sizes - 1, sizes)] = data[span_places(begins, sizes)]
    return Units(form, to - sizes - 1, to, first)


SHAPE = Shape(WINDOW, GRAM, word_units)


def _extend(blob: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Words (spaces) in the common bytes from a and b on, going by step, at most room bytes."""
    words = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(int(room.max(initial=0))):
        alive = alive[room[alive] > k]
        x = blob[a[alive] + k * step]
        good = x == blob[b[alive] + k * step]
        alive, x = alive[good], x[good]
        if not len(alive):
            break
        words[alive] += x == 32
    return words


def extend_anchors(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a context shares with one of a smaller doc, by extension from the anchor."""
    n = len(c.seed)
    # A space in front of every context, so that its first word is seen to begin there.
    sizes = c.size + 1
    begin = np.cumsum(sizes) - sizes
    blob = np.full(int(sizes.sum()), 32, np.uint8)
    blob[span_places(begin + 1, c.size)] = c.blob[span_places(c.begin, c.size)]
    at = begin + 1 + c.before
    # The context of the smallest doc for each window, told by its hash; the extension decides.
    word = np.flatnonzero(blob == 32) + 1
    window = span_places(np.searchsorted(word, begin + 1), c.windows)
    owner = np.repeat(np.arange(n), c.windows)
    h = span_hash(blob, word[window], word[window + WINDOW])
    order = np.lexsort((c.doc[owner], h, c.seed[owner]))
    owner, h = owner[order], h[order]
    new = np.ones(len(owner), bool)
    new[1:] = (h[1:] != h[:-1]) | (c.seed[owner][1:] != c.seed[owner][:-1])
    leader = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(owner) else owner
    later = c.doc[leader] < c.doc[owner]
    a, b = np.divmod(np.unique(leader[later] * n + owner[later]), max(n, 1))
    right = _extend(blob, at[a], at[b], np.minimum((begin + sizes - at)[a], (begin + sizes - at)[b]), 1)
    left = _extend(blob, at[a] - 1, at[b] - 1, np.minimum((at - begin)[a], (at - begin)[b]), -1) - 1
    total = np.concatenate([[0], np.cumsum(blob == 32)])
    # Words before the anchor in b's context; windows are numbered from the context's first word.
    ahead = (total[at] - total[begin] - 1)[b]
    lo, hi = np.maximum(ahead - left, 0), np.minimum(ahead + right - WINDOW, c.windows[b] - 1)
    good = lo <= hi
    return b[good], lo[good], hi[good]


def deduplicate_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (words), spans (removed runs of words) and kept (the rest, a space after each word); odd rows as in
    remove_repeats."""
    return remove_repeats(docs, SHAPE, extend_anchors)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_substrings(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    kept = F.substring("kept", F.lit(1), F.greatest(F.octet_length("kept") - 1, F.lit(0)))
    return found.select("doc_id", F.col("n_units").alias("n_words"), n.alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
