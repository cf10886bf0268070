"""Alignment of two tokenizers' tokens over the same bytes, and how often ids meet in a corpus.

Both tokenizers cut a text's bytes; where tokens of both end, a group ends. Most stretches are one to one: token i of the one ends
where token i + shift of the other does. Probes of doubling size compare the two arrays of ends at the present shift, halving ones find where
such a stretch stops, and the irregular group that follows is walked token by token and gives the new shift. All texts of a slice are
walked as one, since a text's end is an end of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pieces
from .bpe import file_bytes, spread, text_slices
from .common import bound_batches, packed, table, written

#: Bytes of text that are encoded at once, and aligned at once.
ENCODED, SLICE = 2 << 20, 1 << 19
#: Bits of an id within the number of a pair.
ID_BITS = 20
#: Groups of more links are counted by distinct ids, one by one.
LARGE = 256
#: Pairs held by more than a 65,536th of all links of documents are fewer than that, and are broadcast.
HOT = 1 << 16


class ByteMerges:
    """The byte-level vocabulary as merges of bytes, all distinct pieces of many texts at a time."""

    def __init__(self, pairs: bpe.BytePairs):
        keys, made = np.array([a << 32 | b for a, b in pairs.merged], np.int64), np.array([*pairs.merged.values()])
        self.merges = pieces.Merges(keys, np.array(pairs.rank)[made], made)
        self.byte = np.zeros(256, np.int32)
        for i, b in enumerate(pairs.bytes):
            if len(b) == 1 and pairs.rank[i] < 0:
                self.byte[b[0]] = i
        self.raw, self.known = pairs.decode, pieces.Known()
        self.sizes = pairs.sizes

    def _encode_new(self, words: list[str]) -> list[bytes]:
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        ids, word = self.merges.merge(self.byte[np.frombuffer(b"".join(data), np.uint8)], np.repeat(np.arange(len(words)), sizes))
        return pieces.by_word(ids, word, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Special tokens in them are ordinary text."""
        return bpe.encode_words(texts, bpe.piece_starts, lambda words: self.known.of(words, self._encode_new))


@lru_cache(2)
def load(file: bytes) -> ByteMerges:
    return ByteMerges(bpe.BytePairs(file))


def runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of both sides and number of groups, for each stretch of one-to-one groups or, with number 1, each irregular
    group, of which the last tokens stand for the first. a and b are ascending 32-bit integers and end alike."""
    out: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    # Stretches are compared as bytes, four for each token.
    one, two, x, y = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    while i < n:
        p, q, step = 4 * i, 4 * j, 16
        while one[p : p + step] == two[q : q + step]:
            p += step
            q += step
            step *= 2
            if p >= 4 * n or q >= 4 * m:
                break
        while step > 4:
            step //= 2
            if one[p : p + step] == two[q : q + step]:
                p += step
                q += step
        k = min(p // 4, n, m + i - j) - i
        if k:
            out += (i, j, k)
            i += k
            j += k
            if i >= n:
                break
        left, right = x[i], y[j]
        while left != right:
            if left < right:
                i += 1
                left = x[i]
            else:
                j += 1
                right = y[j]
        out += (i, j, 1)
        i += 1
        j += 1
    left, right, many = np.array(out, np.int64).reshape(-1, 3).T
    return left, right, many


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side up to the end of each group."""
    left, right, many = runs(a.astype(np.int32), b.astype(np.int32))
    return spread(left, many) + 1, spread(right, many) + 1


def _links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, id of a, id of b) as numbers, ascending, and how many links each has. na, nb and doc tell of each group."""
    links = na * nb
    begin_a, begin_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = links <= LARGE
    count, width = links[small], np.repeat(nb[small], links[small])
    nth = spread(np.zeros(len(count), np.int64), count)
    ida = a[np.repeat(begin_a[small], count) + nth // width].astype(np.int64)
    idb = b[np.repeat(begin_b[small], count) + nth % width].astype(np.int64)
    keys, times = np.unique(np.repeat(doc[small], count) << 2 * ID_BITS | ida << ID_BITS | idb, return_counts=True)
    if small.all():
        return keys, times
    more = [(keys, times)]
    for g in np.flatnonzero(~small).tolist():
        ua, ca = np.unique(a[begin_a[g] : begin_a[g] + na[g]].astype(np.int64), return_counts=True)
        ub, cb = np.unique(b[begin_b[g] : begin_b[g] + nb[g]].astype(np.int64), return_counts=True)
        more.append(((doc[g] << 2 * ID_BITS | ua[:, None] << ID_BITS | ub).ravel(), (ca[:, None] * cb).ravel()))
    keys, inverse = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, np.concatenate([t for _, t in more]))
    return keys, total


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids below size, with a place for what follows, and their numbers."""
    width = len(str(size)) + 1
    text = np.char.ljust(np.arange(size).astype(str), width).astype(f"S{width}")
    return text.view(np.uint8).reshape(size, width), np.char.str_len(np.char.strip(text)).astype(np.int64)


def _written_groups(digits, a, b, ends_a, ends_b, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2` for all groups as bytes, and the bytes before each token's text; the last tokens of texts are followed by nothing."""
    na, nb = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    n = len(a) + len(b)
    ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    place_a = np.arange(len(a)) + np.repeat(ends_b - nb, na)
    place_b = np.arange(len(b)) + np.repeat(ends_a, nb)
    ids[place_a], ids[place_b] = a, b
    after[place_a[ends_a - 1]] = ord("|")
    after[place_b[ends_b - 1]] = ord(";")
    table, lengths = digits
    rows, size = table[ids], lengths[ids]
    rows[np.arange(n), size] = after
    kept = np.arange(rows.shape[1]) <= size[:, None]
    kept[last, size[last]] = False
    return rows[kept], np.concatenate([[0], np.cumsum(kept.sum(1))])


def align_texts(pairs: ByteMerges, model: pieces.Pieces, texts: pa.Array, digits) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
    """Successive rows of texts with n_a, n_b, n_groups, n_links, groups and links of each: encoded together, aligned about SLICE bytes at a time."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    led = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    coded = [pairs.encode(led), model.encode(texts)]
    before = [np.concatenate([[0], np.cumsum(counts)]) for _, counts in coded]
    for row, end in text_slices(led, SLICE):
        sides = [(ids[at[row] : at[end]], counts[row:end]) for (ids, counts), at in zip(coded, before, strict=True)]
        yield row, end, _align_slice(pairs, model, led.slice(row, end - row), *sides, digits)


def _align_slice(pairs: ByteMerges, model: pieces.Pieces, texts: pa.Array, side_a, side_b, digits) -> dict[str, pa.Array]:
    (a, count_a), (b, count_b) = side_a, side_b
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = sizes > 0
    size_a, size_b = pairs.sizes[a], model.sizes[b]
    data, raw_a, raw_b = b"".join(texts.cast(pa.binary()).to_pylist()), pairs.raw(a).tobytes(), model.raw(b).tobytes()
    fits = full.copy()
    if raw_a != data or raw_b != data:
        at = [np.concatenate([[0], np.cumsum(x)]) for x in (sizes, _per_text(size_a, count_a), _per_text(size_b, count_b))]
        for k in np.flatnonzero(full).tolist():
            own, one, two = (x[p[k] : p[k + 1]] for x, p in zip((data, raw_a, raw_b), at, strict=True))
            fits[k] = one == own and two == own
        keep_a, keep_b = np.repeat(fits, count_a), np.repeat(fits, count_b)
        a, b, size_a, size_b = a[keep_a], b[keep_b], size_a[keep_a], size_b[keep_b]
        count_a, count_b = count_a * fits, count_b * fits
    ends_a, ends_b = group_ends(np.cumsum(size_a), np.cumsum(size_b))
    na, nb = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    doc = np.repeat(np.arange(len(texts)), count_a)[ends_a - 1] if len(a) else np.zeros(0, np.int64)
    n_groups = np.bincount(doc, minlength=len(texts))
    keys, times = _links(a, b, na, nb, doc)
    held = np.bincount(keys >> 2 * ID_BITS, minlength=len(texts))
    through = np.cumsum(count_a + count_b)
    last = through[count_a > 0] - 1
    text, before = _written_groups(digits, a, b, ends_a, ends_b, last)
    bounds = before[np.concatenate([[0], through])].astype(np.int32)
    link = pa.StructArray.from_arrays([pa.array(keys & ((1 << 2 * ID_BITS) - 1)), pa.array(times, pa.int64())], names=["pair", "times"])
    long = lambda x: pa.array(x, pa.int64())
    return {
        "n_a": long(count_a), "n_b": long(count_b), "n_groups": long(n_groups), "n_links": long(_per_text(na * nb, n_groups)),
        "groups": pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(text)),
        "links": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), link),
    }


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def _align(file, model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, piece_model = load(file.value), pieces.load(model.value)
        digits = _digits(max(len(pairs.sizes), piece_model.size))
        for batch in batches:
            for row, end in text_slices(batch.column("text"), ENCODED):
                part = batch.slice(row, end - row)
                for first, last, made in align_texts(pairs, piece_model, part.column("text"), digits):
                    rows = part.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in columns], names=columns)

    return run


def aligned(docs: DataFrame, path: str, model: str, keep: list[str] | None = None) -> DataFrame:
    """row_ (a struct of the kept columns, all by default), n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links, structs of
    pair (the ids of a and b in one number) and times, for each distinct pair of ids that share a group of the text.

    A is the byte-level BPE of the file path over a space and the text, B the pieces of the file model over the text. Null and empty texts,
    and those whose tokens' bytes are not a space and the text, have no tokens: zeros, an empty string and no links. Texts that
    repeat give equal rows; an empty table gives none. Long texts are aligned whole; columns that are called as results stay in row_.
    Both files are read by the driver and broadcast: they have the size of vocabularies.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = packed(docs, ["text"], keep).withColumn("text", F.make_valid_utf8("text"))
    row = rows.schema["row_"].dataType.simpleString()
    columns = ["row_", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    files = [spark.sparkContext.broadcast(file_bytes(p)) for p in (path, model)]
    return rows.mapInArrow(_align(*files, columns), f"row_ {row}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, times: long>>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, docs (how many rows of texts hold it among their links) and best (no pair of the same first id is held by more)."""
    counts = written(texts.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    first = F.shiftright("pair", ID_BITS).alias("first")
    # One row for each id of a vocabulary.
    most = F.broadcast(counts.groupBy(first).agg(F.max("docs").alias("most")))
    return written(counts.withColumn("first", first).join(most, "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair_counts")


def link_sums(texts: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """id_, n_best and count_sum: the links of each row of texts (id_, links) that are best, and the sum of all its links' counts.

    The pairs that many rows hold are few and broadcast, so their links are not dealt by pair; the others, of which none is
    held by more than its share, meet their counts by a shuffle.
    """
    total = counts.agg(F.sum("docs")).first()[0] or 0
    common = counts.filter(F.col("docs") * hot > total)
    links = texts.select("id_", F.inline("links"))
    near = links.join(F.broadcast(common), "pair")
    far = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts.filter(F.col("docs") * hot <= total), "pair")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    return near.unionByName(far).groupBy("id_").agg(best, F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), bpe.default_vocabulary(), pieces.default_model(), ["doc_id"])
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    texts = written(found.select(F.monotonically_increasing_id().alias("id_"), "row_.doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "aligned")
    sums = link_sums(texts, pair_counts(texts))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
    return texts.drop("links").join(sums, "id_", "left").withColumns(none).drop("id_")
