"""Benchmark decontamination by Wu-Manber search for windows of the benchmark's words.

Texts become normal forms: A-Z lower-cased, words with one space between, before and after them. A window of item
words is such a form too, so a window occurs in a text as often as its bytes do. The windows of a block of items are
compiled to a shift table over hashed blocks of bytes, which tells how far the search may jump, and to buckets by the hash of
the last bytes. A bucket is ordered by the hash of the whole window, so a place in a text selects the one window that can
stand there, however many share their first words, and bytes are compared directly. Many texts are searched at once.

The benchmark is cut into pieces of bounded size, which Spark spreads over blocks; one block at a time is compiled and
broadcast, and windows are held as places in the block's text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import ASCII_LOWER, LETTERED, equal_spans, span_hasher, span_places, text_slices
from .common import LOWER, UPPER, WORD_CLASS, bound_batches, drop_written, packed, shared_folder, table, written

WINDOW = 13
#: Bytes of benchmark text that are compiled, broadcast and searched for at once; words of a piece of a long item.
BLOCK_BYTES, PIECE_WORDS = 4 << 20, 2048
#: Least and most bits of the shift table's address, and lengths at which another table is made for shorter windows.
TABLE_BITS = (16, 24)
CLASSES = (3, 6, 12, 24, 48)
#: A text is searched in parts of so many bytes, all at once.
PART = 512
FOLDED = str.maketrans(UPPER, LOWER)
#: Item ids that a batch of results holds, a document more at most.
IDS_PER_BATCH = 200_000


def _hash_block(columns: list[np.ndarray], bits: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint32)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def _bucket_key(code: np.ndarray, window_hash: np.ndarray) -> np.ndarray:
    """The bucket in the upper bits and the window's hash below."""
    return (code.astype(np.uint64) << np.uint64(40)) | (window_hash >> np.uint64(24))


@dataclass
class Form:
    """Texts in normal form: bytes, the texts' begins, the places of all spaces and the first space of each text."""

    data: np.ndarray
    begin: np.ndarray
    spaces: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray) -> Form:
        form, begin = normal_form(data, starts)
        spaces = np.flatnonzero(form == 32)
        return cls(form, begin, spaces, np.searchsorted(spaces, begin))

    @property
    def words(self) -> np.ndarray:
        """The number of words of each text."""
        return np.diff(self.first) - 1


@dataclass
class Searcher:
    """Windows of one number of words and of at least `least` bytes: shift table, and buckets as ordered keys."""

    words: int
    least: int
    width: int
    bits: int
    shift: np.ndarray
    key: np.ndarray
    window: np.ndarray

    @classmethod
    def compile(cls, blob: np.ndarray, begin: np.ndarray, size: np.ndarray, window_hash: np.ndarray, window: np.ndarray, words: int) -> Searcher:
        least = int(size.min())
        width = min(8, least)
        bits = int(np.clip((len(begin) * (least - width + 1) * 4).bit_length(), *TABLE_BITS))
        shift = np.full(1 << bits, min(least - width + 1, 255), np.uint8)
        # From the largest shift to the least, so that the least stays where blocks share an address.
        for end in range(width, least + 1):
            if least - end < 255:
                shift[_hash_block([blob[begin + end - width + k] for k in range(width)], bits)] = least - end
        last = _hash_block([blob[begin + least - width + k] for k in range(width)], bits)
        key = _bucket_key(last, window_hash)
        order = np.argsort(key)
        return cls(words, least, width, bits, shift, key[order], window[order].astype(np.int32))

    def find(self, form: Form, hashes, blob: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, windows) of all occurrences in the form."""
        data, m, b, none = form.data, self.least, self.width, np.zeros(0, np.int64)
        if len(data) < m:
            return none, none
        # at: the end of the window that each part looks at; a part answers for the places that begin in it.
        start = np.arange(0, len(data) - m + 1, PART)
        at, stop = start + m, np.minimum(start + PART, len(data) - m + 1) + m
        seen: list[np.ndarray] = []
        while len(at):
            code = _hash_block([data[at - b + k] for k in range(b)], self.bits)
            jump = self.shift[code]
            hit = (jump == 0) & (data[at - m] == 32)
            if hit.any():
                seen.append(np.stack([at[hit] - m, code[hit].astype(np.int64)], 1))
            at = at + np.maximum(jump, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not seen:
            return none, none
        place, code = np.concatenate(seen).T
        # The span of as many words as the windows have, where the text has them.
        text, k = np.searchsorted(form.begin, place, "right") - 1, np.searchsorted(form.spaces, place)
        fits = k + self.words < form.first[text + 1]
        place, code, k = place[fits], code[fits], k[fits]
        end = form.spaces[k + self.words] + 1
        key = _bucket_key(code, hashes(place, end))
        low = np.searchsorted(self.key, key)
        many = np.searchsorted(self.key, key, "right") - low
        candidate = self.window[span_places(low, many)]
        place, length = np.repeat(place, many), np.repeat(end - place, many)
        same = size[candidate] == length
        place, candidate = place[same], candidate[same]
        equal = equal_spans(data, place, blob, begin[candidate], size[candidate])
        return place[equal], candidate[equal]


@dataclass
class Matcher:
    """All windows of a block of items: their places in the block's text, words, and the set of items that hold each.

    Windows that stand in the same items share a set; members lists the sets' items, ids names them.
    """

    searchers: list[Searcher]
    blob: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    words: np.ndarray
    item_set: np.ndarray
    set_start: np.ndarray
    members: np.ndarray
    ids: list[str]

    @classmethod
    def compile(cls, items: list[tuple[str, str]], width: int = WINDOW) -> Matcher:
        none = np.zeros(0, np.int64)
        if not items:
            return cls([], none.astype(np.uint8), none, none, none, none, np.zeros(1, np.int64), none, [])
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        raw = [t.encode() for _, t in items]
        form = Form.of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        n = form.words
        words = np.minimum(n, width)
        many = np.where(n > 0, n - words + 1, 0)
        first = span_places(form.first[:-1], many)
        words, owner = np.repeat(words, many), np.repeat(np.array([number[i] for i, _ in items], np.int64), many)
        begin = form.spaces[first]
        size = form.spaces[first + words] + 1 - begin
        h = span_hasher(form.data)(begin, begin + size)
        # Equal windows become one; unequal ones of equal hash (not to be expected) stay apart.
        order = np.lexsort((owner, size, h))
        begin, size, words, owner, h = begin[order], size[order], words[order], owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
        leader = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
        new |= ~equal_spans(form.data, begin, form.data, begin[leader], size)
        window = np.cumsum(new) - 1
        once = np.ones(len(h), bool)
        once[1:] = new[1:] | (owner[1:] != owner[:-1])
        counts = np.bincount(window[once], minlength=int(new.sum()))
        cut = np.concatenate([[0], np.cumsum(counts)])
        owner = owner[once].astype(np.int32)
        sets: dict[bytes, int] = {}
        item_set = np.array([sets.setdefault(owner[a:b].tobytes(), len(sets)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.int64)
        members = [np.frombuffer(s, np.int32) for s in sets]
        begin, size, words, h = begin[new], size[new], words[new], h[new]
        searchers = []
        for w in np.unique(words):
            for c in range(len(CLASSES) + 1):
                some = np.flatnonzero((words == w) & (np.searchsorted(CLASSES, size, "right") == c))
                if len(some):
                    searchers.append(Searcher.compile(form.data, begin[some], size[some], h[some], some, int(w)))
        short = [v.astype(np.int32) for v in (begin, size, words, item_set)]
        return cls(searchers, form.data, *short, np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *members]), ids)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Ids of the items that hold any of the windows, in order."""
        sets = np.unique(self.item_set[windows])
        found = np.unique(self.members[span_places(self.set_start[sets], np.diff(self.set_start)[sets])])
        return [self.ids[k] for k in found.tolist()]


def normal_form(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) with every text as ' w1 w2 ... ', or as one space if it has no word."""
    # A space stands before every text, so that neighbours never touch; it opens the text's form.
    wide = np.insert(data, starts[:-1], 32)
    begin = starts[:-1] + np.arange(len(starts) - 1)
    word = LETTERED[wide]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[begin] = True
    # A text that ends in a word needs its closing space.
    end = np.concatenate([begin[1:], [len(wide)]])
    open_end = word[end - 1]
    form = np.where(word, ASCII_LOWER[wide], np.uint8(32))
    total = np.concatenate([[0], np.cumsum(keep)])
    # A space right after the opening one only stays if a word came before it.
    sizes = total[end] - total[begin]
    form = np.insert(form[keep], total[end[open_end]], 32)
    sizes = sizes + open_end
    return form, np.concatenate([[0], np.cumsum(sizes)])


def search_slice(matcher: Matcher, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words in each text, and for every occurrence in order of texts: text, first word in the text, window)."""
    form = Form.of(data, starts)
    hashes = span_hasher(form.data)
    found = [s.find(form, hashes, matcher.blob, matcher.begin, matcher.size) for s in matcher.searchers]
    place = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in found]])
    window = np.concatenate([np.zeros(0, np.int64), *[w for _, w in found]])
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    text = np.searchsorted(form.begin, place, "right") - 1
    return form.words, text, np.searchsorted(form.spaces, place) - form.first[text], window


def item_pieces(text: str | None, words: int = PIECE_WORDS, width: int = WINDOW) -> Iterator[str]:
    """The item's words in pieces that overlap by width - 1 words, so that each window stands in one; none without words."""
    held: list[str] = []
    cut = False
    for m in re.finditer(WORD_CLASS + "+", (text or "").translate(FOLDED)):
        held.append(m[0])
        if len(held) == words + width - 1:
            yield " ".join(held)
            held, cut = held[words:], True
    if held and (not cut or len(held) >= width):
        yield " ".join(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for piece in item_pieces(text):
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([piece])], names=["item_id", "text"])


def _blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """The benchmark, a stated set of queries, in blocks of bounded size, each with whether there are several; one block at a time is on the driver, as pieces are
    dealt to partitions of about that size, which are fetched one by one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    pieces = written(items.mapInArrow(_pieces, "item_id string, text string"), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    several = total > limit
    dealt = pieces.repartition(-(-total // limit)) if several else pieces
    block: list[tuple[str, str]] = []
    size = 0
    for r in dealt.toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > limit:
            yield several, block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield several, block
    drop_written(pieces)


def _runs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[new], reach[np.concatenate([new[1:], [len(first)]]) - 1]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def _search(matcher, columns: list[str]):
    """The task's function: one block's findings as the columns spans and items, and n_words."""

    def results(block: Matcher, part: pa.RecordBatch, data: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_words, texts, firsts, windows = search_slice(block, data, starts)
        spans: list = [[] for _ in n_words]
        items: list = [[] for _ in n_words]
        cut = np.searchsorted(texts, np.arange(len(n_words) + 1))
        begun, held = 0, 0
        for t in range(len(n_words)):
            a, b = int(cut[t]), int(cut[t + 1])
            if b > a:
                runs = _runs(firsts[a:b], firsts[a:b] + block.words[windows[a:b]])
                spans[t] = [{"first": x, "n": y - x} for x, y in zip(*(r.tolist() for r in runs), strict=True)]
                items[t] = block.items_of(windows[a:b])
            held += len(items[t])
            if held > IDS_PER_BATCH or t == len(n_words) - 1:
                made = {"n_words": pa.array(n_words[begun : t + 1], pa.int64()), "spans": pa.array(spans[begun : t + 1], SPANS), "items": pa.array(items[begun : t + 1], pa.list_(pa.string()))}
                items[begun : t + 1] = [None] * (t + 1 - begun)
                rows = part.slice(begun, t + 1 - begun)
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in columns], names=columns)
                begun, held = t + 1, 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = matcher.value
        for batch in batches:
            for row, end, data, starts in text_slices(batch.column("text")):
                yield from results(block, batch.slice(row, end - row), data, starts)

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_ (a struct of the kept columns, all by default), n_words, n_hit, items (sorted as strings), spans and contaminated.

    A document word is hit if it stands in an occurrence of a window of 13 consecutive words of an item (of all its
    words if it has fewer); spans are the runs of hit words. A document is contaminated if it has a hit and
    20 n_hit >= n_words. Null and empty texts have no words and are clean; long texts are searched whole. Items without
    an id or without words match nothing; item ids are strings, and one that repeats counts once, with the windows of
    all its texts. Rows of docs that repeat give repeated rows; an empty table gives none, an empty benchmark no hits.
    Columns of docs with the names of results stay in row_.

    A benchmark of one block costs one pass. For a larger one the rows are written once with a number; each block of
    block_bytes then costs a pass that writes only what it finds, and the findings are merged by number at the end.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = packed(docs, ["text"], keep)
    blocks = _blocks(benchmark, block_bytes)
    several, first = next(blocks, (False, []))
    if several:
        rows = written(rows.withColumn("id_", F.monotonically_increasing_id()), "numbered")
        found = rows.select("id_", "row_").join(_findings(rows.select("id_", "text"), chain([first], (block for _, block in blocks))), "id_")
    else:
        found = _searched(rows, first)[0]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    out = found.select("row_", "n_words", n_hit.alias("n_hit"), "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _searched(rows: DataFrame, block: list[tuple[str, str]]) -> tuple[DataFrame, Broadcast]:
    """rows (with text) and one block's findings, and the broadcast block."""
    made = rows.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.array().cast("array<struct<first:long,n:long>>"), "items": F.array().cast("array<string>")})
    used = rows.sparkSession.sparkContext.broadcast(Matcher.compile(block))
    return made.mapInArrow(_search(used, made.columns), made.schema), used


def _findings(texts: DataFrame, blocks: Iterable[list[tuple[str, str]]]) -> DataFrame:
    """id_, n_words, spans and items of texts (id_, text) over all blocks. One block is alive at a time; the first one's pass writes a row for
    each text, the others those with a hit."""
    spark = texts.sparkSession
    path, schema = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}", None
    for k, block in enumerate(blocks):
        found, used = _searched(texts, block)
        found = found.drop("text").filter(F.lit(k == 0) | (F.size("spans") > 0))
        found.write.mode("append").parquet(path)
        schema = found.schema
        used.unpersist()
    every = spark.read.schema(schema).parquet(path)
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    merged = every.groupBy("id_").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), items.alias("items"))
    return merged.mapInArrow(_joined_spans, merged.schema)


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans, in any order, are joined to maximal runs."""
    for batch in batches:
        column = batch.column("spans")
        counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        first, n = (column.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
        # Texts stand behind each other, so far apart that no run reaches the next one.
        apart = int((first + n).max(initial=0)) + 1
        base = np.repeat(np.arange(len(counts)), counts) * apart
        begin, end = _runs(first + base, first + base + n) if len(first) else (first, first)
        starts = np.searchsorted(begin, np.arange(len(counts) + 1) * apart)
        spans = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(begin % apart), pa.array(end - begin)], names=["first", "n"]))
        yield pa.RecordBatch.from_arrays([spans.cast(SPANS) if name == "spans" else batch.column(name) for name in batch.schema.names], names=batch.schema.names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; nulls, repeated rows and an empty table as find_contamination has them."""
    return find_contamination(docs, benchmark).filter(~F.col("contaminated")).select("row_.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("row_.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
