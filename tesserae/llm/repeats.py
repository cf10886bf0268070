"""Which windows of a text also start in a document with a smaller doc_id: the plan that two operators share.

A text is a sequence of units (bytes, or words). Every window of `window` units holds a seed, the gram of `gram` units
with the least hash (the first of equals); equal windows hold equal seeds at equal places. Texts are dealt to batches
by a hash, and so much is exchanged:

1. each batch sends its distinct seed hashes to buckets; a bucket answers each batch which of them another batch has;
2. for seeds that repeat, a batch takes the context: the units of all windows that have this seed. The contexts of a seed are
   compared, in the operator's own way, within each slice of the batch, then between its slices; contexts whose windows
   all repeat windows of a smaller doc_id go no further;
3. a bucket compares what is left of all batches, and answers each batch with runs of repeated windows;
4. the batch cuts its texts.

So a line or passage in a third of all documents costs one entry for each batch, and every window that is removed was found
by the operator's comparison. A seed that stands in very many different contexts is a hot group: it is split, its windows
go to buckets one by one, each under its own hash, and are compared there in the same way.
The texts are shuffled once, by batch, and that exchange is read again by each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BLOCK, mix, span_hash, span_places
from .common import bound_batches

#: Bytes of text in a batch, on average, and in a slice of whole texts, which is what a task works on at once; buckets
#: of seeds for each batch.
BATCH_BYTES, SLICE_BYTES, BUCKETS_PER_BATCH = 8 << 20, 1 << 20, 2
#: Up to so many batches there is a task for each on average; of more, a task works on up to so many, one after the other.
MANY_TASKS, BATCHES_PER_TASK = 4096, 16
#: Different contexts of a seed, summed over slices, beyond which its group is split by window.
SPLIT_CONTEXTS = 10_000


@dataclass
class Units:
    """Texts of a batch in a form of bytes: units by their begins and ends there, and the first unit of each text."""

    form: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], Units]

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Entries:
    """Occurrences of seeds: hash, text, unit of the seed, first and last window (by first unit) that have it as seed."""

    hash: np.ndarray
    text: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def take(self, which: np.ndarray) -> Entries:
        return Entries(self.hash[which], self.text[which], self.at[which], self.lo[which], self.hi[which])


def find_seeds(u: Units, shape: Shape) -> Entries:
    n, none = len(u.begins), np.zeros(0, np.int64)
    if n < shape.window:
        return Entries(none.astype(np.uint64), none, none, none, none)
    # Units are not empty, so if the last one ends at n they are single bytes.
    h = span_hash(u.form, u.begins[: n - shape.gram + 1], u.ends[shape.gram - 1 :], every=bool(u.ends[-1] == n))
    # The least of a window's whole hashes, the first of equal ones: it depends on nothing outside the window.
    least = np.empty(n - shape.window + 1, np.uint64)
    for begin in range(0, len(least), BLOCK):
        own, width = least[begin : begin + BLOCK], 1
        part = h[begin : begin + len(own) + shape.grams - 1]
        while 2 * width <= shape.grams:
            part = np.minimum(part[width:], part[:-width])
            width *= 2
        np.minimum(part[len(part) - len(own) :], part[: len(own)], out=own)
    # Windows that lie within one text, in runs of one seed: it is another one if it is less, or if the last one is left behind.
    whole = np.ones(len(least), bool)
    for k in u.first[1:-1]:
        whole[max(0, k - shape.window + 1) : k] = False
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1]) | ~whole[:-1] | ~whole[1:]
    lo, hi = np.flatnonzero(new[:-1] & whole), np.flatnonzero(new[1:] & whole)
    # The seed is a run's last window's first gram, if that is the least; or the first window's last gram, if it made the run;
    # else it is looked for.
    at = np.where(h[hi] == least[hi], hi, lo)
    entered = (at == lo) & (lo > 0) & (least[lo] < least[np.maximum(lo, 1) - 1])
    at[entered] += shape.grams - 1
    open_ = np.flatnonzero(h[at] != least[lo])
    while len(open_):
        at[open_] += 1
        open_ = open_[h[at[open_]] != least[lo[open_]]]
    # Least hashes are small ones; mixed again they spread evenly over the buckets.
    return Entries(mix(h[at]), np.searchsorted(u.first, at, "right") - 1, at, lo, hi)


def _several_texts(e: Entries) -> np.ndarray:
    """Entries whose hash stands in two texts of the batch or more."""
    order = np.argsort(e.hash, kind="stable")
    group = np.cumsum(np.concatenate([[0], e.hash[order][1:] != e.hash[order][:-1]])) if len(order) else order
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else order
    out = np.zeros(len(order), bool)
    if len(order):
        t = e.text[order]
        out[order] = (np.minimum.reduceat(t, begin) != np.maximum.reduceat(t, begin))[group]
    return out


@dataclass
class Slice:
    """Some texts of a batch: the number of the first, their ids, units and seeds."""

    text: int
    ids: np.ndarray
    units: Units
    seeds: Entries


def slices(table: pa.Table, shape: Shape, limit: int = SLICE_BYTES, seeds: bool = True) -> Iterator[Slice]:
    """A batch's documents in an order that every step sees alike, in slices of about so many bytes. Seeds are found if asked for."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] or ""))
    at = 0
    while at < len(order):
        raw, size, first = [], 0, at
        while at < len(order) and (not raw or size < limit):
            raw.append((texts[order[at]] or "").encode())
            size += len(raw[-1])
            at += 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        units = shape.units(data, np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64))
        yield Slice(first, np.array([ids[k] for k in order[first:at]], np.int64), units, find_seeds(units, shape) if seeds else None)


def _sorted_distinct(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, cuts between them) of hashes in order."""
    some, cut = np.unique(((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), return_index=True)
    return some, np.append(cut, len(h))


def _distinct_hashes(table: pa.Table, shape: Shape, counted: bool = True) -> tuple[list[Entries], np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of each slice; their hashes in order, whether each stands in several slices, and its different contexts in
    all of them, 65535 at most (0 if they are not to be counted)."""
    seeds, parts, numbers = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in slices(table, shape):
        u, e = s.units, s.seeds
        if not counted:
            seeds.append(e)
            parts.append(_sorted_distinct(e.hash))
            numbers.append(np.zeros(len(parts[-1]), np.int64))
            continue
        context = span_hash(u.form, u.begins[e.lo], u.ends[e.hi + shape.window - 1])
        order = np.lexsort((context, e.hash))
        h, context = e.hash[order], context[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
        values, count = np.unique(h[new], return_counts=True)
        seeds.append(e)
        parts.append(values)
        numbers.append(count)
    values, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    contexts = np.bincount(inverse, np.concatenate(numbers), len(values))
    return seeds, values, count > 1, np.minimum(contexts, 65535).astype(np.uint16)


def _seed_rows(shape: Shape, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, h, _, contexts = _distinct_hashes(table, shape)
        some, cut = _by_bucket(h, buckets)
        part = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(some, pa.int64()), "batch": pa.array(np.full(len(some), key[0].as_py()), pa.int64()), "hashes": part(h.astype(np.uint32)), "contexts": part(contexts)})

    return run


def _answer_rows(split: int):
    def run(table: pa.Table) -> pa.Table:
        # Half a hash is enough here: a bucket holds a bounded number of seeds, and one taken for repeated is only looked at.
        parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        contexts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("contexts").to_pylist()])
        values, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = np.bincount(inverse, contexts, len(values)) > split
        flag = np.where(many, 2, count > 1).astype(np.uint8)[inverse]
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "flags": pa.array([flag[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return run


@dataclass
class Contexts:
    """Contexts that are compared: seed (a dense number), doc, windows, where the seed begins in the context's
    bytes (before), the bytes blob[begin : begin + size]."""

    seed: np.ndarray
    doc: np.ndarray
    windows: np.ndarray
    before: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    blob: np.ndarray


#: A comparison returns, for contexts of seeds with several, (context, first window, last window) of runs of repeats.
Compare = Callable[[Contexts], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Rows:
    """Contexts on their way to the buckets: hash of the seed, number of the text in its batch, doc, first window in the
    text, number of windows, where the seed begins, size; and the bytes, one after the other."""

    h: np.ndarray
    text: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    windows: np.ndarray
    before: np.ndarray
    size: np.ndarray
    blob: np.ndarray

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in cls.__dataclass_fields__])

    def take(self, which: np.ndarray) -> Rows:
        begin = np.cumsum(self.size) - self.size
        return Rows(*[getattr(self, f)[which] for f in PACKED], self.blob[span_places(begin[which], self.size[which])])

    def compared(self, compare: Compare) -> tuple[np.ndarray, np.ndarray]:
        """(runs: row, first window, last window of windows that repeat one of a smaller doc; rows with windows beside these)."""
        runs, stay = np.zeros((0, 3), np.int64), np.ones(len(self.h), bool)
        order = np.argsort(self.h, kind="stable")
        if len(order):
            new = np.concatenate([[True], self.h[order][1:] != self.h[order][:-1]])
            doc, start = self.doc[order], np.flatnonzero(new)
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            group = np.cumsum(new) - 1
            order, group = order[several[group]], group[several[group]]
        if len(order):
            begin = np.cumsum(self.size) - self.size
            seed = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
            which, a, b = compare(Contexts(seed, self.doc[order], self.windows[order], self.before[order], begin[order], self.size[order], self.blob))
            # As single windows, then as maximal runs; a context has fewer windows than SPREAD - 1.
            window = _sorted_distinct(np.repeat(order[which] * SPREAD, b - a + 1) + span_places(a, b - a + 1))
            first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1] + 1])) if len(window) else window
            last = np.append(first[1:], len(window))[: len(first)] - 1
            runs = np.stack([window[first] // SPREAD, window[first] % SPREAD, window[last] % SPREAD], 1)
            stay = np.bincount(window // SPREAD, minlength=len(self.h)) < self.windows
        return runs, stay

    def cover(self, runs: np.ndarray) -> np.ndarray:
        """Runs as (text, first window in the text, last one)."""
        return np.stack([self.text[runs[:, 0]], self.lo[runs[:, 0]] + runs[:, 1], self.lo[runs[:, 0]] + runs[:, 2]], 1).astype(np.int32)


SPREAD = 64
PACKED = ("h", "text", "doc", "lo", "windows", "before", "size")
CONTEXTS = "bucket long, batch long, n long, head binary, bytes binary, cover binary"
TYPES = {"h": np.uint64, "text": np.int32, "doc": np.int64, "lo": np.int32, "windows": np.uint8, "before": np.uint32, "size": np.uint32}


def packed_head(columns: dict[str, np.ndarray]) -> bytes:
    """The columns of contexts by the bytes' places, which compress better than numbers do: most upper bytes are equal."""
    planes = [np.ascontiguousarray(columns[c].astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for c, t in TYPES.items()]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked_head(head: bytes, n: int) -> dict[str, np.ndarray]:
    widths = [np.dtype(t).itemsize for t in TYPES.values()]
    data = np.frombuffer(pa.decompress(head, n * sum(widths), "zstd", asbytes=True), np.uint8)
    cut = np.split(data, np.cumsum([n * w for w in widths])[:-1])
    return {c: np.ascontiguousarray(v.reshape(w, n).T).view(t).reshape(n) for (c, t), w, v in zip(TYPES.items(), widths, cut, strict=True)}


def _context_rows(shape: Shape, buckets: int, compare: Compare):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if not table.num_rows or not answers.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("bucket", "batch", "n") else pa.binary()) for c in ("bucket", "batch", "n", "head", "bytes", "cover")})
        seeds, values, several, _ = _distinct_hashes(table, shape, counted=False)
        order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        flags = answers.column("flags").to_pylist()
        flag = np.maximum(np.concatenate([np.frombuffer(flags[k], np.uint8) for k in order]), several)
        left, covers = [], []
        for s, e in zip(slices(table, shape, seeds=False), seeds, strict=True):
            rows = _slice_contexts(s, e, shape, values, flag)
            runs, stay = rows.compared(compare)
            covers.append(rows.cover(runs))
            left.append(rows.take(np.flatnonzero(stay)))
        rows = Rows.joined(left)
        runs, stay = rows.compared(compare)
        stay = np.flatnonzero(stay)
        covers.append(rows.cover(runs))
        return _packed_rows(rows.take(stay[np.argsort(rows.h[stay], kind="stable")]), buckets, number, np.concatenate(covers))

    return run


def _slice_contexts(s: Slice, e: Entries, shape: Shape, values: np.ndarray, flag: np.ndarray) -> Rows:
    """Contexts of the seeds that repeat, and the windows of those that are split, each its own seed and context."""
    u = s.units
    own = flag[np.searchsorted(values, e.hash)] if len(values) else np.zeros(0, np.uint8)
    whole = e.take(np.flatnonzero(((own > 0) | _several_texts(e)) & (own < 2)))
    hot = e.take(np.flatnonzero(own == 2))
    many = hot.hi - hot.lo + 1
    place = span_places(hot.lo, many)
    w = Entries(span_hash(u.form, u.begins[place], u.ends[place + shape.window - 1], 11), np.repeat(hot.text, many), place, place, place)
    e = Entries(*[np.concatenate([getattr(whole, f), getattr(w, f)]) for f in ("hash", "text", "at", "lo", "hi")])
    begin = u.begins[e.lo]
    size = u.ends[e.hi + shape.window - 1] - begin
    return Rows(e.hash, s.text + e.text, s.ids[e.text], e.lo - u.first[e.text], e.hi - e.lo + 1, u.begins[e.at] - begin, size, u.form[span_places(begin, size)])


def _packed_rows(rows: Rows, buckets: int, number: int, cover: np.ndarray) -> pa.Table:
    """A row for each bucket; what the batch has found itself goes with the first one and comes back to it."""
    some, cut = _by_bucket(rows.h, buckets)
    at = np.concatenate([[0], np.cumsum(rows.size)])
    if not len(some) and len(cover):
        some, cut = np.zeros(1, np.int64), np.zeros(2, np.int64)
    out = {"head": [], "bytes": [], "cover": []}
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        out["head"].append(packed_head({c: getattr(rows, c)[a:b] for c in PACKED}))
        out["bytes"].append(pa.compress(rows.blob[at[a] : at[b]].tobytes(), "zstd", asbytes=True))
        out["cover"].append(cover.tobytes() if k == 0 else b"")
    longs = {"bucket": some, "batch": np.full(len(some), number), "n": np.diff(cut)}
    return pa.table({**{c: pa.array(v, pa.int64()) for c, v in longs.items()}, **{c: pa.array(v, pa.binary()) for c, v in out.items()}})


def _cover_rows(compare: Compare):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        heads = [unpacked_head(x, k) for x, k in zip(table.column("head").to_pylist(), table.column("n").to_pylist(), strict=True)]
        parts = {c: [h[c] for h in heads] for c in TYPES}
        held = [int(x.sum()) for x in parts["size"]]
        owner = np.repeat(np.arange(n), [len(x) for x in parts["h"]])
        blob = np.frombuffer(b"".join(pa.decompress(x, k, "zstd", asbytes=True) for x, k in zip(table.column("bytes").to_pylist(), held, strict=True)), np.uint8)
        column = {c: np.concatenate(v) for c, v in parts.items()}
        rows = Rows(column.pop("h"), *[column[c].astype(np.int64) for c in PACKED[1:]], blob)
        runs, _ = rows.compared(compare)
        made, source = rows.cover(runs), owner[runs[:, 0]]
        by_row = np.argsort(source, kind="stable")
        cut = np.searchsorted(source[by_row], np.arange(n + 1))
        local = table.column("cover").to_pylist()
        covers = [made[by_row[cut[k] : cut[k + 1]]].tobytes() + local[k] for k in range(n)]
        return pa.table({"batch": table.column("batch"), "cover": pa.array(covers, pa.binary())})

    return run


def _cut_rows(shape: Shape):
    def run(key: tuple, table: pa.Table, covers: pa.Table) -> pa.Table:
        cover = np.concatenate([np.zeros((0, 3), np.int32), *[np.frombuffer(x, np.int32).reshape(-1, 3) for x in covers.column("cover").to_pylist()]]).astype(np.int64)
        cover = cover[np.argsort(cover[:, 0], kind="stable")]
        made = [pa.table({"doc_id": pa.array([], pa.int64()), "n_units": pa.array([], pa.int64()), "spans": pa.array([], SPANS), "kept": pa.array([], pa.binary())})]
        for s in slices(table, shape, seeds=False):
            a, b = np.searchsorted(cover[:, 0], [s.text, s.text + len(s.ids)])
            made.append(_cut_slice(s, cover[a:b] - [s.text, 0, 0], shape.window))
        return pa.concat_tables(made)

    return run


def _cut_slice(s: Slice, cover: np.ndarray, window: int) -> pa.Table:
    u = s.units
    n, edge = len(u.begins), np.zeros(len(u.begins) + 1, np.int64)
    np.add.at(edge, u.first[cover[:, 0]] + cover[:, 1], 1)
    np.add.at(edge, np.minimum(u.first[cover[:, 0]] + cover[:, 2] + window, n), -1)
    removed = np.cumsum(edge[:n]) > 0
    start, stop = removed.copy(), removed.copy()
    border = u.first[(u.first > 0) & (u.first < n)]
    start[1:] &= ~removed[:-1]
    stop[:-1] &= ~removed[1:]
    start[border] = removed[border]
    stop[border - 1] = removed[border - 1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    text = np.searchsorted(u.first, start, "right") - 1
    runs = np.bincount(text, minlength=len(s.ids))
    spans = pa.StructArray.from_arrays([pa.array(start - u.first[text], pa.int64()), pa.array(stop - start, pa.int64())], ["first", "n"])
    keep = np.flatnonzero(~removed)
    width = u.ends - u.begins
    kept = u.form[span_places(u.begins[keep], width[keep])].tobytes()
    total = np.concatenate([[0], np.cumsum(np.where(removed, 0, width))])[u.first]
    return pa.table({
        "doc_id": pa.array(s.ids), "n_units": pa.array(np.diff(u.first), pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int32()), spans),
        "kept": pa.array([kept[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)], pa.binary()),
    })


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))


def remove_repeats(docs: DataFrame, shape: Shape, compare: Compare, batch_bytes: int = BATCH_BYTES, split_contexts: int = SPLIT_CONTEXTS) -> DataFrame:
    """doc_id, n_units, spans (first unit and number of each maximal run that is removed) and kept (bytes of the rest).

    A unit is removed if a window that covers it also starts in a document with a smaller doc_id, by the input as it is.
    One row for each row of docs. Rows that share a doc_id are one document for this rule: they remove nothing from each
    other, and need not be in one batch. Rows without a doc_id neither remove nor lose anything. Null and empty texts have no
    units; a long text is one slice, and is cut whole. An empty table gives no rows. Other columns are not read, so
    none can clash.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = max(1, -(-size // batch_bytes))
    buckets = BUCKETS_PER_BATCH * batches
    # The number of tasks grows with the input, so that what one of them reads does not.
    tasks = max(-(-batches // BATCHES_PER_TASK), min(batches, MANY_TASKS))
    dealt = docs.filter("doc_id IS NOT NULL").withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).repartition(tasks, "batch")
    seeds = dealt.groupBy("batch").applyInArrow(_seed_rows(shape, buckets), "bucket long, batch long, hashes binary, contexts binary")
    answers = seeds.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answer_rows(split_contexts), "bucket long, batch long, flags binary")
    contexts = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_context_rows(shape, buckets, compare), CONTEXTS)
    covers = contexts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_cover_rows(compare), "batch long, cover binary")
    cut = dealt.groupBy("batch").cogroup(covers.groupBy("batch")).applyInArrow(_cut_rows(shape), "doc_id long, n_units long, spans array<struct<first:long,n:long>>, kept binary")
    single = docs.filter("doc_id IS NULL")
    whole = single.select("doc_id", "text").mapInArrow(_whole(shape), "doc_id long, n_units long, spans array<struct<first:long,n:long>>, kept binary")
    return cut.union(whole)


def _whole(shape: Shape):
    empty = pa.table({"cover": pa.array([], pa.binary())})
    cut = _cut_rows(shape)

    def run(batches):
        for b in batches:
            if b.num_rows:
                named = pa.table({"doc_id": pa.array(np.zeros(b.num_rows, np.int64)), "text": b.column("text")})
                out = cut((), named, empty)
                yield from out.set_column(0, "doc_id", pa.nulls(b.num_rows, pa.int64())).to_batches()

    return run
