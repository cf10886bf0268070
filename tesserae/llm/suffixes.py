"""Suffix-array deduplication: removes byte strings of WINDOW bytes that also start in a document with a smaller id.

Suffixes are sorted where a seed stands in several documents (see repeats): those that begin at the seed, and the
reversed ones that end before it. Sorting is deep-shallow: multikey quicksort by letters of eight bytes down to a shallow
depth, where most groups have fallen apart, then a blind trie for each group that still has a long common prefix. Neighbours in
the two suffix arrays with their common-prefix lengths tell which contexts share a window, for each place of the seed in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import span_places
from .common import table
from .repeats import Contexts, Shape, Units, remove_repeats

WINDOW, GRAM = 50, 16
#: Bytes down to which suffixes are sorted by letters; beyond, a blind trie orders what is still equal.
SHALLOW, LETTER = 24, 8


def byte_units(data: np.ndarray, starts: np.ndarray) -> Units:
    place = np.arange(len(data) + 1)
    return Units(data, place[:-1], place[1:], starts)


SHAPE = Shape(WINDOW, GRAM, byte_units)


class BlindTrie:
    """Strings of equal length by their first differing places only; a descent is blind and one comparison finds where a
    new string leaves it. A node is [depth, branches by byte]; a leaf is a list of the equal strings' numbers."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, number: int, texts: dict[int, bytes]) -> None:
        if self.root is None:
            self.root = [-1, number]
            return
        node = self.root
        while node[0] >= 0:
            branches = node[1]
            node = branches.get(text[node[0]]) or next(iter(branches.values()))
        other = texts[node[1]]
        if other == text:
            node.append(number)
            return
        depth = _common(other, text)
        parent, key, node = None, None, self.root
        while 0 <= node[0] < depth:
            parent, key = node, text[node[0]]
            node = node[1][key]
        if node[0] == depth:
            node[1][text[depth]] = [-1, number]
            return
        split = [depth, {other[depth]: node, text[depth]: [-1, number]}]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def in_order(self) -> tuple[list[int], list[int]]:
        """Numbers in order of their strings, and each one's common prefix with the one before it (-1: equal; first: 0)."""
        numbers: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, depth = stack.pop()
            if node[0] < 0:
                numbers += node[1:]
                common += [depth] + [-1] * (len(node) - 2)
            else:
                keys = sorted(node[1])
                for k in reversed(keys):
                    stack.append((node[1][k], depth if k == keys[0] else node[0]))
        return numbers, common


def _common(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _letters(blob: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: np.ndarray | int, step: int) -> np.ndarray:
    """Eight bytes from depth on as one number, most significant first; past the end of a string there are zeros."""
    out = np.zeros(len(begin), np.uint64)
    last = np.maximum(size - 1, 0)
    for k in range(LETTER):
        place = depth + k
        byte = blob[begin + np.minimum(place, last) * step]
        byte[size <= place] = 0
        out <<= np.uint64(8)
        out |= byte
    return out


def _multikey_quicksort(blob: np.ndarray, order: np.ndarray, new: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, shallow: int) -> np.ndarray:
    """Sorts order in place within its segments, which begin where new is set, by the first `shallow` bytes; the segments
    that are left hold strings that are equal so far. All open segments are split in one go.

    A segment is split into letters below, equal to and above the median of three; only the middle part goes on to the next
    letter. Returns new.
    """
    n, alike = len(order), 0
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    letter = _letters(blob, begin[order], size[order], 0, step)
    # Letters that are the same throughout each segment, as a seed's own ones, split nothing.
    while alike < shallow and (letter == np.repeat(letter[start], count)).all():
        alike += LETTER
        letter = _letters(blob, begin[order], size[order], alike, step)
    depth = np.full(n, alike)
    while True:
        go = (count > 1) & (depth[start] < shallow)
        start, count = start[go], count[go]
        if not len(start):
            return new
        at = span_places(start, count)
        seg = np.repeat(np.arange(len(start)), count)
        pivot = np.sort(np.stack([letter[start], letter[start + count // 2], letter[start + count - 1]]), axis=0)[1][seg]
        own = letter[at]
        side = 1 + (own > pivot).astype(np.int64) - (own < pivot)
        parts = np.bincount(seg * 3 + side, minlength=3 * len(start))
        offset = np.cumsum(parts) - parts
        to = np.empty(len(at), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(parts[k::3]) - parts[k::3]
            to[mine] = offset[seg[mine] * 3 + k] + np.arange(len(mine)) - before[seg[mine]]
        for v in (order, letter, depth):
            v[at[to]] = v[at]
        at_part = np.append(at, n)[offset]
        full = parts > 0
        new[at_part[full]] = True
        start, count = at_part[full], parts[full]
        middle = np.flatnonzero(full)[np.arange(len(start))] % 3 == 1
        equal = span_places(start[middle], count[middle])
        depth[equal] += LETTER
        deeper = equal[(depth[equal] < shallow)]
        letter[deeper] = _letters(blob, begin[order[deeper]], size[order[deeper]], depth[deeper], step)


def shallow_sort(blob: np.ndarray, group: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, by their first SHALLOW bytes, and for each in that order the bytes in common
    with the one before it: -1 at the first of a group, limit if they are equal so far. A string is size bytes from begin on in
    steps of step, padded with zeros to limit."""
    order = np.argsort(group, kind="stable")
    n = len(order)
    if not n:
        return order, order
    shallow = min(SHALLOW, limit)
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    new = _multikey_quicksort(blob, order, head.copy(), begin, size, step, shallow)
    common = np.full(n, limit, np.int64)
    # Neighbours that fell apart: the first letter in which they differ.
    pair = np.flatnonzero(new & ~head)
    for depth in range(0, shallow, LETTER):
        x, y = order[pair - 1], order[pair]
        differ = _letters(blob, begin[x], size[x], depth, step) ^ _letters(blob, begin[y], size[y], depth, step)
        apart = differ != 0
        same = np.zeros(int(apart.sum()), np.int64)
        for k in range(1, LETTER):
            same += differ[apart] < np.uint64(1) << np.uint64(64 - 8 * k)
        common[pair[apart]] = depth + same
        pair = pair[~apart]
    common[head] = -1
    return order, np.minimum(common, limit)


def sort_deep(order: np.ndarray, common: np.ndarray, blob: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, limit: int) -> None:
    """Sorts on in place what shallow_sort left equal. Groups of strings that are equal to the end are in order as they are."""
    shallow = min(SHALLOW, limit)
    start = np.flatnonzero(common < limit)
    stop = np.append(start[1:], len(order))
    if not len(start):
        return
    y = np.flatnonzero(common == limit)
    same, before, after = np.ones(len(order), bool), order[y - 1], order[y]
    differ = np.zeros(len(y), bool)
    for depth in range(shallow, limit, LETTER):
        ends = [np.minimum(size[x], limit) for x in (before, after)]
        differ |= _letters(blob, begin[before], ends[0], depth, step) != _letters(blob, begin[after], ends[1], depth, step)
    same[y] = ~differ
    deep = ~np.logical_and.reduceat(same, start)
    for a, b in zip(start[deep].tolist(), stop[deep].tolist(), strict=True):
        trie, texts = BlindTrie(), {}
        for x in order[a:b].tolist():
            m = max(min(int(size[x]), limit), shallow)
            s = blob[begin[x] + shallow : begin[x] + m] if step > 0 else blob[begin[x] - m + 1 : begin[x] - shallow + 1][::-1]
            texts[x] = s.tobytes().ljust(limit - shallow, b"\0")
            trie.insert(texts[x], x, texts)
        numbers, shared = trie.in_order()
        order[a:b] = numbers
        common[a + 1 : b] = [limit if c < 0 else shallow + c for c in shared[1:]]


def deep_shallow_sort(blob: np.ndarray, group: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """As shallow_sort, by the whole strings; common is limit where they are equal."""
    order, common = shallow_sort(blob, group, begin, size, step, limit)
    sort_deep(order, common, blob, begin, size, step, limit)
    return order, common


def _reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each string the most bytes it has in common with any other of its group: with a neighbour."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def _among(kept: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order and common of the kept strings alone (a flag for each string), numbered anew."""
    place = np.flatnonzero(kept[order])
    if not len(place):
        return place, place
    between = np.minimum.reduceat(common, np.concatenate([[0], place + 1]) if place[-1] + 1 < len(common) else np.concatenate([[0], place[:-1] + 1]))[: len(place)]
    return (np.cumsum(kept) - 1)[order[place]], between


def compare_suffixes(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a context shares with one of a smaller doc, by the two suffix arrays.

    A window with k bytes before its seed is shared if both arrays have a neighbour with as many bytes in common, k to the
    left and the rest to the right. Contexts without such a window leave both arrays as soon as that is seen.
    """
    # Bytes before the seed, of a context's windows: least and most.
    least, most = np.maximum(c.before - c.windows + 1, 0), np.minimum(c.before, WINDOW - GRAM)
    at, rest, one = c.begin + c.before, c.size - c.before, np.arange(len(c.seed))
    right, right_common = shallow_sort(c.blob, c.seed, at, rest, 1, WINDOW)
    left = left_common = one[:0]

    def narrowed(kept: np.ndarray) -> None:
        nonlocal one, at, rest, least, most, right, right_common, left, left_common
        right, right_common = _among(kept, right, right_common)
        if len(left):
            left, left_common = _among(kept, left, left_common)
        one, at, rest, least, most = one[kept], at[kept], rest[kept], least[kept], most[kept]

    def bounded() -> None:
        nonlocal least, most
        least = np.maximum(least, WINDOW - _reach(right, right_common))
        if len(left):
            most = np.minimum(most, _reach(left, left_common))
        narrowed(least <= most)

    bounded()
    left, left_common = shallow_sort(c.blob, c.seed[one], at - 1, c.before[one], -1, WINDOW - GRAM)
    bounded()
    sort_deep(right, right_common, c.blob, at, rest, 1, WINDOW)
    bounded()
    sort_deep(left, left_common, c.blob, at - 1, c.before[one], -1, WINDOW - GRAM)
    bounded()
    n, doc, found = len(one), c.doc[one], []
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(WINDOW - GRAM + 1):
        # Windows with so many bytes before the seed: classes of equal bytes on either side of its first byte.
        valid = np.flatnonzero((least <= before) & (before <= most))
        if not len(valid):
            continue
        class_r[right] = np.cumsum(right_common < WINDOW - before)
        class_l[left] = np.cumsum(left_common < before)
        code = class_r[valid] * (n + 1) + class_l[valid]
        by = np.argsort(code)
        sorted_code, valid = code[by], valid[by]
        new = np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])
        first = np.minimum.reduceat(doc[valid], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = one[valid[doc[valid] > first]]
        found.append(np.stack([later, c.before[later] - before], 1))
    hits = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return hits[:, 0], hits[:, 1], hits[:, 1]


def deduplicate_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (bytes), spans (removed runs of bytes) and kept (the remaining bytes); odd rows as in remove_repeats."""
    return remove_repeats(docs, SHAPE, compare_suffixes)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_suffixes(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
