"""Helpers of the tasks that read texts as UTF-8 bytes: a batch's texts as one numpy array, words and rolling hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A batch is worked off in slices of whole texts of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of successive slices; starts has a value more than there are rows. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + limit, "right")) - 1)
        yield row, end, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def word_bounds(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, first word of each text and the number of words); is_word: by byte. No word crosses texts."""
    inside = is_word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, starts)


def byte_class(gaps: str) -> np.ndarray:
    """By byte, whether it is none of the given ASCII characters."""
    out = np.ones(256, bool)
    out[list(gaps.encode())] = False
    return out


#: Words between ASCII white space, and words of letters, digits and everything beyond ASCII.
SPACED = byte_class(" \t\n\x0b\x0c\r")
LETTERED = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


@lru_cache(2)
def _tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), int(rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 1 | 4


@lru_cache(4)
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base below STRIDE and in steps of it, and of its inverse."""
    base = _tables(seed)[1]
    out = []
    for r in (base, pow(base, -1, 2**64)):
        for step, size in ((r, STRIDE), (pow(r, STRIDE, 2**64), STRIDES)):
            p = np.full(size, step & (2**64 - 1), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return tuple(out)


STRIDE, STRIDES = 1 << 13, 1 << 17
#: Places that are worked on at a time where steps follow each other.
BLOCK = 1 << 15


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def span_hasher(data: np.ndarray, seed: int = 7) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """From begins and ends to a 64-bit hash of each span of data, the same wherever the span stands. At most 1 GB of data."""
    low, high, low_inverse, high_inverse = _powers(seed)
    n, table = len(data), _tables(seed)[0]
    total = np.zeros(n + 1, np.uint64)
    for at in range(0, n, STRIDE):
        part = table[data[at : at + STRIDE]]
        part *= low[: len(part)]
        part *= high[at // STRIDE]
        np.cumsum(part, out=total[at + 1 : at + 1 + len(part)])
        total[at + 1 : at + 1 + len(part)] += total[at]

    def of(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = total[ends] - total[begins]
        h *= low_inverse[begins % STRIDE]
        h *= high_inverse[begins // STRIDE]
        return mix(h + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return of


def span_hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 7, every: bool = False) -> np.ndarray:
    """every: the spans are those of one size at all of the first places of data."""
    if every and len(begins):
        return _every_hash(data, len(begins), int(ends[0] - begins[0]), seed)
    return span_hasher(data, seed)(begins, ends)


def _every_hash(data: np.ndarray, n: int, size: int, seed: int) -> np.ndarray:
    """The same hashes, from those of half the size, a block that fits a processor's cache at a time."""
    table, base = _tables(seed)
    power = lambda k: np.uint64(pow(base, k, 2**64))
    out = np.full(n, size * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for at in range(0, n, BLOCK):
        own = out[at : at + BLOCK]
        # part: sums over width bytes at each place; the bits of size tell which are taken.
        part, done, width = table[data[at : at + len(own) + size - 1]], 0, 1
        while done < size:
            if size & width:
                own += part[done : done + len(own)] * power(done)
                done += width
            if done < size:
                longer = part[width:] * power(width)
                longer += part[:-width]
                part, width = longer, 2 * width
        own[:] = mix(own)
    return out


def equal_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[a : a + size] and y[b : b + size] are equal, for each row."""
    same = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for k in range(int(size.max(initial=0))):
        alive = alive[size[alive] > k]
        good = x[a[alive] + k] == y[b[alive] + k]
        same[alive[~good]] = False
        alive = alive[good]
        if not len(alive):
            break
    return same


def span_places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places in the spans of these sizes, span after span."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begins - (total - sizes), sizes)


def sums_by_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]
