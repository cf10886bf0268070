"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

An encoding is greedy by merge rank, yet its last token has a local test: among the tokens that are suffixes of a
prefix exactly one, t, can follow the last token of what stands before it. Two tokens can stand side by side if undoing
their merges from the latest on never meets a pair that would have merged across the border earlier. So one pass over a
piece of text with an automaton that lists the tokens ending at each byte stores the last token of every prefix, and
back-pointers from the end give the ids. The vocabulary's file is a parameter: the driver reads it and broadcasts its bytes, whose size is that of a vocabulary.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, packed, table

# Fixed value: how the vocabulary's format cuts text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are encoded at once; pieces kept with their ids in a worker, and the longest that is kept.
SLICE = 1 << 20
CACHED, CACHED_BYTES = 400_000, 64


LETTER, NUMBER, BLANK = 1, 2, 3


@lru_cache(1)
def letter_kinds() -> np.ndarray:
    """LETTER, NUMBER, BLANK or 0 for every code point, as the pattern's classes have it."""
    kinds = np.zeros(0x110000, np.int8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for found in regex.finditer(pattern, text):
            kinds[np.frombuffer(found[0].encode("utf-32-le"), np.uint32)] = kind
    return kinds


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern starts at each character of many texts, of which each starts where first is set."""
    kind = letter_kinds()[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before other characters stands alone or, if it is a space, belongs to them.
    inner = np.flatnonzero(start[1:] & ~first[1:] & (kind[:-1] == BLANK)) + 1
    start[inner - 1] = True
    start[inner[codes[inner - 1] == 32]] = False
    # An apostrophe at the start of a piece takes the ending that follows it.
    tail = np.concatenate([codes, [0, 0, 0]])
    border = np.concatenate([first, [True, True, True]])
    at = np.flatnonzero(start & (codes == ord("'")))
    at = at[~border[at + 1]]
    one, two = tail[at + 1], np.where(border[at + 2], 0, tail[at + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, size in ((short, 1), (long, 2)):
        places = at[hit]
        start[places + 1] = False
        after = places + 1 + size
        start[after[after < len(codes)]] = True
    return start


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's file: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class BytePairs:
    """Merges of a byte-level BPE vocabulary, the automaton of its tokens, and the two directions."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab = spec["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        # Ranks: base bytes come first, then merges in order; rank_of orders the tokens as the merges do.
        self.left, self.right, self.rank = [*range(size)], [*range(size)], [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, i = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = i
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = left, right, r
        self._plain = [i for token, i in vocab.items() if token not in self.special]
        self.next: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._piece = regex.compile(PIECES)
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _automaton(self, ids: list[int]) -> None:
        """next state by state * 256 + byte; token of a state or -1; the nearest suffix state that is a token, or 0."""
        self.token, self.shorter, fail = [-1], [0], [0]
        for i in ids:
            s = 0
            for b in self.bytes[i]:
                t = self.next.get(s << 8 | b)
                if t is None:
                    t = self.next[s << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.shorter.append(0)
                    fail.append(0)
                s = t
            self.token[s] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for key, t in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, t))
        queue = deque(t for _, t in children.get(0, []))
        while queue:
            s = queue.popleft()
            self.shorter[s] = fail[s] if self.token[fail[s]] >= 0 else self.shorter[fail[s]]
            for b, t in children.get(s, []):
                f = fail[s]
                while f and (f << 8 | b) not in self.next:
                    f = fail[f]
                fail[t] = self.next.get(f << 8 | b, 0)
                queue.append(t)
        self.fail = fail

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 4 * CACHED:
                self._fits.clear()
            known = self._fits[a, b] = self._side_by_side(a, b)
        return known

    def _side_by_side(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' merges; what was undone later than a pair across the border came too late.
        rank, merged, limit = self.rank, self.merged, float("inf")
        while True:
            across = merged.get((a, b))
            if across is not None and rank[across] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        if not self.next:
            self._automaton(self._plain)
        step, fail, token, shorter = self.next, self.fail, self.token, self.shorter
        last, s = [-1] * (len(piece) + 1), 0
        for end, b in enumerate(piece, 1):
            while s and (s << 8 | b) not in step:
                s = fail[s]
            s = step.get(s << 8 | b, 0)
            at = s if token[s] >= 0 else shorter[s]
            while at:
                t = token[at]
                begin = end - len(self.bytes[t])
                if not begin or self.compatible(last[begin], t):
                    last[end] = t
                    break
                at = shorter[at]
            assert last[end] >= 0, "no token fits"
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode_plain(), but special tokens in the texts are tokens of their own."""
        marked = np.zeros(len(texts), bool)
        for t in self.special:
            marked |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.encode_plain(texts)
        own = {k: np.frombuffer(self.encode(texts[k].as_py()), np.int32) for k in np.flatnonzero(marked).tolist()}
        ids, counts = self.encode_plain(pc.if_else(pa.array(marked), "", texts))
        parts, begin, done = [], np.cumsum(counts) - counts, 0
        for k, found in own.items():
            parts += [ids[done : begin[k]], found]
            done, counts[k] = begin[k], len(found)
        return np.concatenate([*parts, ids[done:]]), counts

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after the other. Special tokens in the text are tokens of their own."""
        if self._cut and any(t in text for t in self.special):
            parts = self._cut.split(text)
        else:
            parts = [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                known = self._known
                out += [known[p] if p in known else self._new(p) for p in self._piece.findall(part)]
        return b"".join(out)

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Special tokens in them are ordinary text; null counts as empty."""
        return encode_words(texts, piece_starts, lambda words: [self._known.get(p) or self._new(p) for p in words.to_pylist()])

    def _new(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.encode_piece(data), np.int32).tobytes()
        if len(data) <= CACHED_BYTES:
            if len(self._known) >= CACHED:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after the other."""
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        return self.blob[np.repeat(self.begins[ids] - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]


@lru_cache(2)
def load(file: bytes) -> BytePairs:
    return BytePairs(file)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k] + 1, ... of counts[k] places for each k."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def encode_words(texts: pa.Array, cut: Callable[[np.ndarray, np.ndarray], np.ndarray], encode: Callable[[pa.Array], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each has. cut tells where words start, given code points and where texts
    start; encode gets the distinct words and gives each one's ids as 32-bit integers. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    if not data:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    offsets = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(len(codes), bool)
    first[np.searchsorted(offsets, (np.cumsum(sizes) - sizes)[sizes > 0])] = True
    starts = offsets[cut(codes, first)]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
    coded = encode(words.dictionary)
    counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    each = words.indices.to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(counts[each])])
    ids = np.frombuffer(b"".join(coded), np.int32)[spread((np.cumsum(counts) - counts)[each], counts[each])]
    return ids, np.diff(total[np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))])


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """Successive rows of about so many bytes of text, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + limit, "right")))
        yield row, end
        row = end


def _tokenize(file, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(file.value)
        for batch in batches:
            for row, end in text_slices(batch.column("text"), SLICE):
                part = batch.slice(row, end - row)
                ids, counts = pairs.encode_all(part.column("text"))
                starts = np.concatenate([[0], np.cumsum(counts)])
                text = pairs.decode(ids)
                ends = np.concatenate([[0], np.cumsum(pairs.sizes[ids])])[starts]
                # A text's tokens may end within a character only if it was not valid to begin with; then it is replaced.
                raw = text.tobytes()
                decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                made = {"ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in columns], names=columns)

    return run


def encode_and_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """row_ (a struct of the kept columns, all by default), ids (an array of ints) and decoded, the text of the ids.

    Null and empty texts have no ids and decode to the empty text. Texts that repeat give equal rows; an empty table
    gives none. Any UTF-8 text decodes to itself; long texts are encoded whole; columns that are called as results stay in
    row_.
    """
    bound_batches(docs.sparkSession)
    rows = packed(docs, ["text"], keep)
    row = rows.schema["row_"].dataType.simpleString()
    columns = ["row_", "ids", "decoded"]
    return rows.mapInArrow(_tokenize(docs.sparkSession.sparkContext.broadcast(file_bytes(path)), columns), f"row_ {row}, ids array<int>, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (an array of ints), n_tokens, ids_sha256 and decoded_sha256, a row for each row of docs.

    Null and empty texts have no ids and the digests of the empty text; repeated rows give equal rows, whatever else they hold;
    an empty table gives none; of columns with clashing names only doc_id and text are read; long texts are encoded whole.
    """
    coded = encode_and_decode(docs, path, ["doc_id"])
    return coded.select("row_.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """As tokens(), without the ids."""
    return tokens(docs, path).drop("ids")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), default_vocabulary())
