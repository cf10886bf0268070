"""SentencePiece BPE encoding and decoding by vectorised rounds of merges.

An encoder merges, again and again, the adjacent pair of the best rank, the leftmost of equals, until no pair is left. Texts are cut
into words where no piece of the vocabulary can reach across, so words are independent, and words that repeat are encoded once.
All distinct words of a slice of texts stand in one flat array of symbols. A round finds each word's best rank by a segmented
minimum, merges all its occurrences in that word at once, the leftmost first where they overlap, and compacts the arrays; words
without a pair leave. Where a merge makes a pair that is at least as good as itself, that pair comes next, so what stands to the right
of it in the word waits for a later round: the result is the sequential one. Normalisation must be the identity, as in the model given here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHED, CACHED_BYTES, encode_words, file_bytes, spread, text_slices
from .common import bound_batches, packed, table

#: Fixed value: the letter that stands for a space in pieces.
SPACE = "▁"
NONE = np.int32(1 << 30)
#: Bits of the table of character pairs within pieces, and how long a word may be before pieces themselves cut it.
PAIR_BITS, LONG = 22, 64
#: What decoding puts for an unknown piece and for bytes that are no UTF-8.
UNKNOWN, BROKEN = " ⁇ ", "�"


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)


def by_word(ids: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
    """The ids of each of n words, which stand in order, as 32-bit integers."""
    data = ids.astype(np.int32).tobytes()
    ends = (4 * np.cumsum(np.bincount(word, minlength=n))).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Known:
    """Ids of words that a worker has met, a bounded table."""

    def __init__(self):
        self.ids: dict[str, bytes] = {}

    def of(self, words: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        known, words = self.ids, words.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            made = encode(new)
            if len(known) + len(new) > CACHED:
                known.clear()
            known.update((w, ids) for w, ids in zip(new, made) if len(w) <= CACHED_BYTES)
            fresh = iter(made)
            found = [next(fresh) if ids is None else ids for ids in found]
        return found


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * 31_337 + right) & ((1 << PAIR_BITS) - 1)


class Merges:
    """Pairs of symbols, each with its rank and what it becomes."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], ranks[order].astype(np.int32), made[order].astype(np.int32)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the keys, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self._lookup(left, right)
        return np.where(at >= 0, self.ranks[at], NONE)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and their words, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = best == NONE
            if over.any():
                done.append((sym[over], word[over]))
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            # Overlapping occurrences form runs of neighbours, of which every second merges, from the left.
            hit = rank == best
            at = np.flatnonzero(hit)
            begin = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(at - at[begin][np.cumsum(begin) - 1]) % 2 == 0]
            made = self.made[self._lookup(sym[at], sym[at + 1])]
            # The pairs that a merge makes with its neighbours, the left one perhaps merged already.
            left = np.full(len(at), NONE, np.int32)
            k = np.flatnonzero((at > 0) & (word[np.maximum(at - 1, 0)] == word[at]))
            after = (k > 0) & (at[np.maximum(k - 1, 0)] == at[k] - 2)
            left[k] = self._rank(np.where(after, made[np.maximum(k - 1, 0)], sym[at[k] - 1]), made[k])
            right = np.full(len(at), NONE, np.int32)
            k = np.flatnonzero((at + 2 < len(sym)) & (word[np.minimum(at + 2, len(sym) - 1)] == word[at]))
            right[k] = self._rank(made[k], sym[at[k] + 2])
            sooner = np.minimum(left, right) <= best[at]
            if sooner.any():
                # What stands to the right of such a merge in its word waits.
                before = np.cumsum(sooner) - sooner
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                before -= before[first][np.cumsum(first) - 1]
                keep = before == 0
                at, made = at[keep], made[keep]
            sym[at] = made
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            sym, word, rank = sym[stays], word[stays], rank[stays]
            new = place[at]
            touched = np.zeros(len(sym), bool)
            touched[new] = True
            touched[np.maximum(new - 1, 0)] = True
            rank[touched] = NONE
            touched[-1] = False
            changed = np.flatnonzero(touched)
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._rank(sym[changed], sym[changed + 1])
        if not done:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class Pieces:
    """A vocabulary of pieces: ranks of pairs of symbols, and the two directions.

    A symbol is the id of a piece or, for a character that is none, the number of pieces plus its code point.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and spaces before words is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model must not normalise, but put a space in front")
        kinds = proto.SentencePiece
        self.size = len(proto.pieces)
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        if (self.kinds == kinds.USER_DEFINED).any() or (self.kinds == kinds.UNUSED).any():
            raise ValueError("pieces defined by users and unused ones are not supported")
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in np.flatnonzero(self.kinds == kinds.BYTE):
            value = int(self.pieces[i][3:5], 16)
            self.byte_id[value], self.bytes[i] = i, bytes([value])
        self.is_byte = self.kinds == kinds.BYTE
        self.is_control, self.is_unknown = self.kinds == kinds.CONTROL, self.kinds == kinds.UNKNOWN
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        _, rank = np.unique([-p.score for p in proto.pieces], return_inverse=True)
        self._pairs(rank)
        self._spans()

    def _symbol(self, text: str) -> int | None:
        found = self.id.get(text)
        return self.size + ord(text) if found is None and len(text) == 1 else found

    def _pairs(self, rank: np.ndarray) -> None:
        keys, ids = [], []
        inside = np.zeros(1 << PAIR_BITS, bool)
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(i)
            codes = np.array([ord(c) for c in piece], np.int64)
            inside[_pair_hash(codes[:-1], codes[1:])] = True
        self.merges = Merges(np.array(keys, np.int64), rank[ids], np.array(ids))
        self.known = Known()
        self.inside = inside
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]

    def _spans(self) -> None:
        """Hashes of all pieces of a length, by length: where none stands across a border, nothing merges across it."""
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.spans: dict[int, np.ndarray] = {}
        by_length: dict[int, list[str]] = {}
        for piece in self.id:
            by_length.setdefault(len(piece), []).append(piece)
        for length, pieces in by_length.items():
            if length > 1:
                codes = np.array([[ord(c) for c in p] for p in pieces], np.uint64)
                value = np.zeros(len(pieces), np.uint64)
                for k in range(length):
                    value = value * self.base + codes[:, k]
                self.spans[length] = np.unique(value)

    def _borders(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character: where texts start, and where no piece reaches across."""
        plain = np.where(codes == 32, ord(SPACE), codes)
        cut = first.copy()
        cut[1:] |= ~self.inside[_pair_hash(plain[:-1], plain[1:])]
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(codes)))
        long = lengths > LONG
        if long.any():
            at = spread(starts[long], lengths[long])
            word = np.repeat(np.arange(int(long.sum())), lengths[long])
            text, n = plain[at].astype(np.uint64), len(at)
            covered = np.zeros(n + 1, np.int64)
            value = np.zeros(n, np.uint64)
            for length in range(1, max(self.spans, default=0) + 1):
                # value[i] holds the hash of the length characters from i on.
                value = value[: n - length + 1] * self.base + text[length - 1 :]
                if length in self.spans and len(value):
                    known = self.spans[length]
                    near = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    here = np.flatnonzero((known[near] == value) & (word[: n - length + 1] == word[length - 1 :]))
                    np.add.at(covered, here + 1, 1)
                    np.add.at(covered, here + length, -1)
            cut[at] |= np.cumsum(covered[:-1]) == 0
        return cut

    def _encode_new(self, words: list[str]) -> list[bytes]:
        chars = np.array([len(w) for w in words], np.int64)
        sym, word = self.merges.merge(self.symbol[_codes("".join(words).encode())], np.repeat(np.arange(len(words)), chars))
        # A character that is no piece becomes its bytes.
        alone = sym >= self.size
        ids = sym
        if alone.any():
            raw = [chr(c).encode() for c in (sym[alone] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[alone] = [len(r) for r in raw]
            ids, word = np.repeat(sym, times), np.repeat(word, times)
            ids[np.repeat(alone, times)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return by_word(ids, word, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        led = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        return encode_words(led, self._borders, lambda words: self.known.of(words, self._encode_new))

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other, as they stand."""
        return self.blob[spread(self.begins[ids], self.sizes[ids])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: one space in front is dropped, control pieces vanish, bytes that are no UTF-8 are replaced."""
        kinds = self.is_control[ids] | self.is_unknown[ids]
        if not kinds.any() and len(ids):
            lead = self.pieces[ids[0]].startswith(SPACE)
            try:
                return self.raw(ids).tobytes().decode("utf-8")[lead:]
            except UnicodeDecodeError:
                pass
        out, held, opening = [], bytearray(), True
        for i in [*np.asarray(ids).tolist(), None]:
            if i is not None and self.is_byte[i]:
                held += self.bytes[i]
                continue
            out.append(_replaced(bytes(held)))
            held.clear()
            opening = opening and not any(out)
            if i is None or self.is_control[i]:
                continue
            if self.is_unknown[i]:
                out.append(UNKNOWN)
                continue
            piece = self.pieces[i]
            if opening and piece.startswith(SPACE):
                piece, opening = piece[1:], False
            out.append(piece.replace(SPACE, " "))
        return "".join(out)


def _replaced(data: bytes) -> str:
    """Bytes as text, each one that starts no character replaced by itself."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BROKEN)
            at += 1
    return "".join(out)


@lru_cache(2)
def load(model: bytes) -> Pieces:
    return Pieces(model)


def _encode(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model.value)
        for batch in batches:
            for row, end in text_slices(batch.column("text")):
                part = batch.slice(row, end - row)
                ids, counts = pieces.encode(part.column("text"))
                starts = np.concatenate([[0], np.cumsum(counts)])
                decoded = [pieces.decode(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                made = {"ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in columns], names=columns)

    return run


def encode_and_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """row_ (a struct of the kept columns, all by default), ids (an array of ints) and decoded, the text of the ids.

    Null and empty texts have no ids and decode to the empty text. Texts that repeat give equal rows; an empty table gives
    none. A text decodes to itself but for the letter U+2581, which becomes a space. Bytes that are no UTF-8 count as U+FFFD. Long texts
    are encoded whole; columns that are called as results stay in row_. The model's file is read by the driver and broadcast: it has
    the size of a vocabulary.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = packed(docs, ["text"], keep).withColumn("text", F.make_valid_utf8("text"))
    row = rows.schema["row_"].dataType.simpleString()
    columns = ["row_", "ids", "decoded"]
    return rows.mapInArrow(_encode(spark.sparkContext.broadcast(file_bytes(path)), columns), f"row_ {row}, ids array<int>, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), default_model(), ["doc_id"])
    return coded.select("row_.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
