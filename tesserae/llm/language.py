"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained on the driver from a bounded sample of labelled rows, by backpropagation through time in numpy;
tasks then run it over every byte of every text. Texts are cut into windows, which run side by side: each answers for STRIDE
bytes and reads CONTEXT more on either side, so that no byte is judged from a state that has just begun. Each
position gets the chances of all languages from the states of both directions; a document's are the mean over the
positions of its letters. Gates use x / (1 + |x|) for tanh, and half of one more than that for the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import byte_class, text_slices
from .common import bound_batches, packed, table

STRIDE, CONTEXT, HIDDEN = 128, 16, 8
WINDOW = STRIDE + 2 * CONTEXT
#: Bytes of a training window.
TRAINED = 64
#: The sample: rows of each language, rows in all (so fewer of each where there are many languages), and bytes of a row. It
#: bounds what the driver holds.
ROWS_PER_LANG, SAMPLE_ROWS, BYTES_PER_ROW = 400, 25_600, 512
#: Windows that run side by side in a task, with few languages.
SIDE_BY_SIDE = 2048
UNDETERMINED = "und"
LETTERS = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalpha()))


def _soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


@dataclass
class Network:
    """Per direction: what each byte adds to the three gates (3H x 256) and the state's weights (3H x H); then the
    readout (K x 2H) and its bias."""

    langs: list[str]
    byte: list[np.ndarray]
    state: list[np.ndarray]
    readout: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
        return cls(langs, [draw(3 * hidden, 256) for _ in "fb"], [draw(3 * hidden, hidden) for _ in "fb"], draw(len(langs), 2 * hidden), np.zeros((len(langs), 1), np.float32))

    @property
    def hidden(self) -> int:
        return self.state[0].shape[1]

    def parameters(self) -> list[np.ndarray]:
        return [*self.byte, *self.state, self.readout, self.bias]

    def states(self, x: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
        """x: bytes (T x N). States (T x H x N) of direction d; trace gets what the backward pass needs, by step."""
        steps, n = x.shape
        hid, weights, table_ = self.hidden, self.state[d], self.byte[d]
        out = np.empty((steps, hid, n), np.float32)
        h = np.zeros((hid, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = np.take(table_, x[t], axis=1)
            g = weights @ h
            gates = a[: 2 * hid]
            gates += g[: 2 * hid]
            gates = _soft(gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:hid], gates[hid:]
            c = r * g[2 * hid :]
            c += a[2 * hid :]
            c = _soft(c)
            new = h - c
            new *= z
            new += c
            if trace is not None:
                trace.append((t, h, z, r, c, g[2 * hid :]))
            out[t] = h = new
        return out

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chances of the languages (K x T x N) at every position."""
        both = np.concatenate([self.states(x, 0), self.states(x, 1)], 1)
        return _softmax(np.einsum("kh,thn->ktn", self.readout, both, optimize=True) + self.bias[:, :, None])

    def gradients(self, x: np.ndarray, lang: np.ndarray, counted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over counted positions (T x N) of windows of known languages, and its gradients."""
        traces: list[list] = [[], []]
        both = np.concatenate([self.states(x, 0, traces[0]), self.states(x, 1, traces[1])], 1)
        p = _softmax(np.einsum("kh,thn->ktn", self.readout, both, optimize=True) + self.bias[:, :, None])
        total = max(1, counted.sum())
        right = np.take_along_axis(p, np.broadcast_to(lang[None, None], (1, *x.shape)), 0)[0]
        loss = float(-(np.log(right + 1e-9) * counted).sum() / total)
        p -= (np.arange(len(self.langs))[:, None, None] == lang)
        p *= counted / total
        grads = [None, None, None, None, np.einsum("ktn,thn->kh", p, both, optimize=True), p.sum((1, 2))[:, None]]
        up = np.einsum("kh,ktn->thn", self.readout, p, optimize=True)
        hid = self.hidden
        for d in (0, 1):
            carry = np.zeros((hid, x.shape[1]), np.float32)
            weights = np.zeros_like(self.state[d])
            reached = np.empty((x.shape[0], 3 * hid, x.shape[1]), np.float32)
            for t, h, z, r, c, g in reversed(traces[d]):
                dh = up[t, d * hid : (d + 1) * hid] + carry
                dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
                dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dc * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                reached[t] = np.concatenate([dz, dr, dc])
                inner = np.concatenate([dz, dr, dc * r])
                weights += inner @ h.T
                carry = dh * z + self.state[d].T @ inner
            flat, rows = x.ravel(), reached.transpose(1, 0, 2).reshape(3 * hid, -1)
            grads[d] = np.stack([np.bincount(flat, row, 256) for row in rows]).astype(np.float32)
            grads[2 + d] = weights
        return loss, grads


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def fit(texts: list[bytes], langs: list[str], epochs: int = 6, batch: int = 512, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over windows of the texts, in an order that depends on the seed only."""
    names = sorted(set(langs))
    net = Network.new(names, seed=seed)
    if not texts:
        return net
    windows = [(t[k : k + TRAINED], names.index(n)) for t, n in zip(texts, langs, strict=True) for k in range(0, max(1, len(t)), TRAINED)]
    x = np.zeros((len(windows), TRAINED), np.uint8)
    for k, (w, _) in enumerate(windows):
        x[k, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([n for _, n in windows])
    rng = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            b = np.ascontiguousarray(x[part].T)
            _, grads = net.gradients(b, y[part], LETTERS[b].astype(np.float32))
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def predict_slice(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean chances (texts x K) over each text's letters, zero for texts without."""
    n, k = len(starts) - 1, len(net.langs)
    sizes = np.diff(starts)
    windows = -(-sizes // STRIDE)
    text = np.repeat(np.arange(n), windows)
    first = np.cumsum(windows) - windows
    begin = starts[:-1][text] + (np.arange(len(text)) - first[text]) * STRIDE
    sums, letters = np.zeros((n, k)), np.zeros(n)
    padded = np.concatenate([np.zeros(CONTEXT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    steps = np.arange(WINDOW)[:, None]
    core = (steps >= CONTEXT) & (steps < CONTEXT + STRIDE)
    side = max(64, SIDE_BY_SIDE * 8 // max(8, k))
    for at in range(0, len(text), side):
        part = slice(at, at + side)
        # padded holds place p of the data at p + CONTEXT.
        x = padded[begin[part] + steps]
        place = begin[part] + steps - CONTEXT
        x[(place < starts[:-1][text[part]]) | (place >= starts[1:][text[part]])] = 0
        counted = LETTERS[x] & core
        p = net.chances(x)
        p *= counted
        for j in range(k):
            sums[:, j] += np.bincount(text[part], p[j].sum(0, dtype=np.float64), n)
        letters += np.bincount(text[part], counted.sum(0), n)
    return sums / np.maximum(letters, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, lang: str = "lang") -> Network:
    """A network from at most ROWS_PER_LANG rows of each language and SAMPLE_ROWS in all, chosen by hash of id and text.
    Every language is learned; more of them than SAMPLE_ROWS raise an error. Held-out rows, rows without an id, language
    or letter are not used, and equal rows count once; source is never read."""
    fit_for = F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    counts = docs.filter(fit_for).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(SAMPLE_ROWS + 1).collect()
    if len(counts) > SAMPLE_ROWS:
        raise ValueError(f"more than {SAMPLE_ROWS} languages")
    rows_each = min(ROWS_PER_LANG, SAMPLE_ROWS // max(1, len(counts)))
    # A share of each language's rows by hash that is a little over what is needed, from a table of the
    # languages, which SAMPLE_ROWS bounds.
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2.0 * rows_each / r["n"]) * (1 << 40)) + 1) for r in counts], "lang_ string, share_ long")
    h = F.xxhash64("doc_id", "text")
    usable = docs.filter(fit_for & F.col("text").rlike(r"\p{L}")).join(F.broadcast(shares), F.col(lang) == F.col("lang_")).filter(F.pmod(h, F.lit(1 << 40)) < F.col("share_"))
    sample = usable.select(F.col(lang).alias("lang"), F.substring(F.encode("text", "UTF-8"), 1, BYTES_PER_ROW).alias("text"), h.alias("h"), F.col("doc_id").cast("string").alias("id")).distinct()
    rows = sorted((r["lang"], r["h"], r["id"], bytes(r["text"])) for r in sample.collect())
    taken: dict[str, int] = {}
    texts, langs = [], []
    for name, _, _, text in rows:
        if taken.setdefault(name, 0) < rows_each:
            taken[name] += 1
            texts.append(text)
            langs.append(name)
    return fit(texts, langs)


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, starts in text_slices(batch.column("text")):
                part = batch.slice(row, end - row)
                lettered = part.column("lettered").to_pylist()
                p = predict_slice(net, data, starts)
                best = p.argmax(1)
                known = lettered
                names = [net.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known, strict=True)]
                score = [round(min(1.0, float(p[i, b])), 6) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("row_"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["row_", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """row_ (a struct of the kept columns, all by default), lang_pred and score, the mean chance of that language.

    Only text is read. Null texts and texts without a letter are undetermined with score 0, as is every text if the
    network has learned no language. Of languages with equal chances the first by name is taken. Equal texts get equal
    rows; long texts are read whole; an empty table gives none; columns that are called as results stay in row_.
    """
    bound_batches(docs.sparkSession)
    if not net.langs:
        return packed(docs, [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")], keep)
    rows = packed(docs, ["text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")], keep)
    return rows.mapInArrow(_predict(net), f"row_ {rows.schema['row_'].dataType.simpleString()}, lang_pred string, score double")


#: A document stays in the corpus if some language is found with at least this score: so much more than an even chance, but
#: no more than MOST_SCORE.
OVER_CHANCE, MOST_SCORE = 1.4, 0.5


def least_score(languages: int) -> float:
    return min(MOST_SCORE, OVER_CHANCE / max(1, languages))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those of undetermined or doubtful language; a null lang is filled with the one found.

    Null texts, empty ones and those without a letter go. Rows that repeat stay or go together; an empty table gives none;
    other columns, whatever they are called, are not touched.
    """
    net = learn(docs)
    found = identify(docs, net).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score(len(net.langs))))
    return found.select(*[F.coalesce("row_.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row_.`{c}`") for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs), ["doc_id"])
    return found.select("row_.doc_id", held_out(F.col("row_.doc_id")).alias("held_out"), "lang_pred", "score")
