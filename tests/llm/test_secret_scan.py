"""The whole secret scan in plain Python: letters, chances, the false-discovery rule and what is reported."""

import re

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import bpe, secrets

from ..conftest import DATA
from .test_operators import brute_battery, brute_secrets


def plain_repeat(words):
    """By encoding, how likely two letters of text are equal: letters of candidates without a digit, folded where the alphabet has one case."""
    count = {}
    for w in words:
        if not re.search("[0-9]", w):
            for c in w:
                count[c] = count.get(c, 0) + 1
    out = []
    for name, alphabet in secrets.ENCODINGS:
        folded = {}
        for c, n in count.items():
            forms = [c] if "a" in alphabet and "A" in alphabet else [c.lower(), c.upper()]
            kept = next((f for f in forms if f in alphabet), None)
            if kept:
                folded[kept] = folded.get(kept, 0) + n
        total = sum(folded.values())
        own = sum(v * v for v in folded.values()) / total**2 if total else 0.0
        out.append(max(own, 1 / len(alphabet), {"decimal": 0.2, "hex": 0.2, "HEX": 0.2}.get(name, 0.06)))
    return out


def plain_least_bin(judged):
    """The least bin at which the expected false share of what is reported is small enough."""
    for least in sorted({b for _, b in judged}):
        found = sum(r for r, b in judged if b >= least)
        if found and 10.0 ** (-least / secrets.STEP) * len(judged) <= secrets.FALSE_SHARE * found:
            return least
    return secrets.BINS + 1


def plain_scan(texts):
    words = [w for t in texts.values() for w in re.findall(secrets.CANDIDATE, t or "")]
    repeat = plain_repeat(words)
    judged = {w: brute_battery(w, repeat) for w in set(words)}
    exact = {w: (chance >= secrets.REJECT, int(np.floor(bin_))) for w, (chance, bin_) in judged.items()}
    least = plain_least_bin([exact[w] for w in words])
    out, doubtful = {}, set()
    for i, t in texts.items():
        t = t or ""
        base = [s for s in brute_secrets(t).split(",") if s]
        spans = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in base]
        for m in re.finditer(secrets.CANDIDATE, t):
            if not any(a <= m.start() and m.end() <= e for a, _, e in spans):
                chance, bin_ = judged[m[0]]
                if abs(chance - secrets.REJECT) < 1e-4 or abs(bin_ - least) <= 2 + 0.03 * bin_:
                    doubtful.add(i)
                if exact[m[0]][0] and exact[m[0]][1] >= least:
                    spans.append((m.start(), 3, m.end()))
        out[i] = ",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(spans))
    return out, doubtful


def test_the_whole_scan_equals_plain_python(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    want, doubtful = plain_scan(texts)
    got = {r["doc_id"]: r["spans"] for r in secrets.op9_secret_scans(spark, DATA).collect()}
    assert got.keys() == want.keys() and len(doubtful) < len(want) / 10
    assert {i: s for i, s in got.items() if i not in doubtful} == {i: s for i, s in want.items() if i not in doubtful}
    assert sum("random" in s for s in got.values()) > 0 or not any("random" in s for s in want.values())


def test_planted_keys_among_text(spark):
    rng = np.random.default_rng(12)
    words = ["the", "and", "tion", "ing", "er", "re", "on", "at", "en", "es", "Al", "Be"]
    texts = {k: "say " + "".join(rng.choice(words, rng.integers(8, 14))) + " end" for k in range(400)}
    for k in range(400, 420):
        alphabet = secrets.ENCODINGS[5 + k % 4][1]
        texts[k] = f"é {''.join(rng.choice(list(alphabet), 48))} token=abcdefgh{k} " + "".join(rng.choice(words, 9))
    want, doubtful = plain_scan(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["d"]: r["s"] for r in secrets.scan_secrets(docs).select(F.col("row_.doc_id").alias("d"), secrets.span_list(F.col("spans")).alias("s")).collect()}
    assert {i: s for i, s in got.items() if i not in doubtful} == {i: s for i, s in want.items() if i not in doubtful}
    assert sum("random" in want[k] for k in range(400, 420)) > 15


def test_op8_digests_equal_the_library(spark, duck):
    import hashlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op8_bpe(spark, DATA).collect())) == sorted(want)


def test_pieces_with_special_tokens_and_endings(spark):
    """The arrays' cut against the library's, special tokens as tokens of their own."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    pairs = bpe.load(bpe.file_bytes(bpe.default_vocabulary()))
    r = random.Random(2)
    texts = ["", None, "a's", "s's", "''s", " 's", "it'really", "'re", "'r", "l'll", "a\n\nb", "a \n b", "　 a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>"]
    texts += ["".join(r.choice([" ", "'", "s", "ll", "\n", "\t", "　", "é", "1", "²", "!", "日", "😀", "\x85", "\x1c", "<|endoftext|>"]) for _ in range(r.randint(1, 40))) for _ in range(2000)]
    ids, counts = pairs.encode_all(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
        assert ids[e - n : e].tolist() == t.encode(text or "", add_special_tokens=False).ids
