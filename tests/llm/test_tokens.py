"""SentencePiece, alignment of tokenizers and the Merkle manifest against the libraries, brute force and SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import align, bpe, merkle, oracle, pieces

from ..conftest import DATA, rows_of
from .test_operators import empty, odd

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.file_bytes(pieces.default_model()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return t


def texts_of_all_kinds(voc):
    r = random.Random(1)
    letters = [lambda: chr(r.randint(32, 126)), lambda: chr(r.randint(160, 0x2FFF)), lambda: chr(r.randint(0x4E00, 0x9FFF)), lambda: chr(r.randint(0x1F300, 0x1F6FF)), lambda: r.choice("  \n\t'▁\x00\x85　")]
    out = ["", None, " ", "  ", "a", "▁", "▁a ▁", "\x00", "\n", "é", "😀a😀", "aaaa" * 500, "=" * 1000, " " * 999, "<0x41><s></s><unk><|endoftext|>", "�", "'s's ''s 'll"]
    out += ["".join(r.choice(letters)() for _ in range(r.randint(1, 200))) for _ in range(300)]
    out += ["".join(r.choice("ab") for _ in range(r.randint(1, 200))) for _ in range(300)]
    out += ["".join(r.choice(voc) for _ in range(r.randint(1, 80))) for _ in range(500)]
    out += ["".join(r.choice(voc[:3000]).strip() for _ in range(r.randint(50, 900))) for _ in range(100)]
    return [*out, "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(30_000))]


# SentencePiece


def test_pieces_equal_the_library(model, library):
    texts = texts_of_all_kinds([p.replace("▁", " ") for p in model.pieces[259:]])
    ids, counts = model.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
        want = library.encode(t or "")
        assert ids[e - n : e].tolist() == want
        assert model.decode(ids[e - n : e]) == library.decode(want)


def test_any_ids_decode_as_in_the_library(model, library):
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.choice([r.randint(0, 31_999), r.randint(0, 300), r.randint(3, 258)]) for _ in range(r.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_a_merge_that_makes_a_better_pair_goes_first(model):
    # ab is the worst pair, but (ab, a) and (b, ab) are better than it: the second ab must not merge along with the first.
    small = pieces.Pieces.__new__(pieces.Pieces)
    small.size, small.id = 10, {"a": 0, "b": 1, "ab": 2, "aba": 3, "abab": 4, "bab": 5}
    small._pairs(np.array([9, 9, 8, 1, 0, 2]))
    small._spans()

    def sequential(s):
        s = list(s)
        rank = {"ab": 8, "aba": 1, "abab": 0, "bab": 2}
        while True:
            found = min(((rank[x + y], k) for k, (x, y) in enumerate(itertools.pairwise(s)) if x + y in rank), default=None)
            if found is None:
                return s
            s[found[1] : found[1] + 2] = [s[found[1]] + s[found[1] + 1]]

    name = {i: p for p, i in small.id.items()}
    for n in range(1, 11):
        for s in map("".join, itertools.product("ab", repeat=n)):
            sym, _ = small.merges.merge(np.array([small.id[c] for c in s], np.int32), np.zeros(n, np.int64))
            assert [name[i] for i in sym.tolist()] == sequential(s), s


def test_op11_equals_the_library(spark, duck, library):
    want = []
    for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, pieces.op11_sentencepiece(spark, DATA).collect())) == sorted(want)


def test_pieces_odd_rows(spark):
    docs = odd(spark)
    got = pieces.encode_and_decode(docs, pieces.default_model()).select("row_.text", "row_.ids", F.col("ids").alias("n"), "decoded").collect()
    assert len(got) == docs.count() and all(r["decoded"] == (r["text"] or "") for r in got)
    assert all(r["n"] == [] for r in got if not r["text"])
    assert pieces.encode_and_decode(empty(spark), pieces.default_model()).count() == 0
    broken = spark.createDataFrame([(b"a\xff\xe2\x82b",)], "t binary").select(F.col("t").cast("string").alias("text"))
    assert "�" in pieces.encode_and_decode(broken, pieces.default_model()).first()["decoded"]


# Alignment


def brute_ends(a, b):
    common = sorted(set(a) & set(b))
    return [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common]


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(2000):
        n = r.randint(1, 60)
        share = r.choice([0.1, 0.5, 0.95])
        cuts = [sorted({*(k for k in range(1, n) if r.random() < share), n}) for _ in range(2)]
        if r.random() < 0.5:
            cuts[1] = sorted({*(k for k in cuts[0] if r.random() < 0.9), n})
        left, right = align.group_ends(*(np.array(c) for c in cuts))
        assert (left.tolist(), right.tolist()) == brute_ends(*cuts)


def brute_alignment(rows, tokenizer, library, model):
    pairs = bpe.load(bpe.file_bytes(bpe.default_vocabulary()))
    made, held, most = [], Counter(), {}
    for i, t in rows:
        full = " " + t if t else ""
        a, b = tokenizer.encode(full, add_special_tokens=False).ids, library.encode(t or "")
        raw_a, raw_b = [pairs.bytes[x] for x in a], [model.bytes[x] for x in b]
        if not t or b"".join(raw_a) != full.encode() or b"".join(raw_b) != full.encode():
            made.append((i, [], [], [], Counter()))
            continue
        ends = brute_ends(*(list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b)))
        groups = [(a[p:q], b[u:v]) for p, q, u, v in zip([0, *ends[0]], ends[0], [0, *ends[1]], ends[1], strict=False)]
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        made.append((i, a, b, groups, links))
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    for i, a, b, groups, links in made:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        yield {"doc_id": i, "n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": sum(links.values()), "n_best": best, "count_sum": sum(n * held[p] for p, n in links.items()), "groups_sha256": sha(text) if a else ""}


def test_op12_equals_brute_force(spark, duck, tokenizer, library, model):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = sorted(map(repr, (sorted(d.items()) for d in brute_alignment(rows, tokenizer, library, model))))
    assert sorted(repr(sorted(r.asDict().items())) for r in align.op12_token_alignment(spark, DATA).collect()) == want


@pytest.mark.parametrize("large,hot", [(256, 1 << 16), (2, 20), (1, 1)])
def test_alignment_odd_rows(spark, tokenizer, library, model, monkeypatch, large, hot):
    monkeypatch.setattr(align, "LARGE", large)
    texts = [*texts_of_all_kinds([p.replace("▁", " ") for p in model.pieces[259:]])[:400:3], "▁", "a▁b", "", None, "ab " * 300]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "one two"), (0, "one two"), (None, "one two"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("mine"), "links": F.lit(1), "row_": F.lit(2)}).repartition(3)
    found = align.aligned(docs, bpe.default_vocabulary(), pieces.default_model())
    saved = align.written(found.withColumn("id_", F.monotonically_increasing_id()), "test")
    counts = align.pair_counts(saved)
    sums = {r["id_"]: r for r in align.link_sums(saved, counts, hot).collect()}
    got = []
    for r in saved.collect():
        s = sums.get(r["id_"])
        got.append({"doc_id": r["row_"]["doc_id"], "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"], "n_links": r["n_links"], "n_best": s["n_best"] if s else 0, "count_sum": s["count_sum"] if s else 0, "groups_sha256": sha(r["groups"]) if r["n_a"] else ""})
    want = list(brute_alignment(rows, tokenizer, library, model))
    assert sorted(repr(sorted(g.items())) for g in got) == sorted(repr(sorted(w.items())) for w in want)
    assert align.aligned(docs.limit(0), bpe.default_vocabulary(), pieces.default_model()).count() == 0


# Merkle manifest


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root and whether it is the root, for rows (doc_id, source, lang, n_chars, text)."""

    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes, at):
        path = []
        while len(nodes) > 1:
            path.append((at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""))
            nodes, at = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], at >> 1
        return nodes[0], path

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    nodes = {g: [x[0][2] for x in sorted(groups[g], key=lambda x: x[0])] for g in langs}
    subroots = [climb(nodes[g], 0)[0] for g in langs]
    for k, g in enumerate(langs):
        root, high = climb(subroots, k)
        for at, (key, r) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            h = key[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            _, low = climb(nodes[g], at)
            for right, beside in low + high:
                h = sha(beside + h if right else h + beside)
            yield r[0], key[2], subroots[k], root, sha("".join(b for _, b in low + high)), h, h == root


def manifest_rows(spark, rows):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(repr, (tuple(r) for r in merkle.op13_merkle_manifest(spark, folder).collect())))


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    r = random.Random(levels)
    rows = [(r.choice([None, *range(60)]), r.choice([None, "s", "é"]), r.choice([None, "", "a", "b", "ü", "zz"]), r.choice([None, 1, 2**63 - 1]), r.choice([None, "", "x" * 5000, "😀"])) for _ in range(90)]
    rows += [(7, "s", "hot", 3, "same")] * 40 + [(8, None, "one", None, None)]
    assert manifest_rows(spark, rows) == sorted(map(repr, brute_manifest(rows)))


def test_manifest_of_one_row_of_one_group_and_of_none(spark):
    one = [(1, "s", None, 2, "t")]
    assert manifest_rows(spark, one) == sorted(map(repr, brute_manifest(one)))
    assert manifest_rows(spark, one * 5) == sorted(map(repr, brute_manifest(one * 5)))
    assert manifest_rows(spark, one[:0]) == []
    docs = odd(spark).withColumns({"leaf": F.lit(1), "path": F.lit("p"), "root": F.lit(None).cast("string"), "item": F.lit(0), "group": F.lit("g"), "at": F.lit(5), "size": F.lit(6)})
    found = merkle.manifest(docs)
    assert found.count() == docs.count() and found.select("root").distinct().count() == 1
    assert found.filter(merkle.folded(merkle.folded(F.col("leaf"), F.col("at"), F.col("path")), F.col("top_at"), F.col("top_path")) != F.col("root")).count() == 0


def test_manifest_equals_sql(spark, duck):
    assert rows_of(merkle.op13_merkle_manifest(spark, DATA).toPandas()) == rows_of(duck.execute(oracle.MERKLE).df())
