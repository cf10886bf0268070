"""Seeds of equal windows: the same whatever stands around them."""

import numpy as np
import pytest

from tesserae.llm import bytetext, repeats, substrings, suffixes


@pytest.mark.parametrize("bits", [2, 5, 64])
@pytest.mark.parametrize("shape", [suffixes.SHAPE, substrings.SHAPE])
def test_equal_windows_have_equal_seeds(monkeypatch, bits, shape):
    """A hash of few bits makes ties common; a slice of some kB and one of 8 MB must break them alike."""
    whole = repeats.span_hash
    monkeypatch.setattr(repeats, "span_hash", lambda *a, **b: whole(*a, **b) >> np.uint64(64 - bits))
    rng = np.random.default_rng(bits)
    text = bytes(rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), 3000))
    front = bytes(rng.choice(np.frombuffer(b"mnop  ", np.uint8), 8 << 20))
    seeds = []
    for parts in ([text], [front, text]):
        data = np.frombuffer(b"".join(parts), np.uint8)
        u = shape.units(data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        e = repeats.find_seeds(u, shape)
        base = u.first[len(parts) - 1]
        mine = e.text == len(parts) - 1
        seeds.append({w - base: (h, at - base) for h, at, lo, hi in zip(e.hash[mine], e.at[mine], e.lo[mine], e.hi[mine], strict=True) for w in range(lo, hi + 1)})
    assert len(seeds[0]) > 300 and seeds[0] == seeds[1]
    # Windows with the same content, wherever they stand, have the same seed at the same place in them.
    twice = np.frombuffer(text + text, np.uint8)
    u = shape.units(twice, np.array([0, len(text), 2 * len(text)]))
    e = repeats.find_seeds(u, shape)
    found = [{}, {}]
    for t, h, at, lo, hi in zip(e.text, e.hash, e.at, e.lo, e.hi, strict=True):
        found[t].update({w - u.first[t]: (h, at - u.first[t]) for w in range(lo, hi + 1)})
    assert found[0] == found[1]


@pytest.mark.parametrize("bits", [1, 3, 64])
@pytest.mark.parametrize("shape", [suffixes.SHAPE, substrings.SHAPE])
def test_seeds_by_definition(monkeypatch, bits, shape):
    """Against the first least of each window's hashes, window by window; texts of all lengths, also below a window."""
    whole = repeats.span_hash
    monkeypatch.setattr(repeats, "span_hash", lambda *a, **b: whole(*a, **b) >> np.uint64(64 - bits))
    rng = np.random.default_rng(bits)
    parts = [bytes(rng.choice(np.frombuffer(b"abc  ", np.uint8), int(n))) for n in (700, 0, 3, 49, 50, 51, 900)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    u = shape.units(data, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    h = repeats.span_hash(u.form, u.begins[: len(u.begins) - shape.gram + 1], u.ends[shape.gram - 1 :])
    want = {}
    for t in range(len(parts)):
        for w in range(int(u.first[t]), int(u.first[t + 1]) - shape.window + 1):
            want[w] = (t, w + int(np.argmin(h[w : w + shape.grams])))
    e = repeats.find_seeds(u, shape)
    got = {w: (t, at) for t, at, lo, hi in zip(e.text.tolist(), e.at.tolist(), e.lo.tolist(), e.hi.tolist(), strict=True) for w in range(lo, hi + 1)}
    assert got == want and len(e.at) == len({(t, at) for t, at in want.values()})


def test_hashes_of_every_place():
    data = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8)
    for size in (1, 2, 7, 16, 50):
        begins = np.arange(len(data) - size + 1)
        assert (bytetext.span_hash(data, begins, begins + size, every=True) == bytetext.span_hash(data, begins, begins + size)).all()


def test_contexts_that_share_no_window_are_not_sorted_deep(monkeypatch):
    """Copies need no trie, nor do contexts that share their seed and a few bytes on either side; those that part late do."""
    inserted = []
    insert = suffixes.BlindTrie.insert
    monkeypatch.setattr(suffixes.BlindTrie, "insert", lambda self, text, number, texts: (inserted.append(number), insert(self, text, number, texts))[1])
    rng = np.random.default_rng(2)
    filler = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    core, copy, late = filler(33), filler(84), filler(80)

    def compared(texts):
        blob, n = np.frombuffer(b"".join(texts), np.uint8), len(texts)
        full = lambda v: np.full(n, v, np.int64)
        c = repeats.Contexts(full(0), np.arange(n), full(35), full(34), np.arange(n) * 84, full(84), blob)
        which, a, b = suffixes.compare_suffixes(c)
        return sorted((int(w), int(k)) for w, lo, hi in zip(which, a, b, strict=True) for k in range(lo, hi + 1))

    assert compared([filler(21) + core + filler(30) for _ in range(50)]) == []
    assert compared([copy] * 50) == [(w, k) for w in range(1, 50) for k in range(35)]
    assert not inserted
    ends = [late + filler(4) for _ in range(5)]
    assert compared(ends) == [(w, k) for w in range(1, 5) for k in range(35) if any(e[k : k + 50] == ends[w][k : k + 50] for e in ends[:w])]
    assert inserted


def test_heads_of_contexts_are_packed_by_bytes():
    import numpy as np

    from tesserae.llm import repeats

    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        columns = {"h": np.sort(rng.integers(0, 1 << 63, n)).astype(np.uint64), "text": np.arange(n), "doc": rng.integers(-5, 60_000, n), "lo": rng.integers(0, 9000, n), "windows": rng.integers(1, 30, n), "before": rng.integers(0, 60, n), "size": rng.integers(50, 99, n)}
        head = repeats.packed_head(columns)
        assert all((v == columns[c]).all() and v.dtype == repeats.TYPES[c] for c, v in repeats.unpacked_head(head, n).items())
    # Numbers as they are took 33 bytes each.
    assert len(head) < 500 * 18
