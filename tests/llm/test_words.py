"""The vectorised helpers against plain Python."""

import numpy as np
import pyarrow as pa

from pelagia.llm.words import blocks, counted, ngrams, shapes, shingles, words


def test_words_and_blocks():
    texts = pa.array(["a bb  a", None, "", "  ", "a", "é\tbb x"])
    seen = []
    for i, j, data, offsets in blocks(texts, limit=4):
        w = words(data, offsets)
        seen += [(i + d, bytes(data[s:e]).decode(), int(h)) for s, e, d, h in zip(w.start, w.end, w.doc, w.hash, strict=True)]
        assert j > i
    assert [(d, t) for d, t, _ in seen] == [(0, "a"), (0, "bb"), (0, "a"), (4, "a"), (5, "é"), (5, "bb"), (5, "x")]
    by = {}
    for _, t, h in seen:
        assert by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)
    assert list(blocks(pa.array([], pa.string()))) == []


def test_shingles_of_short_texts_and_counts():
    values, doc = np.array([1, 2, 3, 9, 9, 9, 9], np.uint64), np.array([0, 0, 0, 2, 2, 2, 2])
    g, of = shingles(values, doc, 3, 3)
    assert list(of) == [0, 2, 2] and g[1] == g[2]
    g, of = shingles(values, doc, 4, 3)
    assert list(of) == [0, 2]
    v, d, n = counted(*ngrams(values, doc, 2))
    assert list(d) == [0, 0, 2] and list(n) == [1, 1, 3]


def test_shapes():
    data = np.frombuffer(b"The&&& Abc&& x1 y22", np.uint8)
    w = words(data, np.array([0, len(data)]))
    s = shapes(data, w)
    assert s[0] == s[1] and s[2] == s[3] and s[0] != s[2]
