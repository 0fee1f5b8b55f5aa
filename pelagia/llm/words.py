"""Vectorised word hashing over Arrow text batches, used inside Spark's Arrow stages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)
    return _POWER[:n]


class Words(NamedTuple):
    """start, end: byte places; doc: number of the text within the block; hash: of the word's bytes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes: first text, end, bytes, offsets.
    A longer text is a block of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _hash_runs(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of 64-bit values; runs are in order and may have gaps."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    taken = values[np.repeat(start, length) + place] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(taken, np.cumsum(length) - length) + length.astype(np.uint64) * _GOLDEN)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of a block: maximal runs without white space within one text."""
    space = _IS_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = True, space
    before[offsets[:-1]] = True
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = space, True
    after[offsets[1:]] = True
    start = np.flatnonzero(~space & before[:-1])
    end = np.flatnonzero(~space & after[1:]) + 1
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1, _hash_runs(_BYTE[data], start, end - start))


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("x")
_SHAPE[ord("A") : ord("Z") + 1] = ord("X")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_SHAPE[128:] = ord("x")


def shapes(data: np.ndarray, found: Words) -> np.ndarray:
    """Hash of each word's shape: letters, capitals and digits as classes, other characters as they are,
    equal neighbours once (``The&&&`` is ``Xx&``)."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    length = found.end - found.start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(found.start, length)
    kind = _SHAPE[data[place]]
    keep = np.empty(len(kind), bool)
    keep[0], keep[1:] = True, kind[1:] != kind[:-1]
    keep[first] = True
    count = np.add.reduceat(keep, first, dtype=np.int64)
    return _hash_runs(_BYTE[kind[keep]], np.cumsum(count) - count, count)


def ngrams(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of n words of one text."""
    if n == 1:
        return values, doc
    if len(values) < n:
        return values[:0], doc[:0]
    inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
    total = np.zeros(len(values) - n + 1, np.uint64)
    for i, power in enumerate(powers(n + 1)[1:]):
        total += values[i : len(values) - n + 1 + i] * power
    return mix(total)[inside], doc[: len(doc) - n + 1][inside]


def shingles(values: np.ndarray, doc: np.ndarray, size: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles; a text of fewer words than ``size``, but at least one, has one shingle of all of them.
    Ordered by text."""
    grams, of = ngrams(values, doc, size)
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        grams = np.concatenate([grams, _hash_runs(values, first, count[short])])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    return grams, of


def counted(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) with their counts, ordered by text, then value."""
    if not len(values):
        return values, doc, np.zeros(0, np.int64)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.empty(len(values), bool)
    new[0], new[1:] = True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return values[first], doc[first], np.diff(np.append(first, len(values)))
