"""Benchmark decontamination by the q-gram lemma.

A region of a document within ``e`` edits of an item of ``m`` characters shares at least ``m - q + 1 - q * e`` of
the item's q-grams with it, and all of them lie within ``e`` diagonals of the region's own. Shared q-grams are
counted in overlapping diagonal bands; bands that meet the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .words import mix, powers

Q = 8
EDIT_RATE = 0.08
#: Characters of items that one pass over the documents holds; more items take more passes.
BLOCK_CHARS = 1_000_000
CHUNK = 1 << 20
#: Hits, and cells of a band's table, that are held at a time.
HITS, CELLS = 1 << 22, 1 << 18
_STRIDE = 16
_PLAIN = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    _low = chr(_c).lower() if not 0xD800 <= _c < 0xE000 else chr(0)
    _PLAIN[_c] = 32 if chr(_c).isspace() else ord(_low) if len(_low) == 1 and ord(_low) < 1 << 16 else _c
_CODE = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77))


def plain(text: str) -> np.ndarray:
    """One code per code point: lower case, white space as a blank, the rest as it is; code points beyond the basic
    plane keep their case."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) and codes.max() >= len(_PLAIN):
        return np.where(codes < len(_PLAIN), _PLAIN[np.minimum(codes, len(_PLAIN) - 1)], codes)
    return _PLAIN[codes]


def _hashed(codes: np.ndarray) -> np.ndarray:
    if len(codes) and codes.max() >= len(_CODE):
        return mix(codes.astype(np.uint64) + np.uint64(77))
    return _CODE[codes]


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at every place, from hashes of 1, 2, 4, ... characters."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    part, width, total, done = _hashed(codes), 1, np.zeros(len(codes) + 1, np.uint64), 0
    while True:
        if q & width:
            n = len(codes) - done - width + 1
            total, done = total[:n] * powers(width + 1)[width] + part[done : done + n], done + width
        if 2 * width > q:
            return mix(total)
        part, width = part[:-width] * powers(width + 1)[width] + part[width:], 2 * width


class Short:
    """The items of one length below q: their different texts by the hash of the whole."""

    def __init__(self, items: list[int], codes: list[np.ndarray]) -> None:
        self.size = len(codes[items[0]])
        same: dict[bytes, list[int]] = {}
        for i in items:
            same.setdefault(np.asarray(codes[i], np.uint32).tobytes(), []).append(i)
        texts = np.array([np.frombuffer(b, np.uint32) for b in same])
        keys = np.array([qgrams(t, self.size)[0] for t in texts], np.uint64)
        order = np.argsort(keys)
        self.key, self.text = keys[order], texts[order]
        self.items = [list(same.values())[k] for k in order]

    def first_places(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """text, item and place (in all texts) of the first occurrence of each item in each text."""
        grams, found = qgrams(codes, self.size), {}
        for begin in range(0, len(grams), CHUNK):
            part = grams[begin : begin + CHUNK]
            slot = np.minimum(np.searchsorted(self.key, part), len(self.key) - 1)
            at = np.flatnonzero(self.key[slot] == part)
            slot, at = slot[at], at + begin
            doc = np.searchsorted(ends, at, "right")
            real = (codes[at[:, None] + np.arange(self.size)] == self.text[slot]).all(axis=1) & (at + self.size < ends[doc])
            pair, first = np.unique(doc[real] * len(self.key) + slot[real], return_index=True)
            for p, a in zip(pair.tolist(), at[real][first].tolist(), strict=True):
                found.setdefault(p, a)
        for p, a in found.items():
            for i in self.items[p % len(self.key)]:
                yield p // len(self.key), i, a


@dataclass
class Items:
    """The benchmark texts of one pass, and where their q-grams stand."""

    ids: list
    codes: list[np.ndarray]
    q: int
    rate: float
    budget: np.ndarray = field(init=False)
    bound: np.ndarray = field(init=False)
    width: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.minimum((size * self.rate).astype(np.int64), np.maximum(0, (size - self.q) // self.q))
        self.bound = size - self.q + 1 - self.q * self.budget
        self.width = 2 * self.budget + 1
        long = [i for i, c in enumerate(self.codes) if len(c) >= self.q]
        self.short = [Short([i for i, c in enumerate(self.codes) if len(c) == n], self.codes) for n in sorted({len(c) for c in self.codes}) if 0 < n < self.q]
        grams = [qgrams(self.codes[i], self.q) for i in long]
        keys = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.key = keys[order]
        self.item = np.repeat(np.array(long, np.int64), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])[order]
        bits = max(12, int(np.ceil(np.log2(len(keys) + 1))) + 4)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.key >> self.shift).astype(np.int64)] = True
        # windows: for items of about one length, so many hits stand in so many places
        group = {i: int(np.log2(len(self.codes[i])) * 4) for i in long}
        self.windows = [(max(len(self.codes[i]) + self.budget[i] for i in of), min(self.bound[i] for i in of)) for of in ([i for i in long if group[i] == g] for g in sorted(set(group.values())))]


def _dense(hit: np.ndarray, items: Items) -> np.ndarray:
    """The hits of windows in which some item's bound can be met."""
    total = np.concatenate([[0], np.cumsum(hit)])
    keep = np.zeros(len(hit) + 1, np.int64)
    start = np.arange(0, len(hit), _STRIDE)
    for width, bound in items.windows:
        end = np.minimum(start + width + _STRIDE, len(hit))
        full = total[end] - total[start] >= bound
        np.add.at(keep, start[full], 1)
        np.add.at(keep, end[full], -1)
    return np.flatnonzero(hit & (np.cumsum(keep)[:-1] > 0))


def _bands(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first diagonal and width of the bands that meet the item's bound; bands in a row are one."""
    grams = qgrams(codes, items.q)
    at = _dense(items.seen[(grams >> items.shift).astype(np.int64)], items)
    low, high = np.searchsorted(items.key, grams[at], "left"), np.searchsorted(items.key, grams[at], "right")
    count = high - low
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) // HITS)) + 1):
        n, begin = count[some], low[some]
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item = items.item[entry]
        diagonal = np.repeat(at[some], n) - items.place[entry] + (1 << 32)
        band = diagonal // items.width[item]
        parts.append(np.unique(np.concatenate([item << 40 | band, item << 40 | (band - 1)]), return_counts=True))
    cell, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    hits = np.bincount(which, weights=np.concatenate([h for _, h in parts]), minlength=len(cell))
    cell = cell[hits >= items.bound[cell >> 40]]
    first = np.flatnonzero(np.diff(cell, prepend=-2) != 1)
    run = np.diff(np.append(first, len(cell)))
    item, band = cell[first] >> 40, cell[first] & ((1 << 40) - 1)
    return item, band * items.width[item] - (1 << 32), (run + 1) * items.width[item]


def aligned(patterns: list[np.ndarray], codes: np.ndarray, first: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, start and end of the best alignment of each candidate's pattern with the text: banded, free ends in
    the text. ``first`` and ``width`` give the band's diagonals, ``low`` and ``high`` bound the document."""
    one = np.int64(1) << np.int64(32)
    size = np.array([len(p) for p in patterns])
    table = np.zeros((len(patterns), int(size.max())), np.uint32)
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = p
    lanes = np.arange(int(width.max()))
    place = first[:, None] + lanes
    cost = np.where(lanes < width[:, None], lanes, one << np.int64(20))  # the first diagonal of a path, in the low half
    for i in range(table.shape[1]):
        at = place + i
        inside = (at >= low[:, None]) & (at < high[:, None])
        same = inside & (codes[np.clip(at, 0, len(codes) - 1)] == table[:, i, None])
        now = cost + np.where(same, 0, one)
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + one)
        now = np.minimum.accumulate(now - lanes * one, axis=1) + lanes * one
        cost = np.where((i < size)[:, None], now, cost)
    best = cost.argmin(axis=1)
    value = cost[np.arange(len(cost)), best]
    return value >> 32, np.clip(first + (value & 0xFFFFFFFF), low, high), np.clip(first + best + size, low, high)


def _matches(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """text, item, edits, start, end of the best region of each item in each text."""
    parts = [plain(t) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = ends - np.array([len(p) + 1 for p in parts])
    codes = np.zeros(int(ends[-1]), np.uint32)
    for p, s in zip(parts, starts, strict=True):
        codes[s : s + len(p)] = p
    item, diagonal, width = _bands(codes, items)
    if len(item):
        size, budget = np.array([len(c) for c in items.codes])[item], items.budget[item]
        # a band may touch several texts where short ones stand side by side: one candidate for each
        doc = np.searchsorted(ends, np.maximum(diagonal, 0), "right")
        count = np.searchsorted(ends, np.minimum(diagonal + width + size, len(codes) - 1), "right") - doc + 1
        doc = np.repeat(doc - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, diagonal, width, size, budget = (np.repeat(x, count) for x in (item, diagonal, width, size, budget))
        fits = ends[doc] - 1 - starts[doc] >= size - budget
        item, diagonal, width, doc, budget, size = item[fits], diagonal[fits], width[fits], doc[fits], budget[fits], size[fits]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        # candidates of about one size together, so many that their bands have CELLS lanes
        order = np.lexsort((size, width))
        item, diagonal, width, doc, budget = item[order], diagonal[order], width[order], doc[order], budget[order]
        k = 0
        while k < len(item):
            part = slice(k, k + max(1, min(256, CELLS // int(width[min(k + 255, len(width) - 1)]))))
            k = part.stop
            i, d, b = item[part], doc[part], budget[part]
            edits, start, end = aligned([items.codes[x] for x in i], codes, diagonal[part], width[part], starts[d], ends[d] - 1)
            for j in np.flatnonzero(edits <= b):
                key, found = (int(d[j]), int(i[j])), (int(edits[j]), int(start[j] - starts[d[j]]), int(end[j] - starts[d[j]]))
                best[key] = min(best.get(key, found), found)
        for (text, i), (edits, start, end) in best.items():
            yield text, i, edits, start, end
    for short in items.short:
        for text, i, at in short.first_places(codes, ends):
            yield text, i, 0, at - int(starts[text]), at - int(starts[text]) + short.size


def _found(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """The matches of a batch, searched in runs of whole texts of about CHUNK characters."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        out += [(i + text, *rest) for text, *rest in _matches(texts[i:j], items)]
        i = j
    return out


def _reporter(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            if found := _found(batch.column("text").to_pylist(), items):
                text, item, *rest = zip(*found, strict=True)
                ids = pa.array([items.ids[k] for k in item], item_type)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text)), ids, *(pa.array(x, pa.int64()) for x in rest)], ["id", "item_id", "edits", "start", "end"])

    return run


def _keeper(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for text, *_ in _found([t or "" for t in batch.column(text_col).to_pylist()], shared.value):
                clean[text] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, q: int, edit_rate: float) -> Iterator:
    """The items, a broadcast of bounded size at a time."""
    kept = benchmark.select(benchmark[item_col].alias("item"), text_of(benchmark, item_text).alias("body")).where("body <> ''").distinct()
    total = kept.agg(F.sum(F.length("body"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_CHARS))
    for block in range(n_blocks):
        rows = kept.where(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == block).orderBy("item", "body").collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Items([r["item"] for r in rows], [plain(r["body"]) for r in rows], q, edit_rate))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, as ``contaminated`` defines it, without a shuffle. All columns stay. Null
    and empty texts hold nothing and stay; rows with a null id and repeated rows are judged each by their text; without
    items all rows stay. An empty table gives an empty table."""
    for shared in _blocks(benchmark, item_col, item_text, q, edit_rate):
        docs = docs.mapInArrow(_keeper(shared, text_col), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """One row per document row and item found in it: id, ``item_id``, ``edits`` and the code points ``start`` and
    ``end`` of the best region (fewest edits, then first).

    An item of m characters is found within ``edit_rate * m`` edits, fewer for items of under about 2q characters
    so that the bound stays above 0; items of under q characters are found unchanged only, empty and null ones never.
    Case and the kind of white space do not count. Null and empty texts hold nothing; a null document id is
    reported as null; repeated rows are reported each; items with a null id are found like others. Other columns
    are not read. Items are held in blocks of bounded size, one pass over the documents each."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    held = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], f"id {kind}, item_id {item_type.simpleString()}, edits bigint, start bigint, end bigint")
    for shared in _blocks(benchmark, item_col, item_text, q, edit_rate):
        out = out.union(held.mapInArrow(_reporter(shared, to_arrow_type(item_type)), out.schema))
    return out.withColumnRenamed("id", id_col)
