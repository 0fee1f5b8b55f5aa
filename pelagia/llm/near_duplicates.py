"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A signature register holds the shingle whose Poisson process, of a rate that is the shingle's weight, arrives first in
that register: two texts agree in a register with their probability Jaccard similarity. A shingle weighs
1 + ln(occurrences). Links are verified by the plain Jaccard similarity of the shingle sets, so a text that repeats
shingles is also drawn with equal weights; where no shingle repeats, both draws are the same. Bands of registers propose
links, and connected components give the classes. Equal texts are collapsed first by a map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_of
from .similar import bits, linked_classes, members
from .words import blocks, counted, mix, powers, shingles, words

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
_BITS = bits(8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def signatures(values: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash: n_docs x registers, the first arrival's element. In each round every element that can still
    win a register makes its next arrival; an element whose time has passed its document's latest register is done."""
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(values))
    alive = np.arange(len(values))
    turn = 0
    while len(alive):
        turn = (turn + int(_STEP)) % 2**64
        draw = mix(values[alive] + np.uint64(turn))
        time[alive] -= np.log(_uniform(draw)) / weight[alive]
        slot = doc[alive] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        better = time[alive] < first[slot]
        slot, hit = slot[better], alive[better]
        np.minimum.at(first, slot, time[hit])
        won = time[hit] == first[slot]
        owner[slot[won]] = values[hit[won]]
        latest = first.reshape(n_docs, registers).max(axis=1)
        alive = alive[time[alive] < latest[doc[alive]]]
    return owner.reshape(n_docs, registers)


def _weighted(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = words(data, offsets)
    return counted(*shingles(found.hash, found.doc, size, len(offsets) - 1))


def bucket_keys(signature: np.ndarray, bands: int, rows: int) -> list[np.ndarray]:
    """Keys of single bands, then of runs of 2, 4, ... bands up to the whole signature: a coarse bucket
    proposes far relatives, a fine one the closest."""
    keys, width = [], rows
    while True:
        for at in range(0, bands * rows - width + 1, width):
            part = signature[:, at : at + width] * powers(width + 1)[1:]
            keys.append(mix(part.sum(axis=1, dtype=np.uint64) + mix(np.array([len(keys) + 1], np.uint64))).view(np.int64))
        if width * 2 > bands * rows:
            return keys
        width *= 2


def _parities(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x 8 words of 64 bits: bit k is the parity of how many elements hash to k. Two sets differ in at
    least as many elements as their bits differ."""
    place = (mix(values) & np.uint64(511)).astype(np.int64) + doc * 512
    bits = (np.bincount(place, minlength=n_docs * 512) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(n_docs, 512), axis=1).view(np.int64)


def _drawn_keys(values: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, bands: int, rows: int) -> list[np.ndarray]:
    """The bucket keys of each text: of the weighted draw, and of the equal one too where a shingle is repeated."""
    keys = np.stack(bucket_keys(signatures(values, doc, 1.0 + np.log(count), n_docs, bands * rows), bands, rows), axis=1)
    repeats = np.zeros(n_docs, bool)
    repeats[doc[count > 1]] = True
    some = repeats[doc]
    number = np.cumsum(repeats) - 1
    equal = np.stack(bucket_keys(signatures(values[some], number[doc[some]], np.ones(int(some.sum())), int(repeats.sum()), bands * rows), bands, rows), axis=1)
    return [np.concatenate([k, equal[number[i]]]) if repeats[i] else k for i, k in enumerate(keys)]


def _buckets(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for i, j, data, offsets in blocks(texts):
                values, doc, count = _weighted(data, offsets, size)
                sizes = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                keys = _drawn_keys(values, doc, count, j - i, bands, rows)
                ends = np.concatenate([[0], np.cumsum([len(keys[k]) for k in some])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([keys[k] for k in some])))
                parities = _parities(values, doc, j - i)[some]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(pa.array(some)) for c in ("row", "id")), pa.array(sizes[some]), lists, *map(pa.array, parities.T)], ["row", "id", "n", "keys", *_BITS])

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column("text"))
            for i, j, data, offsets in blocks(texts):
                values, doc, _ = _weighted(data, offsets, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["id", "set"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs u, v whose shingle sets have the similarity, verified exactly."""
    held = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    held = held.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return held.where(both >= F.lit(threshold) * (F.size("a") + F.size("b") - both)).select("u", "v")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``given, row, id``: one row per row of ``docs``, with hashes of the row and of its text; ``id, class_id, home``:
    the class of each different text with the least id of its rows, and one row that has it."""
    text = text_of(docs, text_col)
    read = docs.select(docs[id_col].alias("given"), F.xxhash64(docs[id_col], text).alias("row"), F.xxhash64(F.lower(text)).alias("id"), text.alias("text"))
    keyed = materialise(read.drop("text"))
    same = materialise(keyed.groupBy("id").agg(F.min("row").alias("row"), F.min(F.when(F.col("given").isNotNull(), F.struct("given", "row"))).alias("first")))
    texts = read.select("row", "id", "text")
    drawn = texts.mapInArrow(_buckets(size, bands, rows), f"row bigint, id bigint, n bigint, keys array<bigint>, {', '.join(f'{b} bigint' for b in _BITS)}")
    drawn = materialise(drawn.join(same.select("row").hint("merge"), "row", "left_semi").drop("row").dropDuplicates(["id"]))
    member = members(drawn.select("id", F.explode(F.array_distinct("keys")).alias("key")))
    wanted = materialise(member.select("id").distinct())
    facts = materialise(drawn.drop("keys").join(wanted, "id"))
    discard(drawn)
    rows_of = same.select("id", "row").join(wanted, "id").select("row").hint("merge")
    sets = materialise(texts.join(rows_of, "row", "left_semi").select("id", "text").mapInArrow(_shingle_sets(size), "id bigint, set array<bigint>").dropDuplicates(["id"]))
    label = linked_classes(member, facts, lambda pairs: _alike(pairs, sets, threshold), threshold)
    discard(member, wanted, facts, sets)
    placed = same.join(label, "id", "left").select("id", F.coalesce("class", "id").alias("class"), "first")
    least = materialise(placed.groupBy("class").agg(F.min("first").alias("first")))
    return keyed, materialise(placed.select("id", "class").join(least, "class").select("id", F.col("first.given").alias("class_id"), F.col("first.row").alias("home")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: the id and ``class_id``, the least id of its class.

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles (lower case) is at
    least ``threshold``; texts equal in lower case are linked always. A class is a connected component.
    Null and empty texts count as equal texts. A text of fewer words than ``size`` has one shingle of all of
    them. Rows with a null id take part by their text only; where no row of a class has an id its ``class_id`` is
    null. Rows that repeat an id are classed each by its own text. Other columns are not read. An empty table gives an
    empty table."""
    keyed, classes = _classes(docs, id_col, text_col, size, threshold, bands, rows)
    return keyed.select("given", "id").join(classes.select("id", "class_id").hint("merge"), "id", "left").select(F.col("given").alias(id_col), "class_id")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each class, as ``near_duplicate_classes`` defines it: the one of the least id, and
    of rows that repeat that id with other texts one of the class's. Rows without an id all stay, as nothing tells them
    apart."""
    _, classes = _classes(docs, id_col, text_col, size, threshold, bands, rows)
    kept = classes.select(F.col("home").alias("row")).where("row is not null").distinct().hint("merge")
    held = docs.where(docs[id_col].isNotNull()).select(F.struct(*(docs[c] for c in docs.columns)).alias("held"), F.xxhash64(docs[id_col], text_of(docs, text_col)).alias("row"))
    return held.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("held.*").union(docs.where(docs[id_col].isNull()))
