"""Exact search of the highest inner products by bit-sliced indexes.

The index: rows fall into blocks of about ``BLOCK`` by a hash. A block holds, for each component and binary place, a
bitmap of the rows that have that bit (components are shifted to be non-negative). A query's score is the sum of slices,
each shifted by the places of the query's own bits: the sums are made for all rows of a block at once by carry-save
addition of bitmaps, where a negative factor takes the complement. What comes out is the score itself as slices. Rows
are then selected from the most significant slice down: those above every row still undecided are in, and the rows of
the boundary, which agree in all slices and so have one score, are resolved by their ids. No score is rounded.

Every query meets every block: queries are split into groups, and each cell of blocks and groups is one task's input of
bounded size. A cell returns ``k`` rows for each query; Spark keeps the best of those.

Odd rows: null vectors, and those that hold a null or a component that is not finite, take no part. Vectors meet those
of the same number of components only. Rows that repeat an id are rows each, as queries and as candidates. A null id is
no query; as a candidate it comes after all ids of the same score. An empty table, or one without queries, gives no
rows. Inner products that leave a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrix, quantised

BLOCK = 32768  # rows of a block, about
GROUP = 4096  # queries of a group at most, about
CELLS = 48  # cells at least, where there are queries enough
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps of a block's components, least place first, as (components, places, words), and the shift. Bit i of a
    bitmap stands for row i."""
    shift = int(x.min()) if x.size else 0
    u = (x - shift).astype(np.uint64)
    places = int(u.max()).bit_length() if u.size else 0
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], places, words * 8), np.uint8)
    for b in range(places):
        packed = np.packbits((u.T >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64), shift


def score_slices(slices: np.ndarray, complements: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """The slices, least first, of the sum over components of |factor| times the component, or times its complement
    where the factor is negative. ``slices`` and ``complements`` are as in ``slices_of``."""
    places, words = slices.shape[1:]
    flat, turned = slices.reshape(-1, words), complements.reshape(-1, words)
    size, negative = np.abs(query).astype(np.uint64), query < 0
    digits = int(size.max()).bit_length() if size.size else 0
    has = (size[:, None] >> np.arange(digits, dtype=np.uint64)) & np.uint64(1) == 1
    out: list[np.ndarray] = []
    carry = np.zeros((0, words), np.uint64)
    p = 0
    while p < places + digits - 1 or len(carry):
        pending = [carry]
        for b in range(max(0, p - digits + 1), min(places, p + 1)):
            at = np.flatnonzero(has[:, p - b])
            plus, minus = at[~negative[at]], at[negative[at]]
            pending += [flat[plus * places + b], turned[minus * places + b]]
        x = np.concatenate(pending)
        carries = []
        while len(x) >= 3:  # three bitmaps of this place become one, and one of the next
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            x = np.concatenate([ab ^ c, x[3 * m :]])
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        carry = np.concatenate(carries) if carries else carry[:0]
        p += 1
    return out


def highest(score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of bitmap ``among`` with the highest scores, in no order; of equal scores the first places."""
    sure, open_ = np.zeros_like(among), among.copy()
    for s in reversed(score):
        taken = sure | (open_ & s)
        n = int(np.bitwise_count(taken).sum())
        if n > k:
            open_ &= s
        else:
            sure = taken
            if n == k:
                return _places(sure)
            open_ &= ~s
    above = _places(sure)
    return np.concatenate([above, _places(open_)[: k - len(above)]])


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _values(score: list[np.ndarray], at: np.ndarray) -> list[int]:
    """The numbers that the slices hold at some places."""
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    total = np.zeros(len(at), object)
    for p, s in enumerate(score):
        total += ((s[word] >> bit) & np.uint64(1)).astype(object) << p
    return [int(v) for v in total]


_INDEX = "dim int, block int, n int, places int, shift bigint, slices binary, ids array<bigint>, rows array<bigint>"


def _indexed(key: tuple, table: pa.Table) -> pa.Table:
    """One block: rows in order of their ids, so that the first places of a boundary are the smallest ids."""
    dim = key[0].as_py()
    order = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last
    slices, shift = slices_of(matrix(order["components"], dim))
    one = lambda v, kind: pa.array([v], kind)
    return pa.table({
        "dim": one(dim, pa.int32()), "block": one(key[1].as_py(), pa.int32()), "n": one(order.num_rows, pa.int32()), "places": one(slices.shape[1], pa.int32()), "shift": one(shift, pa.int64()),
        "slices": one(slices.tobytes(), pa.binary()), "ids": one(order["vec_id"].to_pylist(), pa.list_(pa.int64())), "rows": one(order["row"].to_pylist(), pa.list_(pa.int64())),
    })


def _searched(k: int):
    names = ["query_row", "query_id", "vec_id", "row", "score"]

    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in names]
        if index.num_rows and queries.num_rows:
            dim = key[0].as_py()
            block = {c: index[c][0].as_py() for c in ("n", "places", "shift", "slices")}
            ids, rows = index["ids"][0].as_py(), index["rows"][0].as_py()
            words = -(-block["n"] // 64)
            slices = np.frombuffer(block["slices"], np.uint64).reshape(dim, block["places"], words)
            complements = ~slices
            every = np.packbits(np.arange(words * 64) < block["n"], bitorder="little").view(np.uint64)
            place_of = {r: i for i, r in enumerate(rows)}
            for row, query_id, q in zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), matrix(queries["components"], dim), strict=True):
                among, own = every.copy(), place_of.get(row)
                if own is not None:
                    among[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                score = score_slices(slices, complements, q)
                at = highest(score, among, k)
                base = block["shift"] * int(q.sum()) + int(q[q < 0].sum()) * ((1 << block["places"]) - 1)
                for place, value in zip(at.tolist(), _values(score, at), strict=True):
                    for column, v in zip(found, (row, query_id, ids[place], rows[place], value + base), strict=True):
                        column.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in found], names)

    return run


def highest_products(embeddings: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, group: int = GROUP, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the k other rows with the
    highest inner products of quantised components; ties go to the smaller id. The sizes change no result."""
    rows = materialise(quantised(embeddings))
    asked = rows.where((F.col("vec_id") % every) == 0)
    n, n_asked = rows.count(), asked.count()
    n_blocks = max(1, -(-n // block))
    n_groups = max(1, -(-n_asked // group), min(-(-n_asked // 64), -(-cells // n_blocks)))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    index = materialise(keyed.groupBy("dim", "block").applyInArrow(_indexed, _INDEX))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_groups)).cast("int")
    queries = asked.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    cell = ["dim", "block", "part"]
    near = copies.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_searched(k), "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
