"""Clusters of vectors around centroids, with a vector-approximation file.

Every vector is kept twice in one written table: in full, and as one small cell number for each component. In a round,
tables of the least and the greatest squared distance between each cell and each centroid's component give, by lookups
and sums, an interval of the distance to each centroid. A centroid whose least distance is beyond another's greatest is
out; full vectors are fetched only of rows where more than one centroid remains. Cells are of
equal width between the least and the greatest value of each component over all vectors. Results do not depend on them.

A round is one scan: tasks add up the components by cluster, so a few rows for each task are shuffled, however unevenly
the vectors fall. The driver sees the centroids only: ``k`` rows.

Odd rows: vectors that are null, of another length, or hold a null or a component that is not finite are left out. Rows
that repeat an id are rows each; equal hashes are ordered by components; a null id is hashed as the empty string. With
fewer than ``k`` vectors each starts a cluster. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import batches_of, quantised

BITS = 6  # of a cell: 64 cells a component


class Cells:
    """Cell bounds of each component: ``marks`` are the least values of the cells after the first; ``least`` and
    ``greatest`` bound the outer cells."""

    def __init__(self, marks: list[list[int]], least: list[int], greatest: list[int]):
        self.marks = [np.array(m, np.int64) for m in marks]
        n = max(map(len, marks), default=0) + 1
        self.low, self.high = np.zeros((len(marks), n), np.int64), np.zeros((len(marks), n), np.int64)
        for d, m in enumerate(self.marks):
            self.low[d], self.high[d] = least[d], greatest[d]
            self.low[d, 1 : len(m) + 1], self.high[d, : len(m)] = m, m - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every component."""
        return np.stack([np.searchsorted(m, x[:, d], "right") for d, m in enumerate(self.marks)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each component's cells to each centroid: components x cells x centroids."""
        c = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - c, c - self.high[:, :, None]
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        return np.maximum(np.maximum(below, above), 0) ** 2, far


def nearest(cells: np.ndarray, fetch, near: np.ndarray, far: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid (of ties the first) of each row of ``cells``, and how many full vectors were fetched.
    ``near`` and ``far`` are lookup tables; ``fetch(rows)`` gives full vectors."""
    least, most = np.zeros((2, len(cells), len(centroids)), np.int64)
    for d in range(cells.shape[1]):
        least += near[d][cells[:, d]]
        most += far[d][cells[:, d]]
    possible = least <= most.min(axis=1)[:, None]
    found = possible.argmax(axis=1)
    rows = np.flatnonzero(possible.sum(axis=1) > 1)
    if len(rows):
        full = fetch(rows)
        distance = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
        for c in range(len(centroids)):
            at = np.flatnonzero(possible[rows, c])
            distance[at, c] = ((full[at] - centroids[c]) ** 2).sum(axis=1)
        found[rows] = distance.argmin(axis=1)
    return found, len(rows)


def _with_cells(cells: Cells, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in batches_of(batches, dim):
            at = cells.of(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in at], pa.binary()), batch.column("components")], ["vec_id", "cells", "components"])

    return run


def _assigned(batch: pa.RecordBatch, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> np.ndarray:
    cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, x.shape[1])
    return nearest(cells, lambda rows: x[rows], *tables, centroids)[0]


def _sums(cells: Cells, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        tables = cells.tables(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch, x in batches_of(batches, dim):
            at = _assigned(batch, x, tables, centroids)
            count += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += x[at == c].sum(axis=0).astype(object)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array([list(map(int, total[c])) for c in some], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _distances(cells: Cells, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch, x in batches_of(batches, centroids.shape[1]):
            at = _assigned(batch, x, tables, centroids)
            distance = ((x - centroids[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cell_bounds(vectors: DataFrame, dim: int, bits: int = BITS) -> Cells:
    """Cells of equal width, ``2**bits`` of them for each component at most."""
    ends = vectors.agg(*(F.struct(F.min(F.col("components")[d]).alias("a"), F.max(F.col("components")[d]).alias("z")).alias(f"c{d}") for d in range(dim))).first()
    least, greatest = [e["a"] for e in ends], [e["z"] for e in ends]
    marks = lambda a, z: {a + -(-(z - a + 1) * i >> bits) for i in range(1, 1 << bits)} - {a}
    return Cells([sorted(marks(a, z)) for a, z in zip(least, greatest, strict=True)], least, greatest)


def centroid_clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, seed: str = "1", bits: int = BITS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of ``dim`` components.

    Centroids start as the vectors with the smallest hashes of seed and id. Each round gives every vector to the
    nearest one (squared Euclidean distance, of ties the smaller number) and moves each that has vectors to the floor of
    their mean; then vectors are given out once more."""
    kept = materialise(quantised(embeddings).where(F.col("dim") == dim).select("vec_id", "components"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("name"), "components").orderBy("name", "components").limit(k).collect()
    if not first:
        return kept.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["components"] for r in first], np.int64)
    cells = cell_bounds(kept, dim, bits)
    kind = kept.schema["vec_id"].dataType.simpleString()
    vectors = materialise(kept.mapInArrow(_with_cells(cells, dim), f"vec_id {kind}, cells binary, components array<bigint>"))
    for _ in range(rounds):
        sums = vectors.select("cells", "components").mapInArrow(_sums(cells, centroids), "cluster int, n bigint, total array<bigint>")
        at = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(dim)]
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *at).collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"t{d}"]) // r["n"] for d in range(dim)]
    given = materialise(vectors.mapInArrow(_distances(cells, centroids), f"vec_id {kind}, cluster int, distance bigint"))
    totals = {r["cluster"]: int(r["s"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    known = [(c, s, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in totals.items()]
    clusters = kept.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return given.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
