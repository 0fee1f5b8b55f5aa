"""Hashed linear models: follow-the-regularised-leader training on a bounded sample, sparse dot products for scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks

#: bytes and offsets of a block of texts -> hash and text number of each feature, scale of each text's counts
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: a batch's texts -> the texts that are scored
Restore = Callable[[pa.Array], pa.Array]
BUCKETS = 1 << 20
FOLDS = 5
#: Labelled rows of each class that training uses at most, least hash first.
SAMPLE = 3000


@dataclass
class Ftrl:
    """Logistic regression by FTRL-Proximal with per-coordinate rates."""

    buckets: int = BUCKETS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 3

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, float, float]]) -> np.ndarray:
        """examples: feature places, values, label 0 or 1, importance. Weights; the last one is the bias."""
        z, n = np.zeros(self.buckets + 1), np.zeros(self.buckets + 1)

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zi) <= self.l1, 0.0, (np.sign(zi) * self.l1 - zi) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2))

        for _ in range(self.epochs):
            for at, value, label, importance in examples:
                zi, ni = z[at], n[at]
                w = weights(zi, ni)
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
                g = (p - label) * importance * value
                z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha * w
                n[at] = ni + g * g
        return weights(z, n)


def held_out(id_col: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


def _examples(features: Features, restore: Restore | None, buckets: int, damped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = restore(batch.column("text")) if restore else batch.column("text")
            for i, j, data, offsets in blocks(texts):
                hashes, doc, scale = features(data, offsets)
                cell, count = np.unique(doc * buckets + _place(hashes, buckets), return_counts=True)
                count = np.log1p(count) if damped else count
                of = cell // buckets
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((cell % buckets).astype(np.int32), (count * scale[of]).astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("id", "label", "importance")), *lists], ["id", "label", "importance", "at", "value"])

    return run


def train(docs: DataFrame, labels: DataFrame, features: Features, restore: Restore | None = None, model: Ftrl | None = None, sample: int = SAMPLE, damped: bool = False) -> np.ndarray:
    """Weights from ``docs`` (id, text) and ``labels`` (id, label).

    Rows of the held-out fold, null ids and null labels are left out; an id labelled more than once counts once,
    with its greatest label, and with the least of its texts. Training uses ``sample`` rows of each class at most (least id hash first), each
    weighted by its class's size, so the driver and the model see a bounded number of rows. With no labelled rows
    every weight is 0. ``damped``: a feature's value is the logarithm of 1 + its count, else the count; either
    is multiplied by the text's scale."""
    model = model or Ftrl()
    known = labels.select("id", F.col("label").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(docs.select("id").distinct(), "id", "left_semi")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total:
        return np.zeros(model.buckets + 1)
    mean = sum(min(n, sample) for n in total.values()) / sum(total.values())
    chosen = [known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("importance", F.lit(mean * n / min(n, sample))) for label, n in sorted(total.items())]
    picked = chosen[0] if len(chosen) == 1 else chosen[0].union(chosen[1])
    # of rows that repeat an id the least text counts
    texts = docs.join(F.broadcast(picked), "id").groupBy("id", "label", "importance").agg(F.min("text").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = texts.select("id", "label", "importance", "text").mapInArrow(_examples(features, restore, model.buckets, damped), f"id {kind}, label int, importance double, at array<int>, value array<float>")
    got = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").toArrow().combine_chunks()
    examples = []
    for k in range(got.num_rows):
        at, value = (got.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("at", "value"))
        examples.append((np.append(at, model.buckets), np.append(value, 1.0), got.column("label")[k].as_py(), got.column("importance")[k].as_py()))
    return model.fit(examples)


def scored(docs: DataFrame, weights: np.ndarray, features: Features, restore: Restore | None = None, damped: bool = False) -> DataFrame:
    """``id, score`` of every row of ``docs`` (id, text); score is the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = restore(batch.column("text")) if restore else batch.column("text")
            for i, j, data, offsets in blocks(texts):
                hashes, doc, scale = features(data, offsets)
                at = _place(hashes, len(w) - 1)
                weight = w[at]
                if damped:  # counts are needed of the features only that have a weight
                    some = np.flatnonzero(weight)
                    cell, count = np.unique(doc[some] * len(w) + at[some], return_counts=True)
                    doc, weight = cell // len(w), w[cell % len(w)] * np.log1p(count)
                dot = np.bincount(doc, weights=weight, minlength=j - i) * scale + w[-1]
                score = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(score)], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, score double")
