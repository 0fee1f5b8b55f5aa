"""Document quality by hashed word n-gram logistic regression trained with FTRL updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .linear import SAMPLE, Ftrl, held_out, scored, train
from .words import mix, ngrams, shapes, words

THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one and two words and of one to three word shapes; counts are divided by the text's words."""
    found = words(data, offsets)
    parts = []
    for k, (values, longest) in enumerate(((found.hash, 2), (shapes(data, found), 3))):
        for n in range(1, longest + 1):
            hashes, doc = ngrams(values, found.doc, n)
            parts.append((mix(hashes + np.uint64(10 * k + n)), doc))
    count = np.bincount(found.doc, minlength=len(offsets) - 1)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), 10.0 / np.maximum(count, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    Only the text is an input of the score. Null and empty texts get the score of the bias alone; a null id
    counts as not held out; repeated rows get equal rows; other columns are not read; without labels every
    score is 0.5. An empty table gives an empty table."""
    held = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    weights = train(held, labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")), features, model=Ftrl(), sample=sample)
    return scored(held, weights, features).select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
