"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are refused, so that sums of squares of any usual length fit in a long.
LARGEST = 1 << 28


def quantised(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """``row, vec_id, dim, components``: each component x, as a double, as floor(scale * x). Null vectors and those that
    hold a null or a component that is not finite are left out. ``row`` names the row (vec_id need not) once the frame
    is written."""
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    whole = vectors.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    return whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("components"))


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix of 64-bit integers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)
    if out.size and max(-int(out.min()), int(out.max())) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return out


def batches_of(batches: Iterator[pa.RecordBatch], dim: int, column: str = "components") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch that has rows, with its vectors."""
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(column), dim)
