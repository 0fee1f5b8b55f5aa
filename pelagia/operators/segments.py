"""Ordered groups in pieces: scans over a group of any size, without a window over all of it.

A group is cut into segments of consecutive positions. Its rows are counted in fine bins of equal width, and bins are
put together until a segment has about ``segment_rows`` rows; a group of fewer rows is one segment. What a scan needs
from outside its segment comes from a table with one row for each segment: the number of rows before it, and the last
row before and the first row after. Rows of one position stay together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a segment, about, and of a group that a job leaves whole.
SEGMENT_ROWS = 2_000_000
#: Fine bins for each segment that a group needs.
BINS = 16


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet each other."""
    named = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)))
    return left.join(named, same, how).drop(*(f"_k{i}" for i in range(len(keys))))


def segmented(rows: DataFrame, keys: Sequence[str], position: Column, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with ``_seg``, which grows with the position (whole numbers, not null) within a group."""
    at = rows.select(*keys, position.cast("bigint").alias("_at"))
    ends = at.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    parts = F.ceil(F.col("_n") / F.lit(segment_rows)).cast("bigint")
    span = F.col("_hi") - F.col("_lo") + 1
    width = F.when(parts > 1, F.greatest(F.lit(1).cast("bigint"), F.ceil(span / (parts * BINS)).cast("bigint"))).otherwise(span)
    groups = ends.select(*keys, "_lo", "_hi", parts.alias("_parts"), width.alias("_width"))
    large = groups.where("_parts > 1")
    counted = _met(at, large, keys).groupBy(*keys, F.expr("(_at - _lo) div _width").alias("_bin")).agg(F.count("*").alias("_m"))
    every = large.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_hi - _lo) div _width"))).alias("_bin"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    filled = _met(every, counted, [*keys, "_bin"], "left").select(*keys, "_bin", F.floor(F.coalesce(F.sum("_m").over(before), F.lit(0)) / F.lit(segment_rows)).cast("int").alias("_s"))
    lists = filled.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_bin", "_s"))), lambda b: b["_s"]).alias("_segs"))
    plan = _met(groups.select(*keys, "_lo", "_width"), lists, keys, "left")
    placed = _met(rows.withColumn("_at", position.cast("bigint")), plan, keys)
    return placed.withColumn("_seg", F.coalesce(F.get("_segs", F.expr("cast((_at - _lo) div _width as int)")), F.lit(0))).drop("_at", "_lo", "_width", "_segs")


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], position: Column | None = None, segment_rows: int | None = None) -> DataFrame:
    """``rows`` with ``_prev`` and ``_next``, structs of the columns of the row before and after (null at the ends), and
    ``_i``, the row's number in its group from 1. Without ``segment_rows`` by one window over each group, else over
    segments of ``position``, the leading number of the order."""
    payload = F.struct(*(F.col(c).alias(c) for c in columns))
    if segment_rows is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("*", F.lag(payload).over(w).alias("_prev"), F.lead(payload).over(w).alias("_next"), F.row_number().over(w).cast("bigint").alias("_i"))
    cut = segmented(rows, keys, position, segment_rows)
    placed = F.struct(*order)
    ends = cut.groupBy(*keys, "_seg").agg(F.count("*").alias("_n"), F.min_by(payload, placed).alias("_first"), F.max_by(payload, placed).alias("_last"))
    by = Window.partitionBy(*keys).orderBy("_seg")
    halo = ends.select(*keys, "_seg", (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.lag("_last").over(by).alias("_p"), F.lead("_first").over(by).alias("_f"))
    w = Window.partitionBy(*keys, "_seg").orderBy(*order)
    met = _met(cut, halo, [*keys, "_seg"])
    out = met.select("*", F.coalesce(F.lag(payload).over(w), F.col("_p")).alias("_prev"), F.coalesce(F.lead(payload).over(w), F.col("_f")).alias("_next"), (F.col("_before") + F.row_number().over(w)).alias("_i"))
    return out.drop("_before", "_p", "_f")


def carried(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of ``neighbours`` with ``_known``, the last value that is not null up to this row, and ``_known_at``, the
    ``_i`` of that row. Over segments the state at the end of each is combined first, then carried into the next."""
    known = F.struct(F.col(value).alias("v"), F.col("_i").alias("i"))
    hit = F.when(F.col(value).isNotNull(), known)
    if "_seg" not in rows.columns:
        w = Window.partitionBy(*keys).orderBy("_i")
        return rows.withColumn("_state", F.last(hit, True).over(w)).select("*", F.col("_state.v").alias("_known"), F.col("_state.i").alias("_known_at")).drop("_state")
    left = rows.groupBy(*keys, "_seg").agg(F.max_by(hit, F.when(hit.isNotNull(), F.col("_i"))).alias("_left"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    enters = left.select(*keys, "_seg", F.last("_left", True).over(before).alias("_enters"))
    w = Window.partitionBy(*keys, "_seg").orderBy("_i")
    met = _met(rows, enters, [*keys, "_seg"]).withColumn("_state", F.coalesce(F.last(hit, True).over(w), F.col("_enters")))
    return met.select("*", F.col("_state.v").alias("_known"), F.col("_state.i").alias("_known_at")).drop("_state", "_enters")


def largest_group(rows: DataFrame, key: str) -> int:
    """Rows of the largest group; 0 for no rows. One aggregation over the key alone."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
