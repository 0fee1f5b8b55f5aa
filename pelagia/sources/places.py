"""Numbers of rows in order of their files, without a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["source_file", "_block"]


def with_places(rows: DataFrame) -> DataFrame:
    """Rows as a file source gives them, with the file, the start of their split and a number that grows within it."""
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))


def numbered(placed: DataFrame, name: str = "row_no", within: Sequence[str] = ("source_file",)) -> DataFrame:
    """Rows of ``with_places`` with their numbers from 0 in order of the file, without gaps. The rows of each split
    are counted; a row's number is that of the rows in earlier splits and of those before it in its own. ``within``
    numbers on over the files of a group, in order of their paths: columns that a file has one value of."""
    keys = [*within, *(c for c in BLOCK if c not in within)]
    counted = placed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_mono").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(*within).orderBy(*BLOCK)) - F.col("_rows")
    starts = counted.select(*keys, "_first", before.alias("_before"))
    return placed.join(starts, keys).select(*placed.columns, (F.col("_before") + F.col("_mono") - F.col("_first")).alias(name))


def numbered_within(placed: DataFrame, within: Sequence[Column], name: str = "row_no") -> DataFrame:
    """S1 for files that hold rows of many groups, one after another or mixed: each group's rows with their numbers from
    0 in order of the files, without gaps; nulls are a group too. A group's rows of one split are ranked in that split,
    so a long group is never sorted as a whole."""
    held = placed.withColumn("_group", F.struct(*within))
    keys = ["_group", *BLOCK]
    counted = held.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_group").orderBy(*BLOCK)) - F.col("_rows")
    starts = counted.select(*keys, before.alias("_before"))
    ranked = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_mono")))
    return ranked.join(starts, keys).select(*placed.columns, (F.col("_before") + F.col("_rank") - 1).alias(name))
