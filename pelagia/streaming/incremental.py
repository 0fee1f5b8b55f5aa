"""Frames that keep arriving, matched in micro-batches.

Each batch is matched against the telemetry table and appended to the frame table. A frame that is there already
is not matched again, so a batch that is run twice adds nothing; unmatched frames are kept aside and tried again
with every batch, for telemetry may come late. A deployment's start time is fixed when it is first seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelagia.operators.frames import matched_frames
from pelagia.operators.timeline import DEP, start_time


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(path)
        return None if df.isEmpty() else df
    except Exception as error:  # nothing is written yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def match_batch(batch: DataFrame, telemetry: DataFrame, folder: str, batch_id: int, **options) -> None:
    """One micro-batch: ``folder`` holds matched rows, starts and the frames that wait, by batch."""
    spark = batch.sparkSession
    done, starts = _read(spark, f"{folder}/matched"), _read(spark, f"{folder}/starts")
    others = lambda df: df.where(F.col("batch") != batch_id) if df is not None else None
    done, starts = others(done), others(starts)
    waiting = _read(spark, f"{folder}/waiting")
    waiting = waiting.where(F.col("batch") == waiting.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]) if waiting is not None and not waiting.where(F.col("batch") < batch_id).isEmpty() else None
    frames = batch.select(DEP, "row_no", "filename")
    if waiting is not None:
        frames = frames.unionByName(waiting.select(DEP, "row_no", "filename"))
    frames = frames.dropDuplicates([DEP, "filename"])
    fresh = start_time(telemetry)
    if starts is not None:
        fresh = fresh.join(starts.select(DEP), DEP, "left_anti")
    known = fresh if starts is None else fresh.unionByName(starts.select(DEP, "start"))
    earlier = done.drop("batch") if done is not None else None
    table = matched_frames(frames, telemetry, earlier, starts=known, **options)
    write = lambda df, name: df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/{name}")
    write(fresh, "starts")
    write(table.where("Matched"), "matched")
    left = frames.join(table.where("not Matched").select(DEP, F.col("Filename").alias("filename")), [DEP, "filename"], "left_semi")
    write(left, "waiting")


def match_stream(frames: DataFrame, telemetry: DataFrame, folder: str, event_time: str = "arrived", delay: str = "1 hour", **options) -> StreamingQuery:
    """Start the stream: names that repeat within the watermark are dropped before they are matched."""
    once = frames.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([DEP, "filename"])
    return once.writeStream.foreachBatch(lambda df, n: match_batch(df, telemetry, folder, n, **options)).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
