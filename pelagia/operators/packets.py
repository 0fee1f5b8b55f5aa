"""Decoding of key-length-value telemetry packets: the one stage that needs Python, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.functions.klv import FIELDS, KEY, decode_batches

from .quality import described

def packet_rows(packets: DataFrame) -> DataFrame:
    """K1: rows of the packets (video_id, seq, stream, payload) that decode, of each video's first such stream."""
    rows = packets.select("video_id", "seq", "stream", "payload").mapInArrow(decode_batches, "video_id bigint, seq bigint, stream int, time_us bigint, " + ", ".join(f"{f} double" for f in FIELDS))
    first = rows.groupBy("video_id").agg(F.min_by("stream", "seq").alias("_s"))
    return rows.join(first, "video_id").where("stream = _s").drop("_s").withColumn("ts", F.timestamp_micros("time_us"))


def packet_summary(rows: DataFrame) -> DataFrame:
    """K4: packets and the times of the first and last one, in order of the packets."""
    return rows.groupBy("video_id").agg(F.count("*").alias("n_packets"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"))


def packet_statistics(rows: DataFrame, few: int | None = None) -> DataFrame:
    """K4: the statistics of each field; ``few`` as for ``described``."""
    return described(rows.unpivot(["video_id"], list(FIELDS), "field", "value"), ["video_id", "field"], few=few)


__all__ = ["FIELDS", "KEY", "packet_rows", "packet_statistics", "packet_summary"]
