"""Packets with damage, files and documents, and the incremental form."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions.klv import KEY, decoded, decoded_batch
from pelagia.operators import packets
from pelagia.plans import jobs
from pelagia.sources import tables
from pelagia.streaming import incremental


def packet(time=1_000_000, body=b""):
    inner = (b"\x02\x08" + time.to_bytes(8, "big") if time is not None else b"") + body
    return KEY + bytes([len(inner)]) + inner


def test_damaged_packets():
    assert decoded(packet(body=b"\x05\x02\xff\xff"))[:2] == (1_000_000, 360.0)
    assert decoded(b"x" * 30) is None and decoded(packet()[:-3]) is None and decoded(packet(time=None, body=b"\x05\x02\x00\x00")) is None
    assert decoded(packet(body=b"\x0d\x04\x7f\xff\xff\xff"))[5] == 90.0
    long = KEY + b"\x81\x0a\x02\x08" + (5).to_bytes(8, "big")
    assert decoded(long)[0] == 5 and decoded(None) is None and decoded(b"") is None


def test_batches_of_packets_like_single_ones():
    rng = random.Random(1)
    made = []
    for _ in range(400):
        body = b"".join(bytes([tag, n]) + rng.randbytes(n) for tag, n in ((rng.choice([5, 6, 7, 13, 14, 15, 99]), rng.choice([0, 1, 2, 4, 8])) for _ in range(rng.randrange(5))))
        p = packet(rng.choice([None, rng.randrange(2**60)]), body)
        made.append(rng.choice([p, p, p, p[: rng.randrange(len(p) + 1)], b"", rng.randbytes(len(p)), p[:-1] + rng.randbytes(1), KEY + b"\x81" + p[16:], packet(5, b"\x81\x05\x01x"), packet(5, b"\x05\x09123456789")]))
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in made])])
    some, time, values = decoded_batch(np.frombuffer(b"".join(made), np.uint8), offsets)
    expected = {k: d for k, p in enumerate(made) if (d := decoded(p))}
    assert list(some) == list(expected) and len(expected) > 50
    for k, t, v in zip(some, time, values.T, strict=True):
        assert t == expected[k][0] and list(v) == pytest.approx([np.nan if x is None else x for x in expected[k][1:]], rel=1e-12, nan_ok=True)


def test_first_stream_counts(spark):
    rows = [(1, 0, 1, b"bad"), (1, 1, 2, packet(7)), (1, 2, 1, packet(8)), (1, 3, 2, packet(9))]
    df = spark.createDataFrame([(v, s, t, bytearray(p)) for v, s, t, p in rows], "video_id bigint, seq bigint, stream int, payload binary")
    got = packets.packet_rows(df)
    assert sorted(r["time_us"] for r in got.collect()) == [7, 9]
    assert packets.packet_summary(got).first()["n_packets"] == 2


def test_documents_of_both_forms(spark):
    new = json.dumps({"image-set-items": {"a.tif": {"image-uuid": "1"}, "b.tif": {"image-uuid": "2"}}})
    old = json.dumps({"image-set-items": [{"$filename": "b.tif", "image-uuid": "9"}, {"$filename": "c.tif", "image-uuid": "3"}]})
    df = spark.createDataFrame([("s", 1, new), ("s", 2, old), ("t", 1, "{}")], "set_id string, source_no int, document string")
    assert {r["filename"]: r["item"]["image-uuid"] for r in tables.document_items(df).collect()} == {"a.tif": "1", "b.tif": "2", "c.tif": "3"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.tif").write_bytes(b"abc")
    (tmp_path / "in/y.txt").write_bytes(b"no")
    (tmp_path / "log.csv").write_text("﻿ Time ,X\n1,2\n3,4\n")
    assert [r["filename"] for r in tables.list_images(spark, str(tmp_path / "in")).collect()] == ["x.tif"]
    assert tables.file_hashes(spark, str(tmp_path / "in")).first()["sha256"].startswith("ba7816bf")
    log = tables.read_log(spark, str(tmp_path / "log.csv"))
    assert log.columns == ["Time", "X", "source_file", "row_no"] and [r["X"] for r in log.orderBy("row_no").collect()] == ["2", "4"]
    tables.write_table(log.select("X", "Time"), str(tmp_path / "out"), ["Time", "X"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["Time", "X"]


def test_table_pairs(spark):
    f = spark.createDataFrame([("1", "Dive12_frames"), ("2", "z"), ("3", "z")], "folder string, name string")
    c = spark.createDataFrame([("1", "Dive1_cam"), ("1", "dive12_cam"), ("2", "other")], "folder string, name string")
    assert {r["folder"]: r["camera_table"] for r in tables.table_pairs(f, c).collect()} == {"1": "dive12_cam", "2": "other", "3": None}


def _telemetry(spark, seconds):
    return spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(seconds)], "deployment_id bigint, row_no bigint, s double").select("deployment_id", "row_no", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))


def _frames(spark, names):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "deployment_id bigint, row_no bigint, filename string")


def test_batches_replay_and_retry(spark, tmp_path):
    folder = str(tmp_path / "r1")
    first = _frames(spark, ["a_1000.tif", "a_90000.tif", "still.tif"])
    for _ in range(2):
        incremental.match_batch(first, _telemetry(spark, [0, 1, 2]), folder, 0, tolerance_s=0.5)
    assert [r["Filename"] for r in spark.read.parquet(f"{folder}/matched").collect()] == ["a_1000.tif"]
    incremental.match_batch(_frames(spark, ["a_2000.tif", "a_1000.tif"]), _telemetry(spark, [0, 1, 2, 90]), folder, 1, tolerance_s=0.5)
    done = spark.read.parquet(f"{folder}/matched")
    assert sorted(r["Filename"] for r in done.collect()) == ["a_1000.tif", "a_2000.tif", "a_90000.tif"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    _frames(spark, ["a_0.tif", "a_1000.tif", "a_1000.tif"]).withColumn("arrived", F.timestamp_seconds(F.lit(10))).write.parquet(src)
    stream = spark.readStream.schema("deployment_id bigint, row_no bigint, filename string, arrived timestamp").parquet(src)
    incremental.match_stream(stream, _telemetry(spark, [0, 1]), str(tmp_path / "out"), tolerance_s=0.5).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/matched")).count() == 2


def test_incremental_ids(spark):
    t = _telemetry(spark, [0, 1, 2])
    first = jobs.cross_reference(_frames(spark, ["a_0.tif"]), t, tolerance_s=0.5)
    both = jobs.cross_reference(_frames(spark, ["a_0.tif", "a_1000.tif", "x.tif"]), t, first, tolerance_s=0.5)
    assert {r["Filename"]: (r["ObjectID"], r["Matched"]) for r in both.collect()} == {"a_0.tif": (1, True), "a_1000.tif": (2, True), "x.tif": (3, False)}
