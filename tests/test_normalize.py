"""Literal cases of the scalar expressions."""

import posixpath

import pytest
from pyspark.sql import functions as F

from pelagia.functions import normalize as n


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_null_like_and_numbers(spark):
    assert values(spark, n.to_number, " N/A ", "nan", "-", "1d", " 5 ", "1e3", "1_000", ".5", None) == [None, None, None, None, 5.0, 1000.0, 1000.0, 0.5, None]
    assert values(spark, n.is_null_like, "Unknown", "", "x", None) == [True, True, False, True]


def test_join_keys(spark):
    assert values(spark, n.join_key, "1", "1.0", " 1 ", "1.7", "CamA", "n/a") == ["1", "1", "1", "1", "cama", None]


def test_epochs(spark):
    us = lambda c: F.unix_micros(n.epoch_time(c))
    assert values(spark, us, "100000000000000", "100000000000001", "100000000001", "20240101", "x") == [100000000000000000, 100000000000001, 100000000001000, 20240101000000, None]


def test_any_time(spark):
    shown = lambda c: F.date_format(n.any_time(c), "yyyy-MM-dd HH:mm:ss")
    got = values(spark, shown, "01.09.2022 00:00:00", "1/9/2022 1:28:32 AM", "20:15", "20220109T012832", "2022-01-09T01:28:32Z", "2022-01-09 03:28:32+02:00", "2022/01/09 01:28:32", "01-09-2022 01:28:32", "99/99/2022")
    assert got == ["2022-09-01 00:00:00", "2022-01-09 01:28:32", None, "2022-01-09 01:28:32", "2022-01-09 01:28:32", "2022-01-09 01:28:32", "2022-01-09 01:28:32", "2022-01-09 01:28:32", None]


def test_elapsed(spark):
    assert values(spark, n.elapsed_milliseconds, "a_1767.tif", "a_323456.JPG", "a.tif") == [1767, 323456, None]


@pytest.mark.parametrize(("x", "y", "expected"), [(0, 1, 0), (1, 0, 90), (-1, 0, 270), (0, 0, None), (0, -1, 180)])
def test_bearing(spark, x, y, expected):
    zero = F.lit(0.0)
    got = spark.range(1).select(n.bearing(zero, zero, F.lit(float(x)), F.lit(float(y))).alias("b")).first()["b"]
    assert got == (None if expected is None else pytest.approx(expected))


def test_projection_round_trip_and_rejects(spark):
    df = spark.createDataFrame([(10.0, 50.0), (200.0, 0.0), (None, 1.0)], "x double, y double")
    rows = df.select(n.project(F.col("x"), F.col("y"), 4326, 3857).alias("p")).select("p.*").collect()
    assert rows[0]["x"] == pytest.approx(1113194.9079)
    assert rows[1]["reject_reason"] and rows[2]["x"] is None and rows[2]["reject_reason"] is None
    back = spark.createDataFrame([(rows[0]["x"], rows[0]["y"])], "x double, y double").select(n.project(F.col("x"), F.col("y"), 3857, 4326).alias("p")).first()["p"]
    assert (back["x"], back["y"]) == (pytest.approx(10.0), pytest.approx(50.0))


def test_path_keys_like_normal_paths(spark):
    paths = ["./a.tif", "a.tif", "../x/../a", "../../a", "/../a", "/a/../../b", "a/b/c/d/e/../../../../../../f", "a//b/./c/", ".", "", "x/..", "/", "C:\\d\\..\\e"]
    assert values(spark, n.path_key, *paths) == [posixpath.normpath(p.replace("\\", "/").lower()) for p in paths]


def test_paths_and_srs(spark):
    assert values(spark, n.path_key, "A\\b\\..\\C.TIF", "a/./b//c") == ["a/c.tif", "a/b/c"]
    assert values(spark, lambda c: n.srs_part(c, 2), "3857; 3855", "3857", "3857;") == ["3855", None, None]
