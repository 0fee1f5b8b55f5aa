"""Literal cases of the time-series operators, and the nearest-time join against a search."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from pelagia.operators import asof, frames, imagery, imageset, profiles, quality, schema, timeline
from pelagia.plans import jobs


def track(spark, rows, columns="x double, y double, z double, heading double, pitch double, roll double"):
    """rows: deployment, row number, seconds, then the columns."""
    df = spark.createDataFrame([(d, r, float(s), *v) for d, r, s, *v in rows], f"deployment_id bigint, row_no bigint, s double, {columns}")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s")


def test_track_heading(spark):
    t = track(spark, [(1, 0, 0, 0.0, 0.0, None, None, 0.0, 0.0), (1, 1, 1, 0.0, 0.0, None, None, 0.0, 0.0), (1, 2, 2, 1.0, 0.0, None, None, 0.0, 0.0)])
    assert [r["heading"] for r in timeline.track_heading(t, 45.0).orderBy("row_no").collect()] == [45.0, 90.0, 90.0]


def test_carried_heading_adds_its_offset_again(spark):
    t = track(spark, [(1, i, i, 0.0, 0.0, None, h, 0.0, 0.0) for i, h in enumerate((10.0, None, None))])
    assert [r["heading"] for r in timeline.carried_heading(t, offset=5.0).orderBy("row_no").collect()] == [15.0, 20.0, 25.0]


def test_resample_takes_the_row_before(spark):
    t = track(spark, [(1, i, 10 * i, float(i), 0.0, None, 1.0, float(i + 1), 0.0) for i in range(3)])
    got = timeline.resampled(t, 10).orderBy("ts").collect()
    assert [(r["x"], r["pitch"], r["heading"]) for r in got] == [(0.0, 1.0, None), (1.0, 1.0, None), (2.0, 2.0, None)]
    still = track(spark, [(1, 0, 5, 0.0, 0.0, None, 1.0, 0.0, 0.0)])
    assert timeline.resampled(still, 10).count() == 1


def test_tolerances(spark):
    t = track(spark, [(1, i, s, 0.0, 0.0, None, None, 0.0, 0.0) for i, s in enumerate((0, 0, 10))])
    assert timeline.match_tolerance(t).first()["tolerance_s"] == 2.5
    assert timeline.join_tolerance(t).first()["tolerance_s"] == 5.0


def test_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 1.0, 2.0)] + [("b", 7.0)], "k string, value double")
    a, b = (r.asDict() for r in quality.described(df, ["k"]).orderBy("k").collect())
    assert (a["mode"], a["q1"], a["median"], a["q3"], a["std_dev"]) == (1.0, 1.0, 2.0, 3.0, 1.0)
    assert b["n"] == 1 and b["mean"] is None


def test_footprint(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 0.0)], "x double, y double").select("*", F.lit(0.0).alias("heading"), F.lit(2.0).alias("camera_height"), F.lit(90.0).alias("hfov"), F.lit(90.0).alias("vfov"))
    a, b = imagery.footprints(df).collect()
    assert [round(a[c], 9) for c in ("xMin", "xMax", "yMin", "yMax")] == [-2, 2, -2, 2]
    assert [b[c] for c in ("xMin", "xMax", "yMin", "yMax")] == [0, 0, 0, 0]


def test_nearest_literal(spark):
    samples = track(spark, [(1, 0, 0, *[0.0] * 6), (1, 1, 10, *[0.0] * 6), (1, 2, 10, *[0.0] * 6), (1, 3, 15, *[0.0] * 6)])
    asks = track(spark, [(1, i, s, *[0.0] * 6) for i, s in enumerate((5, 10, 12.5, 99))])
    got = [tuple(r)[1:] for r in asof.nearest_rows(asks, samples).orderBy("row_no").collect()]
    assert got == [(0, 0, -5.0), (1, 1, 0.0), (2, 2, -2.5), (3, 3, -84.0)]
    joined = asof.asof_join(asks, samples, 5.0).orderBy("row_no").collect()
    assert [r["matched"] for r in joined] == [True, True, True, False]


@pytest.mark.parametrize("bucket", [None, 3.0, 17.0])
def test_nearest_against_search(spark, bucket):
    rng = random.Random(5)
    samples = [(d, i, rng.randrange(60), *[0.0] * 6) for d in range(5) for i in range(rng.choice([1, 4, 30]))]
    asks = [(d, i, rng.randrange(70) + rng.choice([0, 0.5]), *[0.0] * 6) for d in range(6) for i in range(25)]
    s, q = track(spark, samples), track(spark, asks)
    got = asof.nearest_rows(q, s) if bucket is None else asof.nearest_rows_bucketed(q, s, bucket)
    got = {(r[0], r[1]): (r[2], r[3]) for r in got.repartition(7).collect()}
    for d, i, t, *_ in asks:
        rows = sorted((x[2], x[1]) for x in samples if x[0] == d)
        at = bisect.bisect_left([r[0] for r in rows], t)
        near = [rows[k] for k in (at - 1, at) if 0 <= k < len(rows)]
        best = min(near, key=lambda r: (abs(r[0] - t), r[0] >= t)) if near else None
        assert got[d, i] == ((best[1], best[0] - t) if best else (None, None))


def test_plans_have_no_single_partition_or_nested_loop(spark):
    t = track(spark, [(1, 0, 0, *[0.0] * 6)])
    for df in (asof.nearest_rows(t, t), timeline.resampled(t, 1.0), timeline.carried_heading(t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_video_row_rounds_half_to_even(spark):
    rows = track(spark, [(1, 0, 0, 1.0, 2.0, None, 3.0, 0.0, 0.0), (1, 1, 1, 1.0, 2.0, None, 3.0, 0.0, 0.0)]).withColumns({"camera_pitch": F.lit(30.0), "camera_roll": F.lit(0.0), "hfov": F.lit(1.0), "vfov": F.lit(1.0), "near_distance": F.lit(1.0), "camera_height": F.lit(1.0), "far_distance": F.col("row_no") + 2.5})
    got = profiles.video_metadata(rows).orderBy("ObjectID").collect()
    assert [r["Sensor Far Distance"] for r in got] == [2, 4] and got[0]["Sensor Relative Elevation Angle"] == -60
    assert len(profiles.video_metadata(rows).columns) == 25


def test_coverage(spark):
    df = lambda a, b: spark.createDataFrame([(1, a, b)], "deployment_id bigint, a bigint, b bigint").select("deployment_id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    assert quality.coverage(df(0, 100), df(50, 200)).first()["coverage_pct"] == 50.0
    none = quality.coverage(df(0, 100), df(100, 200))
    assert none.first()["coverage_pct"] is None and quality.coverage_warnings(none).first()["warning"] == "no overlap"


def test_orientation_prefers_the_photogrammetric_form(spark):
    df = spark.createDataFrame([("1", "2")], "Omega string, Yaw string")
    o = df.select(imageset.orientation(df).alias("o")).first()["o"]
    assert o["convention"] == "omega_phi_kappa" and o["yaw"] is None


def test_rename_plan(spark):
    df = spark.createDataFrame([(1, n) for n in ("Squid_0000000.tif", "x.tif", "a_1.tif", "b_1.tif")], "set_id int, name string")
    got = {r["name"]: (r["new_name"], r["status"]) for r in frames.rename_plan(df, "ROV1").collect()}
    assert got["Squid_0000000.tif"] == ("ROV1_0000000.tif", "renamed") and got["x.tif"][1] == "skipped"
    assert sorted(got[n][1] for n in ("a_1.tif", "b_1.tif")) == ["error", "renamed"]


def test_blank_handle_is_missing(spark):
    items = spark.createDataFrame([(1, "a.tif", {"image-uuid": "u", "image-hash-sha256": "h", "image-handle": ""})], "set_id int, filename string, item map<string,string>")
    heads = spark.createDataFrame([(1, {"image-set-name": "s"})], "set_id int, header map<string,string>")
    assert [r["field"] for r in imageset.item_issues(items, heads).collect()] == ["image-handle"]


def test_names(spark):
    assert schema.resolve(["e_rov_ins", "X "], ["X", "E_ROV_INS"]) == "X "
    assert schema.resolve_lat_lon(["my_lat", "my_lng"]) == ("my_lat", "my_lng")
    with pytest.raises(KeyError):
        schema.resolve_telemetry(["Time"])
    assert schema.sanitised_names(["a b", "a-b", "1x"]) == ["a_b", "a_b_2", "f_1x"]
    good, bad = schema.checked_mappings([("h", "Near Distance"), ("h", "ObjectID"), ("q", "Near Distance")], ["H"], ["Near Distance"])
    assert good == [("H", "Near Distance")] and [b[2] for b in bad] == ["reserved target", "absent source"]


def test_nearest_columns_never_clash(spark):
    columns = "x double, delta_s double, m_x double"
    samples = track(spark, [(1, 0, 0, 7.0, 0.0, 0.0)], columns)
    asks = track(spark, [(1, 0, 1, 1.0, 2.0, 3.0)], columns).withColumn("matched", F.lit("mine"))
    got = asof.asof_join(asks, samples, 5.0)
    assert len(set(got.columns)) == len(got.columns)
    row = got.first()
    assert (row["x"], row["delta_s"], row["m_x"], row["matched"], row["delta_s_2"], row["matched_2"], row["m_x_2"], row["m_delta_s"]) == (1.0, 2.0, 3.0, "mine", -1.0, True, 7.0, 0.0)


def test_combined_table_of_odd_columns(spark):
    first = spark.createDataFrame([(1, 0, "2024-01-01 00:00:00", "a b", " 5 "), (1, 1, "n/a", "-", "6"), (2, 0, "2024-01-01 00:00:00", "c", "nan")], "deployment_id bigint, row_no bigint, Time string, `own name` string, n string")
    second = spark.createDataFrame([(1, k, f"2024-01-01 00:00:{k:02d}", "x" * k, "1e2") for k in (0, 4, 8)], "deployment_id bigint, row_no bigint, UTC string, N string, `own name` string")
    table, names = asof.combined_table(first, second)
    assert table.columns == ["deployment_id", "row_no", "Time", "own_name", "n", "UTC", "N_2", "own_name_2"]
    assert {r["clean"]: r["raw"] for r in names.collect()} == {"Time": "Time", "own_name": "own name", "n": "n", "UTC": "UTC", "N_2": "N_2", "own_name_2": "own name_2"}
    a, b, c = table.orderBy("deployment_id", "row_no").collect()
    assert (a["own_name"], a["n"], a["UTC"], a["own_name_2"]) == ("a b", 5.0, "2024-01-01 00:00:00", 100.0)
    assert (b["own_name"], b["n"], b["UTC"], c["n"], c["UTC"]) == (None, 6.0, None, None, None)
    with pytest.raises(KeyError):
        asof.combined_table(first, second.drop("UTC"))


def test_what_must_be_there(spark):
    with pytest.raises(KeyError, match="x, y, time"):
        schema.resolve_cross_reference(["Depth"], strict=True)
    with pytest.raises(KeyError):
        schema.resolve_telemetry(["Lat", "Time"])
    raw = spark.createDataFrame([(1, 0, "-", "5", "2024-01-01"), (1, 1, "3", "5", "never")], "deployment_id bigint, row_no bigint, X string, Y string, Time string")
    with pytest.raises(ValueError, match="no rows"):
        jobs.telemetry(raw, schema.resolve_telemetry(raw.columns))
