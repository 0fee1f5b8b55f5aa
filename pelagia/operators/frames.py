"""Frames extracted from video: matching to telemetry, cameras, incremental tables, renaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.normalize import basename, elapsed_milliseconds, join_key, path_key, project, to_number

from .asof import asof_join
from .timeline import DEP, match_tolerance, start_time

# Fixed value: base, numbered ending and extension of a frame's name.
FRAME_PATTERN = r"^(.+?)(_\d+)(\.[A-Za-z0-9]+)$"
# Telemetry column -> column of the frame table that a match fills.
MATCHED = {
    "heading": "CameraHeading", "pitch": "CameraPitch", "roll": "CameraRoll", "hfov": "HorizontalFieldOfView", "vfov": "VerticalFieldOfView",
    "near_distance": "NearDistance", "far_distance": "FarDistance", "camera_height": "CameraHeight", "sensor_azimuth": "SensorRelativeAzimuthAngle",
    "sensor_elevation": "SensorRelativeElevationAngle", "sensor_roll": "SensorRelativeRollAngle",
}


def frame_times(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """Each frame's elapsed milliseconds and absolute time; null where the name has none."""
    timed = frames.join(starts, DEP, "left").withColumn("elapsed_ms", elapsed_milliseconds(F.col("filename")))
    return timed.withColumn("ts", F.timestamp_micros(F.unix_micros("start") + F.col("elapsed_ms") * 1000)).drop("start")


def new_frames(frames: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Frames whose name is not in the earlier table."""
    return frames if earlier is None else frames.join(earlier.select(DEP, F.col("Filename").alias("filename")).distinct(), [DEP, "filename"], "left_anti")


def next_ids(earlier: DataFrame) -> DataFrame:
    """The first free object id of each deployment: greatest id + 1, or rows + 1 where no id is a number."""
    return earlier.groupBy(DEP).agg((F.coalesce(F.max("ObjectID"), F.count("*")) + 1).alias("next_id"))


def matched_frames(frames: DataFrame, telemetry: DataFrame, earlier: DataFrame | None = None, tolerance_s: float | None = None, camera_id: int = 1, crs: int = 4326, starts: DataFrame | None = None, segment_rows: int | None = None) -> DataFrame:
    """P23 over J6, N12, A7, A4 and J1: the 27-column frame table of the new frames. A frame without a match, or
    without a time in its name, keeps id, path, name, camera, elapsed time and difference, and ``Matched`` false.
    ``segment_rows`` cuts long deployments as in ``asof_join``."""
    new = new_frames(frames, earlier)
    timed = frame_times(new, starts if starts is not None else start_time(telemetry))
    near = asof_join(timed, telemetry, tolerance_s if tolerance_s is not None else match_tolerance(telemetry, segment_rows), segment_rows=segment_rows)
    first = next_ids(earlier) if earlier is not None else None
    near = near.join(first, DEP, "left") if first is not None else near.withColumn("next_id", F.lit(None).cast("bigint"))
    w = Window.partitionBy(DEP).orderBy("filename", "row_no")
    near = near.withColumn("_id", F.row_number().over(w) - 1 + F.coalesce("next_id", F.lit(1)))
    return frame_rows(near, camera_id, crs)


def frame_rows(near: DataFrame, camera_id: int = 1, crs: int = 4326, others: Sequence[str] = ()) -> DataFrame:
    """The frame table of frames with their nearest telemetry: ``_id``, filename, maybe path, ts, elapsed_ms,
    delta_s, matched, and the telemetry's columns after ``m_``; ``others`` are kept."""
    near = near.withColumn("_p", project(F.col("m_x"), F.col("m_y"), 4326, crs))
    hit = lambda c: F.when(F.col("matched"), c)
    has = lambda c: F.col(f"m_{c}").cast("double") if f"m_{c}" in near.columns else F.lit(None).cast("double")
    path = F.col("path") if "path" in near.columns else F.col("filename")
    return near.select(
        DEP, F.col("_id").cast("bigint").alias("ObjectID"), path.alias("Raster"), F.col("filename").alias("Filename"),
        hit(F.unix_micros("ts")).alias("Precision Time Stamp"), hit(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("AcquisitionDate"),
        hit(F.col("m_x")).alias("Platform Longitude"), hit(F.col("m_y")).alias("Platform Latitude"), hit(F.col("m_z")).alias("Sensor Altitude"),
        hit(F.col("_p.x")).alias("PerspectiveX"), hit(F.col("_p.y")).alias("PerspectiveY"), hit(F.col("m_z")).alias("PerspectiveZ"), hit(F.lit(crs)).alias("SRS"),
        F.lit(camera_id).alias("CameraID"), *(hit(has(c)).alias(name) for c, name in MATCHED.items()),
        F.col("elapsed_ms").alias("ElapsedMilliseconds"), F.col("delta_s").alias("MatchTimeDeltaSeconds"), F.col("matched").alias("Matched"), *others,
    )


def matched_source_rows(frames: DataFrame, telemetry: DataFrame, tolerance_s: float | None = None, segment_rows: int | None = None) -> DataFrame:
    """The telemetry's own rows and columns, one for each frame that matches."""
    timed = frame_times(frames, start_time(telemetry)).select(DEP, "row_no", "ts").where("ts is not null")
    near = asof_join(timed, telemetry, tolerance_s if tolerance_s is not None else match_tolerance(telemetry, segment_rows), segment_rows=segment_rows)
    return near.where("matched").select(DEP, *(F.col(f"m_{c}").alias(c) for c in telemetry.columns if c != DEP))


def appended(earlier: DataFrame | None, new: DataFrame) -> DataFrame:
    """O2/O3: earlier rows and new ones; columns that only one side has are null in the other."""
    return new if earlier is None else earlier.unionByName(new, allowMissingColumns=True)


def run_totals(table: DataFrame, n_before: DataFrame | None = None) -> DataFrame:
    """Frames matched, unmatched, without a time, and done before."""
    totals = table.groupBy(DEP).agg(F.count_if("Matched").alias("matched"), F.count_if(~F.col("Matched") & F.col("ElapsedMilliseconds").isNotNull()).alias("unmatched"), F.count_if(F.col("ElapsedMilliseconds").isNull()).alias("no_time"))
    return totals if n_before is None else totals.join(n_before, DEP, "full").fillna(0)


def camera_join(frames: DataFrame, cameras: DataFrame, key: str = "camera_id") -> DataFrame:
    """Frames with ``Frame_`` and ``Camera_`` columns, by normalised camera id; the last row of a camera counts."""
    last = cameras.withColumn("_k", join_key(F.col(key))).where("_k is not null").groupBy("_k").agg(F.max_by(F.struct(*cameras.columns), "row_no").alias("c"))
    side = last.select("_k", *(F.col(f"c.{n}").alias(f"Camera_{n}") for n in cameras.columns))
    left = frames.select(join_key(F.col(key)).alias("_k"), *(F.col(n).alias(f"Frame_{n}") for n in frames.columns))
    return left.join(side, "_k", "left").drop("_k")


def camera_table(rows: DataFrame, columns: dict[str, str], defaults: dict[str, float]) -> DataFrame:
    """A10: for each output name the first numeric value in row order, else the default; 0 counts."""
    def first(source: str):
        n = to_number(F.col(source))
        return F.min_by(n, F.when(n.isNotNull(), F.col("row_no")))

    return rows.groupBy(DEP).agg(*(F.coalesce(first(source), F.lit(defaults.get(name)).cast("double")).alias(name) for name, source in columns.items()))


def existing_images(frames: DataFrame, inventory: DataFrame, path_col: str = "path") -> DataFrame:
    """frames with ``image_found``: by base name within the set, else by whole path."""
    names = inventory.select("set_id", F.lower(basename(F.col("path"))).alias("_n")).distinct().withColumn("_a", F.lit(True))
    paths = inventory.select(path_key(F.col("path")).alias("_p")).distinct().withColumn("_b", F.lit(True))
    keyed = frames.withColumns({"_n": F.lower(basename(F.col(path_col))), "_p": path_key(F.col(path_col))})
    return keyed.join(names, ["set_id", "_n"], "left").join(paths, "_p", "left").withColumn("image_found", F.coalesce("_a", "_b", F.lit(False))).drop("_n", "_p", "_a", "_b")


def rename_plan(files: DataFrame, base: str) -> DataFrame:
    """``status`` and ``new_name`` of each file (set_id, name): the numbered ending stays, the base changes."""
    stem, suffix, ext = (F.regexp_extract("name", FRAME_PATTERN, i) for i in (1, 2, 3))
    planned = files.withColumn("new_name", F.when(stem != "", F.concat(F.lit(base), suffix, ext)))
    taken = files.select("set_id", F.lower("name").alias("_t")).distinct().withColumn("_there", F.lit(True))
    w = Window.partitionBy("set_id", F.lower("new_name")).orderBy("name")
    joined = planned.withColumn("_t", F.lower("new_name")).join(taken, ["set_id", "_t"], "left").withColumn("_n", F.row_number().over(w))
    status = F.when(F.col("new_name").isNull(), "skipped").when(F.col("new_name") == F.col("name"), "unchanged").when(F.col("_there") | (F.col("_n") > 1), "error").otherwise("renamed")
    return joined.select("set_id", "name", "new_name", status.alias("status"))


def rewritten_paths(rows: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """Image paths moved to ``folder``; a bare name stays bare."""
    new = lambda c: F.when(F.instr(F.regexp_replace(c, r"\\", "/"), "/") > 0, F.concat(F.lit(f"{folder}/"), basename(F.col(c)))).otherwise(F.col(c))
    return rows.withColumns({c: new(c) for c in columns})
