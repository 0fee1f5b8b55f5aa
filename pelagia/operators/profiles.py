"""Acquisition profiles and the video metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.normalize import coerce, project

from .timeline import DEP, object_ids

_PROFILE = "profile string, camera_pitch double, camera_roll double, hfov double, vfov double, camera_height double, near_distance double, far_distance double, heading_mode string, heading_constant double"
# Profile, pitch from nadir, roll, fields of view, height, near and far distance, heading mode, heading.
PROFILES = [
    ("ROV - Down-looking (Nadir) Camera", 0.0, 0.0, 48.0, 36.0, 2.0, 0.3, 8.0, "from_track", 0.0),
    ("ROV - Forward-Oblique Camera", 45.0, 0.0, 60.0, 45.0, 3.0, 0.5, 10.0, "from_track", 0.0),
    ("AUV - Nadir Survey Camera", 0.0, 0.0, 50.0, 38.0, 3.0, 0.5, 12.0, "from_track", 0.0),
    ("Towed Camera Sled - Nadir", 0.0, 0.0, 45.0, 34.0, 2.5, 0.5, 8.0, "from_track", 0.0),
    ("Drop / Lander Camera - Stationary Nadir", 0.0, 0.0, 48.0, 36.0, 1.5, 0.3, 5.0, "constant", 0.0),
    ("Diver / Handheld Camera", 30.0, 0.0, 60.0, 45.0, 1.0, 0.2, 4.0, "from_track", 0.0),
    ("Custom (define manually below)", None, None, None, None, None, None, None, "constant", None),
]
# The columns of the table and their types.
VIDEO_FIELDS = {
    "ObjectID": "LONG", "Filename": "TEXT", "Precision Time Stamp": "LONG", "AcquisitionDate": "DATE", "Sensor Longitude": "DOUBLE",
    "Sensor Latitude": "DOUBLE", "Sensor True Altitude": "DOUBLE", "Sensor Ellipsoid Height Extended": "DOUBLE", "CameraID": "LONG",
    "CameraNCols": "LONG", "CameraNRows": "LONG", "CameraFocalLength": "DOUBLE", "CameraPixelSize": "DOUBLE", "Platform Heading Angle": "DOUBLE",
    "Platform Pitch Angle (Full)": "DOUBLE", "Platform Roll Angle (Full)": "DOUBLE", "Sensor Relative Azimuth Angle": "DOUBLE",
    "Sensor Relative Elevation Angle": "DOUBLE", "Sensor Relative Roll Angle": "DOUBLE", "Sensor Horizontal Field of View": "DOUBLE",
    "Sensor Vertical Field of View": "DOUBLE", "Near Distance": "DOUBLE", "Sensor Far Distance": "LONG", "Camera Height Above Seafloor": "DOUBLE",
}
CONSTANTS = ("camera_pitch", "camera_roll", "hfov", "vfov", "camera_height", "near_distance", "far_distance", "heading_mode", "heading_constant")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, _PROFILE)


def with_profile(df: DataFrame, overrides: DataFrame | None = None, template: DataFrame | None = None, profile: str = "profile") -> DataFrame:
    """Each deployment's camera constants: override, else template, else the profile's default. A given 0 counts.
    ``df`` names the profile; overrides and template have deployment_id and any of the constants."""
    out = df.join(F.broadcast(profiles(df.sparkSession)), profile, "left")
    for given in (template, overrides):
        if given is not None:
            names = [c for c in CONSTANTS if c in given.columns]
            out = out.join(given.select(DEP, *(F.col(c).alias(f"_{c}") for c in names)), DEP, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*(f"_{c}" for c in names))
    return out


def profile_templates(chosen: DataFrame) -> DataFrame:
    """Each deployment's constants as a JSON template."""
    names = [c for c in CONSTANTS if c in chosen.columns]
    return chosen.select(DEP, F.to_json(F.struct(F.struct(*names).alias("profile"))).alias("template"))


def from_templates(templates: DataFrame) -> DataFrame:
    """The constants that each deployment's template gives, for ``with_profile``; ``valid`` is false for a text
    without a profile object."""
    kinds = dict(f.split(" ") for f in _PROFILE.split(", "))
    read = F.from_json(F.get_json_object("template", "$.profile"), ", ".join(f"{c} {kinds[c]}" for c in CONSTANTS))
    is_object = F.coalesce(F.get_json_object("template", "$.profile").rlike(r"^\s*\{"), F.lit(False))
    return templates.select(DEP, is_object.alias("valid"), F.when(is_object, read).alias("p")).select(DEP, "valid", "p.*")


def carried_mappings(source: DataFrame, mappings: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows with ``_mapped``, the source values that take the place of computed ones."""
    return source.withColumn("_mapped", F.struct(*(coerce(F.col(f"`{c}`"), VIDEO_FIELDS[target]).alias(target) for c, target in mappings)))


def mapped(table: DataFrame, mappings: Sequence[tuple[str, str]]) -> DataFrame:
    """P6 for a table that carries ``_mapped``: a mapped value counts, a null one never does."""
    targets = {target for _, target in mappings}
    return table.select(*((F.coalesce(F.col("_mapped")[c], F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")) for c in table.columns if c != "_mapped"))


def video_metadata(track: DataFrame, crs: int = 4326, z_is_ellipsoid: bool = False, far_distance: bool = True, segment_rows: int | None = None) -> DataFrame:
    """The video metadata table of a track that carries camera constants. Elevation is measured from the
    horizon (pitch - 90), far distance in whole metres, half to even."""
    t = object_ids(track, segment_rows=segment_rows).withColumn("_p", project(F.col("x"), F.col("y"), crs, 4326))
    has = lambda c, kind: F.col(c).cast(kind) if c in track.columns else F.lit(None).cast(kind)
    values = {
        "ObjectID": F.col("object_id").cast("bigint"), "Filename": has("filename", "string"), "Precision Time Stamp": F.unix_micros("ts"), "AcquisitionDate": F.col("ts"),
        "Sensor Longitude": F.col("_p.x"), "Sensor Latitude": F.col("_p.y"), "Sensor True Altitude": F.col("z"),
        "Sensor Ellipsoid Height Extended": F.col("z") if z_is_ellipsoid else F.lit(None).cast("double"), "CameraID": has("camera_id", "bigint"), "CameraNCols": has("ncols", "bigint"),
        "CameraNRows": has("nrows", "bigint"), "CameraFocalLength": has("focal_length", "double"), "CameraPixelSize": has("pixel_size", "double"), "Platform Heading Angle": F.col("heading"),
        "Platform Pitch Angle (Full)": F.col("pitch"), "Platform Roll Angle (Full)": F.col("roll"), "Sensor Relative Azimuth Angle": F.lit(0.0),
        "Sensor Relative Elevation Angle": F.col("camera_pitch") - 90, "Sensor Relative Roll Angle": F.col("camera_roll"), "Sensor Horizontal Field of View": F.col("hfov"),
        "Sensor Vertical Field of View": F.col("vfov"), "Near Distance": F.col("near_distance"), "Sensor Far Distance": F.bround("far_distance", 0).cast("bigint"), "Camera Height Above Seafloor": F.col("camera_height"),
    }
    return t.select(DEP, *(values[c].alias(c) for c in VIDEO_FIELDS if far_distance or c != "Sensor Far Distance"), *(c for c in ("_mapped",) if c in track.columns))


def with_mappings(table: DataFrame, source: DataFrame, mappings: Sequence[tuple[str, str]], on: Sequence[str]) -> DataFrame:
    """A mapped source value takes the place of the computed one; a null one never does."""
    taken = source.select(*on, *(F.col(f"`{c}`").alias(f"_m{i}") for i, (c, _) in enumerate(mappings)))
    joined = table.join(taken, list(on), "left")
    made = {target: F.coalesce(coerce(F.col(f"_m{i}"), VIDEO_FIELDS[target]), F.col(f"`{target}`")) for i, (_, target) in enumerate(mappings)}
    return joined.withColumns(made).select(*(f"`{c}`" for c in table.columns))


def track_points(table: DataFrame) -> DataFrame:
    """WKT point of each row: true altitude, else ellipsoid height, else 0."""
    z = F.coalesce("`Sensor True Altitude`", "`Sensor Ellipsoid Height Extended`", F.lit(0.0))
    lon, lat = F.col("`Sensor Longitude`"), F.col("`Sensor Latitude`")
    return table.where(lon.isNotNull() & lat.isNotNull()).select(DEP, "ObjectID", lon.alias("lon"), lat.alias("lat"), z.alias("z"), F.concat(F.lit("POINT Z ("), F.concat_ws(" ", lon.cast("string"), lat.cast("string"), z.cast("string")), F.lit(")")).alias("wkt"))
