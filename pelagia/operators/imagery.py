"""Imagery tables: enrichment by documents, ground extents, oriented and catalogue rows, increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.functions.normalize import basename, clean, first_number, path_key, srs_part, table_time, to_number

from .imageset import ALTITUDE
from .schema import sanitised_names

# Category, pitch, roll, fields of view, height, near and far distance.
CATEGORIES = [
    ("Horizontal", 90.0, 0.0, 60.0, 40.0, 1.8, 1.0, 30.0),
    ("Oblique", 45.0, 0.0, 60.0, 40.0, 200.0, 1.0, 500.0),
    ("Nadir", 0.0, 0.0, 60.0, 40.0, 200.0, 1.0, 500.0),
    ("360", 90.0, 0.0, 360.0, 180.0, 1.8, 1.0, 30.0),
    ("Inspection", 90.0, 0.0, 60.0, 40.0, 1.8, 0.0, 5.0),
    ("AerialFrameVideo", 70.0, 0.0, 60.0, 40.0, 100.0, 1.0, 500.0),
    ("TerrestrialFrameVideo", 90.0, 0.0, 70.0, 40.0, 2.0, 1.0, 20.0),
    ("Terrestrial360Video", 90.0, 0.0, 360.0, 180.0, 2.0, 1.0, 20.0),
]


# Source columns that have a column of their own; computed document fields and placeholder columns that
# are not carried over.
MAPPED_COLUMNS = ("Filename", "Raster", "CameraHeading", "CameraPitch", "CameraRoll", "HorizontalFieldOfView", "VerticalFieldOfView", "NearDistance", "FarDistance", "CameraHeight", "AcquisitionDate", "Precision Time Stamp", "SRS")
COMPUTED_COLUMNS = (
    "ifdo_image_latitude", "ifdo_image_longitude", "ifdo_image_altitude_meters", "ifdo_image_coordinate_reference_system", "ifdo_image_hash_sha256", "ifdo_image_uuid",
    "ifdo_image_camera_yaw_degrees", "ifdo_image_camera_pitch_degrees", "ifdo_image_camera_roll_degrees",
)
PLACEHOLDER_COLUMNS = ("CenterX", "CenterY", "ZOrder")
#: Columns of the oriented table, whose names extra ones cannot take.
ORIENTED = ("set_id", "row_no", "Name", "ImagePath", "AcquisitionDate", "CameraHeading", "CameraPitch", "CameraRoll", "CameraHeight", "height_source", "HorizontalFieldOfView", "VerticalFieldOfView", "NearDistance", "FarDistance", "OrientedImageryType", "x", "y", "z", "SourceHorizontalSRS", "SourceVerticalSRS", "CameraID", "SequenceOrder")
TEXT_LENGTH = 255


def extra_columns(names: Sequence[str], taken: Sequence[str] = ()) -> dict[str, str]:
    """Source columns that are kept as text, under unique clean names."""
    kept = [c for c in names if c not in (*MAPPED_COLUMNS, *COMPUTED_COLUMNS, *PLACEHOLDER_COLUMNS)]
    return dict(zip(kept, sanitised_names(kept, taken), strict=True))


def category_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, d_pitch double, d_roll double, d_hfov double, d_vfov double, d_height double, d_near double, d_far double")


def extent_columns(x: Column, y: Column, heading: Column, height: Column, hfov: Column, vfov: Column) -> dict[str, Column]:
    """The box around a nadir footprint turned by the heading; zeros where there is no position."""
    half = lambda fov: F.abs(height) * F.tan(F.radians(F.least(F.greatest(fov, F.lit(0.0)), F.lit(179.0)) / 2))
    c, s = F.abs(F.cos(F.radians(heading))), F.abs(F.sin(F.radians(heading)))
    ex, ey = half(hfov) * c + half(vfov) * s, half(hfov) * s + half(vfov) * c
    at = lambda v: F.when(x.isNotNull() & y.isNotNull(), v).otherwise(0.0)
    return {"xMin": at(x - ex), "xMax": at(x + ex), "yMin": at(y - ey), "yMax": at(y + ey)}


def footprints(rows: DataFrame) -> DataFrame:
    """W5 for rows with x, y, heading, camera_height, hfov and vfov."""
    return rows.withColumns(extent_columns(*(F.col(c) for c in ("x", "y", "heading", "camera_height", "hfov", "vfov"))))


def set_extent(rows: DataFrame) -> DataFrame:
    """The box around all footprints of a set that have a position."""
    return rows.where("x is not null and y is not null").groupBy("set_id").agg(F.min("xMin").alias("xMin"), F.max("xMax").alias("xMax"), F.min("yMin").alias("yMin"), F.max("yMax").alias("yMax"))


def camera_height(df: DataFrame, default: Column) -> tuple[Column, Column]:
    """Height and where it is from: own column, an altitude column, or the category."""
    own = to_number(F.col("CameraHeight")) if "CameraHeight" in df.columns else F.lit(None).cast("double")
    alt = first_number([F.col(f"`{c}`") for c in ALTITUDE if c in df.columns])
    return F.coalesce(own, alt, default), F.when(own.isNotNull(), "camera height").when(alt.isNotNull(), "altitude").otherwise("category")


def oriented_rows(frames: DataFrame, category: str, extra: bool = False) -> DataFrame:
    """The oriented imagery table of frames (set_id, row_no, Raster, Filename, PerspectiveX/Y/Z, heading
    resolved before). Row values, else the category's; rows without a position are left out; all rows carry the
    set's first camera id; the sequence follows the acquisition time. ``extra`` keeps the other source columns."""
    d = category_defaults(frames.sparkSession).where(F.col("category") == category)
    rows = frames.join(F.broadcast(d), F.lit(category) == F.col("category"), "left")
    have = lambda c: to_number(F.col(c)) if c in frames.columns else F.lit(None).cast("double")
    height, source = camera_height(frames, F.col("d_height"))
    text = lambda c: clean(F.col(f"`{c}`")).cast("string") if c in frames.columns else F.lit(None).cast("string")
    camera = frames.groupBy("set_id").agg(F.min_by(text("CameraID"), "row_no").alias("_cam"))
    made = rows.withColumns({"_x": have("PerspectiveX"), "_y": have("PerspectiveY")}).where("_x is not null and _y is not null").join(camera, "set_id")
    others = extra_columns([c for c in frames.columns if c not in ("set_id", "row_no")], ORIENTED) if extra else {}
    out = made.select(
        "set_id", "row_no", F.coalesce(text("Filename"), basename(F.col("Raster"))).alias("Name"), F.col("Raster").alias("ImagePath"),
        table_time(F.coalesce(text("AcquisitionDate"), text("Precision Time Stamp"))).alias("AcquisitionDate"), have("heading").alias("CameraHeading"),
        F.coalesce(have("CameraPitch"), "d_pitch").alias("CameraPitch"), F.coalesce(have("CameraRoll"), "d_roll").alias("CameraRoll"), height.alias("CameraHeight"), source.alias("height_source"),
        F.coalesce(have("HorizontalFieldOfView"), "d_hfov").alias("HorizontalFieldOfView"), F.coalesce(have("VerticalFieldOfView"), "d_vfov").alias("VerticalFieldOfView"),
        F.coalesce(have("NearDistance"), "d_near").alias("NearDistance"), F.coalesce(have("FarDistance"), "d_far").alias("FarDistance"), F.lit(category).alias("OrientedImageryType"),
        F.col("_x").alias("x"), F.col("_y").alias("y"), F.coalesce(have("PerspectiveZ"), F.lit(0.0)).alias("z"), srs_part(text("SRS"), 1).alias("SourceHorizontalSRS"), srs_part(text("SRS"), 2).alias("SourceVerticalSRS"), F.col("_cam").alias("CameraID"),
        *(F.left(F.col(f"`{c}`").cast("string"), F.lit(TEXT_LENGTH)).alias(n) for c, n in others.items()),
    )
    order = Window.partitionBy("set_id").orderBy(F.col("AcquisitionDate").asc_nulls_last(), "row_no")
    return out.withColumn("SequenceOrder", F.row_number().over(order))


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """The raster catalogue: path, name, time, box, system, sort time and height."""
    boxed = footprints(rows)
    return boxed.select("set_id", F.col("path").alias("Raster"), basename(F.col("path")).alias("Name"), F.col("ts").alias("AcquisitionDate"), "xMin", "xMax", "yMin", "yMax", srs_part(F.col("srs"), 1).alias("SRS"), F.col("ts").alias("StdTime"), F.col("z").alias("StdZ"))


def enriched(frames: DataFrame, per_image: DataFrame, set_document: DataFrame, xml_domain: DataFrame) -> DataFrame:
    """Frames (set_id, filename) with ``ifdo``, the item map of the first source that has the image: its own
    document, then the set's, then its XML domain. Sources have set_id, filename, source_no, item."""
    tagged = [s.select("set_id", "filename", "source_no", "item").withColumn("_p", F.lit(i)) for i, s in enumerate((per_image, set_document, xml_domain))]
    w = Window.partitionBy("set_id", "filename").orderBy("_p", "source_no")
    best = tagged[0].union(tagged[1]).union(tagged[2]).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return frames.join(best.select("set_id", "filename", F.col("item").alias("ifdo")), ["set_id", "filename"], "left")


def item_keys(*sources: DataFrame) -> list[str]:
    """All keys of the sources' items in order: the vocabulary of the documents, which comes to the driver."""
    every = sources[0].select("item")
    for s in sources[1:]:
        every = every.union(s.select("item"))
    return [r["k"] for r in every.select(F.explode(F.map_keys("item")).alias("k")).distinct().orderBy("k").collect()]


def item_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The given keys of ``ifdo`` as ``ifdo_*`` columns."""
    return rows.select("*", *(F.element_at("ifdo", F.lit(k)).alias("ifdo_" + k.replace("-", "_")) for k in keys)).drop("ifdo")


def new_images(frames: DataFrame, present: DataFrame, path_col: str = "Raster") -> DataFrame:
    """Frames whose path, normalised, is not among the images (path) that are there."""
    return frames.withColumn("_p", path_key(F.col(path_col))).join(present.select(path_key(F.col("path")).alias("_p")).distinct(), "_p", "left_anti").drop("_p")
