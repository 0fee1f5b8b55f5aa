"""The end-to-end jobs: inspect, video metadata, cross-reference, image sets, imagery tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pelagia.functions.normalize import is_geographic, to_number
from pelagia.operators import frames as fr
from pelagia.operators import asof, imagery, imageset, profiles, quality, schema, timeline
from pelagia.operators.segments import SEGMENT_ROWS, largest_group
from pelagia.operators.timeline import DEP
from pelagia.sources import ordered, tables


def _judged(raw: DataFrame, resolved: dict[str, str | None], keep: Sequence[str]) -> DataFrame:
    kept = raw.select(DEP, "row_no", *((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in resolved.items()), *(F.col(f"`{c}`").alias(f"_src{i}") for i, c in enumerate(keep)))
    return timeline.cleaned(kept)


def _track(judged: DataFrame, resolved: dict[str, str | None]) -> DataFrame:
    numbers = [k for k in resolved if k not in ("x", "y", "time", "filename", "camera_id")]
    return judged.where("reject_reason IS NULL").drop("reject_reason", "time").withColumns({k: to_number(F.col(k)) for k in numbers})


def telemetry(raw: DataFrame, resolved: dict[str, str | None], keep: Sequence[str] = ()) -> DataFrame:
    """A raw log (deployment_id, row_no and its own columns) as a track; rows without a position or a
    time are left out, and none left is an error. ``keep`` names source columns that stay as ``_src0``, ``_src1``, ..."""
    return timeline.require_rows(_track(_judged(raw, resolved, keep), resolved), "telemetry with position and time")


def read_telemetry(raw: DataFrame, resolved: dict[str, str | None], keep: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """``telemetry`` for a job: the track, written once, and the totals (``kept`` and a number for each reason of
    rejection), counted while it is written. The log is read and parsed a single time."""
    seen = Observation()
    reasons = {"kept": F.col("reject_reason").isNull(), "no position": F.col("reject_reason") == "no position", "no time": F.col("reject_reason") == "no time"}
    judged = _judged(raw, resolved, keep).observe(seen, *(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in reasons.items()))
    track = tables.written(_track(judged, resolved))
    if not seen.get["kept"]:
        raise ValueError("telemetry with position and time: no rows")
    return track, dict(seen.get)


def scan_rows(track: DataFrame, key: str = DEP) -> int | None:
    """How a job scans: whole deployments (or sets) where the largest one fits a task, else segments of so many rows."""
    return SEGMENT_ROWS if largest_group(track, key) > SEGMENT_ROWS else None


def inspect(track: DataFrame, videos: DataFrame | None = None, segment_rows: int | None = None) -> DataFrame:
    """One row for each deployment: extent, median interval, gaps and their statistics; with ``videos``
    (deployment_id and either start and end, or the times that ``start_provenance`` chooses from) also where the start
    is from, overlap, coverage and warnings."""
    whole, gap = timeline.interval_summary(track, segment_rows=segment_rows)
    stats = quality.described(gap.select(DEP, F.col("gap_s").alias("value")), [DEP], few=segment_rows)
    out = whole.join(stats.select(DEP, F.col("n").alias("n_gaps"), *(F.col(c).alias(f"gap_{c}") for c in ("min", "max", "mean", "median", "std_dev"))), DEP, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
    if videos is None:
        return out
    if "start" not in videos.columns:
        videos = quality.start_provenance(videos.join(whole.select(DEP, F.col("start").alias("sensor_start")), DEP, "left"))
    covered = quality.coverage(videos, out.select(DEP, "start", "end", "n_gaps"))
    warned = F.sort_array(quality.warning_list(covered))
    names = [c for c in ("start_source",) if c in covered.columns]
    return out.join(covered.select(DEP, *names, "overlap_start", "overlap_end", "coverage_pct", warned.alias("warnings")), DEP, "full")


def inspection_reports(raw: DataFrame, videos: DataFrame | None = None, overrides: dict[str, str] | None = None, secondary: DataFrame | None = None) -> DataFrame:
    """E1 from a raw log to reports: JSON and text for each deployment, with the statistics of each field (A2) and the
    suggested mapping of columns (P7); with ``secondary``, another log of the deployments, also what ``joined_logs``
    finds of it."""
    resolved = schema.resolve_telemetry(raw.columns, overrides)
    track, _ = read_telemetry(raw, {k: c for k, c in resolved.items() if k != "filename"})
    rows = scan_rows(track)
    stats = quality.described_telemetry(track, few=rows)
    fields = stats.groupBy(DEP).agg(F.sort_array(F.collect_list(F.struct(*(c for c in stats.columns if c != DEP)))).alias("fields"))
    pairs = [F.struct(F.lit(schema.SUGGESTED[k]).alias("target"), F.lit(c).alias("source")) for k, c in resolved.items() if c and k in schema.SUGGESTED]
    summary = inspect(track, videos, rows).join(fields, DEP, "left").withColumn("suggested_mapping", F.array(*pairs))
    if secondary is not None:
        summary = summary.join(joined_logs(raw, secondary)["summary"], DEP, "left")
    return tables.reports(summary)


def joined_logs(raw: DataFrame, secondary: DataFrame, tolerance_s: float | None = None) -> dict[str, DataFrame]:
    """The joined table of an inspection (J2): ``table``, the log with the columns of the nearest row of another one,
    ``columns``, their clean and raw names, and ``summary``: for each deployment the joined rows, those that met a row
    of the other log, and the share of these."""
    clock = schema.resolve([c for c in secondary.columns if c not in (DEP, "row_no")], asof.TIMES, required=True)
    marked = secondary.withColumn("_met", F.col(f"`{clock}`").isNotNull().cast("string"))
    size = max(largest_group(raw, DEP), largest_group(secondary, DEP))
    table, names = asof.combined_table(raw, marked, tolerance_s, segment_rows=SEGMENT_ROWS if size > SEGMENT_ROWS else None)
    flag = names.where("raw = '_met'").first()["clean"]  # one of the table's column names
    met = F.count_if(F.col(flag).isNotNull())
    summary = table.groupBy(DEP).agg(F.count("*").alias("joined_rows"), met.alias("joined_matches"), F.round(100 * met / F.count("*"), 1).alias("joined_pct"))
    return {"table": table.drop(flag), "columns": names.where("raw <> '_met'"), "summary": summary}


def build_video_metadata(track: DataFrame, deployments: DataFrame, interval_s: float | None = None, z: float | None = None, overrides: DataFrame | None = None, crs: int = 4326, mappings: Sequence[tuple[str, str]] = (), template: DataFrame | None = None, segment_rows: int | None = None) -> DataFrame:
    """The video metadata table of a track. ``deployments`` names each deployment's profile; ``mappings`` are
    pairs of a column of the track and the field whose computed value it replaces."""
    rows = timeline.constant_z(profiles.carried_mappings(track, mappings) if mappings else track, z)
    rows = timeline.resampled(rows, interval_s, segment_rows) if interval_s else rows
    rows = profiles.with_profile(rows.join(deployments, DEP, "left"), overrides, template)
    moved = timeline.track_heading(rows.withColumn("_own", F.col("heading")), segment_rows=segment_rows)
    heading = F.coalesce(F.when(F.col("heading_mode") == "from_track", F.col("heading")).otherwise(F.col("_own")), "heading_constant")
    made = profiles.video_metadata(moved.withColumn("heading", heading), crs, segment_rows=segment_rows)
    return profiles.mapped(made, mappings) if mappings else made


def video_metadata_table(raw: DataFrame, deployments: DataFrame, path: str, mappings: Sequence[tuple[str, str]] = (), columns: dict[str, str] | None = None, **options) -> DataFrame:
    """E2 from a raw log to files: the table as CSV below ``path``, rows in order of time, a folder for each deployment
    where they are few (``write_in_order``). Returns the mappings that were dropped, with reasons."""
    good, bad = schema.checked_mappings(mappings, raw.columns, list(profiles.VIDEO_FIELDS))
    track, _ = read_telemetry(raw, schema.resolve_telemetry(raw.columns, columns), [source for source, _ in good])
    rows = scan_rows(track)
    table = build_video_metadata(track, deployments, mappings=[(f"_src{i}", target) for i, (_, target) in enumerate(good)], segment_rows=rows, **options)
    tables.write_in_order(table, path, [DEP], ["Precision Time Stamp", "ObjectID"], [c for c in table.columns if c != DEP], ranged=rows is not None, folders=tables.few_keys(track, [DEP]))
    return raw.sparkSession.createDataFrame(bad, "source string, target string, reason string")


def cross_reference(frames: DataFrame, telemetry: DataFrame, earlier: DataFrame | None = None, **options) -> DataFrame:
    """The frame table of all frames: earlier rows as they are, new ones matched."""
    return fr.appended(earlier, fr.matched_frames(frames, telemetry, earlier, **options))


def _cross_referenced(frames: DataFrame, raw: DataFrame, path: str, earlier: DataFrame | None, camera: dict[str, float] | None, options: dict) -> tuple[DataFrame, DataFrame | None]:
    """The frame table and the cameras of a run whose tables are written below ``path``; where every frame is in the
    ``earlier`` table, that table, and no cameras: the telemetry is not read then."""
    resolved = schema.resolve_cross_reference(raw.columns, strict=True)
    timeline.require_rows(frames, "frames")
    if earlier is not None and fr.new_frames(frames, earlier).isEmpty():
        return earlier, None
    track, _ = read_telemetry(raw, resolved)
    rows = scan_rows(track)
    table = tables.written(cross_reference(frames, track, earlier, segment_rows=rows, **options))
    cameras = fr.camera_table(track, {"NCols": "camera_ncols", "NRows": "camera_nrows", "FocalLength": "camera_focal_length", "PixelSize": "camera_pixel_size"}, camera or {}).withColumn("CameraID", F.lit(options.get("camera_id", 1)))
    folders = tables.few_keys(table.select(DEP).union(track.select(DEP)), [DEP])
    tables.write_in_order(table, f"{path}/frames", [DEP], ["ObjectID"], [c for c in table.columns if c != DEP], folders=folders)
    tables.write_in_order(cameras, f"{path}/cameras", [DEP], ["CameraID"], ["CameraID", "NCols", "NRows", "FocalLength", "PixelSize"], folders=folders)
    matched = fr.matched_source_rows(frames, raw.join(track.select(DEP, "row_no", "ts"), [DEP, "row_no"]), options.get("tolerance_s"), rows)
    tables.write_in_order(matched, f"{path}/matched", [DEP], ["row_no"], [c for c in raw.columns if c not in (DEP, "row_no")], folders=folders)
    return table, cameras


def cross_reference_tables(frames: DataFrame, raw: DataFrame, path: str, earlier: DataFrame | None = None, camera: dict[str, float] | None = None, **options) -> DataFrame:
    """E3 from a raw metadata table to files: frame, camera and matched-row tables as CSV below ``path``, a folder for
    each deployment where they are few (``write_in_order``). The position and time columns must be there, and both tables must have rows. Returns the totals
    of the run. Where no frame is new nothing is read or written, and the totals are those of the earlier table."""
    return fr.run_totals(_cross_referenced(frames, raw, path, earlier, camera, options)[0])


def cross_reference_sets(frames: DataFrame, raw: DataFrame, path: str, inventory: DataFrame, hashes: DataFrame, headers: DataFrame, earlier: DataFrame | None = None, items: DataFrame | None = None, camera: dict[str, float] | None = None, layout: str | None = None, settings: str = "set", **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """E3 and then E4 of the same frames: the totals of the run and, where frames were new, the image sets of their
    frame and camera tables, one set for each deployment, written below ``path``. ``inventory`` (set_id, path),
    ``hashes`` (path, sha256), ``headers`` and the earlier ``items`` are as for ``image_sets``."""
    table, cameras = _cross_referenced(frames, raw, path, earlier, camera, options)
    totals = fr.run_totals(table)
    if cameras is None:
        return totals, {}
    key = F.concat_ws("/", F.col(DEP).cast("string"), F.col("CameraID").cast("string"))
    rows = table.select(F.col(DEP).alias("set_id"), F.col("ObjectID").alias("row_no"), F.col("Raster").alias("path"), F.col("Filename").alias("filename"), key.alias("camera_key"), *(f"`{c}`" for c in table.columns if c not in (DEP, "ObjectID", "Raster", "Filename")))
    of_sets = cameras.select(F.col(DEP).alias("set_id"), F.lit(0).alias("row_no"), key.alias("camera_key"), "CameraID", "NCols", "NRows", "FocalLength", "PixelSize")
    made = image_sets(rows, of_sets, inventory, hashes, headers, items, settings, camera_key="camera_key", pair=("Platform Latitude", "Platform Longitude"))
    write_image_sets(made, f"{path}/sets", layout)
    return totals, made


def image_sets(frames: DataFrame, cameras: DataFrame, inventory: DataFrame, hashes: DataFrame, headers: DataFrame, earlier: DataFrame | None = None, settings: str = "set", camera_key: str = "camera_id", **fields) -> dict[str, DataFrame]:
    """``items``, ``documents``, ``lines``, ``per_image``, ``issues``, ``biigle``, ``skipped``, ``joined``, ``xml``,
    ``manifests`` and ``manifest_lines`` of image sets. ``frames`` has set_id, row_no, path, filename, any source columns and, where a set
    has several tables, table_no; ``headers`` has set_id, a map ``header`` and, likewise, table_no: the first table's
    header and the last table's item count. ``earlier`` items (set_id, filename, uuid and item fields) give images
    their ids, and stay where the image is still there but not made anew."""
    found = tables.written(fr.existing_images(frames, inventory))  # read for the items and again for each output of the frames
    skipped = found.where("not image_found").select("set_id", "filename")
    rows = found.where("image_found")
    rows = rows if "table_no" in frames.columns else rows.withColumn("table_no", F.lit(0))
    items = imageset.item_fields(rows, ["set_id", "filename", "row_no", "table_no", "path"], **fields)
    items = imageset.with_identities(imageset.last_items(items), earlier)
    items = items.join(hashes.select("path", "sha256"), "path", "left").drop("path")
    if earlier is not None:
        there = inventory.select("set_id", imageset.basename(F.col("path")).alias("filename"))
        items = imageset.carried_forward(items, earlier, there)
    items = tables.written(items)  # read for the headers' defaults and again for each output
    defaults = imageset.header_defaults(items)
    names = [c for c in defaults.columns if c != "set_id"]
    pairs = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in names)))
    given = imageset.first_headers(headers) if "table_no" in headers.columns else headers
    made = given.join(defaults, "set_id", "left").select("set_id", imageset.merged_header(F.col("header"), pairs).alias("header"))
    keys = [c for c in items.columns if c.startswith("image-") and c != "image-other-fields"]
    entry: list[tuple[str, Column]] = [*((c, F.col(f"`{c}`")) for c in keys), ("image-uuid", F.col("uuid")), ("image-hash-sha256", F.col("sha256")), ("image-handle", F.lit(""))]
    folded = items.select("set_id", "filename", F.struct(*(c.alias(n) for n, c in entry)).alias("item"))
    mapped = items.select("set_id", "filename", F.map_from_entries(F.array(*(F.struct(F.lit(n), c.cast("string")) for n, c in entry))).alias("item"))
    issues = imageset.header_issues(made).select("set_id", F.lit(None).cast("string").alias("filename"), "field", "issue").union(imageset.item_issues(mapped, made).select("set_id", "filename", "field", F.lit("missing required field")))
    biigle = imageset.biigle_rows(imageset.last_items(rows), items.select("set_id", "filename", *(F.col(f"`{c}`") for c in keys)), ["set_id", "filename"])
    xml = tables.image_xml(mapped.select("set_id", "filename", F.lit("iFDO").alias("domain"), F.lit(1).alias("version"), F.map_filter("item", lambda k, v: v.isNotNull()).alias("item")))
    return {
        "items": items, "documents": imageset.documents(folded, made), "lines": imageset.document_lines(folded, made), "per_image": imageset.per_image_documents(folded, made), "issues": issues, "biigle": biigle,
        "skipped": skipped, "joined": fr.camera_join(rows, cameras, camera_key), "xml": xml, "manifests": tables.manifests(rows.select("set_id", "filename", "path").distinct(), F.lit(settings)),
        "manifest_lines": ordered.manifest_lines(rows.select("set_id", "filename", "path").distinct(), F.lit(settings)),
    }


def paired_cameras(frame_tables: DataFrame, camera_tables: DataFrame) -> DataFrame:
    """J4 over contents: the rows of each frame table (folder, name, ...) keep ``camera_table``, the name of the table
    that fits it, to read its cameras from."""
    pairs = tables.table_pairs(frame_tables.select("folder", "name").distinct(), camera_tables.select("folder", "name").distinct())
    return frame_tables.join(pairs, ["folder", "name"], "left")


def write_image_sets(made: dict[str, DataFrame], path: str, layout: str | None = None) -> None:
    """Documents of each set, or of each image where ``layout`` asks for that, annotation rows and manifests
    below ``path``, a folder for each set where they are few (``write_in_order``)."""
    folders = tables.few_keys(made["items"], ["set_id"])
    if tables.document_format(layout) == "per-image":
        tables.write_in_order(made["per_image"], f"{path}/documents", ["set_id"], ["name"], ["name", "document"], form="json", folders=folders, packed=True)
    else:
        tables.write_documents(made["lines"], f"{path}/documents")
    tables.write_in_order(made["biigle"], f"{path}/biigle", ["set_id"], ["filename"], ["filename", "taken_at", "lng", "lat", "gps_altitude", "distance_to_ground", "area", "SUB_heading"], folders=folders)
    tables.write_documents(made["manifest_lines"], f"{path}/manifests")


def imagery_tables(frames: DataFrame, category: str, present: DataFrame | None = None, heading_offset: float = 0.0, sources: tuple[DataFrame, DataFrame, DataFrame] | None = None, segment_rows: int | None = None) -> dict[str, DataFrame]:
    """E5: ``catalogue`` and ``oriented`` rows of frames (set_id, row_no, path, x, y, heading, ...). Images that are
    in the dataset already (``present``: path) are left out of the oriented rows; sets in a geographic system are
    rejected, as the boxes are in metres. ``sources``, as ``enrichment_sources`` gives them, add ``ifdo_*`` columns.
    ``segment_rows`` (``scan_rows`` of the frames by set) resolves headings of long sets in segments."""
    if sources is not None:
        named = frames if "filename" in frames.columns else frames.withColumn("filename", imageset.basename(F.col("path")))
        frames = imagery.item_columns(imagery.enriched(named, *sources), imagery.item_keys(*sources))
    turned = timeline.carried_heading(frames.withColumn(DEP, F.col("set_id")), offset=heading_offset, segment_rows=segment_rows).drop(DEP)
    fine = turned.where(~is_geographic(F.col("srs"))) if "srs" in frames.columns else turned
    new = fine.withColumns({"Raster": F.col("path"), "PerspectiveX": F.col("x"), "PerspectiveY": F.col("y")})
    oriented = imagery.oriented_rows(imagery.new_images(new, present) if present is not None else new, category, extra=sources is not None)
    return {"catalogue": imagery.catalogue_rows(fine), "oriented": oriented, "rejected": turned.join(fine.select("set_id", "row_no"), ["set_id", "row_no"], "left_anti"), "manifest": tables.manifests(fine.select("set_id", F.col("path").alias("filename"), "path"), F.lit(category))}
