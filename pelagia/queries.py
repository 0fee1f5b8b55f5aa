"""One query for each operator over views of the given tables, and the SQL that DuckDB holds it against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import normalize as n
from pelagia.operators import asof, frames, imagery, imageset, packets, profiles, quality, schema, timeline
from pelagia.operators.timeline import DEP
from pelagia.plans import jobs
from pelagia.sources import ordered, tables
from pelagia.streaming import incremental, stateful
from pelagia.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = duck(" ".join(sql.split()), *views)
        return f

    return add


def _t(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_telemetry")


_NULLS = "('', 'nan', 'none', 'null', 'n/a', 'na', '-', 'unknown')"
_CLEAN = f"CASE WHEN lower(trim({{c}})) IN {_NULLS} THEN NULL ELSE {{c}} END"


# --- scalars -----------------------------------------------------------------------------------------------------
@query("n1_null_like", f"SELECT row_no, {_CLEAN.format(c='x_text')} AS cleaned FROM v_telemetry_raw", "v_telemetry_raw")
def n1(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.clean(F.col("x_text")).alias("cleaned"))


@query("n2_soft_number", "SELECT row_no, TRY_CAST(trim(x_text) AS DOUBLE) AS number FROM v_telemetry_raw", "v_telemetry_raw")
def n2(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.to_number(F.col("x_text")).alias("number"))


@query("n3_first_number", "SELECT row_no, coalesce(TRY_CAST(trim(x_text) AS DOUBLE), TRY_CAST(time_text AS DOUBLE)) AS number FROM v_telemetry_raw", "v_telemetry_raw")
def n3(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.first_number([F.col("x_text"), F.col("time_text")]).alias("number"))


@query("n4_first_value", f"SELECT row_no, coalesce({_CLEAN.format(c='x_text')}, {_CLEAN.format(c='time_text')}) AS value FROM v_telemetry_raw", "v_telemetry_raw")
def n4(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.first_value([F.col("x_text"), F.col("time_text")]).alias("value"))


@query("n5_join_key", "SELECT row_no, CAST(CAST(trim(camera_id) AS DOUBLE)::BIGINT AS VARCHAR) AS camera_key FROM v_frames", "v_frames")
def n5(spark, d):
    return view(spark, d, "v_frames").select("row_no", n.join_key(F.col("camera_id")).alias("camera_key"))


_EPOCH = "CASE row_no % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000 END"


@query("n6_epoch_time", f"SELECT row_no, {_EPOCH} AS us FROM v_telemetry", "v_telemetry")
def n6(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", F.unix_micros(n.epoch_time(F.col("time_text"))).alias("us"))


_ANY = "CASE row_no % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE CASE WHEN row_no % 20 = 4 THEN NULL ELSE epoch_us(ts) // 1000000 * 1000000 END END"


@query("n7_any_time", f"SELECT row_no, {_ANY} AS us FROM v_telemetry", "v_telemetry")
def n7(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", F.unix_micros(n.any_time(F.col("time_text"))).alias("us"))


@query("n8_exif_time", "SELECT row_no, CASE WHEN row_no % 5 < 2 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') WHEN row_no % 20 = 4 THEN NULL ELSE time_text END AS t FROM v_telemetry JOIN v_telemetry_raw USING (row_no)", "v_telemetry", "v_telemetry_raw")
def n8(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.exif_time(F.col("time_text")).alias("t"))


@query("n9_iso_time", "SELECT row_no, CASE WHEN row_no % 5 < 2 THEN strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') WHEN row_no % 20 = 4 THEN NULL ELSE time_text END AS t FROM v_telemetry JOIN v_telemetry_raw USING (row_no)", "v_telemetry", "v_telemetry_raw")
def n9(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", n.iso_time(F.col("time_text")).alias("t"))


@query("n10_table_time", "SELECT row_no, CASE row_no % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 END AS us FROM v_telemetry", "v_telemetry")
def n10(spark, d):
    return view(spark, d, "v_telemetry_raw").select("row_no", F.unix_micros(n.table_time(F.col("time_text")).cast("timestamp")).alias("us"))


@query("n11_coerce", "SELECT row_no, CAST(trunc(z) AS BIGINT) AS as_long, z AS as_double FROM v_telemetry", "v_telemetry")
def n11(spark, d):
    return _t(spark, d).select("row_no", n.coerce(F.col("z"), "LONG").alias("as_long"), n.coerce(F.col("z"), "DOUBLE").alias("as_double"))


@query("n12_elapsed", "SELECT row_no, TRY_CAST(nullif(regexp_extract(filename, '_([0-9]+)\\.[A-Za-z0-9]+$', 1), '') AS BIGINT) AS elapsed_ms FROM v_frames", "v_frames")
def n12(spark, d):
    return view(spark, d, "v_frames").select("row_no", n.elapsed_milliseconds(F.col("filename")).alias("elapsed_ms"))


@query("n14_srs_parts", "SELECT row_no, CASE WHEN row_no % 2 = 0 THEN '3857' ELSE '4326' END AS horizontal, CASE WHEN row_no % 3 = 0 THEN '3855' END AS vertical, row_no % 2 = 1 AS geographic FROM v_telemetry", "v_telemetry")
def n14(spark, d):
    srs = F.concat(F.when(F.col("row_no") % 2 == 0, "3857").otherwise("4326"), F.when(F.col("row_no") % 3 == 0, " ; 3855").otherwise("; "))
    return _t(spark, d).select("row_no", n.srs_part(srs, 1).alias("horizontal"), n.srs_part(srs, 2).alias("vertical"), n.is_geographic(srs).alias("geographic"))


@query("n16_path_key", "SELECT path, lower(path) AS key, regexp_extract(path, '[^/]*$', 0) AS base FROM v_files", "v_files")
def n16(spark, d):
    messy = F.replace(F.concat(F.lit("./x/../"), F.col("path")), F.lit("/img"), F.lit("/./IMG"))
    return view(spark, d, "v_files").select("path", n.path_key(messy).alias("key"), n.basename(F.col("path")).alias("base"))


_BEARING = "CASE WHEN x2 <> x1 OR y2 <> y1 THEN ((degrees(atan2(x2 - x1, y2 - y1)) % 360) + 360) % 360 END"


@query("n17_bearing", f"SELECT row_no, round({_BEARING.replace('x1', 'x').replace('y1', 'y').replace('x2', 'nx').replace('y2', 'ny')}, 6) AS bearing FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v_telemetry WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, row_no))", "v_telemetry")
def n17(spark, d):
    step = _t(spark, d).select("row_no", "x", "y", F.lead("x").over(timeline.track_order()).alias("nx"), F.lead("y").over(timeline.track_order()).alias("ny"))
    return step.select("row_no", F.round(n.bearing(*(F.col(c) for c in ("x", "y", "nx", "ny"))), 6).alias("bearing"))


@query("n18_project", "SELECT row_no, round(radians(x) * 6378137.0, 3) AS px, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) AS py FROM v_telemetry", "v_telemetry")
def n18(spark, d):
    return _t(spark, d).select("row_no", n.project(F.col("x"), F.col("y"), 4326, 3857).alias("p")).select("row_no", F.round("p.x", 3).alias("px"), F.round("p.y", 3).alias("py"))


# --- sources and schema ------------------------------------------------------------------------------------------
@query("s5_content_hash", "SELECT path, sha256(body) AS sha256 FROM v_files", "v_files")
def s5(spark, d):
    return tables.content_hashes(view(spark, d, "v_files"))


@query("s11_manifest", "SELECT set_id, count(*) OVER (PARTITION BY set_id) AS n_images, regexp_extract(path, '[^/]*$', 0) AS filename, path, 'default' AS settings FROM v_files", "v_files")
def s11(spark, d):
    made = tables.manifests(view(spark, d, "v_files").select("set_id", n.basename(F.col("path")).alias("filename"), "path"), F.lit("default"))
    listed = F.from_json(F.get_json_object("manifest", "$.images"), "array<struct<filename:string,path:string>>")
    read = made.select("set_id", F.get_json_object("manifest", "$.n_images").cast("bigint").alias("n_images"), F.get_json_object("manifest", "$.settings").alias("settings"), listed.alias("images"))
    return read.select("set_id", "n_images", "settings", F.explode("images").alias("i")).select("set_id", "n_images", "i.filename", "i.path", "settings")


@query("s11_manifest_files", "SELECT set_id, count(*) OVER (PARTITION BY set_id) AS n_images, row_number() OVER (PARTITION BY set_id ORDER BY path) AS place, regexp_extract(path, '[^/]*$', 0) AS filename, path, 'default' AS settings FROM v_files", "v_files")
def s11b(spark, d):
    path = _fresh(spark)
    images = view(spark, d, "v_files").select("set_id", n.basename(F.col("path")).alias("filename"), "path")
    tables.write_documents(ordered.manifest_lines(images, F.lit("default")), path)
    lines = ordered.read_in_order(spark, path)
    body = F.regexp_replace("value", "^,", "")
    head = lines.where("place = 0").select("set_id", F.from_json(F.concat("value", F.lit("]}")), "n_images bigint, settings string").alias("h"))
    each = lines.where("value LIKE '%\"path\":%'").select("set_id", "place", F.from_json(body, "filename string, path string").alias("i"))
    return each.join(head, "set_id").select(F.col("set_id").cast("bigint"), "h.n_images", "place", "i.filename", "i.path", "h.settings")


def _fresh(spark) -> str:
    return f"{tables.shared_folder(spark)}/pelagia-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("s14_image_xml", "SELECT set_id, regexp_extract(path, '[^/]*$', 0) AS filename, 'IFDO' AS domain, concat('<PAMDataset><Metadata domain=\"IFDO\"><MDI key=\"a&amp;b\">&lt;x&gt;</MDI><MDI key=\"image-set\">', set_id, '</MDI></Metadata></PAMDataset>') AS xml FROM v_files", "v_files")
def s14(spark, d):
    return tables.image_xml(_xml_items(spark, d))


def _xml_items(spark, d):
    item = F.create_map(F.lit("image-set"), F.col("set_id").cast("string"), F.lit("a&b"), F.lit("<x>"))
    return view(spark, d, "v_files").select("set_id", n.basename(F.col("path")).alias("filename"), F.lit("IFDO").alias("domain"), F.lit(1).alias("version"), item.alias("item"))


@query("s14_replaced_domain", "SELECT set_id, regexp_extract(path, '[^/]*$', 0) AS filename, concat('<PAMDataset>', CASE WHEN doc_no % 2 = 0 THEN '<Metadata domain=\"other\"><MDI key=\"k\">1</MDI></Metadata>' ELSE '' END, '<Metadata domain=\"IFDO\"><MDI key=\"a&amp;b\">&lt;x&gt;</MDI><MDI key=\"image-set\">', set_id, '</MDI></Metadata></PAMDataset>') AS xml FROM (SELECT *, CAST(regexp_extract(path, '_([0-9]+)', 1) AS BIGINT) AS doc_no FROM v_files)", "v_files")
def s14b(spark, d):
    items = _xml_items(spark, d)
    number = F.regexp_extract("filename", "_([0-9]+)", 1).cast("bigint")
    old = '<PAMDataset>\n  <Metadata domain="IFDO">\n<MDI key="image-set">old</MDI></Metadata><Metadata domain="other"><MDI key="k">1</MDI></Metadata>\n</PAMDataset>\n'
    there = items.where(number % 2 == 0).select("set_id", "filename", F.lit(old).alias("xml"))
    return tables.image_xml(items, there).select("set_id", "filename", "xml")


_DEG = "concat(CAST(floor(abs({v})) AS BIGINT), ',', printf('%.6f', (abs({v}) - floor(abs({v}))) * 60), CASE WHEN {v} >= 0 THEN '{p}' ELSE '{m}' END)"


@query("s15_xmp", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, concat('<rdf:Description ', concat_ws(' ', concat('xmp:CreateDate=\"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), '\"'), concat('exif:GPSLatitude=\"', " + _DEG.format(v="y", p="N", m="S") + ", '\"'), concat('exif:GPSLongitude=\"', " + _DEG.format(v="x", p="E", m="W") + ", '\"'), 'exif:GPSAltitude=\"' || CAST(round(abs(z) * 100) AS BIGINT) || '/100\"', 'exif:GPSAltitudeRef=\"' || CASE WHEN z < 0 THEN '1' WHEN z >= 0 THEN '0' END || '\"'), '><dc:description>frame</dc:description><payload>{}</payload></rdf:Description>') AS xmp FROM v_telemetry", "v_telemetry")
def s15(spark, d):
    return tables.xmp_sidecars(_t(spark, d).select(F.col(DEP).alias("set_id"), F.concat(F.col("row_no"), F.lit(".tif")).alias("filename"), F.lit("frame").alias("description"), "ts", F.col("y").alias("lat"), F.col("x").alias("lon"), F.col("z").alias("altitude"), F.lit("{}").alias("payload")))


@query("s1_log_files", "SELECT deployment_id, row_no, time_text, x_text FROM v_telemetry_raw", "v_telemetry_raw")
def s1(spark, d):
    path = _fresh(spark)
    named = view(spark, d, "v_telemetry_raw").select(F.col("deployment_id").alias(" deployment_id"), F.col("row_no").alias("no"), "time_text", F.col("x_text").alias("x_text "))
    named.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return tables.read_log(spark, path).select(F.col("deployment_id").cast("bigint"), F.col("no").cast("bigint").alias("row_no"), "time_text", "x_text")


@query("s1_row_numbers", "SELECT deployment_id, row_no, row_number() OVER (PARTITION BY deployment_id ORDER BY row_no) - 1 AS file_row FROM v_telemetry_raw", "v_telemetry_raw")
def s1b(spark, d):
    path = _fresh(spark)
    rows = view(spark, d, "v_telemetry_raw").select(DEP, F.col("row_no").alias("no"), "time_text", "x_text")
    tables.write_in_order(rows, path, [DEP], ["no"])
    return tables.read_log(spark, path, [DEP]).select(F.col(DEP).cast("bigint"), F.col("no").cast("bigint").alias("row_no"), F.col("row_no").alias("file_row"))


@query("s6_document_items", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, CASE WHEN row_no % 2 = 0 THEN 1 ELSE 2 END AS source_no, CASE WHEN row_no % 2 = 0 THEN 'map' ELSE 'list' END AS quality FROM v_telemetry", "v_telemetry")
def s6(spark, d):
    rows = _t(spark, d).select(F.col(DEP).alias("set_id"), "row_no", F.concat("row_no", F.lit(".tif")).alias("filename"))
    even = F.collect_list(F.when(F.col("row_no") % 2 == 0, F.struct("filename", F.create_map(F.lit("image-quality"), F.lit("map")))))
    every = F.collect_list(F.create_map(F.lit("$filename"), F.col("filename"), F.lit("image-quality"), F.lit("list")))
    both = rows.groupBy("set_id").agg(F.map_from_entries(even).alias("m"), every.alias("l"))
    texts = both.select("set_id", F.lit(1).alias("source_no"), F.to_json(F.struct(F.col("m").alias("image-set-items"))).alias("document")).union(both.select("set_id", F.lit(2), F.to_json(F.struct(F.col("l").alias("image-set-items")))))
    return tables.document_items(texts).select("set_id", "filename", "source_no", F.element_at("item", F.lit("image-quality")).alias("quality"))


def _document_files(spark, d) -> str:
    """Documents of both forms as files, a folder for each set: names, text with braces and quotes, nested values."""
    path = _fresh(spark)
    text = F.concat(F.lit('"} {[ '), F.coalesce("body", F.lit("")), F.lit(" \\"))
    rows = view(spark, d, "v_files").select("set_id", n.basename(F.col("path")).alias("filename"), F.left(text, F.lit(400)).alias("t"), F.array(F.struct(F.col("set_id").alias("a"), F.left(text, F.lit(9)).alias("b"))).alias("l"))
    named = rows.where("set_id % 2 = 0").groupBy("set_id").agg(F.to_json(F.struct(F.struct(F.struct(F.lit("}{").alias("name")).alias("image-pi")).alias("image-set-header"), F.map_from_entries(F.collect_list(F.struct("filename", F.struct("t", "l")))).alias("image-set-items"), F.struct(F.struct(F.lit(1).alias("z")).alias("y")).alias("other"))).alias("value"))
    listed = rows.where("set_id % 2 = 1").groupBy("set_id").agg(F.collect_list(F.struct(F.col("filename").alias("$filename"), "t", "l")).alias("i"))
    again = F.transform("i", lambda e: F.struct(e["$filename"].alias("$filename"), F.lit("again").alias("t"), e["l"].alias("l")))
    listed = listed.select("set_id", F.to_json(F.struct(F.concat("i", again).alias("image-set-items"))).alias("value"))
    named.union(listed).write.partitionBy("set_id").text(path)
    return path


@query("s6_scanned_items", "SELECT set_id, regexp_extract(path, '[^/]*$', 0) AS filename, left(concat('\"} {[ ', coalesce(body, ''), ' \\'), 400) AS t FROM v_files", "v_files")
def s6b(spark, d):
    made = ordered.scanned_items(spark, _document_files(spark, d))
    return made.select(F.regexp_extract("source_file", r"set_id=(\d+)", 1).cast("bigint").alias("set_id"), "filename", F.element_at("item", F.lit("t")).alias("t"))


@query("s6_repeated_names", "SELECT set_id, regexp_extract(path, '[^/]*$', 0) AS filename, left(concat('\"} {[ ', coalesce(body, ''), ' \\'), 400) AS t FROM v_files", "v_files")
def s6c(spark, d):
    texts = spark.read.text(_document_files(spark, d), wholetext=True).select("set_id", F.lit(1).alias("source_no"), F.col("value").alias("document"))
    return tables.document_items(texts).select(F.col("set_id").cast("bigint"), "filename", F.element_at("item", F.lit("t")).alias("t"))


@query("s6_unreadable_documents", "SELECT set_id, source_no, reason FROM (SELECT DISTINCT set_id, unnest([1, 2]) AS source_no FROM v_files) CROSS JOIN (SELECT unnest(['not JSON', 'no items']) AS reason) WHERE (set_id % 3 = 0 AND reason = 'not JSON' AND source_no = 1) OR (reason = 'no items' AND source_no = 2)", "v_files")
def s6d(spark, d):
    sets = view(spark, d, "v_files").select("set_id").distinct()
    body = F.when(F.col("set_id") % 3 == 0, '{"image-set-items": {"a.tif": {').otherwise('{"image-set-items": {"a.tif": {}}}')
    texts = sets.select("set_id", F.lit(1).alias("source_no"), body.alias("document")).union(sets.select("set_id", F.lit(2), F.lit('{"image-set-header": {}}')))
    return tables.unreadable_documents(texts)


@query("s12_reports", "SELECT deployment_id, count(*) AS n_rows, concat('deployment_id: ', deployment_id, chr(10), 'n_rows: ', count(*), chr(10), 'least: ', coalesce(CAST(CAST(min(pitch) AS BIGINT) AS VARCHAR), 'not available')) AS report_text FROM v_telemetry GROUP BY 1", "v_telemetry")
def s12(spark, d):
    made = tables.reports(_t(spark, d).groupBy(DEP).agg(F.count("*").alias("n_rows"), F.min("pitch").cast("bigint").alias("least")))
    return made.select(DEP, F.get_json_object("report_json", "$.n_rows").cast("bigint").alias("n_rows"), "report_text")


@query("s16_templates", "SELECT DISTINCT deployment_id AS set_id, 'again' AS description, concat('p', deployment_id) AS pi FROM v_telemetry", "v_telemetry")
def s16(spark, d):
    made = tables.templates(_t(spark, d).select(DEP).distinct().select(F.col(DEP).alias("set_id"), F.create_map(F.lit("image-pi"), F.concat(F.lit("p"), F.col(DEP))).alias("metadata")), "again")
    return made.select("set_id", F.get_json_object("template", "$.description").alias("description"), F.get_json_object("template", "$.metadata.image-pi").alias("pi"))


@query("p2_canonical_columns", "SELECT row_no, x, y, ts AS time FROM v_telemetry", "v_telemetry")
def p2(spark, d):
    raw = _t(spark, d).select("row_no", F.col("x").alias("Easting"), F.col("y").alias("northing"), F.col("ts").alias("Timestamp"))
    return schema.canonical(raw, schema.resolve_telemetry(raw.columns), ["row_no"]).select("row_no", "x", "y", "time")


@query("p3_cross_reference_columns", "SELECT row_no, x, y, ts AS time FROM v_telemetry", "v_telemetry")
def p3(spark, d):
    raw = _t(spark, d).select("row_no", F.col("x").alias("Sensor Longitude"), F.col("y").alias("Sensor Latitude"), F.col("ts").alias("UTC"))
    return schema.canonical(raw, schema.resolve_cross_reference(raw.columns), ["row_no"]).select("row_no", "x", "y", "time")


@query("p9_inferred_types", "SELECT 'time_text' AS \"column\", 'DATE' AS kind, NULL::BIGINT AS length UNION ALL SELECT 'x_text', CASE WHEN count(*) FILTER (NOT lower(trim(x_text)) IN " + _NULLS + " AND TRY_CAST(trim(x_text) AS DOUBLE) IS NULL) = 0 THEN 'DOUBLE' ELSE 'TEXT' END, NULL FROM v_telemetry_raw", "v_telemetry_raw")
def p9(spark, d):
    return schema.inferred_types(view(spark, d, "v_telemetry_raw").select("time_text", "x_text"), ["time_text"]).withColumn("length", F.col("length").cast("bigint"))


# --- filters and timeline ----------------------------------------------------------------------------------------
def _cleaned(spark, d):
    raw = view(spark, d, "v_telemetry_raw").withColumn("y", F.lit("1"))
    return timeline.cleaned(raw, "x_text", "y", "time_text")


@query("f1_cleaned", "SELECT row_no, TRY_CAST(trim(x_text) AS DOUBLE) AS x, CASE WHEN TRY_CAST(trim(x_text) AS DOUBLE) IS NULL THEN 'no position' WHEN time_text = 'n/a' THEN 'no time' END AS reject_reason FROM v_telemetry_raw", "v_telemetry_raw")
def f1(spark, d):
    return _cleaned(spark, d).select("row_no", "x", "reject_reason")


@query("f2_reject_counts", "SELECT deployment_id, count(*) FILTER (TRY_CAST(trim(x_text) AS DOUBLE) IS NOT NULL AND time_text <> 'n/a') AS kept, count(*) FILTER (NOT (TRY_CAST(trim(x_text) AS DOUBLE) IS NOT NULL AND time_text <> 'n/a')) AS rejected FROM v_telemetry_raw GROUP BY 1", "v_telemetry_raw")
def f2(spark, d):
    return timeline.reject_counts(_cleaned(spark, d))


@query("f2_observed_totals", "SELECT count(*) FILTER (TRY_CAST(trim(x_text) AS DOUBLE) IS NOT NULL AND time_text <> 'n/a') AS kept, count(*) FILTER (TRY_CAST(trim(x_text) AS DOUBLE) IS NULL) AS no_position, count(*) FILTER (TRY_CAST(trim(x_text) AS DOUBLE) IS NOT NULL AND time_text = 'n/a') AS no_time, count(*) FILTER (TRY_CAST(trim(x_text) AS DOUBLE) IS NOT NULL AND time_text <> 'n/a') AS rows_written FROM v_telemetry_raw", "v_telemetry_raw")
def f2b(spark, d):
    raw = view(spark, d, "v_telemetry_raw").select(DEP, "row_no", F.col("x_text").alias("X"), F.lit("1").alias("Y"), F.col("time_text").alias("Time"))
    track, seen = jobs.read_telemetry(raw, {"x": "X", "y": "Y", "time": "Time"})
    return track.agg(F.count("*").alias("rows_written")).select(*(F.lit(seen[k]).cast("bigint").alias(k.replace(" ", "_")) for k in ("kept", "no position", "no time")), "rows_written")


@query("f3_existing_images", "SELECT path, set_id % 2 = 0 AS image_found FROM v_files", "v_files")
def f3(spark, d):
    files = view(spark, d, "v_files").select("set_id", "path")
    return frames.existing_images(files, files.where("set_id % 2 = 0")).select("path", "image_found")


_GAPS = "SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY deployment_id ORDER BY ts, row_no) / 1e6 AS g0, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY deployment_id ORDER BY ts, row_no)) / 1e6 AS gap_s FROM v_telemetry"


@query("a3_median_interval", f"SELECT deployment_id, round(quantile_cont(gap_s, 0.5), 6) AS median_s FROM ({_GAPS}) WHERE gap_s IS NOT NULL GROUP BY 1", "v_telemetry")
def a3(spark, d):
    return timeline.median_interval(_t(spark, d)).select(DEP, F.round("median_s", 6).alias("median_s"))


@query("a3_segmented", f"SELECT deployment_id, round(quantile_cont(gap_s, 0.5), 6) AS median_s FROM ({_GAPS}) WHERE gap_s IS NOT NULL GROUP BY 1", "v_telemetry")
def a3b(spark, d):
    return timeline.median_interval(_t(spark, d), segment_rows=25).select(DEP, F.round("median_s", 6).alias("median_s"))


@query("a4_match_tolerance", f"SELECT deployment_id, round(coalesce(greatest(quantile_cont(gap_s, 0.5) / 2, 0.05), 1.0), 6) AS tolerance_s FROM ({_GAPS}) GROUP BY 1", "v_telemetry")
def a4(spark, d):
    return timeline.match_tolerance(_t(spark, d)).select(DEP, F.round("tolerance_s", 6).alias("tolerance_s"))


@query("a5_join_tolerance", f"SELECT deployment_id, round(greatest(quantile_cont(gap_s, 0.5) / 2, 0.05), 6) AS tolerance_s FROM ({_GAPS}) WHERE gap_s > 0 GROUP BY 1", "v_telemetry")
def a5(spark, d):
    return timeline.join_tolerance(_t(spark, d)).select(DEP, F.round("tolerance_s", 6).alias("tolerance_s"))


@query("a6_extent", "SELECT deployment_id, count(*) AS n_rows, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM v_telemetry GROUP BY 1", "v_telemetry")
def a6(spark, d):
    return timeline.extent(_t(spark, d)).select(DEP, "n_rows", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "duration_s")


@query("a7_start_time", "SELECT deployment_id, CASE WHEN deployment_id % 10 = 0 THEN 0 ELSE epoch_us(min(ts)) END AS start_us FROM v_telemetry GROUP BY 1", "v_telemetry")
def a7(spark, d):
    given = _t(spark, d).where("deployment_id % 10 = 0").select(DEP, F.timestamp_seconds(F.lit(0)).alias("start_override")).distinct()
    return timeline.start_time(_t(spark, d), given).select(DEP, F.unix_micros("start").alias("start_us"))


_W1 = f"WITH g AS ({_GAPS}), m AS (SELECT deployment_id, quantile_cont(gap_s, 0.5) * 5 AS threshold_s FROM g WHERE gap_s IS NOT NULL GROUP BY 1) SELECT g.deployment_id, row_no, round(gap_s, 6) AS gap_s FROM g JOIN m USING (deployment_id) WHERE gap_s > threshold_s"


@query("w1_gaps", f"SELECT * FROM ({_W1})", "v_telemetry")
def w1(spark, d):
    return timeline.gaps(_t(spark, d)).select(DEP, "row_no", F.round("gap_s", 6).alias("gap_s"))


@query("w1_segmented", f"SELECT * FROM ({_W1})", "v_telemetry")
def w1b(spark, d):
    return timeline.gaps(_t(spark, d), segment_rows=40).select(DEP, "row_no", F.round("gap_s", 6).alias("gap_s"))


@query("w2_packet_breaks", "SELECT video_id, n, round(step_s, 6) AS step_s FROM (SELECT *, pts - lag(pts) OVER (PARTITION BY video_id ORDER BY n) AS step_s FROM v_packet_index) WHERE step_s > 3.0 / frame_rate", "v_packet_index")
def w2(spark, d):
    return timeline.packet_breaks(view(spark, d, "v_packet_index")).select("video_id", "n", F.round("step_s", 6).alias("step_s"))


@query("w2_frame_totals", "SELECT video_id, CAST(floor((max(pts) - min(pts)) * max(frame_rate)) AS BIGINT) AS n_frames FROM v_packet_index GROUP BY 1", "v_packet_index")
def w2b(spark, d):
    return timeline.frame_totals(view(spark, d, "v_packet_index")).select("video_id", "n_frames")


_STEP = "SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(row_no) OVER w IS NULL AS is_last FROM v_telemetry WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, row_no)"
_BEAR = "CASE WHEN nx <> x OR ny <> y THEN ((degrees(atan2(nx - x, ny - y)) % 360) + 360) % 360 END"


@query("w3_track_heading", f"SELECT row_no, round(coalesce(CASE WHEN is_last AND h IS NULL THEN lag(h) OVER (PARTITION BY deployment_id ORDER BY ts, row_no) ELSE h END, 45.0), 6) AS heading FROM (SELECT *, coalesce(heading, {_BEAR}) AS h FROM ({_STEP}))", "v_telemetry")
def w3(spark, d):
    return timeline.track_heading(_t(spark, d), 45.0).select("row_no", F.round("heading", 6).alias("heading"))


@query("w3_segmented", f"SELECT row_no, round(coalesce(CASE WHEN is_last AND h IS NULL THEN lag(h) OVER (PARTITION BY deployment_id ORDER BY ts, row_no) ELSE h END, 45.0), 6) AS heading FROM (SELECT *, coalesce(heading, {_BEAR}) AS h FROM ({_STEP}))", "v_telemetry")
def w3b(spark, d):
    return timeline.track_heading(_t(spark, d), 45.0, segment_rows=30).select("row_no", F.round("heading", 6).alias("heading"))


_W4 = "SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS i FROM v_telemetry WINDOW w AS (PARTITION BY deployment_id ORDER BY row_no)"


@query("w4_carried_heading", f"SELECT row_no, round((((known + (i - i0 + 1) * 5.0) % 360) + 360) % 360, 6) AS heading FROM (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS known, coalesce(last_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER w, 1) AS i0 FROM (SELECT *, coalesce(heading, {_BEAR}) AS b FROM ({_W4})) WINDOW w AS (PARTITION BY deployment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING))", "v_telemetry")
def w4(spark, d):
    return timeline.carried_heading(_t(spark, d), offset=5.0).select("row_no", F.round("heading", 6).alias("heading"))


@query("w4_segmented", f"SELECT row_no, round((((known + (i - i0 + 1) * 5.0) % 360) + 360) % 360, 6) AS heading FROM (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS known, coalesce(last_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER w, 1) AS i0 FROM (SELECT *, coalesce(heading, {_BEAR}) AS b FROM ({_W4})) WINDOW w AS (PARTITION BY deployment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING))", "v_telemetry")
def w4b(spark, d):
    return timeline.carried_heading(_t(spark, d), offset=5.0, segment_rows=30).select("row_no", F.round("heading", 6).alias("heading"))


def _boxes(spark, d):
    return imagery.footprints(_t(spark, d).select(F.col(DEP).alias("set_id"), "row_no", "ts", "x", "y", "z", F.coalesce("heading", F.lit(0.0)).alias("heading"), F.abs(F.coalesce("z", F.lit(2.0))).alias("camera_height"), F.lit(60.0).alias("hfov"), F.lit(40.0).alias("vfov"), F.lit("3857").alias("srs"), F.concat(F.lit("a/"), F.col("row_no"), F.lit(".tif")).alias("path")))


_HALF = "SELECT *, abs(coalesce(z, 2.0)) * tan(radians(30.0)) AS hw, abs(coalesce(z, 2.0)) * tan(radians(20.0)) AS hh, abs(cos(radians(coalesce(heading, 0)))) AS c, abs(sin(radians(coalesce(heading, 0)))) AS s FROM v_telemetry"


@query("w5_footprint", f"SELECT row_no, round(x - hw * c - hh * s, 6) AS \"xMin\", round(x + hw * c + hh * s, 6) AS \"xMax\", round(y - hw * s - hh * c, 6) AS \"yMin\", round(y + hw * s + hh * c, 6) AS \"yMax\" FROM ({_HALF})", "v_telemetry")
def w5(spark, d):
    return _boxes(spark, d).select("row_no", *(F.round(c, 6).alias(c) for c in ("xMin", "xMax", "yMin", "yMax")))


@query("a13_set_extent", f"SELECT deployment_id AS set_id, round(min(x - hw * c - hh * s), 6) AS \"xMin\", round(max(x + hw * c + hh * s), 6) AS \"xMax\", round(min(y - hw * s - hh * c), 6) AS \"yMin\", round(max(y + hw * s + hh * c), 6) AS \"yMax\" FROM ({_HALF}) GROUP BY 1", "v_telemetry")
def a13(spark, d):
    return imagery.set_extent(_boxes(spark, d)).select("set_id", *(F.round(c, 6).alias(c) for c in ("xMin", "xMax", "yMin", "yMax")))


_W6 = """WITH s AS (SELECT *, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS u, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, min(epoch_us(ts)) OVER (PARTITION BY deployment_id) AS t0, row_number() OVER w AS n FROM v_telemetry WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, row_no)),
 g AS (SELECT *, unnest(range(CASE WHEN n = 1 THEN 0 ELSE (t - t0) // 3600000000 + 1 END, (u - t0) // 3600000000 + 1)) AS i FROM s WHERE u IS NOT NULL),
 p AS (SELECT *, CASE WHEN u > t THEN CAST(t0 + i * 3600000000 - t AS DOUBLE) / (u - t) ELSE 0.0 END AS f FROM g)
 SELECT deployment_id, i AS row_no, t0 + i * 3600000000 AS us, round(x + (x2 - x) * f, 6) AS x, round(y + (y2 - y) * f, 6) AS y, round(coalesce(z + (z2 - z) * f, z, z2), 6) AS z, pitch, roll FROM p"""


@query("w6_resample", f"SELECT * FROM ({_W6})", "v_telemetry")
def w6(spark, d):
    return timeline.resampled(_t(spark, d), 3600).select(DEP, "row_no", F.unix_micros("ts").alias("us"), *(F.round(c, 6).alias(c) for c in "xyz"), "pitch", "roll")


@query("w6_segmented", f"SELECT * FROM ({_W6})", "v_telemetry")
def w6b(spark, d):
    made = timeline.resampled(_t(spark, d), 3600, segment_rows=30)
    return made.select(DEP, "row_no", F.unix_micros("ts").alias("us"), *(F.round(c, 6).alias(c) for c in "xyz"), "pitch", "roll")


@query("w7_constant_z", "SELECT row_no, coalesce(z, -1.5) AS z FROM v_telemetry", "v_telemetry")
def w7(spark, d):
    return timeline.constant_z(_t(spark, d), -1.5).select("row_no", "z")


@query("w8_object_id", "SELECT row_no, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no) - 1 AS object_id FROM v_telemetry", "v_telemetry")
def w8(spark, d):
    return timeline.object_ids(_t(spark, d)).select("row_no", F.col("object_id").cast("bigint").alias("object_id"))


@query("w8_segmented", "SELECT row_no, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no) - 1 AS object_id FROM v_telemetry", "v_telemetry")
def w8b(spark, d):
    return timeline.object_ids(_t(spark, d), segment_rows=30).select("row_no", "object_id")


@query("w9_sequence", "SELECT row_no, row_number() OVER (PARTITION BY deployment_id ORDER BY CASE WHEN row_no % 4 <> 0 THEN ts END NULLS LAST, row_no) AS sequence_order FROM v_telemetry", "v_telemetry")
def w9(spark, d):
    rows = _t(spark, d).withColumns({"set_id": F.col(DEP), "ts": F.when(F.col("row_no") % 4 != 0, F.col("ts"))})
    return timeline.sequence_order(rows).select("row_no", F.col("sequence_order").cast("bigint").alias("sequence_order"))


@query("w9_segmented", "SELECT row_no, row_number() OVER (PARTITION BY deployment_id ORDER BY CASE WHEN row_no % 4 <> 0 THEN ts END NULLS LAST, row_no) AS sequence_order FROM v_telemetry", "v_telemetry")
def w9b(spark, d):
    rows = _t(spark, d).withColumns({"set_id": F.col(DEP), "ts": F.when(F.col("row_no") % 4 != 0, F.col("ts"))})
    return timeline.sequence_order(rows, segment_rows=30).select("row_no", "sequence_order")


# --- statistics --------------------------------------------------------------------------------------------------
_STATS = "count(v) AS n, {0}min(v){1} AS \"min\", {0}max(v){1} AS \"max\", {0}round(max(v) - min(v), 4){1} AS \"range\", {0}round(avg(v), 4){1} AS mean, {0}round(quantile_cont(v, 0.5), 4){1} AS median, {0}round(stddev_samp(v), 4){1} AS std_dev, {0}round(quantile_cont(v, 0.25), 4){1} AS q1, {0}round(quantile_cont(v, 0.75), 4){1} AS q3".format("CASE WHEN count(v) >= 2 THEN ", " END")


@query("a1_described_gaps", f"SELECT deployment_id, {_STATS.replace('min(v)', 'round(min(v), 4)', 1).replace('max(v)', 'round(max(v), 4)', 1)} FROM (SELECT deployment_id, gap_s AS v FROM ({_W1})) GROUP BY 1", "v_telemetry")
def a1(spark, d):
    return quality.described(timeline.gaps(_t(spark, d)).select(DEP, F.col("gap_s").alias("value")), [DEP]).drop("mode")


@query("a1_mode", "SELECT deployment_id, min(v) AS mode FROM (SELECT deployment_id, pitch AS v, count(*) AS c, max(count(*)) OVER (PARTITION BY deployment_id) AS m FROM v_telemetry GROUP BY 1, 2) WHERE c = m GROUP BY 1", "v_telemetry")
def a1b(spark, d):
    return quality.described(_t(spark, d).select(DEP, F.col("pitch").alias("value")), [DEP]).select(DEP, "mode")


_A2 = " UNION ALL ".join(f"SELECT deployment_id, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM v_telemetry" for f in ("x", "y", "z", "heading", "pitch", "roll"))


_STATS4 = _STATS.replace("min(v)", "round(min(v), 4)", 1).replace("max(v)", "round(max(v), 4)", 1)


@query("a2_described_telemetry", f"SELECT s.*, m.mode FROM (SELECT deployment_id, field, {_STATS4} FROM ({_A2}) WHERE v IS NOT NULL GROUP BY 1, 2) s JOIN (SELECT deployment_id, field, CASE WHEN sum(c) >= 2 THEN round(min(v) FILTER (c = m), 4) END AS mode FROM (SELECT deployment_id, field, v, count(*) AS c, max(count(*)) OVER (PARTITION BY deployment_id, field) AS m FROM ({_A2}) WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (deployment_id, field)", "v_telemetry")
def a2(spark, d):
    return quality.described_telemetry(_t(spark, d))


@query("a2_by_counts", f"SELECT s.*, m.mode FROM (SELECT deployment_id, field, {_STATS4} FROM ({_A2}) WHERE v IS NOT NULL GROUP BY 1, 2) s JOIN (SELECT deployment_id, field, CASE WHEN sum(c) >= 2 THEN round(min(v) FILTER (c = m), 4) END AS mode FROM (SELECT deployment_id, field, v, count(*) AS c, max(count(*)) OVER (PARTITION BY deployment_id, field) AS m FROM ({_A2}) WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (deployment_id, field)", "v_telemetry")
def a2b(spark, d):
    return quality.described_telemetry(_t(spark, d), few=20)


def _videos(spark, d):
    e = timeline.extent(_t(spark, d))
    return e.select(DEP, (F.col("start") + F.expr("INTERVAL 1 HOUR")).alias("start"), (F.col("end") + F.expr("INTERVAL 2 HOURS")).alias("end"))


_EXT = "SELECT deployment_id, date_trunc('second', min(ts)) AS ss, date_trunc('second', max(ts)) AS se, date_trunc('second', min(ts) + INTERVAL 1 HOUR) AS vs, date_trunc('second', max(ts) + INTERVAL 2 HOURS) AS ve FROM v_telemetry GROUP BY 1"


@query("q1_coverage", f"SELECT deployment_id, CASE WHEN greatest(vs, ss) < least(ve, se) THEN round(100.0 * epoch_us(least(ve, se) - greatest(vs, ss)) / epoch_us(ve - vs), 1) END AS coverage_pct FROM ({_EXT})".replace("epoch_us(least(ve, se) - greatest(vs, ss))", "(epoch_us(least(ve, se)) - epoch_us(greatest(vs, ss)))").replace("epoch_us(ve - vs)", "(epoch_us(ve) - epoch_us(vs))"), "v_telemetry")
def q1(spark, d):
    return quality.coverage(_videos(spark, d), timeline.extent(_t(spark, d))).select(DEP, "coverage_pct")


@query("q2_warnings", f"SELECT deployment_id, CASE WHEN greatest(vs, ss) < least(ve, se) THEN 'partly covered' ELSE 'no overlap' END AS warning FROM ({_EXT})", "v_telemetry")
def q2(spark, d):
    return quality.coverage_warnings(quality.coverage(_videos(spark, d), timeline.extent(_t(spark, d))))


@query("q3_provenance", "SELECT deployment_id, CASE WHEN deployment_id % 3 = 0 THEN 'embedded' ELSE 'sensor' END AS start_source, epoch_us(min(ts)) + 60000000 AS end_us FROM v_telemetry GROUP BY 1", "v_telemetry")
def q3(spark, d):
    e = timeline.extent(_t(spark, d))
    none = F.lit(None).cast("timestamp")
    v = e.select(DEP, none.alias("override_start"), F.when(F.col(DEP) % 3 == 0, F.col("start")).alias("embedded_start"), none.alias("container_start"), F.col("start").alias("sensor_start"), none.alias("embedded_end"), F.lit(60.0).alias("duration_s"))
    return quality.start_provenance(v).select(DEP, "start_source", F.unix_micros("end").alias("end_us"))


# --- joins -------------------------------------------------------------------------------------------------------
def _frames(spark, d):
    return view(spark, d, "v_frames")


def _timed(spark, d):
    return frames.frame_times(_frames(spark, d), timeline.start_time(_t(spark, d))).where("ts IS NOT NULL")


_TIMED = "q AS (SELECT f.deployment_id, f.row_no, s.us0 + 1000 * TRY_CAST(nullif(regexp_extract(f.filename, '_([0-9]+)\\.[A-Za-z0-9]+$', 1), '') AS BIGINT) AS t FROM v_frames f JOIN (SELECT deployment_id, min(epoch_us(ts)) AS us0 FROM v_telemetry GROUP BY 1) s USING (deployment_id)), k AS (SELECT deployment_id, row_no, epoch_us(ts) AS t FROM v_telemetry)"
_NEAR = f"WITH {_TIMED}, b AS (SELECT q.*, k.t AS bt, k.row_no AS br FROM q ASOF LEFT JOIN k ON q.deployment_id = k.deployment_id AND q.t > k.t WHERE q.t IS NOT NULL), bf AS (SELECT b.*, k.t AS ft, k.row_no AS fr FROM b ASOF LEFT JOIN k ON b.deployment_id = k.deployment_id AND b.t <= k.t) SELECT deployment_id, row_no, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND t - bt <= ft - t) THEN br ELSE fr END AS match_row_no, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND t - bt <= ft - t) THEN bt - t ELSE ft - t END / 1e6 AS delta_s FROM bf"


@query("j1_nearest_asof", f"SELECT * FROM ({_NEAR})", "v_telemetry", "v_frames")
def j1(spark, d):
    return asof.nearest_rows(_timed(spark, d), _t(spark, d))


@query("j1_nearest_asof_bucketed", f"SELECT * FROM ({_NEAR})", "v_telemetry", "v_frames")
def j1b(spark, d):
    return asof.nearest_rows_bucketed(_timed(spark, d), _t(spark, d), 86400.0)


@query("j1_nearest_asof_segmented", f"SELECT * FROM ({_NEAR})", "v_telemetry", "v_frames")
def j1c(spark, d):
    return asof.nearest_rows_bucketed(_timed(spark, d), _t(spark, d), segment_rows=40)


@query("j2_asof_columns", f"SELECT n.deployment_id, n.row_no, delta_s, abs(delta_s) <= 3600 AS matched, t.ts IS NOT NULL AS has_ts, t.x AS m_x, t.y AS m_y, t.z AS m_z, t.heading AS m_heading, t.pitch AS m_pitch, t.roll AS m_roll, t.row_no AS m_row_no FROM ({_NEAR}) n LEFT JOIN v_telemetry t ON t.deployment_id = n.deployment_id AND t.row_no = n.match_row_no AND abs(delta_s) <= 3600", "v_telemetry", "v_frames")
def j2(spark, d):
    return asof.asof_join(_timed(spark, d), _t(spark, d), 3600.0, bucket_s=30 * 86400.0).select(DEP, "row_no", "delta_s", "matched", F.col("m_ts").isNotNull().alias("has_ts"), *(f"m_{c}" for c in ("x", "y", "z", "heading", "pitch", "roll", "row_no")))


_SECOND = "SELECT deployment_id, row_no, time_text, x_text, us FROM (SELECT r.*, CASE WHEN r.row_no % 5 = 0 THEN epoch_us(t.ts) WHEN r.row_no % 5 = 1 THEN epoch_us(t.ts) // 1000 * 1000 ELSE epoch_us(t.ts) // 1000000 * 1000000 END AS us FROM v_telemetry_raw r JOIN v_telemetry t USING (deployment_id, row_no)) WHERE row_no % 3 = 0 AND row_no % 20 <> 4"


@query("j2_combined_table", f"SELECT * FROM (WITH s AS ({_SECOND}), w AS (SELECT deployment_id, greatest(quantile_cont(g, 0.5) / 2, 0.05) AS tol FROM (SELECT deployment_id, (us - lag(us) OVER (PARTITION BY deployment_id ORDER BY us, row_no)) / 1e6 AS g FROM s) WHERE g > 0 GROUP BY 1), p AS (SELECT deployment_id, row_no, epoch_us(ts) AS t FROM v_telemetry WHERE row_no % 2 = 0), b AS (SELECT p.*, k.us AS bt, k.row_no AS br FROM p ASOF LEFT JOIN s k ON p.deployment_id = k.deployment_id AND p.t > k.us), f AS (SELECT b.*, k.us AS ft, k.row_no AS fr FROM b ASOF LEFT JOIN s k ON b.deployment_id = k.deployment_id AND b.t <= k.us), h AS (SELECT *, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND t - bt <= ft - t) THEN br ELSE fr END AS m, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND t - bt <= ft - t) THEN t - bt ELSE ft - t END / 1e6 AS gap FROM f) SELECT h.deployment_id, h.row_no, h.t AS time_us, v.z AS x_text, CASE WHEN h.gap <= w.tol THEN k.us END AS second_us, TRY_CAST(trim(CASE WHEN h.gap <= w.tol THEN k.x_text END) AS DOUBLE) AS x_text_2 FROM h JOIN v_telemetry v ON v.deployment_id = h.deployment_id AND v.row_no = h.row_no LEFT JOIN w ON w.deployment_id = h.deployment_id LEFT JOIN s k ON k.deployment_id = h.deployment_id AND k.row_no = h.m)", "v_telemetry", "v_telemetry_raw")
def j2b(spark, d):
    first = _t(spark, d).where("row_no % 2 = 0").select(DEP, "row_no", F.col("ts").alias("UTC"), F.col("z").alias("x_text"))
    second = view(spark, d, "v_telemetry_raw").where("row_no % 3 = 0 AND row_no % 20 <> 4").select(DEP, "row_no", F.col("time_text").alias("Time"), "x_text")
    table, names = asof.combined_table(first, second)
    assert [tuple(r) for r in names.collect()] == [("UTC", "UTC"), ("x_text", "x_text"), ("Time", "Time"), ("x_text_2", "x_text_2")]
    return table.select(DEP, "row_no", F.unix_micros("UTC").alias("time_us"), "x_text", F.unix_micros(n.any_time(F.col("Time"))).alias("second_us"), "x_text_2")


@query("j3_camera_join", "SELECT f.deployment_id AS \"Frame_deployment_id\", f.row_no AS \"Frame_row_no\", f.filename AS \"Frame_filename\", f.camera_id AS \"Frame_camera_id\", c.row_no AS \"Camera_row_no\", c.camera_id AS \"Camera_camera_id\", c.ncols AS \"Camera_ncols\", c.nrows AS \"Camera_nrows\", c.focal_length AS \"Camera_focal_length\", c.pixel_size AS \"Camera_pixel_size\" FROM v_frames f LEFT JOIN v_cameras c ON CAST(CAST(trim(f.camera_id) AS DOUBLE) AS BIGINT) = CAST(c.camera_id AS BIGINT)", "v_frames", "v_cameras")
def j3(spark, d):
    return frames.camera_join(_frames(spark, d), view(spark, d, "v_cameras"))


@query("j4_table_pairs", "SELECT CAST(deployment_id % 7 AS VARCHAR) AS folder, concat('dive', deployment_id, '_frames') AS name, (SELECT c FROM (SELECT concat('dive', o.deployment_id, '_cameras') AS c, length(p) AS size FROM (SELECT DISTINCT deployment_id FROM v_telemetry) o, (SELECT unnest([left(concat('dive', t.deployment_id, '_frames'), i) FOR i IN range(1, 40)]) AS p) x WHERE o.deployment_id % 2 = 0 AND o.deployment_id % 7 = t.deployment_id % 7 AND length(p) <= length(concat('dive', o.deployment_id, '_cameras')) AND starts_with(concat('dive', o.deployment_id, '_cameras'), p)) ORDER BY size DESC, c LIMIT 1) AS camera_table FROM (SELECT DISTINCT deployment_id FROM v_telemetry) t", "v_telemetry")
def j4(spark, d):
    users = _t(spark, d).select(DEP).distinct()
    f = users.select((F.col(DEP) % 7).cast("string").alias("folder"), F.concat(F.lit("dive"), F.col(DEP), F.lit("_frames")).alias("name"))
    c = users.where("deployment_id % 2 = 0").select((F.col(DEP) % 7).cast("string").alias("folder"), F.concat(F.lit("dive"), F.col(DEP), F.lit("_cameras")).alias("name"))
    return jobs.paired_cameras(f, c)


def _items(spark, d):
    return _t(spark, d).select(F.col(DEP).alias("set_id"), "row_no", F.lit(0).alias("table_no"), F.concat(F.col("row_no"), F.lit(".tif")).alias("filename"), F.col("y").alias("Latitude"), F.col("x").alias("Longitude"), F.col("z").alias("Altitude"), F.unix_micros("ts").alias("Precision Time Stamp"), F.col("heading").alias("Yaw"), F.col("pitch").alias("Pitch"), F.when(F.col("row_no") % 5 == 0, F.col("roll")).alias("Omega"))


@query("j5_enriched", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, CASE WHEN deployment_id % 2 = 0 THEN 'image' WHEN deployment_id % 3 = 0 THEN 'set' WHEN deployment_id % 5 = 0 THEN '<xml>' END AS ifdo_image_quality, CASE WHEN deployment_id % 2 <> 0 AND deployment_id % 3 <> 0 AND deployment_id % 5 = 0 THEN 'x' END AS ifdo_only_xml FROM v_telemetry", "v_telemetry")
def j5(spark, d):
    f = _items(spark, d).select("set_id", "filename")
    value = lambda v: F.create_map(F.lit("image-quality"), F.lit(v))
    body = lambda v: F.to_json(F.struct(F.map_from_entries(F.array(F.struct(F.col("filename"), value(v)))).alias("image-set-items")))
    own = f.where("set_id % 2 = 0").select("set_id", F.concat(F.lit("m/"), F.col("filename"), F.lit(".ifdo.json")).alias("path"), body("image").alias("text"))
    whole = f.where("set_id % 3 = 0").groupBy("set_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("filename", value("set")))).alias("image-set-items"))).alias("text")).select("set_id", F.lit("set.ifdo.json").alias("path"), "text")
    xml = tables.image_xml(f.where("set_id % 5 = 0").select("set_id", "filename", F.lit("iFDO").alias("domain"), F.lit(1).alias("version"), F.create_map(F.lit("image-quality"), F.lit("<xml>"), F.lit("only-xml"), F.lit("x")).alias("item")))
    texts = own.union(whole).union(xml.select("set_id", F.concat(F.lit("m/"), F.col("filename"), F.lit(".aux.xml")), "xml"))
    sources = tables.enrichment_sources(texts)
    return imagery.item_columns(imagery.enriched(f, *sources), imagery.item_keys(*sources))


@query("j5_repeated_keys", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, concat('new', row_no) AS ifdo_image_quality, CASE WHEN row_no % 2 = 0 THEN 'y' END AS ifdo_other FROM v_telemetry", "v_telemetry")
def j5b(spark, d):
    f = _items(spark, d).select("set_id", "filename", "row_no")
    entry = lambda k, v: F.concat(F.lit(f'<MDI key="{k}">'), v, F.lit("</MDI>"))
    body = F.concat(entry("image-quality", F.lit("old")), F.when(F.col("row_no") % 2 == 0, entry("other", F.lit("y"))).otherwise(""), entry("image-quality", F.concat(F.lit("new"), F.col("row_no"))))
    texts = f.select("set_id", F.concat("filename", F.lit(".aux.xml")).alias("path"), F.concat(F.lit('<PAMDataset><Metadata domain="iFDO">'), body, F.lit("</Metadata></PAMDataset>")).alias("text"))
    sources = tables.enrichment_sources(texts)
    return imagery.item_columns(imagery.enriched(f.drop("row_no"), *sources), imagery.item_keys(*sources))


_EARLIER = "row_no % 2 = 0"


@query("j6_new_frames", f"SELECT deployment_id, row_no, filename FROM v_frames f WHERE NOT EXISTS (SELECT 1 FROM v_frames e WHERE e.{_EARLIER} AND e.deployment_id = f.deployment_id AND e.filename = f.filename)", "v_frames")
def j6(spark, d):
    f = _frames(spark, d)
    return frames.new_frames(f, f.where(_EARLIER).select(DEP, F.col("filename").alias("Filename"))).select(DEP, "row_no", "filename")


@query("j7_new_images", "SELECT path AS \"Raster\" FROM v_files WHERE set_id % 3 <> 0", "v_files")
def j7(spark, d):
    f = view(spark, d, "v_files")
    return imagery.new_images(f.select(F.col("path").alias("Raster")), f.where("set_id % 3 = 0").select(F.upper("path").alias("path")))


@query("j8_identities", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, CASE WHEN row_no % 2 = 0 THEN 'old' ELSE md5(concat(deployment_id, '/', row_no, '.tif')) END AS id FROM v_telemetry", "v_telemetry")
def j8(spark, d):
    i = _items(spark, d).select("set_id", "filename", "row_no")
    got = imageset.with_identities(i, i.where("row_no % 2 = 0").select("set_id", "filename", F.lit("old").alias("uuid")))
    return got.select("set_id", "filename", F.replace("uuid", F.lit("-"), F.lit("")).alias("id"))


@query("j9_carried_forward", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, CASE WHEN row_no % 3 = 0 THEN 'new' ELSE 'old' END AS made FROM v_telemetry WHERE row_no % 3 = 0 OR (row_no % 2 = 0 AND row_no % 5 <> 0)", "v_telemetry")
def j9(spark, d):
    i = _items(spark, d).select("set_id", "filename", "row_no")
    new, old = i.where("row_no % 3 = 0").withColumn("made", F.lit("new")), i.where("row_no % 2 = 0").withColumn("made", F.lit("old"))
    return imageset.carried_forward(new, old, i.where("row_no % 5 <> 0")).select("set_id", "filename", "made")


# --- projections -------------------------------------------------------------------------------------------------
@query("p6_mappings", "SELECT deployment_id, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no) - 1 AS object_id, coalesce(heading, pitch) AS mapped FROM v_telemetry", "v_telemetry")
def p6(spark, d):
    t = timeline.object_ids(_t(spark, d)).select(DEP, F.col("object_id").cast("bigint").alias("ObjectID"), F.col("pitch").alias("Near Distance"), "heading")
    made = profiles.with_mappings(t.drop("heading"), t.drop("Near Distance"), [("heading", "Near Distance")], [DEP, "ObjectID"])
    return made.select(DEP, F.col("ObjectID").alias("object_id"), F.col("Near Distance").alias("mapped"))


def _deployments(spark, d):
    names = F.array(*(F.lit(p[0]) for p in profiles.PROFILES))
    return _t(spark, d).select(DEP).distinct().withColumn("profile", F.get(names, (F.col(DEP) % 7).cast("int")))


@query("p8_profile", "SELECT deployment_id, CASE WHEN deployment_id % 2 = 0 THEN 0.0 ELSE CASE deployment_id % 7 WHEN 0 THEN 48.0 WHEN 1 THEN 60.0 WHEN 2 THEN 50.0 WHEN 3 THEN 45.0 WHEN 4 THEN 48.0 WHEN 5 THEN 60.0 END END AS hfov FROM (SELECT DISTINCT deployment_id FROM v_telemetry)", "v_telemetry")
def p8(spark, d):
    dep = _deployments(spark, d)
    return profiles.with_profile(dep, dep.where("deployment_id % 2 = 0").select(DEP, F.lit(0.0).alias("hfov"))).select(DEP, "hfov")


@query("p8_templates", "SELECT deployment_id, deployment_id % 5 <> 0 AS valid, CASE WHEN deployment_id % 5 = 0 OR deployment_id % 7 = 6 THEN NULL ELSE CASE deployment_id % 7 WHEN 0 THEN 48.0 WHEN 1 THEN 60.0 WHEN 2 THEN 50.0 WHEN 3 THEN 45.0 WHEN 4 THEN 48.0 WHEN 5 THEN 60.0 END END AS hfov, CASE WHEN deployment_id % 5 = 0 THEN NULL WHEN deployment_id % 7 IN (4, 6) THEN 'constant' ELSE 'from_track' END AS heading_mode FROM (SELECT DISTINCT deployment_id FROM v_telemetry)", "v_telemetry")
def p8b(spark, d):
    made = profiles.profile_templates(profiles.with_profile(_deployments(spark, d)))
    damaged = made.withColumn("template", F.when(F.col(DEP) % 5 == 0, '{"other": 1}').otherwise(F.col("template")))
    return profiles.from_templates(damaged).select(DEP, "valid", "hfov", "heading_mode")


@query("p10_lat_lon", "SELECT row_no, CASE WHEN row_no % 2 = 0 THEN y END AS lat, CASE WHEN row_no % 2 = 0 THEN x END AS lon FROM v_telemetry", "v_telemetry")
def p10(spark, d):
    t = _t(spark, d).select("row_no", F.col("x").alias("PerspectiveX"), F.col("y").alias("PerspectiveY"), F.when(F.col("row_no") % 2 == 0, "4326;5773").otherwise("3857").alias("SRS"))
    return t.select("row_no", imageset.lat_lon(t, None, "SRS").alias("p")).select("row_no", "p.lat", "p.lon")


@query("p11_orientation", "SELECT row_no, CASE WHEN row_no % 5 = 0 THEN 'omega_phi_kappa' ELSE 'yaw_pitch_roll' END AS convention, CASE WHEN row_no % 5 = 0 THEN roll END AS omega, CASE WHEN row_no % 5 <> 0 THEN heading END AS yaw FROM v_telemetry", "v_telemetry")
def p11(spark, d):
    t = _items(spark, d)
    return t.select("row_no", imageset.orientation(t).alias("o")).select("row_no", "o.convention", "o.omega", "o.yaw")


_P12 = {
    "image-latitude": "y", "image-longitude": "x", "image-coordinate-reference-system": "'EPSG:4326'", "image-altitude-meters": "z", "image-datetime": "strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g')",
    "image-camera-yaw-degrees": "CASE WHEN row_no % 5 <> 0 THEN heading END", "image-camera-pitch-degrees": "CASE WHEN row_no % 5 <> 0 THEN pitch END", "image-camera-roll-degrees": "CAST(NULL AS DOUBLE)",
    "image-meters-above-ground": "CASE WHEN row_no % 4 = 0 THEN 3.5 END", "image-area-square-meters": "CASE WHEN row_no % 41 - 20 > 0 THEN CAST(row_no % 41 - 20 AS DOUBLE) END",
}


def _described_items(spark, d):
    return _items(spark, d).withColumns({"CameraHeight": F.when(F.col("row_no") % 4 == 0, 3.5), "Footprint Area": F.col("row_no") % 41 - 20})


@query("p12_item_fields", "SELECT row_no, " + ", ".join(f'{v} AS "{k}"' for k, v in _P12.items()) + " FROM v_telemetry", "v_telemetry")
def p12(spark, d):
    return imageset.item_fields(_described_items(spark, d), ["row_no"], ("Latitude", "Longitude"))


_GIVEN = {"image-latitude": "CASE WHEN row_no % 2 = 0 THEN 1.5 ELSE y END", "image-datetime": f"CASE WHEN row_no % 2 = 0 THEN 'typed' ELSE {_P12['image-datetime']} END"}


@query("p12_given_fields", "SELECT row_no, CASE WHEN row_no % 2 = 0 THEN 'who' END AS pi, " + ", ".join(f'{v} AS "{k}"' for k, v in (_P12 | _GIVEN).items()) + " FROM v_telemetry", "v_telemetry")
def p12b(spark, d):
    given = F.when(F.col("row_no") % 2 == 0, F.create_map(F.lit("image-latitude"), F.lit("1.5"), F.lit("image-datetime"), F.lit("typed"), F.lit("image-pi"), F.lit("who")))
    made = imageset.item_fields(_described_items(spark, d).withColumn("typed", given), ["row_no"], ("Latitude", "Longitude"), given="typed")
    return made.withColumn("pi", F.try_element_at("image-other-fields", F.lit("image-pi"))).drop("image-other-fields")


@query("p13_biigle", "SELECT concat(row_no, '.tif') AS filename, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken_at, x AS lng, y AS lat, z AS gps_altitude, 2.5 AS distance_to_ground FROM v_telemetry", "v_telemetry")
def p13(spark, d):
    t = _items(spark, d)
    items = imageset.item_fields(t, ["set_id", "row_no"], ("Latitude", "Longitude"))
    return imageset.biigle_rows(t, items, ["set_id", "row_no"], 2.5).select("filename", "taken_at", "lng", "lat", "gps_altitude", "distance_to_ground")


_PROFILE_ROWS = "(VALUES " + ", ".join("(" + ", ".join([str(i), *("NULL::DOUBLE" if v is None else f"{v}::DOUBLE" for v in p[1:8]), f"'{p[8]}'", "NULL::DOUBLE" if p[9] is None else f"{p[9]}::DOUBLE"]) + ")" for i, p in enumerate(profiles.PROFILES)) + ") AS c(i, camera_pitch, camera_roll, hfov, vfov, camera_height, near_distance, far_distance, heading_mode, heading_constant)"
_CAMERA = {
    "Sensor Relative Azimuth Angle": "0.0", "Sensor Relative Elevation Angle": "c.camera_pitch - 90", "Sensor Relative Roll Angle": "c.camera_roll", "Sensor Horizontal Field of View": "c.hfov",
    "Sensor Vertical Field of View": "c.vfov", "Near Distance": "c.near_distance", "Sensor Far Distance": "CAST(c.far_distance AS BIGINT)", "Camera Height Above Seafloor": "c.camera_height",
}
_NONE = {**dict.fromkeys(("CameraID", "CameraNCols", "CameraNRows"), "NULL::BIGINT"), **dict.fromkeys(("CameraFocalLength", "CameraPixelSize", "Sensor Ellipsoid Height Extended"), "NULL::DOUBLE"), "Filename": "NULL::VARCHAR"}


def _columns(given: dict[str, str]) -> str:
    return ", ".join(f'{v} AS "{k}"' for k, v in given.items())


_P15 = {
    "deployment_id": "deployment_id", "ObjectID": "row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no) - 1", "Precision Time Stamp": "epoch_us(ts)", "AcquisitionDate": "epoch_us(ts)", "Sensor Longitude": "x", "Sensor Latitude": "y",
    "Sensor True Altitude": "z", "Platform Heading Angle": "heading", "Platform Pitch Angle (Full)": "pitch", "Platform Roll Angle (Full)": "roll", **_CAMERA, **_NONE,
}


@query("p15_video_metadata", f"SELECT {_columns(_P15)} FROM v_telemetry JOIN {_PROFILE_ROWS} ON c.i = deployment_id % 7", "v_telemetry")
def p15(spark, d):
    rows = profiles.with_profile(_t(spark, d).join(_deployments(spark, d), DEP))
    return profiles.video_metadata(rows).withColumn("AcquisitionDate", F.unix_micros("AcquisitionDate"))


def _oriented(spark, d):
    return _t(spark, d).select(F.col(DEP).alias("set_id"), "row_no", F.concat(F.lit("a/"), F.col("row_no"), F.lit(".tif")).alias("Raster"), F.when(F.col("row_no") % 9 != 0, F.col("x")).alias("PerspectiveX"), F.col("y").alias("PerspectiveY"), F.col("z").alias("PerspectiveZ"), F.coalesce("heading", F.lit(0.0)).alias("heading"), F.when(F.col("row_no") % 2 == 0, F.col("pitch")).alias("CameraPitch"), F.unix_micros("ts").alias("Precision Time Stamp"), F.lit("3857; 3855").alias("SRS"), F.concat(F.lit("cam"), F.col("row_no")).alias("CameraID"))


_P16 = {
    "set_id": "deployment_id", "row_no": "row_no", "Name": "concat(row_no, '.tif')", "ImagePath": "concat('a/', row_no, '.tif')", "AcquisitionDate": "epoch_us(ts)", "CameraHeading": "coalesce(heading, 0.0)", "CameraPitch": "CASE WHEN row_no % 2 = 0 THEN pitch ELSE 45.0 END",
    "CameraRoll": "0.0", "CameraHeight": "coalesce(z, 200.0)", "height_source": "CASE WHEN z IS NULL THEN 'category' ELSE 'altitude' END", "HorizontalFieldOfView": "60.0", "VerticalFieldOfView": "40.0", "NearDistance": "1.0", "FarDistance": "500.0",
    "OrientedImageryType": "'Oblique'", "x": "x", "y": "y", "z": "coalesce(z, 0.0)", "SourceHorizontalSRS": "'3857'", "SourceVerticalSRS": "'3855'", "CameraID": "first_camera", "SequenceOrder": "row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no)",
}
_FIRST = "(SELECT *, concat('cam', min(row_no) OVER (PARTITION BY deployment_id)) AS first_camera FROM v_telemetry)"


@query("p16_oriented_rows", f"SELECT {_columns(_P16)} FROM {_FIRST} WHERE row_no % 9 <> 0", "v_telemetry")
def p16(spark, d):
    return imagery.oriented_rows(_oriented(spark, d), "Oblique").withColumns({"AcquisitionDate": F.unix_micros(F.col("AcquisitionDate").cast("timestamp")), "SequenceOrder": F.col("SequenceOrder").cast("bigint")})


@query("p17_extra_columns", "SELECT row_no, first_camera AS \"CameraID\", concat('cam', row_no) AS \"CameraID_2\", concat('v', row_no) AS \"own_field\", 'b' AS \"own_field_2\", 'c' AS \"f_9x\" FROM " + _FIRST + " WHERE row_no % 9 <> 0", "v_telemetry")
def p17(spark, d):
    rows = _oriented(spark, d).withColumns({"own field": F.concat(F.lit("v"), F.col("row_no")), "own-field": F.lit("b"), "9x": F.lit("c"), "CenterX": F.lit("1"), "ifdo_image_uuid": F.lit("u")})
    made = imagery.oriented_rows(rows, "Oblique", extra=True)
    assert not {"CenterX", "ifdo_image_uuid"} & set(made.columns)
    return made.select("row_no", "CameraID", "CameraID_2", "own_field", "own_field_2", "f_9x")


_BOX = 'round(x - hw * c - hh * s, 6) AS "xMin", round(x + hw * c + hh * s, 6) AS "xMax", round(y - hw * s - hh * c, 6) AS "yMin", round(y + hw * s + hh * c, 6) AS "yMax"'


@query("p18_catalogue", f"SELECT deployment_id AS set_id, concat('a/', row_no, '.tif') AS \"Raster\", concat(row_no, '.tif') AS \"Name\", epoch_us(ts) AS \"AcquisitionDate\", {_BOX}, '3857' AS \"SRS\", epoch_us(ts) AS \"StdTime\", z AS \"StdZ\" FROM ({_HALF})", "v_telemetry")
def p18(spark, d):
    made = imagery.catalogue_rows(_boxes(spark, d).drop("xMin", "xMax", "yMin", "yMax"))
    return made.withColumns({**{c: F.round(c, 6) for c in ("xMin", "xMax", "yMin", "yMax")}, **{c: F.unix_micros(c) for c in ("AcquisitionDate", "StdTime")}})


@query("p19_track_points", "SELECT deployment_id, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, row_no) - 1 AS \"ObjectID\", x AS lon, y AS lat, coalesce(z, 0.0) AS z FROM v_telemetry", "v_telemetry")
def p19(spark, d):
    rows = profiles.with_profile(_t(spark, d).join(_deployments(spark, d), DEP))
    return profiles.track_points(profiles.video_metadata(rows)).drop("wkt")


@query("p20_merged_metadata", "SELECT deployment_id AS set_id, CASE WHEN deployment_id % 2 = 0 THEN 'typed' ELSE 'template' END AS project FROM (SELECT DISTINCT deployment_id FROM v_telemetry)", "v_telemetry")
def p20(spark, d):
    typed = F.create_map(F.lit("image-project"), F.when(F.col(DEP) % 2 == 0, "typed").otherwise(" - "))
    template = F.create_map(F.lit("image-project"), F.lit("template"), F.lit("image-pi"), F.lit("x"))
    return _t(spark, d).select(DEP).distinct().select(F.col(DEP).alias("set_id"), F.element_at(imageset.merged_metadata(template, typed, ["image-pi"]), F.lit("image-project")).alias("project"))


@query("p21_rewritten_paths", "SELECT row_no, CASE WHEN row_no % 2 = 0 THEN concat('new/', row_no, '.tif') ELSE concat(row_no, '.tif') END AS image FROM v_telemetry", "v_telemetry")
def p21(spark, d):
    rows = _t(spark, d).select("row_no", F.concat(F.when(F.col("row_no") % 2 == 0, "old\\deep\\").otherwise(""), F.col("row_no"), F.lit(".tif")).alias("image"))
    return frames.rewritten_paths(rows, ["image"], "new")


@query("p22_rename_plan", "SELECT set_id, name, nn AS new_name, CASE WHEN nn IS NULL THEN 'skipped' WHEN row_number() OVER (PARTITION BY set_id, nn ORDER BY name) > 1 THEN 'error' ELSE 'renamed' END AS status FROM (SELECT deployment_id AS set_id, filename AS name, CASE WHEN filename LIKE '%\\_%' ESCAPE '\\' THEN concat('ROV1_', split_part(filename, '_', 2)) END AS nn FROM (SELECT DISTINCT deployment_id, filename FROM v_frames))", "v_frames")
def p22(spark, d):
    files = _frames(spark, d).select(F.col(DEP).alias("set_id"), F.col("filename").alias("name")).distinct()
    return frames.rename_plan(files, "ROV1")


def _matched(spark, d):
    return frames.matched_frames(_frames(spark, d), _t(spark, d), tolerance_s=3600.0, crs=3857)


def _frame_columns(time: str, found: str, t: str = "t") -> dict[str, str]:
    hit = lambda v: f"CASE WHEN {found} THEN {v} END"
    none = dict.fromkeys(("HorizontalFieldOfView", "VerticalFieldOfView", "NearDistance", "FarDistance", "CameraHeight", "SensorRelativeAzimuthAngle", "SensorRelativeElevationAngle", "SensorRelativeRollAngle"), "NULL::DOUBLE")
    return {
        "Precision Time Stamp": hit(time), "AcquisitionDate": hit(f"strftime(make_timestamp({time}), '%Y-%m-%d %H:%M:%S.%f')"), "Platform Longitude": hit(f"{t}.x"), "Platform Latitude": hit(f"{t}.y"), "Sensor Altitude": hit(f"{t}.z"),
        "PerspectiveX": hit(f"round(radians({t}.x) * 6378137.0, 3)"), "PerspectiveY": hit(f"round(ln(tan(pi() / 4 + radians({t}.y) / 2)) * 6378137.0, 3)"), "PerspectiveZ": hit(f"{t}.z"), "SRS": hit("3857"), "CameraID": "1",
        "CameraHeading": hit(f"{t}.heading"), "CameraPitch": hit(f"{t}.pitch"), "CameraRoll": hit(f"{t}.roll"), **none,
    }


_ELAPSED = "TRY_CAST(nullif(regexp_extract(f.filename, '_([0-9]+)\\.[A-Za-z0-9]+$', 1), '') AS BIGINT)"
_HIT = "coalesce(abs(delta_s) <= 3600, false)"
_FRAME_TABLE = f"FROM v_frames f JOIN (SELECT deployment_id, min(epoch_us(ts)) AS first_us FROM v_telemetry GROUP BY 1) z USING (deployment_id) LEFT JOIN ({_NEAR}) n ON n.row_no = f.row_no LEFT JOIN v_telemetry t ON t.deployment_id = n.deployment_id AND t.row_no = n.match_row_no"
_P23 = {"deployment_id": "f.deployment_id", "Raster": "f.filename", "Filename": "f.filename", **_frame_columns(f"(first_us + 1000 * {_ELAPSED})", _HIT), "ElapsedMilliseconds": _ELAPSED, "MatchTimeDeltaSeconds": "delta_s", "Matched": _HIT}


def _rounded(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.round(c, 3) for c in ("PerspectiveX", "PerspectiveY")})


@query("p23_frame_table", f"SELECT {_columns({'ObjectID': 'row_number() OVER (PARTITION BY f.deployment_id ORDER BY f.filename, f.row_no)', **_P23})} {_FRAME_TABLE}", "v_telemetry", "v_frames")
def p23(spark, d):
    return _rounded(_matched(spark, d))


# --- aggregates --------------------------------------------------------------------------------------------------
@query("a8_header_defaults", "SELECT deployment_id AS set_id, strftime(date_trunc('millisecond', min(ts)), '%Y-%m-%d %H:%M:%S.%g') AS first_time, round(avg(y), 6) AS lat, round(avg(x), 6) AS lon, round(avg(z), 6) AS altitude, 'EPSG:4326' AS crs, round(min(y), 6) AS low_lat, round(max(y), 6) AS high_lat, round(min(x), 6) AS low_lon, round(max(x), 6) AS high_lon FROM v_telemetry GROUP BY 1", "v_telemetry")
def a8(spark, d):
    h = imageset.header_defaults(imageset.item_fields(_items(spark, d), ["set_id", "row_no"], ("Latitude", "Longitude")))
    numbers = {"lat": "latitude", "lon": "longitude", "altitude": "altitude-meters", "low_lat": "set-min-latitude-degrees", "high_lat": "set-max-latitude-degrees", "low_lon": "set-min-longitude-degrees", "high_lon": "set-max-longitude-degrees"}
    return h.select("set_id", F.col("image-datetime").alias("first_time"), F.col("image-coordinate-reference-system").alias("crs"), *(F.round(f"image-{c}", 6).alias(n) for n, c in numbers.items()))


_A9 = "SELECT deployment_id AS set_id, count(*) OVER (PARTITION BY deployment_id) AS n_items, concat('first', deployment_id) AS name, concat(row_no, '.tif') AS filename, y AS latitude FROM v_telemetry"


def _document_parts(spark, d):
    items = _items(spark, d).select("set_id", "filename", F.struct(F.col("Latitude").alias("image-latitude")).alias("item"))
    heads = items.select("set_id").distinct().select("set_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("table_no"))
    heads = heads.select("set_id", "table_no", F.create_map(F.lit("image-set-name"), F.concat(F.when(F.col("table_no") == 1, "first").otherwise("second"), F.col("set_id"))).alias("header"))
    return items, imageset.first_headers(heads)


def _read_documents(docs):
    listed = F.from_json(F.get_json_object("document", "$.image-set-items"), "map<string,struct<`image-latitude`:double>>")
    rows = docs.select("set_id", F.size(F.json_object_keys(F.get_json_object("document", "$.image-set-items"))).cast("bigint").alias("n_items"), F.get_json_object("document", "$.image-set-header.image-set-name").alias("name"), listed.alias("items"))
    return rows.select("set_id", "n_items", "name", F.explode("items").alias("filename", "item")).select("set_id", "n_items", "name", "filename", F.col("item.image-latitude").alias("latitude"))


@query("a9_documents", _A9, "v_telemetry")
def a9(spark, d):
    return _read_documents(imageset.documents(*_document_parts(spark, d)))


@query("s10_document_files", _A9, "v_telemetry")
def s10(spark, d):
    path = _fresh(spark)
    tables.write_documents(imageset.document_lines(*_document_parts(spark, d)), path)
    parts = ordered.read_in_order(spark, path).groupBy("set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]), "\n").alias("document"))
    return _read_documents(parts)


@query("s10_image_documents", _A9.replace("count(*) OVER (PARTITION BY deployment_id)", "1::BIGINT"), "v_telemetry")
def s10b(spark, d):
    return _read_documents(imageset.per_image_documents(*_document_parts(spark, d)))


@query("a10_camera_constants", "SELECT deployment_id, coalesce(arg_min(z, row_no) FILTER (z IS NOT NULL), 7.0) AS focal FROM v_telemetry GROUP BY 1", "v_telemetry")
def a10(spark, d):
    return frames.camera_table(_t(spark, d), {"focal": "z"}, {"focal": 7.0})


@query("a11_run_totals", f"SELECT f.deployment_id, count(*) FILTER (coalesce(abs(delta_s) <= 3600, false)) AS matched, count(*) FILTER (NOT coalesce(abs(delta_s) <= 3600, false) AND f.filename LIKE 'dive%') AS unmatched, count(*) FILTER (f.filename LIKE 'still%') AS no_time FROM v_frames f LEFT JOIN ({_NEAR}) n ON n.row_no = f.row_no GROUP BY 1", "v_telemetry", "v_frames")
def a11(spark, d):
    return frames.run_totals(_matched(spark, d))


@query("a12_template_coverage", "SELECT deployment_id AS set_id, 'who' AS category, 1 AS n FROM (SELECT DISTINCT deployment_id FROM v_telemetry) UNION ALL SELECT deployment_id, 'Other', 1 FROM (SELECT DISTINCT deployment_id FROM v_telemetry)", "v_telemetry")
def a12(spark, d):
    m = _t(spark, d).select(F.col(DEP).alias("set_id")).distinct().withColumn("metadata", F.create_map(F.lit("image-pi"), F.lit("a"), F.lit("own"), F.lit("b"), F.lit("blank"), F.lit("n/a")))
    return imageset.template_coverage(m, spark.createDataFrame([("image-pi", "who")], "field string, category string")).select("set_id", "category", F.col("n").cast("int").alias("n"))


@query("o2_appended", "SELECT row_no, CASE WHEN row_no % 2 = 0 THEN z END AS z FROM v_telemetry", "v_telemetry")
def o2(spark, d):
    t = _t(spark, d)
    return frames.appended(t.where("row_no % 2 = 1").select("row_no"), t.where("row_no % 2 = 0").select("row_no", "z"))


# --- rules -------------------------------------------------------------------------------------------------------
def _headers(spark, d):
    full = [*imageset.HEADER_FIELDS]
    named = {"image-creators": F.lit('[{"name":"a"}]'), **{f: F.lit('{"name":"a"}') for f in imageset.OBJECT_FIELDS}}
    pairs = [F.struct(F.lit(f), named.get(f, F.lit("x"))) for f in full if f != "image-abstract"]
    extra = [F.struct(F.lit("image-quality"), F.when(F.col(DEP) % 2 == 0, "raw").otherwise("Raw"))]
    return _t(spark, d).select(DEP).distinct().select(F.col(DEP).alias("set_id"), F.map_from_entries(F.array(*pairs, *extra)).alias("header"))


@query("q4_required_fields", "SELECT DISTINCT deployment_id AS set_id, 'image-abstract' AS field FROM v_telemetry", "v_telemetry")
def q4(spark, d):
    return imageset.header_issues(_headers(spark, d)).where("issue = 'missing required field'").select("set_id", "field")


@query("q4_item_fields", "SELECT concat(row_no, '.tif') AS filename, 'image-hash-sha256' AS field FROM v_telemetry UNION ALL SELECT concat(row_no, '.tif'), 'image-handle' FROM v_telemetry", "v_telemetry")
def q4b(spark, d):
    items = _items(spark, d).select("set_id", "filename", F.create_map(F.lit("image-uuid"), F.lit("u"), F.lit("image-handle"), F.lit("")).alias("item"))
    return imageset.item_issues(items, _headers(spark, d)).select("filename", "field")


@query("q5_object_shapes", "SELECT DISTINCT deployment_id AS set_id, unnest(['image-pi', 'image-project', 'image-creators']) AS field, unnest(['not an object', 'object without a name', 'entry without a name']) AS issue FROM v_telemetry", "v_telemetry")
def q5(spark, d):
    other = {"image-pi": "a name", "image-project": '{"name":" "}', "image-creators": '[{"name":"a"},{"uri":"b"}]'}
    plain = _headers(spark, d).withColumn("header", F.map_from_entries(F.transform(F.map_entries("header"), lambda e: F.struct(e["key"], F.coalesce(*(F.when(e["key"] == k, F.lit(v)) for k, v in other.items()), e["value"])))))
    return imageset.header_issues(plain).where("issue <> 'missing required field' AND issue <> 'not an allowed value'")


@query("q6_vocabularies", "SELECT DISTINCT deployment_id AS set_id, 'image-quality' AS field FROM v_telemetry WHERE deployment_id % 2 = 1", "v_telemetry")
def q6(spark, d):
    return imageset.header_issues(_headers(spark, d)).where("issue = 'not an allowed value'").select("set_id", "field")


# --- packets -----------------------------------------------------------------------------------------------------
def _packets(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    part = lambda c, size: F.lpad(F.right(F.hex(c.cast("bigint")), F.lit(2 * size)), 2 * size, "0")
    lat, lon = F.col("event_id") * 7919 % 2000000 - 1000000, F.col("event_id") * 104729 % 2000000 - 1000000
    body = F.concat(
        F.lit("0208"), part(F.col("us"), 8), F.lit("0502"), part(F.col("event_id") * 257 % 65536, 2), F.lit("0602"), part(F.col("event_id") * 31 % 60000 - 30000, 2), F.lit("0702"), part(F.col("event_id") * 37 % 60000 - 30000, 2),
        F.lit("0D04"), part(lat, 4), F.lit("0E04"), part(lon, 4), F.lit("0F02"), part(F.col("event_id") % 65536, 2),
    )
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), F.lit(0).alias("stream"), F.unhex(F.concat(F.lit(packets.KEY.hex()), F.lit("26"), body)).alias("payload"))


_RAW = {
    "heading": "(event_id * 257 % 65536) * 360.0 / 65535", "pitch": "(event_id * 31 % 60000 - 30000) * 20.0 / 32767", "roll": "(event_id * 37 % 60000 - 30000) * 50.0 / 32767",
    "y": "(event_id * 7919 % 2000000 - 1000000) * 90.0 / 2147483647", "x": "(event_id * 104729 % 2000000 - 1000000) * 180.0 / 2147483647", "z": "-900.0 + (event_id % 65536) * 19900.0 / 65535",
}


@query("k1_packets", "SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) AS time_us, " + ", ".join(f"round({v}, {9 if k in 'xy' else 6}) AS {k}" for k, v in _RAW.items()) + " FROM events")
def k1(spark, d):
    return packets.packet_rows(_packets(spark, d)).select("video_id", "seq", "time_us", *(F.round(k, 9 if k in "xy" else 6).alias(k) for k in _RAW))


@query("k4_packet_summary", "SELECT user_id AS video_id, count(*) AS n_packets, epoch_us(arg_min(ts, event_id)) AS first_us, epoch_us(arg_max(ts, event_id)) AS last_us FROM events GROUP BY 1")
def k4(spark, d):
    return packets.packet_summary(packets.packet_rows(_packets(spark, d))).select("video_id", "n_packets", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


_K4 = " UNION ALL ".join(f"SELECT user_id AS video_id, '{k}' AS field, {v} AS v FROM events" for k, v in _RAW.items())
_ROUNDED = ("min", "max", "range", "mean", "median", "std_dev", "q1", "q3")


@query("k4_packet_statistics", f"SELECT video_id, field, n, {', '.join(f'{c} + 0.0 AS {c}' for c in _ROUNDED)} FROM (SELECT video_id, field, {_STATS4} FROM ({_K4}) GROUP BY 1, 2)".replace("min +", '"min" +').replace("max +", '"max" +').replace("range +", '"range" +').replace("AS min", 'AS "min"').replace("AS max", 'AS "max"').replace("AS range", 'AS "range"'))
def k4b(spark, d):
    return packets.packet_statistics(packets.packet_rows(_packets(spark, d))).select("video_id", "field", "n", *((F.col(c) + 0.0).alias(c) for c in _ROUNDED))  # no negative zeros


# --- jobs --------------------------------------------------------------------------------------------------------
_E1 = f"SELECT * FROM (WITH e AS (SELECT deployment_id, count(*) AS n_rows, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM v_telemetry GROUP BY 1), m AS (SELECT deployment_id, round(quantile_cont(gap_s, 0.5), 6) AS median_s FROM ({_GAPS}) WHERE gap_s IS NOT NULL GROUP BY 1), g AS (SELECT deployment_id, {_STATS.replace('AS n,', 'AS n_gaps,', 1)} FROM (SELECT deployment_id, gap_s AS v FROM ({_W1})) GROUP BY 1) SELECT e.*, m.median_s, coalesce(g.n_gaps, 0) AS n_gaps, round(g.min, 4) AS gap_min, round(g.max, 4) AS gap_max, g.mean AS gap_mean, g.median AS gap_median FROM e LEFT JOIN m USING (deployment_id) LEFT JOIN g USING (deployment_id))"


def _inspected(table):
    return table.withColumns({"start_us": F.unix_micros("start"), "end_us": F.unix_micros("end"), "median_s": F.round("median_s", 6)})


_INSPECTED = (DEP, "n_rows", "start_us", "end_us", "duration_s", "median_s", "n_gaps", "gap_min", "gap_max", "gap_mean", "gap_median")


@query("e1_inspect", _E1, "v_telemetry")
def e1(spark, d):
    return _inspected(jobs.inspect(_t(spark, d))).select(*_INSPECTED)


_SEEN = "SELECT deployment_id, CASE WHEN deployment_id % 3 = 0 THEN 'embedded' WHEN deployment_id % 3 = 1 THEN 'container' ELSE 'sensor' END AS start_source, CASE WHEN deployment_id % 3 = 2 THEN start_us ELSE start_us + 3600000000 END AS vs_us, end_us AS se_us, n_gaps FROM i"


@query("e1_coverage", f"SELECT * FROM (WITH i AS ({_E1}), v AS ({_SEEN}), c AS (SELECT *, vs_us // 1000000 AS vs, (vs_us + 864000000000) // 1000000 AS ve, start_us // 1000000 AS ss, se_us // 1000000 AS se FROM v JOIN (SELECT deployment_id, start_us FROM i) USING (deployment_id)), o AS (SELECT *, greatest(vs, ss) AS os, least(ve, se) AS oe FROM c) SELECT deployment_id, start_source, CASE WHEN os < oe THEN os END AS overlap_start, CASE WHEN os < oe THEN oe END AS overlap_end, CASE WHEN os < oe THEN round(100.0 * (oe - os) / (ve - vs), 1) END AS coverage_pct, array_to_string(list_sort(list_filter([CASE WHEN NOT os < oe THEN 'no overlap' END, CASE WHEN os < oe AND 100.0 * (oe - os) / (ve - vs) < 99.9 THEN 'partly covered' END, CASE WHEN start_source = 'sensor' THEN 'start taken from the sensor' END, CASE WHEN os < oe AND n_gaps > 0 THEN 'sensor has gaps' END], lambda x: x IS NOT NULL)), ';') AS warnings FROM o)", "v_telemetry")
def e1b(spark, d):
    e = timeline.extent(_t(spark, d))
    late, none = F.col("start") + F.expr("INTERVAL 1 HOUR"), F.lit(None).cast("timestamp")
    videos = e.select(DEP, none.alias("override_start"), F.when(F.col(DEP) % 3 == 0, late).alias("embedded_start"), F.when(F.col(DEP) % 3 == 1, late).alias("container_start"), none.alias("embedded_end"), F.lit(864000.0).alias("duration_s"))
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return jobs.inspect(_t(spark, d), videos).select(DEP, "start_source", seconds("overlap_start"), seconds("overlap_end"), "coverage_pct", F.array_join("warnings", ";").alias("warnings"))


def _raw_log(spark, d):
    us = F.unix_micros("ts").cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    return _t(spark, d).select(DEP, "row_no", us.alias("UTC"), text("x").alias("Lon"), F.when(F.col("row_no") % 50 == 0, "unknown").otherwise(text("y")).alias("Lat"), text("z").alias("Depth"), text("heading").alias("COG"), text("pitch").alias("Tilt"), text("roll").alias("Roll"), F.when(F.col("row_no") % 2 == 0, F.col("row_no").cast("string")).otherwise("-").alias("own"))


@query("e1_reports", "SELECT deployment_id, count(*) AS n_rows, 7 AS n_mapped, count(z) AS n_z, round(median(pitch), 4) AS pitch_median FROM v_telemetry WHERE row_no % 50 <> 0 GROUP BY 1", "v_telemetry")
def e1c(spark, d):
    made = jobs.inspection_reports(_raw_log(spark, d))
    fields = F.from_json(F.get_json_object("report_json", "$.fields"), "array<struct<field:string,n:bigint,median:double>>")
    one = lambda name: F.get(F.filter(fields, lambda x: x["field"] == name), F.lit(0))
    mapped = F.from_json(F.get_json_object("report_json", "$.suggested_mapping"), "array<struct<target:string,source:string>>")
    return made.select(DEP, F.get_json_object("report_json", "$.n_rows").cast("bigint").alias("n_rows"), F.size(mapped).alias("n_mapped"), F.coalesce(one("z")["n"], F.lit(0)).cast("bigint").alias("n_z"), one("pitch")["median"].alias("pitch_median"))


_E2 = {
    "deployment_id": "deployment_id", "ObjectID": "row_number() OVER (PARTITION BY deployment_id ORDER BY us, row_no) - 1", "Precision Time Stamp": "us", "Sensor Longitude": "round(x, 6)", "Sensor Latitude": "round(y, 6)", "Sensor True Altitude": "round(z, 6)",
    "Platform Pitch Angle (Full)": "pitch", "Platform Roll Angle (Full)": "roll", **_CAMERA, **_NONE,
}


@query("e1_joined_logs", f"SELECT * FROM (WITH s AS ({_SECOND}), w AS (SELECT deployment_id, greatest(quantile_cont(g, 0.5) / 2, 0.05) AS tol FROM (SELECT deployment_id, (us - lag(us) OVER (PARTITION BY deployment_id ORDER BY us, row_no)) / 1e6 AS g FROM s) WHERE g > 0 GROUP BY 1), p AS (SELECT deployment_id, row_no, epoch_us(ts) AS t FROM v_telemetry WHERE row_no % 2 = 0), b AS (SELECT p.*, k.us AS bt FROM p ASOF LEFT JOIN s k ON p.deployment_id = k.deployment_id AND p.t > k.us), f AS (SELECT b.*, k.us AS ft FROM b ASOF LEFT JOIN s k ON b.deployment_id = k.deployment_id AND b.t <= k.us) SELECT f.deployment_id, count(*) AS joined_rows, count(*) FILTER (least(coalesce(t - bt, 9e18), coalesce(ft - t, 9e18)) / 1e6 <= w.tol) AS joined_matches FROM f LEFT JOIN w USING (deployment_id) GROUP BY 1)", "v_telemetry", "v_telemetry_raw")
def e1d(spark, d):
    first = _t(spark, d).where("row_no % 2 = 0").select(DEP, "row_no", F.col("ts").alias("UTC"), F.col("z").alias("x_text"))
    second = view(spark, d, "v_telemetry_raw").where("row_no % 3 = 0 AND row_no % 20 <> 4").select(DEP, "row_no", F.col("time_text").alias("Time"), "x_text")
    return jobs.joined_logs(first, second)["summary"].drop("joined_pct")


@query("e2_video_metadata", f"SELECT {_columns(_E2)}, round(CASE WHEN c.heading_mode = 'from_track' THEN coalesce(CASE WHEN nx IS NULL THEN lag(b) OVER v ELSE b END, c.heading_constant) ELSE c.heading_constant END, 3) AS \"Platform Heading Angle\" FROM (SELECT *, CASE WHEN nx <> x OR ny <> y THEN ((degrees(atan2(nx - x, ny - y)) % 360) + 360) % 360 END AS b FROM (SELECT *, lead(x) OVER v AS nx, lead(y) OVER v AS ny FROM (SELECT deployment_id, row_no, us, x, y, z, pitch, roll FROM ({_W6.replace('round(x + (x2 - x) * f, 6)', 'x + (x2 - x) * f').replace('round(y + (y2 - y) * f, 6)', 'y + (y2 - y) * f')})) WINDOW v AS (PARTITION BY deployment_id ORDER BY us, row_no))) JOIN {_PROFILE_ROWS} ON c.i = deployment_id % 7 WINDOW v AS (PARTITION BY deployment_id ORDER BY us, row_no)", "v_telemetry")
def e2(spark, d):
    made = jobs.build_video_metadata(_t(spark, d), _deployments(spark, d), 3600.0).drop("AcquisitionDate")
    return made.withColumns({**{f"Sensor {c}": F.round(f"Sensor {c}", 6) for c in ("Longitude", "Latitude", "True Altitude")}, "Platform Heading Angle": F.round("Platform Heading Angle", 3)})


_S7 = {**_P15, "Near Distance": "coalesce(CASE WHEN row_no % 2 = 0 THEN CAST(row_no AS DOUBLE) END, c.near_distance)", "Platform Heading Angle": "CASE WHEN c.heading_mode = 'from_track' THEN round(coalesce(heading, CASE WHEN is_last THEN lag(coalesce(heading, " + _BEAR + ")) OVER v ELSE " + _BEAR + " END, c.heading_constant), 3) ELSE coalesce(heading, c.heading_constant) END"}


@query("s7_video_metadata_files", f"SELECT {_columns({k: v for k, v in _S7.items() if k not in ('AcquisitionDate', 'Filename')})} FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(row_no) OVER w IS NULL AS is_last FROM v_telemetry WHERE row_no % 50 <> 0 WINDOW w AS (PARTITION BY deployment_id ORDER BY ts, row_no)) JOIN {_PROFILE_ROWS} ON c.i = deployment_id % 7 WINDOW v AS (PARTITION BY deployment_id ORDER BY ts, row_no)", "v_telemetry")
def s7(spark, d):
    path = _fresh(spark)
    dropped = jobs.video_metadata_table(_raw_log(spark, d), _deployments(spark, d), path, [("own", "Near Distance"), ("own", "ObjectID"), ("none", "Near Distance")])
    assert sorted(r["reason"] for r in dropped.collect()) == ["absent source", "reserved target"]
    kinds = {"LONG": "bigint", "DOUBLE": "double", "TEXT": "string", "DATE": "timestamp"}
    read = spark.read.csv(path, header=True, schema=", ".join([*(f"`{c}` {kinds[k]}" for c, k in profiles.VIDEO_FIELDS.items()), f"{DEP} bigint"]))
    return read.drop("AcquisitionDate", "Filename").withColumn("Platform Heading Angle", F.when(F.col(DEP) % 7 != 4, F.round("Platform Heading Angle", 3)).otherwise(F.col("Platform Heading Angle")))


_RERUN = {"ObjectID": "CASE WHEN f.row_no % 2 = 0 THEN row_number() OVER (PARTITION BY f.deployment_id, f.row_no % 2 = 0 ORDER BY f.filename, f.row_no) ELSE count(*) FILTER (f.row_no % 2 = 0) OVER (PARTITION BY f.deployment_id) + row_number() OVER (PARTITION BY f.deployment_id, f.row_no % 2 = 0 ORDER BY f.filename, f.row_no) END", **_P23}
_AGAIN = "NOT (f.row_no % 2 <> 0 AND EXISTS (SELECT 1 FROM v_frames o WHERE o.row_no % 2 = 0 AND o.deployment_id = f.deployment_id AND o.filename = f.filename))"


@query("e3_cross_reference", f"SELECT {_columns(_RERUN)} {_FRAME_TABLE} WHERE {_AGAIN}", "v_telemetry", "v_frames")
def e3(spark, d):
    first = tables.written(jobs.cross_reference(_frames(spark, d).where(_EARLIER), _t(spark, d), tolerance_s=3600.0, crs=3857))
    return _rounded(jobs.cross_reference(_frames(spark, d), _t(spark, d), first, tolerance_s=3600.0, crs=3857))


@query("s8_cross_reference_files", f"SELECT deployment_id, kind, count(*) AS n, sum(number) AS total FROM (SELECT f.deployment_id, 'frames' AS kind, CASE WHEN {_HIT} THEN CAST(t.pitch AS BIGINT) END AS number {_FRAME_TABLE} UNION ALL SELECT deployment_id, 'cameras', 640 FROM (SELECT DISTINCT deployment_id FROM v_telemetry) UNION ALL SELECT f.deployment_id, 'matched', CAST(t.pitch AS BIGINT) {_FRAME_TABLE} WHERE {_HIT}) GROUP BY 1, 2", "v_telemetry", "v_frames")
def s8(spark, d):
    path = _fresh(spark)
    raw = _t(spark, d).select(DEP, "row_no", F.unix_micros("ts").cast("string").alias("UTC"), F.col("x").alias("Longitude"), F.col("y").alias("Latitude"), F.col("pitch").alias("Pitch"))
    jobs.cross_reference_tables(_frames(spark, d), raw, path, camera={"NCols": 640.0}, tolerance_s=3600.0)
    read = lambda kind, c: spark.read.csv(f"{path}/{kind}", header=True).select(F.col(DEP).cast("bigint"), F.lit(kind).alias("kind"), F.col(c).cast("double").cast("bigint").alias("number"))
    every = read("frames", "CameraPitch").union(read("cameras", "NCols")).union(read("matched", "Pitch"))
    return every.groupBy(DEP, "kind").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


_P23_FILES = {k: v.replace("t.z", "NULL::DOUBLE").replace("t.heading", "NULL::DOUBLE").replace("t.roll", "NULL::DOUBLE") for k, v in _P23.items()}


def _frame_files(spark, d, **options) -> str:
    """The tables of a cross-reference run as files."""
    path = _fresh(spark)
    raw = _t(spark, d).select(DEP, "row_no", F.unix_micros("ts").cast("string").alias("UTC"), F.col("x").alias("Longitude"), F.col("y").alias("Latitude"), F.col("pitch").alias("Pitch"))
    jobs.cross_reference_tables(_frames(spark, d), raw, path, camera={"NCols": 640.0}, tolerance_s=3600.0, **options)
    return path


@query("s8_frame_files", f"SELECT {_columns({'ObjectID': 'row_number() OVER (PARTITION BY f.deployment_id ORDER BY f.filename, f.row_no)', **_P23_FILES})} {_FRAME_TABLE}", "v_telemetry", "v_frames")
def s8b(spark, d):
    path = _frame_files(spark, d, crs=3857)
    made = _matched(spark, d)
    kinds = {c: k for c, k in made.dtypes if c != DEP}
    read = spark.read.csv(f"{path}/frames", header=True, schema=", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), f"{DEP} bigint"]))
    return _rounded(read.select(made.columns))


@query("s8_matched_files", f"SELECT f.deployment_id, epoch_us(t.ts) AS us, t.x, t.y, t.pitch, count(*) AS n_frames {_FRAME_TABLE} WHERE {_HIT} GROUP BY ALL", "v_telemetry", "v_frames")
def s8c(spark, d):
    path = _frame_files(spark, d)
    read = spark.read.csv(f"{path}/matched", header=True, schema=f"us bigint, x double, y double, pitch double, {DEP} bigint")
    return read.groupBy(DEP, "us", "x", "y", "pitch").agg(F.count("*").alias("n_frames"))


def _sets(spark, d, **options):
    rows = _items(spark, d).withColumn("path", F.concat(F.lit("a/"), F.col("filename"))).withColumn("camera_id", F.col("row_no") % 12)
    inventory = rows.where("row_no % 10 <> 0").select("set_id", "path")
    hashes = inventory.select("path").distinct().select("path", F.sha2("path", 256).alias("sha256"))
    return jobs.image_sets(rows, view(spark, d, "v_cameras"), inventory, hashes, _headers(spark, d), pair=("Latitude", "Longitude"), **options)


@query("e4_image_sets", "SELECT deployment_id AS set_id, count(*) OVER w AS n_items, 'x' AS name, round(min(y) OVER w, 6) AS low_latitude, concat(row_no, '.tif') AS filename, y AS latitude, x AS longitude, z AS altitude, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS taken, CASE WHEN row_no % 5 <> 0 THEN pitch END AS pitch, md5(concat(deployment_id, '/', row_no, '.tif')) AS id, sha256(concat('a/', row_no, '.tif')) AS sha256 FROM v_telemetry WHERE row_no % 10 <> 0 WINDOW w AS (PARTITION BY deployment_id)", "v_telemetry")
def e4(spark, d):
    parts = {"latitude": "double", "longitude": "double", "altitude-meters": "double", "datetime": "string", "camera-pitch-degrees": "double", "uuid": "string", "hash-sha256": "string"}
    listed = F.from_json(F.get_json_object("document", "$.image-set-items"), f"map<string,struct<{','.join(f'`image-{c}`:{k}' for c, k in parts.items())}>>")
    head = lambda f: F.get_json_object("document", f"$.image-set-header.{f}")
    rows = _sets(spark, d)["documents"].select("set_id", F.col("n_items").cast("bigint").alias("n_items"), head("image-set-name").alias("name"), F.round(head("image-set-min-latitude-degrees").cast("double"), 6).alias("low_latitude"), listed.alias("items"))
    return rows.select("set_id", "n_items", "name", "low_latitude", F.explode("items").alias("filename", "i")).select("set_id", "n_items", "name", "low_latitude", "filename", *(F.col("i")[f"image-{c}"].alias(a) for c, a in zip(parts, ("latitude", "longitude", "altitude", "taken", "pitch", "id", "sha256"), strict=True))).withColumn("id", F.replace("id", F.lit("-"), F.lit("")))


@query("e4_rerun", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, CASE WHEN row_no % 4 = 0 THEN 'old' ELSE md5(concat(deployment_id, '/', row_no, '.tif')) END AS id, CASE WHEN row_no % 3 <> 0 THEN y END AS latitude FROM v_telemetry WHERE row_no % 10 <> 0 AND (row_no % 3 <> 0 OR row_no % 4 = 0)", "v_telemetry")
def e4c(spark, d):
    rows = _items(spark, d).withColumns({"path": F.concat(F.lit("a/"), F.col("filename")), "camera_id": F.lit(1)})
    inventory = rows.where("row_no % 10 <> 0").select("set_id", "path")
    hashes = inventory.select("path", F.lit("h").alias("sha256")).distinct()
    earlier = rows.where("row_no % 4 = 0").select("set_id", "filename", F.lit("old").alias("uuid"))
    made = jobs.image_sets(rows.where("row_no % 3 <> 0"), view(spark, d, "v_cameras"), inventory, hashes, _headers(spark, d), earlier, pair=("Latitude", "Longitude"))
    return made["items"].select("set_id", "filename", F.replace("uuid", F.lit("-"), F.lit("")).alias("id"), F.col("image-latitude").alias("latitude"))


@query("e4_issues", "SELECT deployment_id AS set_id, NULL::VARCHAR AS filename, 'image-abstract' AS field, 'missing required field' AS issue FROM (SELECT DISTINCT deployment_id FROM v_telemetry) UNION ALL SELECT DISTINCT deployment_id, NULL, 'image-quality', 'not an allowed value' FROM v_telemetry WHERE deployment_id % 2 = 1 UNION ALL SELECT deployment_id, concat(row_no, '.tif'), 'image-handle', 'missing required field' FROM v_telemetry WHERE row_no % 10 <> 0", "v_telemetry")
def e4b(spark, d):
    return _sets(spark, d)["issues"]


@query("e3_image_sets", f"SELECT deployment_id AS set_id, filename, CASE WHEN hit THEN y END AS lat, CASE WHEN hit THEN x END AS lon FROM (SELECT f.deployment_id, f.filename, t.x, t.y, {_HIT} AS hit {_FRAME_TABLE} WHERE f.row_no % 4 <> 0)", "v_telemetry", "v_frames")
def e3c(spark, d):
    f, t = _frames(spark, d), _t(spark, d)
    raw = t.select(DEP, "row_no", F.unix_micros("ts").cast("string").alias("UTC"), F.col("x").cast("string").alias("Sensor Longitude"), F.col("y").cast("string").alias("Sensor Latitude"))
    there = f.where("row_no % 4 <> 0").select(F.col(DEP).alias("set_id"), F.concat(F.lit("img/"), F.col("filename")).alias("path")).distinct()
    heads = f.select(F.col(DEP).alias("set_id")).distinct().select("set_id", F.create_map(F.lit("image-set-name"), F.lit("s")).alias("header"))
    hashes = there.select("path", F.sha2("path", 256).alias("sha256"))
    path = _fresh(spark)
    options = {"camera": {"NCols": 640.0}, "tolerance_s": 3600.0}
    totals, made = jobs.cross_reference_sets(f, raw, path, there, hashes, heads, **options)
    done = tables.written(jobs.cross_reference(f, t, tolerance_s=3600.0))
    again, nothing = jobs.cross_reference_sets(f, raw, f"{path}/again", there, hashes, heads, done, **options)
    assert not nothing and again.exceptAll(totals).isEmpty() and totals.exceptAll(again).isEmpty()
    return made["items"].select("set_id", "filename", F.col("image-latitude").alias("lat"), F.col("image-longitude").alias("lon"))



@query("s9_annotation_files", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken_at, x AS lng, y AS lat, z AS gps_altitude, CASE WHEN row_no % 5 <> 0 THEN heading END AS \"SUB_heading\", 'x' AS manifest_settings FROM v_telemetry WHERE row_no % 10 <> 0", "v_telemetry")
def s9(spark, d):
    path = _fresh(spark)
    jobs.write_image_sets(_sets(spark, d, settings="x"), path, "Per-Image documents")
    kinds = "filename string, taken_at string, lng double, lat double, gps_altitude double, distance_to_ground double, area double, SUB_heading double, set_id bigint"
    rows = spark.read.csv(f"{path}/biigle", header=True, schema=kinds)
    images = spark.read.json(f"{path}/documents", schema="name string, document string, set_id bigint").select("set_id", F.regexp_replace("name", r"\.ifdo\.json$", "").alias("filename"))
    settings = ordered.read_in_order(spark, f"{path}/manifests").groupBy("set_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]), "").alias("value")).select("set_id", F.get_json_object("value", "$.settings").alias("manifest_settings"))
    return rows.join(images, ["set_id", "filename"]).join(settings, "set_id").select("set_id", "filename", "taken_at", "lng", "lat", "gps_altitude", "SUB_heading", "manifest_settings")


@query("e4_skipped", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename FROM v_telemetry WHERE row_no % 10 = 0", "v_telemetry")
def e4c(spark, d):
    return _sets(spark, d)["skipped"]


@query("e4_joined", "SELECT t.deployment_id AS set_id, t.row_no, concat('a/', t.row_no, '.tif') AS path, t.row_no % 12 AS frame_camera, c.row_no AS camera_row, c.camera_id, c.ncols, c.nrows, c.focal_length, c.pixel_size FROM v_telemetry t LEFT JOIN v_cameras c ON CAST(c.camera_id AS BIGINT) = t.row_no % 12 WHERE t.row_no % 10 <> 0", "v_telemetry", "v_cameras")
def e4d(spark, d):
    made = _sets(spark, d)["joined"]
    return made.select(F.col("Frame_set_id").alias("set_id"), F.col("Frame_row_no").alias("row_no"), F.col("Frame_path").alias("path"), F.col("Frame_camera_id").alias("frame_camera"), F.col("Camera_row_no").alias("camera_row"), *(F.col(f"Camera_{c}").alias(c) for c in ("camera_id", "ncols", "nrows", "focal_length", "pixel_size")))


@query("e4_xml", "SELECT deployment_id AS set_id, concat(row_no, '.tif') AS filename, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS taken, md5(concat(deployment_id, '/', row_no, '.tif')) AS id, sha256(concat('a/', row_no, '.tif')) AS sha256 FROM v_telemetry WHERE row_no % 10 <> 0", "v_telemetry")
def e4e(spark, d):
    items = tables.xml_items(_sets(spark, d)["xml"].withColumn("source_no", F.lit(0)), "iFDO")
    at = lambda k: F.element_at("item", F.lit(k))
    return items.select("set_id", "filename", at("image-datetime").alias("taken"), F.replace(at("image-uuid"), F.lit("-"), F.lit("")).alias("id"), at("image-hash-sha256").alias("sha256"))


@query("e4_document_files", "SELECT deployment_id AS set_id, count(*) OVER (PARTITION BY deployment_id) + 2 AS n_lines, row_number() OVER (PARTITION BY deployment_id ORDER BY concat(row_no, '.tif')) AS place, concat(row_no, '.tif') AS filename FROM v_telemetry WHERE row_no % 10 <> 0", "v_telemetry")
def e4f(spark, d):
    path = _fresh(spark)
    tables.write_documents(_sets(spark, d)["lines"], path)
    lines = ordered.read_in_order(spark, path)
    n = lines.groupBy("set_id").agg(F.count("*").alias("n_lines"))
    each = lines.select("set_id", "place", F.regexp_extract("value", r'^,?"([^"]+[.]tif)":\{', 1).alias("filename")).where("filename <> ''")
    return each.join(n, "set_id").select(F.col("set_id").cast("bigint"), "n_lines", "place", "filename")


_E5 = {
    "set_id": "deployment_id", "row_no": "row_no", "Name": "concat(row_no, '.tif')", "ImagePath": "concat('a/', row_no, '.tif')", "CameraHeading": "round(heading, 6)", "CameraPitch": "0.0", "CameraRoll": "0.0", "CameraHeight": "200.0", "height_source": "'category'", "HorizontalFieldOfView": "60.0",
    "VerticalFieldOfView": "40.0", "NearDistance": "1.0", "FarDistance": "500.0", "OrientedImageryType": "'Nadir'", "x": "x", "y": "y", "z": "0.0", "SourceHorizontalSRS": "NULL::VARCHAR", "SourceVerticalSRS": "NULL::VARCHAR", "CameraID": "NULL::VARCHAR",
    "SequenceOrder": "row_number() OVER (PARTITION BY deployment_id ORDER BY row_no)", "ifdo_image_quality": "CASE WHEN deployment_id % 2 = 0 THEN 'raw' END",
}


@query("e5_imagery_tables", f"SELECT {_columns(_E5)} FROM (SELECT * EXCLUDE heading, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING), 0.0) AS heading FROM (SELECT *, coalesce(heading, {_BEAR}) AS b FROM ({_W4}))) WHERE row_no % 4 <> 0", "v_telemetry")
def e5(spark, d):
    rows = _t(spark, d).select(F.col(DEP).alias("set_id"), "row_no", "ts", "x", "y", "z", "heading", F.lit(2.0).alias("camera_height"), F.lit(60.0).alias("hfov"), F.lit(40.0).alias("vfov"), F.lit("3857").alias("srs"), F.concat(F.lit("a/"), F.col("row_no"), F.lit(".tif")).alias("path"))
    xml = tables.image_xml(rows.where("set_id % 2 = 0").select("set_id", n.basename(F.col("path")).alias("filename"), F.lit("iFDO").alias("domain"), F.lit(1).alias("version"), F.create_map(F.lit("image-quality"), F.lit("raw")).alias("item")))
    sources = tables.enrichment_sources(xml.select("set_id", F.concat(F.lit("m/"), F.col("filename"), F.lit(".aux.xml")).alias("path"), F.col("xml").alias("text")))
    made = jobs.imagery_tables(rows, "Nadir", rows.where("row_no % 4 = 0").select(F.concat(F.lit("./b/../"), F.upper("path")).alias("path")), sources=sources)
    return made["oriented"].select(*(F.col(c).cast("bigint").alias(c) if c == "SequenceOrder" else F.round(c, 6).alias(c) if c == "CameraHeading" else F.col(c) for c in _E5))


@query("e5_catalogue", f"SELECT deployment_id AS set_id, concat(row_no, '.tif') AS \"Name\", {_BOX} FROM (SELECT *, abs(cos(radians(heading))) AS c, abs(sin(radians(heading))) AS s, 2.0 * tan(radians(30.0)) AS hw, 2.0 * tan(radians(20.0)) AS hh FROM (SELECT * EXCLUDE heading, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY row_no ROWS UNBOUNDED PRECEDING), 0.0) AS heading FROM (SELECT *, coalesce(heading, {_BEAR}) AS b FROM ({_W4})))) WHERE deployment_id % 2 = 1", "v_telemetry")
def e5b(spark, d):
    rows = _boxes(spark, d).drop("xMin", "xMax", "yMin", "yMax", "heading").join(_t(spark, d).select("row_no", "heading"), "row_no").withColumns({"camera_height": F.lit(2.0), "srs": F.when(F.col("set_id") % 2 == 0, "4326").otherwise("3857")})
    made = jobs.imagery_tables(rows, "Nadir")
    return made["catalogue"].select("set_id", "Name", *(F.round(c, 6).alias(c) for c in ("xMin", "xMax", "yMin", "yMax")))


@query("e5_systems", "SELECT deployment_id AS set_id, row_no, CASE WHEN deployment_id % 5 IN (1, 2, 3) THEN 'rejected' ELSE 'catalogue' END AS went FROM v_telemetry", "v_telemetry")
def e5c(spark, d):
    srs = F.get(F.array(F.lit("3857"), F.lit("4326"), F.lit("4269;5773"), F.lit('GEOGCS["WGS 84"]'), F.lit(None)), (F.col("set_id") % 5).cast("int"))
    made = jobs.imagery_tables(_boxes(spark, d).drop("xMin", "xMax", "yMin", "yMax").withColumn("srs", srs), "Nadir", segment_rows=50)
    row = F.regexp_extract("Name", r"^(\d+)", 1).cast("bigint").alias("row_no")
    return made["catalogue"].select("set_id", row, F.lit("catalogue").alias("went")).union(made["rejected"].select("set_id", "row_no", F.lit("rejected")))


@query("r1_incremental", f"SELECT DISTINCT f.deployment_id, f.filename AS \"Filename\", delta_s AS \"MatchTimeDeltaSeconds\", t.pitch AS \"CameraPitch\" {_FRAME_TABLE} WHERE {_HIT}", "v_telemetry", "v_frames")
def r1(spark, d):
    path = _fresh(spark)
    arrived = F.timestamp_seconds(F.col("row_no"))
    for part in (0, 1):
        _frames(spark, d).where(F.col("row_no") % 2 == part).withColumn("arrived", arrived).write.mode("append").parquet(f"{path}/arriving")
    frames_in = spark.readStream.schema("deployment_id bigint, row_no bigint, filename string, camera_id string, arrived timestamp").option("maxFilesPerTrigger", 1000).parquet(f"{path}/arriving")
    incremental.match_stream(frames_in, _t(spark, d), f"{path}/tables", tolerance_s=3600.0).awaitTermination()
    return spark.read.parquet(f"{path}/tables/matched").select(DEP, "Filename", "MatchTimeDeltaSeconds", "CameraPitch")


@query("r1_stateful", f"SELECT {_columns({k: v for k, v in _P23.items()})}, CASE WHEN {_ELAPSED} IS NULL THEN 'no time' ELSE 'found' END AS status {_FRAME_TABLE}", "v_telemetry", "v_frames")
def r1b(spark, d):
    """Both sides in three batches, telemetry out of order by as much as ``delay_s``, frames before their telemetry; the
    stream is stopped after the first batches and goes on from its checkpoint."""
    path = _fresh(spark)
    t, f = _t(spark, d), _frames(spark, d).select(DEP, "row_no", "filename")
    parts = lambda df, by: [df.where(by == k) for k in range(3)]
    month = F.pmod(F.floor(F.unix_micros("ts") / F.lit(20 * 86400e6)).cast("int") + F.col("row_no") % 2, F.lit(3))
    for k, (rows, asks) in enumerate(zip(parts(t, month), parts(f, F.col("row_no") % 3), strict=True)):
        rows.write.mode("append").parquet(f"{path}/telemetry")
        asks.write.mode("append").parquet(f"{path}/frames")
        done = t.select(DEP).unionByName(f.select(DEP)).distinct() if k == 2 else t.select(DEP).limit(0)
        done.write.mode("append").parquet(f"{path}/ends")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/{name}") for name, df in (("frames", f), ("telemetry", t), ("ends", done))]
        made = stateful.matched_stream(streams[0], streams[1], 3600.0, ends=streams[2], delay_s=400 * 86400.0, crs=3857)
        made.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.read.parquet(f"{path}/table"))
