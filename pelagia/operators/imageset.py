"""Image sets: item fields, headers, documents, their rules, identities and annotation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.functions.normalize import any_time, basename, clean, first_number, first_value, is_geographic, iso_time, to_number

# Source columns in order of preference.
ALTITUDE = ["Sensor Altitude", "Platform Altitude", "Altitude", "PerspectiveZ"]
TIMES = ["Precision Time Stamp", "Time", "Timestamp", "DateTime"]
YAW = ["Yaw", "Heading", "Platform Heading", "Camera Heading", "Camera Yaw"]
PITCH = ["Pitch", "Platform Pitch", "Camera Pitch"]
ROLL = ["Roll", "Platform Roll", "Camera Roll"]
TO_GROUND = ["Camera Height Above Seafloor", "CameraHeight", "Distance To Ground", "Altitude Above Seafloor"]
AREA = ["Area", "Footprint Area", "Ground Area"]
# Fields that the document standard requires.
HEADER_FIELDS = (
    "image-set-name", "image-set-uuid", "image-set-handle", "image-set-ifdo-version", "image-datetime", "image-latitude", "image-longitude",
    "image-altitude-meters", "image-coordinate-reference-system", "image-coordinate-uncertainty-meters", "image-context", "image-project",
    "image-event", "image-platform", "image-sensor", "image-pi", "image-creators", "image-license", "image-copyright", "image-abstract",
)
ITEM_FIELDS = ("image-uuid", "image-hash-sha256", "image-handle")
OBJECT_FIELDS = ("image-context", "image-project", "image-event", "image-platform", "image-sensor", "image-pi", "image-license")
ARRAY_FIELDS = ("image-creators",)
# The standard's controlled vocabularies.
VOCABULARIES = {
    "image-acquisition": ("photo", "video", "slide"),
    "image-quality": ("raw", "processed", "product"),
    "image-deployment": ("mapping", "stationary", "survey", "exploration", "experiment", "sampling"),
    "image-navigation": ("satellite", "beacon", "transponder", "reconstructed"),
    "image-scale-reference": ("3D camera", "calibrated camera", "laser marker", "optical flow"),
    "image-illumination": ("sunlight", "artificial light", "mixed light"),
    "image-pixel-magnitude": ("km", "hm", "dam", "m", "dm", "cm", "mm", "µm"),
    "image-marine-zone": ("seafloor", "water column", "sea surface", "atmosphere", "laboratory"),
    "image-spectral-resolution": ("grayscale", "rgb", "multi-spectral", "hyper-spectral"),
    "image-capture-mode": ("timer", "manual", "mixed"),
    "image-fauna-attraction": ("none", "baited", "light"),
}


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    have = {c.lower(): c for c in df.columns}
    return [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]


def lat_lon(df: DataFrame, pair: tuple[str, str] | None, srs: str | None) -> Column:
    """P10: struct (lat, lon): the pair of columns, else PerspectiveY/X where the system is geographic."""
    made = lambda a, b, when: F.when(when & a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon")))
    parts = []
    if pair:
        parts.append(made(to_number(F.col(f"`{pair[0]}`")), to_number(F.col(f"`{pair[1]}`")), F.lit(True)))
    px, py = _present(df, ["PerspectiveX"]), _present(df, ["PerspectiveY"])
    if px and py and srs:
        parts.append(made(to_number(py[0]), to_number(px[0]), is_geographic(F.col(f"`{srs}`"))))
    return F.coalesce(*parts) if parts else F.lit(None).cast("struct<lat:double,lon:double>")


def orientation(df: DataFrame) -> Column:
    """omega/phi/kappa as a whole where any of them is there, else yaw/pitch/roll; never both."""
    o, p, k = (first_number(_present(df, [n])) for n in ("Omega", "Phi", "Kappa"))
    y, i, r = (first_number(_present(df, n)) for n in (YAW, PITCH, ROLL))
    none = F.lit(None).cast("double")
    made = lambda kind, *v: F.struct(F.lit(kind).alias("convention"), *(c.alias(n) for n, c in zip(("omega", "phi", "kappa", "yaw", "pitch", "roll"), v, strict=True)))
    return F.when(F.coalesce(o, p, k).isNotNull(), made("omega_phi_kappa", o, p, k, none, none, none)).when(F.coalesce(y, i, r).isNotNull(), made("yaw_pitch_roll", none, none, none, y, i, r))


def item_fields(df: DataFrame, keep: Sequence[str], pair: tuple[str, str] | None = None, srs: str | None = None, given: str | None = None) -> DataFrame:
    """The document's item fields of each row. ``given`` names a map column of values that the user gives: they
    count before computed ones; its other keys stay in ``image-other-fields``."""
    rows = df.select("*", lat_lon(df, pair, srs).alias("_ll"), orientation(df).alias("_o"))
    area = first_number(_present(df, AREA))
    fields = {
        "image-latitude": F.col("_ll.lat"), "image-longitude": F.col("_ll.lon"), "image-coordinate-reference-system": F.when(F.col("_ll").isNotNull(), "EPSG:4326"),
        "image-altitude-meters": first_number(_present(df, ALTITUDE)), "image-datetime": iso_time(first_value(_present(df, TIMES))),
        "image-camera-yaw-degrees": F.col("_o.yaw"), "image-camera-pitch-degrees": F.col("_o.pitch"), "image-camera-roll-degrees": F.col("_o.roll"),
        "image-meters-above-ground": first_number(_present(df, TO_GROUND)), "image-area-square-meters": F.when(area > 0, area),
    }
    if not given:
        return rows.select(*keep, *(c.alias(n) for n, c in fields.items()))
    text = {"image-coordinate-reference-system", "image-datetime"}
    own = lambda n: F.try_element_at(F.col(given), F.lit(n))
    made = [F.coalesce(own(n) if n in text else to_number(own(n)), c).alias(n) for n, c in fields.items()]
    return rows.select(*keep, *made, F.map_filter(given, lambda k, v: ~k.isin(*fields)).alias("image-other-fields"))


def biigle_rows(df: DataFrame, items: DataFrame, key: Sequence[str], to_ground: float | None = None, area: float | None = None) -> DataFrame:
    """The annotation table's eight columns; ``items`` has the item fields under the same key. A time that is
    no epoch is read by every accepted form first (``taken_at`` is null with ``time_rejected`` true if none fits)."""
    raw = df.select(*key, F.col("filename"), first_value(_present(df, TIMES)).alias("_t"), F.coalesce(first_number(_present(df, TO_GROUND)), F.lit(to_ground).cast("double")).alias("distance_to_ground"), F.coalesce(first_number(_present(df, AREA)), F.lit(area).cast("double")).alias("area"))
    both = raw.join(items, list(key), "left")
    return both.select(*key, "filename", F.date_format(any_time(F.col("_t")), "yyyy-MM-dd HH:mm:ss").alias("taken_at"), F.col("image-longitude").alias("lng"), F.col("image-latitude").alias("lat"), F.col("image-altitude-meters").alias("gps_altitude"), "distance_to_ground", "area", F.col("image-camera-yaw-degrees").alias("SUB_heading"), (F.col("_t").isNotNull() & any_time(F.col("_t")).isNull()).alias("time_rejected"))


def header_defaults(items: DataFrame) -> DataFrame:
    """What a set's items say of the whole: earliest time, mean position, first system, bounds."""
    lat, lon = F.col("image-latitude"), F.col("image-longitude")
    crs = F.col("image-coordinate-reference-system")
    return items.groupBy("set_id").agg(
        F.min(clean(F.col("image-datetime"))).alias("image-datetime"), F.avg(lat).alias("image-latitude"), F.avg(lon).alias("image-longitude"), F.avg("image-altitude-meters").alias("image-altitude-meters"),
        F.min_by(crs, F.when(crs.isNotNull(), F.col("row_no"))).alias("image-coordinate-reference-system"), F.min(lat).alias("image-set-min-latitude-degrees"),
        F.max(lat).alias("image-set-max-latitude-degrees"), F.min(lon).alias("image-set-min-longitude-degrees"), F.max(lon).alias("image-set-max-longitude-degrees"),
    )


def merged_header(given: Column, defaults: Column) -> Column:
    """A map of header texts; a default fills only what is blank."""
    filled = F.map_filter(given, lambda k, v: clean(v).isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, v: v.isNotNull() & ~F.coalesce(F.map_contains_key(filled, k), F.lit(False))), filled)


def merged_metadata(template: Column, typed: Column, promoted: Sequence[str] = ()) -> Column:
    """P20: template values under typed ones, without the keys that went to the header."""
    own = F.map_filter(typed, lambda k, v: clean(v).isNotNull())
    return F.map_filter(F.map_concat(F.map_filter(template, lambda k, v: ~F.map_contains_key(own, k)), own), lambda k, v: ~k.isin(*promoted) if promoted else F.lit(True))


def stable_id(set_id: Column, name: Column) -> Column:
    """A name-based id in the form of a UUID: equal names get equal ids in every run."""
    h = F.md5(F.concat_ws("/", set_id.cast("string"), name))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def with_identities(items: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The id that earlier output (set_id, filename, uuid) has for an image, else a stable new one."""
    made = stable_id(F.col("set_id"), F.col("filename"))
    if earlier is None:
        return items.withColumn("uuid", made)
    return items.join(earlier.select("set_id", "filename", F.col("uuid").alias("_u")), ["set_id", "filename"], "left").withColumn("uuid", F.coalesce("_u", made)).drop("_u")


def carried_forward(new: DataFrame, earlier: DataFrame, inventory: DataFrame) -> DataFrame:
    """New items, and earlier ones that are not made anew and whose image (set_id, filename) still exists."""
    kept = earlier.join(inventory.select("set_id", "filename").distinct(), ["set_id", "filename"], "left_semi").join(new.select("set_id", "filename").distinct(), ["set_id", "filename"], "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def last_items(items: DataFrame) -> DataFrame:
    """One item for each image of a set: that of the last table, then row."""
    w = Window.partitionBy("set_id", "filename").orderBy(F.col("table_no").desc(), F.col("row_no").desc())
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_headers(headers: DataFrame) -> DataFrame:
    """Of a set's headers (set_id, table_no, header) that of the first table."""
    return headers.groupBy("set_id").agg(F.min_by("header", "table_no").alias("header"))


def documents(items: DataFrame, headers: DataFrame, schema_url: str = "") -> DataFrame:
    """One JSON document for each set: header and items by file name. ``items`` has set_id, filename and ``item``
    (struct or map); ``headers`` has set_id and ``header``. A document is one row; ``document_lines`` is the form for
    sets too large for that."""
    entry = F.struct("filename", F.to_json("item").alias("item"))
    folded = items.groupBy("set_id").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    return folded.join(headers, "set_id", "left").select("set_id", F.size("items").alias("n_items"), F.concat(_opening(schema_url), F.array_join(F.transform("items", _entry), ","), F.lit("}}")).alias("document"))


def _opening(schema_url: str) -> Column:
    head = F.to_json(F.struct(F.lit(schema_url).alias("$schema"), F.col("header").alias("image-set-header")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"image-set-items":{'))


def _entry(x: Column) -> Column:
    return F.concat(F.regexp_extract(F.to_json(F.struct(x["filename"].alias("f"))), r'^\{"f":(.*)\}$', 1), F.lit(":"), x["item"])


def document_lines(items: DataFrame, headers: DataFrame, schema_url: str = "") -> DataFrame:
    """A9 for sets of any size: ``set_id, place, line``; a set's lines in order of place (kind and file name) are its
    document. No set is gathered or numbered: only the order within a set is needed, where the lines are written."""
    at = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("filename")).alias("place")
    sets = items.groupBy("set_id").agg(F.min("filename").alias("_first")).join(headers, "set_id", "left")
    named = items.select("set_id", F.struct("filename", F.to_json("item").alias("item")).alias("x"))
    body = named.join(sets.select("set_id", "_first"), "set_id").select("set_id", at(1, F.col("x.filename")), F.concat(F.when(F.col("x.filename") > F.col("_first"), ",").otherwise(""), _entry(F.col("x"))).alias("line"))
    return body.union(sets.select("set_id", at(0, F.lit("")), _opening(schema_url))).union(sets.select("set_id", at(2, F.lit("")), F.lit("}}")))


def per_image_documents(items: DataFrame, headers: DataFrame, schema_url: str = "") -> DataFrame:
    """One JSON document for each image: the set's header and the one item."""
    one = F.struct("filename", F.to_json("item").alias("item"))
    return items.join(headers, "set_id", "left").select("set_id", F.concat("filename", F.lit(".ifdo.json")).alias("name"), F.concat(_opening(schema_url), _entry(one), F.lit("}}")).alias("document"))


def header_issues(headers: DataFrame, value: str = "header") -> DataFrame:
    """Q4-Q6 for headers (set_id, map of JSON or plain texts): one row for each broken rule."""
    h = F.col(value)
    text = lambda f: F.element_at(h, F.lit(f))
    name_of = lambda v: F.get_json_object(v, "$.name")
    found: list[Column] = [F.when(clean(text(f)).isNull(), F.struct(F.lit(f).alias("field"), F.lit("missing required field").alias("issue"))) for f in HEADER_FIELDS]
    for f in OBJECT_FIELDS:
        is_object = text(f).rlike(r"^\s*\{")
        found.append(F.when(text(f).isNotNull() & ~is_object, F.struct(F.lit(f).alias("field"), F.lit("not an object").alias("issue"))).when(is_object & clean(name_of(text(f))).isNull(), F.struct(F.lit(f).alias("field"), F.lit("object without a name").alias("issue"))))
    for f in ARRAY_FIELDS:
        entries = F.from_json(text(f), "array<struct<name:string>>")
        fine = text(f).rlike(r"^\s*\[") & (F.size(entries) > 0)
        found.append(F.when(text(f).isNotNull() & ~F.coalesce(fine, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit("not a list of objects").alias("issue"))).when(fine & F.exists(entries, lambda e: clean(e["name"]).isNull()), F.struct(F.lit(f).alias("field"), F.lit("entry without a name").alias("issue"))))
    for f, allowed in VOCABULARIES.items():
        found.append(F.when(clean(text(f)).isNotNull() & ~text(f).isin(*allowed), F.struct(F.lit(f).alias("field"), F.lit("not an allowed value").alias("issue"))))
    return headers.select("set_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("set_id", "i.field", "i.issue")


def item_issues(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Q4 for items (set_id, filename, map ``item``): required fields that neither the item nor the header has. A
    blank handle counts as missing."""
    both = items.join(headers, "set_id", "left")
    lacks = lambda f: clean(F.element_at("item", F.lit(f))).isNull() & clean(F.element_at("header", F.lit(f))).isNull()
    missing = F.filter(F.array(*(F.when(F.coalesce(lacks(f), F.lit(True)), F.lit(f)) for f in ITEM_FIELDS)), lambda x: x.isNotNull())
    return both.select("set_id", "filename", F.explode(missing).alias("field"))


def template_coverage(metadata: DataFrame, categories: DataFrame) -> DataFrame:
    """Fields of each set's metadata map by category (field, category), else ``Other``."""
    fields = metadata.select("set_id", F.explode("metadata").alias("field", "value")).where(clean(F.col("value")).isNotNull())
    return fields.join(categories, "field", "left").groupBy("set_id", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("field")).alias("fields"))
