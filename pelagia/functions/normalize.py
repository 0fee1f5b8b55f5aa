"""Normalisation of values, times, join keys and paths as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, in lower case.
NULL_TEXTS = ("", "nan", "none", "null", "n/a", "na", "-", "unknown")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_COUNT = r"^[0-9]{1,17}$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
# Accepted forms besides ISO 8601, in order: pattern of the text, format.
_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]$", "M/d/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy/M/d H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M-d-yyyy H:m:s"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d.M.yyyy H:m:s"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
)
# EPSG codes of common geographic systems.
GEOGRAPHIC_CODES = ("4326", "4269", "4258", "4267", "4283", "4979")
EARTH_RADIUS = 6378137.0


def _text(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")


def is_null_like(value: Column) -> Column:
    """Null, NaN, or one of the texts for a missing value."""
    return value.isNull() | F.lower(_text(value)).isin(*NULL_TEXTS)


def clean(value: Column) -> Column:
    """N1 as a value: null where null-like."""
    return F.when(~is_null_like(value), value)


def to_number(value: Column) -> Column:
    """Double, null where the text is no number. Plain numbers are known by one pattern."""
    plain = value.cast("string")
    text = F.regexp_replace(_text(value), r"(?<=[0-9])_(?=[0-9])", "")
    other = F.when(is_null_like(value), None).when(text.rlike(_NUMBER) | text.rlike(r"^(?i)[+-]?inf(inity)?$"), text.try_cast("double"))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double")).when(plain.isNotNull(), other)


def first_number(values: Sequence[Column]) -> Column:
    """The first that is a number."""
    return F.coalesce(*(to_number(v) for v in values)) if values else F.lit(None).cast("double")


def first_value(values: Sequence[Column]) -> Column:
    """The first that is not null-like, as text."""
    return F.coalesce(*(clean(v).cast("string") for v in values)) if values else F.lit(None).cast("string")


def join_key(value: Column) -> Column:
    """Whole part of a number, else the text in lower case."""
    whole = F.when(to_number(value).isNotNull() & (F.abs(to_number(value)) < 9e18), to_number(value).try_cast("bigint").cast("string"))
    return F.when(~is_null_like(value), F.coalesce(whole, F.lower(_text(value))))


def epoch_time(value: Column) -> Column:
    """Numeric epoch in microseconds above 1e14, milliseconds above 1e11, else seconds."""
    plain = value.cast("string")
    count = plain.try_cast("bigint")
    plainly = F.when(count > 100_000_000_000_000, count).when(count > 100_000_000_000, count * 1000).otherwise(count * 1_000_000)
    # one value of the number for all its uses
    other = F.transform(F.array(F.struct(to_number(value).alias("n"), _text(value).try_cast("bigint").alias("k"))), lambda e: F.when(F.abs(e["n"]) < 2e17, F.timestamp_micros(_micros(e["n"], F.when(e["k"].cast("double") == e["n"], e["k"])))))
    return F.when(plain.rlike(_COUNT), F.timestamp_micros(plainly)).when(plain.isNotNull(), F.get(other, F.lit(0)))


def _micros(n: Column, whole: Column) -> Column:
    return F.when(n > 1e14, F.coalesce(whole, F.floor(n))).when(n > 1e11, F.coalesce(whole * 1000, F.floor(n * 1000))).otherwise(F.coalesce(whole * 1_000_000, F.floor(n * 1_000_000)))


def any_time(value: Column) -> Column:
    """Epoch, then ISO 8601, then the listed forms; no zone means UTC (the session's zone must be UTC)."""
    text = _text(value)
    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp"))
    others = [F.when(text.rlike(pattern), F.try_to_timestamp(F.upper(text) if form.endswith("a") else text, F.lit(form))) for pattern, form in _FORMATS]
    return F.when(~is_null_like(value), F.coalesce(epoch_time(value), iso, *others))


def exif_time(value: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss`` of an epoch; other text as it is."""
    return F.when(~is_null_like(value), F.coalesce(F.date_format(epoch_time(value), "yyyy:MM:dd HH:mm:ss"), value.cast("string")))


def iso_time(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` of an epoch, cut to milliseconds; other text as it is."""
    return F.when(~is_null_like(value), F.coalesce(F.date_format(epoch_time(value), "yyyy-MM-dd HH:mm:ss.SSS"), value.cast("string")))


def table_time(value: Column) -> Column:
    """An epoch or ISO 8601 text, without a zone."""
    text = _text(value)
    return F.when(~is_null_like(value), F.coalesce(epoch_time(value), F.when(text.rlike(_ISO), text.try_cast("timestamp"))).cast("timestamp_ntz"))


def coerce(value: Column, kind: str) -> Column:
    """Value as LONG (towards 0), DOUBLE or TEXT; null where it cannot be."""
    if kind == "LONG":
        return to_number(value).try_cast("bigint")
    return to_number(value) if kind == "DOUBLE" else clean(value).cast("string")


def elapsed_milliseconds(name: Column) -> Column:
    """The digits after the last underscore before the extension."""
    return F.nullif(F.regexp_extract(name, r"_([0-9]+)\.[A-Za-z0-9]+$", 1), F.lit("")).try_cast("bigint")


def srs_part(value: Column, part: int) -> Column:
    """Horizontal (1) or vertical (2) part of ``horizontal;vertical``; null where blank."""
    return F.nullif(_text(F.get(F.split(value.cast("string"), ";"), F.lit(part - 1))), F.lit(""))


def is_geographic(value: Column) -> Column:
    """Whether the horizontal part is a geographic system: a known code or WKT of one."""
    part = srs_part(value, 1)
    return F.coalesce(part.isin(*GEOGRAPHIC_CODES) | F.upper(part).rlike(r"^(GEOGCS|GEOGCRS|GEODCRS)"), F.lit(False))


def path_key(path: Column) -> Column:
    """A path for comparison: forward slashes, no empty or ``.`` parts, ``..`` resolved, lower case. What goes
    above the beginning stays ``..`` in a relative path and is dropped in an absolute one."""
    slashed = F.regexp_replace(F.lower(path), r"\\", "/")
    absolute = slashed.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = part == ".."
        back = up & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        dropped = up & (F.size(done) == 0) & absolute
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(dropped, done).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.when((F.size(folded) == 0) & ~absolute, ".").otherwise(F.array_join(folded, "/")))


def basename(path: Column) -> Column:
    """The part after the last slash."""
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"[^/]*$", 0)


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north in the plane; null where there is no movement."""
    dx, dy = x2 - x1, y2 - y1
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))


def project(x: Column, y: Column, source: int, target: int) -> Column:
    """Struct (x, y, reject_reason) between EPSG 4326 and 3857; a point out of range is null with a reason."""
    point = lambda px, py, why: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"), why.cast("string").alias("reject_reason"))
    none = F.lit(None)
    if source == target:
        return point(x, y, none)
    if (source, target) == (4326, 3857):
        inside = (F.abs(x) <= 180) & (F.abs(y) < 90)
        mx, my = F.radians(x) * EARTH_RADIUS, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2)) * EARTH_RADIUS
    elif (source, target) == (3857, 4326):
        inside = (F.abs(x) <= 20037508.342789244) & (F.abs(y) <= 20048966.104014594 * 10)
        mx, my = F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.lit(1.5707963267948966))
    else:
        raise ValueError(f"no projection from {source} to {target}")
    missing = x.isNull() | y.isNull()
    return F.when(missing, point(none, none, none)).when(inside, point(mx, my, none)).otherwise(point(none, none, F.lit("position out of range")))
