"""Value statistics, and coverage of a video by its sensor log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import modes, quantiles, value_counts
from .timeline import DEP, seconds_between

FIELDS = ("x", "y", "z", "heading", "pitch", "roll")


def described(df: DataFrame, keys: list[str], value: str = "value", few: int | None = None) -> DataFrame:
    """A1: count, min, max, range, mean, median, mode (least of ties), sample deviation, quartiles; 4 decimals.
    All but the count are null for fewer than two values. With ``few``, quartiles and mode come from counts of equal
    values, of which a task sums up that many at most; for groups whose values do not fit a task."""
    if few is not None:
        counts = value_counts(df, keys, value)
        whole = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
        return _statistics(whole.join(quantiles(counts, keys, [0.25, 0.5, 0.75], few), keys).join(modes(counts, keys), keys), keys)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        q.alias("q"), F.expr(f"mode() WITHIN GROUP (ORDER BY {value})").alias("mode"),
    )
    return _statistics(found, keys)


def _statistics(found: DataFrame, keys: list[str]) -> DataFrame:
    made = {"min": F.col("low"), "max": F.col("high"), "range": F.col("high") - F.col("low"), "mean": F.col("mean"), "median": F.col("q")[1], "mode": F.col("mode"), "std_dev": F.col("sd"), "q1": F.col("q")[0], "q3": F.col("q")[2]}
    return found.select(*keys, "n", *(F.when(F.col("n") >= 2, F.round(c, 4)).alias(name) for name, c in made.items()))


def described_telemetry(track: DataFrame, other_z: str | None = None, few: int | None = None) -> DataFrame:
    """A2: statistics of each telemetry field; where a deployment has no z at all, ``other_z`` takes its place."""
    if other_z:
        has = track.groupBy(DEP).agg((F.count("z") > 0).alias("_has"))
        track = track.join(has, DEP).withColumn("z", F.when(F.col("_has"), F.col("z")).otherwise(F.col(other_z)))
    present = [c for c in FIELDS if c in track.columns]
    values = track.select(DEP, *(F.col(c).cast("double").alias(c) for c in present)).unpivot([DEP], present, "field", "value")
    return described(values, [DEP, "field"], few=few)


def coverage(video: DataFrame, sensor: DataFrame) -> DataFrame:
    """Q1: overlap of video and sensor times, cut to whole seconds, and its percentage of the video."""
    v = video.select(DEP, F.date_trunc("second", "start").alias("vs"), F.date_trunc("second", "end").alias("ve"), *(c for c in ("start_source",) if c in video.columns))
    s = sensor.select(DEP, F.date_trunc("second", "start").alias("ss"), F.date_trunc("second", "end").alias("se"), *(c for c in ("n_gaps",) if c in sensor.columns))
    both = v.join(s, DEP, "full")
    start, end = F.greatest("vs", "ss"), F.least("ve", "se")
    known = F.col("vs").isNotNull() & F.col("ve").isNotNull() & F.col("ss").isNotNull() & F.col("se").isNotNull()
    meets = known & (start < end)
    share = 100 * seconds_between(end, start) / seconds_between(F.col("ve"), F.col("vs"))
    return both.withColumns({"overlap_start": F.when(meets, start), "overlap_end": F.when(meets, end), "coverage_pct": F.when(meets, F.round(share, 1)), "_share": F.when(meets, share)})


def warning_list(covered: DataFrame) -> Column:
    """Q2: the warnings of a row of ``coverage``."""
    v, s = F.col("vs").isNotNull() & F.col("ve").isNotNull(), F.col("ss").isNotNull() & F.col("se").isNotNull()
    kinds: list[tuple[Column, str]] = [
        (F.col("vs").isNull() & F.col("ve").isNull(), "no video time"),
        (F.col("ss").isNull() & F.col("se").isNull(), "no sensor time"),
        ((F.col("vs").isNull() != F.col("ve").isNull()), "video time incomplete"),
        ((F.col("ss").isNull() != F.col("se").isNull()), "sensor time incomplete"),
        (v & s & F.col("overlap_start").isNull(), "no overlap"),
        (F.col("_share") < 99.9, "partly covered"),
    ]
    if "start_source" in covered.columns:
        kinds.append((v & s & (F.col("start_source") == "sensor"), "start taken from the sensor"))
    if "n_gaps" in covered.columns:
        kinds.append((F.col("overlap_start").isNotNull() & (F.col("n_gaps") > 0), "sensor has gaps"))
    return F.filter(F.array(*(F.when(test, F.lit(kind)) for test, kind in kinds)), lambda x: x.isNotNull())


def coverage_warnings(covered: DataFrame) -> DataFrame:
    """Q2: one row per warning."""
    return covered.select(DEP, F.explode(warning_list(covered)).alias("warning"))


def start_provenance(videos: DataFrame) -> DataFrame:
    """Q3: start of each video: override, embedded, container, then sensor; end: embedded, else start + duration."""
    order = (("override_start", "override"), ("embedded_start", "embedded"), ("container_start", "container"), ("sensor_start", "sensor"))
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in order))
    start = F.coalesce(*(F.col(c) for c, _ in order))
    end = F.coalesce("embedded_end", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("duration_s") * 1e6).cast("bigint")))
    return videos.select(DEP, start.alias("start"), source.alias("start_source"), end.alias("end"))
