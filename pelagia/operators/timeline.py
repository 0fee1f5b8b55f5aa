"""Time series of a deployment: cleaning, order, gaps, headings, resampling. One window order serves all of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pelagia.functions.normalize import any_time, bearing, to_number

from .quantiles import quantiles, value_counts
from .segments import carried, neighbours

DEP = "deployment_id"
#: Points that a task makes, about, where a track is resampled.
POINTS = 500_000


def track_order() -> WindowSpec:
    """The one order of a deployment's rows."""
    return Window.partitionBy(DEP).orderBy("ts", "row_no")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def cleaned(raw: DataFrame, x: str = "x", y: str = "y", time: str = "time") -> DataFrame:
    """adds ``ts`` and numeric ``x``, ``y``, and ``reject_reason`` (null for rows to keep)."""
    parsed = raw.withColumns({"ts": any_time(F.col(time)), "x": to_number(F.col(x)), "y": to_number(F.col(y))})
    return parsed.withColumn("reject_reason", F.when(F.col("x").isNull() | F.col("y").isNull(), "no position").when(F.col("ts").isNull(), "no time"))


def reject_counts(cleaned_rows: DataFrame) -> DataFrame:
    """rows kept and rejected in each deployment."""
    return cleaned_rows.groupBy(DEP).agg(F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error where it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def stepped(track: DataFrame, columns: list[str], segment_rows: int | None = None) -> DataFrame:
    """A track with ``_prev``, ``_next`` and ``_i`` in its order of time. With ``segment_rows`` a deployment of more
    rows is scanned in segments; the rows are the same."""
    return neighbours(track, [DEP], ["ts", "row_no"], columns, F.unix_micros("ts"), segment_rows)


def intervals(track: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Each row but the first with the seconds since the one before."""
    if segment_rows is not None:
        return stepped(track, ["ts"], segment_rows).withColumn("gap_s", seconds_between(F.col("ts"), F.col("_prev.ts"))).where("gap_s is not null").select(*track.columns, "gap_s")
    return track.withColumn("gap_s", seconds_between(F.col("ts"), F.lag("ts").over(track_order()))).where("gap_s is not null")


def median_interval(track: DataFrame, positive_only: bool = False, segment_rows: int | None = None) -> DataFrame:
    """A3: median seconds between rows of each deployment; with ``segment_rows`` from counts of equal intervals."""
    gaps = intervals(track, segment_rows)
    gaps = gaps.where("gap_s > 0") if positive_only else gaps
    if segment_rows is not None:
        return quantiles(value_counts(gaps, [DEP], "gap_s"), [DEP], [0.5], segment_rows).select(DEP, F.col("q")[0].alias("median_s"))
    return gaps.groupBy(DEP).agg(F.percentile("gap_s", 0.5).alias("median_s"))


def match_tolerance(track: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """A4: half the median interval, 0.05 s at least; 1 s for fewer than two rows."""
    all_dep = track.select(DEP).distinct()
    return all_dep.join(median_interval(track, segment_rows=segment_rows), DEP, "left").select(DEP, F.coalesce(F.greatest(F.col("median_s") / 2, F.lit(0.05)), F.lit(1.0)).alias("tolerance_s"))


def join_tolerance(track: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """A5: half the median positive interval, 0.05 s at least; no row for a deployment without one."""
    return median_interval(track, True, segment_rows).select(DEP, F.greatest(F.col("median_s") / 2, F.lit(0.05)).alias("tolerance_s"))


def extent(track: DataFrame) -> DataFrame:
    """Rows, first and last time, duration."""
    return track.groupBy(DEP).agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("duration_s", seconds_between(F.col("end"), F.col("start")))


def start_time(track: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """The start given in ``override`` (deployment_id, start_override), else the earliest time."""
    least = track.groupBy(DEP).agg(F.min("ts").alias("start"))
    if override is None:
        return least
    return least.join(override, DEP, "full").select(DEP, F.coalesce("start_override", "start").alias("start"))


def gaps(track: DataFrame, absolute_s: float | None = None, factor: float = 5.0, segment_rows: int | None = None) -> DataFrame:
    """Intervals above the threshold: ``absolute_s``, else ``factor`` times the deployment's median."""
    return interval_summary(track, absolute_s, factor, segment_rows)[1]


def interval_summary(track: DataFrame, absolute_s: float | None = None, factor: float = 5.0, segment_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A3, A6 and W1 of one scan: extent and median interval of each deployment, and its intervals above the
    threshold. Without ``segment_rows`` both are partitioned by deployment, so joins of the two do not shuffle again."""
    if segment_rows is None:
        steps = track.select(DEP, "row_no", "ts", seconds_between(F.col("ts"), F.lag("ts").over(track_order())).alias("gap_s"))
        median = F.percentile("gap_s", 0.5)
    else:
        steps = stepped(track.select(DEP, "row_no", "ts"), ["ts"], segment_rows).select(DEP, "row_no", "ts", seconds_between(F.col("ts"), F.col("_prev.ts")).alias("gap_s"))
        median = F.lit(None).cast("double")
    whole = steps.groupBy(DEP).agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), median.alias("median_s")).withColumn("duration_s", seconds_between(F.col("end"), F.col("start")))
    if segment_rows is not None:
        middle = quantiles(value_counts(steps, [DEP], "gap_s"), [DEP], [0.5], segment_rows).select(DEP, F.col("q")[0].alias("median_s"))
        whole = whole.drop("median_s").join(middle, DEP, "left").select(DEP, "n_rows", "start", "end", "median_s", "duration_s")
    limit = whole.select(DEP, (F.lit(absolute_s) if absolute_s is not None else F.col("median_s") * factor).cast("double").alias("threshold_s"))
    return whole, steps.join(limit, DEP).where("gap_s > threshold_s").select(DEP, "row_no", F.col("ts").alias("gap_end"), "gap_s", "threshold_s")


def packet_breaks(packets: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """Steps of presentation time above ``multiplier`` frames."""
    w = Window.partitionBy("video_id").orderBy("n")
    stepped = packets.withColumn("step_s", F.col("pts") - F.lag("pts").over(w))
    return stepped.where(F.col("step_s") > F.lit(multiplier) / F.col("frame_rate")).select("video_id", "n", "step_s")


def frame_totals(packets: DataFrame) -> DataFrame:
    """Duration and whole frames of each video."""
    return packets.groupBy("video_id").agg((F.max("pts") - F.min("pts")).alias("duration_s"), F.max("frame_rate").alias("frame_rate")).withColumn("n_frames", F.floor(F.col("duration_s") * F.col("frame_rate")))


def track_heading(track: DataFrame, constant: float | None = None, from_track: bool = True, segment_rows: int | None = None) -> DataFrame:
    """Own heading, else bearing to the next row; the last row takes the one before; else the constant.
    A stationary row is not carried."""
    if not from_track:
        return track.withColumn("heading", F.coalesce("heading", F.lit(constant).cast("double")))
    if segment_rows is not None:  # the row before the last one leads to it
        step = stepped(track, ["x", "y", "heading"], segment_rows)
        own = F.coalesce("heading", bearing(F.col("x"), F.col("y"), F.col("_next.x"), F.col("_next.y")))
        back = F.coalesce("_prev.heading", bearing(F.col("_prev.x"), F.col("_prev.y"), F.col("x"), F.col("y")))
        turned = F.coalesce(own, F.when(F.col("_next").isNull(), back), F.lit(constant).cast("double"))
        return step.withColumn("heading", turned).select(*track.columns)
    nx, ny = F.lead("x").over(track_order()), F.lead("y").over(track_order())
    step = track.select("*", F.coalesce("heading", bearing(F.col("x"), F.col("y"), nx, ny)).alias("_h"), F.lead("row_no").over(track_order()).isNull().alias("_last"))
    carried = step.withColumn("_h", F.when(F.col("_last") & F.col("_h").isNull(), F.lag("_h").over(track_order())).otherwise(F.col("_h")))
    return carried.withColumn("heading", F.coalesce("_h", F.lit(constant).cast("double"))).drop("_h", "_last")


def carried_heading(rows: DataFrame, force: bool = False, offset: float = 0.0, segment_rows: int | None = None) -> DataFrame:
    """Own heading unless ``force``, else bearing to the next row, else the last resolved one, else 0; every
    row adds the offset, also to a heading that had it."""
    step = neighbours(rows, [DEP], ["row_no"], ["x", "y"], F.col("row_no"), segment_rows)
    computed = bearing(F.col("x"), F.col("y"), F.col("_next.x"), F.col("_next.y"))
    base = F.coalesce(computed, F.col("heading")) if force else F.coalesce(F.col("heading"), computed)
    last = carried(step.withColumn("_base", base), [DEP], "_base")
    carries = F.col("_i") - F.coalesce("_known_at", F.lit(1)) + 1
    return last.withColumn("heading", F.pmod(F.coalesce("_known", F.lit(0.0)) + carries * F.lit(offset), F.lit(360.0))).select(*rows.columns)


def constant_z(track: DataFrame, z: float | None) -> DataFrame:
    """The given z where a row has none."""
    return track if z is None else track.withColumn("z", F.coalesce("z", F.lit(z).cast("double")))


def resampled(track: DataFrame, interval_s: float, segment_rows: int | None = None) -> DataFrame:
    """Rows at a fixed cadence from each deployment's first to last time. x, y, z are linear between the two
    samples around a point, other columns come from the earlier one, the heading is cleared. A point at a sample
    belongs to the segment that ends there. Deployments without a time span stay as they are. Whole deployments are
    dealt by the number of points that they will have, as few rows can become many."""
    step = F.lit(round(interval_s * 1e6)).cast("bigint")
    us = F.unix_micros("ts")
    whole = Window.partitionBy(DEP)
    columns = [c for c in track.columns if c not in (DEP, "row_no", "ts", "x", "y", "z", "heading")]
    if segment_rows is None:
        spans = track.groupBy(DEP).agg(F.floor((F.max(us) - F.min(us)) / step).alias("_points"))
        points = spans.agg(F.sum("_points")).first()[0] or 0
        if points > POINTS:
            track = track.repartition(max(math.ceil(points / POINTS), track.sparkSession.sparkContext.defaultParallelism), DEP)
        seg = track.select("*", us.alias("_t"), F.lead(us).over(track_order()).alias("_u"), *(F.lead(c).over(track_order()).alias(f"_{c}") for c in "xyz"), F.min(us).over(whole).alias("_t0"), F.max(us).over(whole).alias("_t1"), F.row_number().over(track_order()).alias("_n"))
    else:
        ends = track.groupBy(DEP).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"))
        near = stepped(track, ["ts", "x", "y", "z"], segment_rows)
        seg = near.select(*track.columns, us.alias("_t"), F.unix_micros("_next.ts").alias("_u"), *(F.col(f"_next.{c}").alias(f"_{c}") for c in "xyz"), F.col("_i").alias("_n")).join(ends, DEP)
    same = seg.where("_t0 = _t1").select(DEP, "row_no", "ts", "x", "y", "z", "heading", *columns)
    low = F.when(F.col("_n") == 1, 0).otherwise(F.floor((F.col("_t") - F.col("_t0")) / step) + 1)
    high = F.floor((F.col("_u") - F.col("_t0")) / step)
    own = seg.where("_t0 < _t1 and _u is not null").select("*", low.alias("_i0"), high.alias("_i1")).where("_i1 >= _i0")
    grid = own.select("*", F.explode(F.sequence("_i0", "_i1")).alias("_i")).select("*", (F.col("_t0") + F.col("_i") * step).alias("_g"))
    part = F.when(F.col("_u") > F.col("_t"), (F.col("_g") - F.col("_t")) / (F.col("_u") - F.col("_t"))).otherwise(0.0)
    value = lambda c: F.coalesce(F.col(c) + (F.col(f"_{c}") - F.col(c)) * part, c, f"_{c}").alias(c)
    made = grid.select(DEP, F.col("_i").alias("row_no"), F.timestamp_micros("_g").alias("ts"), value("x"), value("y"), value("z"), F.lit(None).cast("double").alias("heading"), *columns)
    return made.union(same)


def object_ids(track: DataFrame, first: int = 0, segment_rows: int | None = None) -> DataFrame:
    """Row number in time order from ``first``."""
    if segment_rows is not None:
        return stepped(track, ["row_no"], segment_rows).select(*track.columns, (F.col("_i") + F.lit(first - 1)).alias("object_id"))
    return track.withColumn("object_id", F.row_number().over(track_order()) + F.lit(first - 1))


def sequence_order(rows: DataFrame, set_col: str = "set_id", time_col: str = "ts", segment_rows: int | None = None) -> DataFrame:
    """Place of each row of a set by acquisition time, rows without a time last."""
    if segment_rows is not None:  # rows without a time are numbered on their own, after those that have one
        timed = rows.withColumn("_none", F.col(time_col).isNull())
        n = timed.groupBy(set_col).agg(F.count(time_col).alias("_timed"))
        at = F.coalesce(F.unix_micros(F.col(time_col)), F.col("row_no"))
        step = neighbours(timed, [set_col, "_none"], [time_col, "row_no"], ["row_no"], at, segment_rows)
        return step.join(n, set_col).select(*rows.columns, (F.col("_i") + F.when(F.col("_none"), F.col("_timed")).otherwise(0)).alias("sequence_order"))
    w = Window.partitionBy(set_col).orderBy(F.col(time_col).asc_nulls_last(), "row_no")
    return rows.withColumn("sequence_order", F.row_number().over(w))
