"""Nearest-time joins with a tolerance, as windows over the union of both sides: linear in the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import TELEMETRY_NAMES, inferred_types, resolve, sanitised_names, typed_value, unique_names
from .segments import segmented
from .timeline import DEP, join_tolerance


def _nearest(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """For query rows (side 0) the row before (strictly) and the one at or after in time among side 1."""
    ahead = Window.partitionBy(*keys).orderBy("t", "side", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("side").desc(), F.col("row_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("side") == 1, F.struct("t", "row_no"))
    both = tagged.select("*", F.last(hit, True).over(ahead).alias("b")).select("*", F.last(hit, True).over(back).alias("f"))
    return both.where("side = 0")


def _chosen() -> Column:
    b, f = F.col("b"), F.col("f")
    return F.when(f.isNull() | (F.col("t") - b["t"] <= f["t"] - F.col("t")), b).otherwise(f)


def _sides(queries: DataFrame, telemetry: DataFrame) -> DataFrame:
    left = queries.select(DEP, F.unix_micros("ts").alias("t"), F.lit(0).alias("side"), "row_no")
    right = telemetry.where("ts is not null").select(DEP, F.unix_micros("ts").alias("t"), F.lit(1).alias("side"), "row_no")
    return left.where("t is not null").unionByName(right)


def nearest_rows(queries: DataFrame, telemetry: DataFrame) -> DataFrame:
    """``deployment_id, row_no, match_row_no, delta_s``: for each query row the nearest telemetry row. On equal
    distance the earlier one; among equal times the first in input order at or after, the last before. The signed
    difference (match - query) is given however large it is."""
    best = _nearest(_sides(queries, telemetry), [DEP]).withColumn("hit", _chosen())
    return best.select(DEP, "row_no", F.col("hit.row_no").alias("match_row_no"), ((F.col("hit.t") - F.col("t")) / F.lit(1e6)).alias("delta_s"))


def nearest_rows_bucketed(queries: DataFrame, telemetry: DataFrame, bucket_s: float | None = None, segment_rows: int | None = None) -> DataFrame:
    """The same for deployments too large for one task: by (deployment, time bucket), with the last row of the
    buckets before and the first of those after as halo rows. Buckets are ``bucket_s`` wide, or, with
    ``segment_rows``, cut for each deployment from its counts of both sides, small ones whole."""
    if segment_rows is not None:
        tagged = segmented(_sides(queries, telemetry), [DEP], F.col("t"), segment_rows).withColumnRenamed("_seg", "bucket")
    else:
        tagged = _sides(queries, telemetry).withColumn("bucket", F.floor(F.col("t") / F.lit(round(bucket_s * 1e6)).cast("bigint")))
    telem = tagged.where("side = 1")
    ends = telem.groupBy(DEP, "bucket").agg(F.min(F.struct("t", "row_no")).alias("first"), F.max(F.struct("t", "row_no")).alias("last"))
    every = tagged.select(DEP, "bucket").distinct().join(ends, [DEP, "bucket"], "left")
    up = Window.partitionBy(DEP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(DEP).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = every.select(DEP, "bucket", F.last("last", True).over(up).alias("_b"), F.last("first", True).over(down).alias("_f"))
    halo = near.select(DEP, "bucket", F.explode(F.array("_b", "_f")).alias("h")).where("h is not null")
    halo = halo.select(DEP, "h.t", F.lit(1).alias("side"), "h.row_no", "bucket")
    best = _nearest(tagged.unionByName(halo), [DEP, "bucket"]).withColumn("hit", _chosen())
    return best.select(DEP, "row_no", F.col("hit.row_no").alias("match_row_no"), ((F.col("hit.t") - F.col("t")) / F.lit(1e6)).alias("delta_s"))


def asof_join(queries: DataFrame, telemetry: DataFrame, tolerance: DataFrame | float, prefix: str = "m_", bucket_s: float | None = None, segment_rows: int | None = None) -> DataFrame:
    """Every query row with the columns of its nearest telemetry row (``prefix`` + name, null on a miss),
    ``delta_s`` and ``matched``; where the query rows have such a column, the new one gets _2, _3, ... ``tolerance``
    is in seconds, or a table of deployment_id, tolerance_s. With ``bucket_s`` or ``segment_rows`` a deployment is split
    by time, for one too large for a task."""
    near = nearest_rows(queries, telemetry) if bucket_s is None and segment_rows is None else nearest_rows_bucketed(queries, telemetry, bucket_s, segment_rows)
    near = near.withColumn("tolerance_s", F.lit(float(tolerance))) if isinstance(tolerance, (int, float)) else near.join(tolerance, DEP, "left")
    near = near.select(DEP, "row_no", "delta_s", F.coalesce(F.abs("delta_s") <= F.col("tolerance_s"), F.lit(False)).alias("matched"), "match_row_no")
    columns = [c for c in telemetry.columns if c != DEP]
    delta, matched, *names = unique_names(["delta_s", "matched", *(f"{prefix}{c}" for c in columns)], queries.columns)
    right = telemetry.select(F.col(DEP).alias("_dep"), F.col("row_no").alias("_row"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_right"))
    found = near.join(right, (near[DEP] == F.col("_dep")) & (F.col("match_row_no") == F.col("_row")) & F.col("matched"), "left")
    found = found.select(F.col(DEP).alias("_dep"), F.col("row_no").alias("_no"), F.struct("delta_s", "matched", "_right").alias("_found"))
    held = queries.select(F.col(DEP).alias("_key"), F.col("row_no").alias("_ask"), F.struct(*(F.col(f"`{c}`") for c in queries.columns)).alias("_left"))
    joined = held.join(found, (F.col("_key") == F.col("_dep")) & (F.col("_ask") == F.col("_no")), "left")
    return joined.select(
        *(F.col("_left")[c].alias(c) for c in queries.columns), F.col("_found.delta_s").alias(delta), F.coalesce("_found.matched", F.lit(False)).alias(matched),
        *(F.col("_found._right")[c].alias(name) for c, name in zip(columns, names, strict=True)),
    )


TIMES = TELEMETRY_NAMES["time"]


def combined_table(primary: DataFrame, secondary: DataFrame | None = None, tolerance_s: float | None = None, bucket_s: float | None = None, segment_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """J2 of whole tables: the primary rows, typed, with all columns of the nearest secondary row; and the table of
    clean and raw column names. Both have deployment_id and row_no, and a column of times found by its name, as text
    or as a timestamp; neither has to be clean.

    The tolerance is half the deployment's median secondary interval, where none is given; a deployment without such
    an interval, like a row without a time or a match, keeps nulls. Joined columns get unique names."""
    keys = [DEP, "row_no"]
    asked = resolve([c for c in primary.columns if c not in keys], TIMES, required=True)
    raw, times = list(primary.columns), [asked]
    rows = primary
    if secondary is not None:
        own = [c for c in secondary.columns if c not in keys]
        clock = resolve(own, TIMES, required=True)
        names = unique_names(own, primary.columns)
        right = secondary.select(*keys, typed_value(secondary, clock, "DATE").alias("ts"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)))
        asks = primary.select(*keys, typed_value(primary, asked, "DATE").alias("ts"))
        tolerance = float(tolerance_s) if tolerance_s is not None else join_tolerance(right.where("ts is not null"), segment_rows)
        met = asof_join(asks, right, tolerance, bucket_s=bucket_s, segment_rows=segment_rows).select(*keys, *(F.col(f"m__c{i}").alias(n) for i, n in enumerate(names)))
        rows, raw = primary.join(met, keys, "left").select(*(f"`{c}`" for c in primary.columns), *(f"`{n}`" for n in names)), raw + names
    values = [c for c in raw if c not in keys]
    kinds = {r["column"]: r["kind"] for r in inferred_types(rows.select(*(f"`{c}`" for c in values)), times).collect()}
    clean = sanitised_names(values, keys)
    done = rows.select(*keys, *(typed_value(rows, c, kinds[c]).alias(n) for c, n in zip(values, clean, strict=True)))
    return done, rows.sparkSession.createDataFrame(list(zip(clean, values, strict=True)), "clean string, raw string")
