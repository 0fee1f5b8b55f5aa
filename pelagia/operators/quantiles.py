"""Exact quantiles and modes of groups of any size.

Equal values are counted first, wherever they are. A rank is then searched in a histogram of its group's values between
the least and the greatest one; the bin that holds it gives the next, narrower range, until a range has few different
values or one, which are summed up in order. So no task needs the values of a group, only ``few`` of them, and a mode is
the greatest of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.sources.tables import written

from .segments import _met

#: Different values that one task sums up in order, and bins of a histogram.
FEW = 200_000
BINS = 2048


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every different value (not null) of each group as ``_v`` with its count ``_c``, written once."""
    return written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))


def modes(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent value of each group, the least of those."""
    return counts.groupBy(*keys).agg(F.max(F.struct("_c", (-F.col("_v")).alias("_w"))).alias("_m")).select(*keys, (-F.col("_m._w")).alias("mode"))


def ranked(counts: DataFrame, ranks: DataFrame, keys: Sequence[str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``keys, _rank, _v``: the value at each rank, counted from 0, of ``ranks`` (keys, _rank). Infinite values and NaN
    have bins of their own, at the ends."""
    order = [*keys, "_rank"]
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    whole = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(finite).alias("_a"), F.max(finite).alias("_z"), F.count("*").alias("_size"))
    open_ = written(_met(ranks.distinct(), whole, keys).withColumn("_below", F.lit(0).cast("bigint")))
    done = []
    while True:
        done.append(open_.where("_lo = _hi").select(*order, F.col("_lo").alias("_v")))
        large = open_.where(f"_lo < _hi AND _size > {few}")
        if large.isEmpty():
            break
        done.append(_summed(counts, open_.where(f"_lo < _hi AND _size <= {few}"), keys))
        ranges = large.select(*keys, "_lo", "_hi", "_a", "_z").distinct()
        inside = _met(counts, ranges, keys).where("_v BETWEEN _lo AND _hi")
        share = F.floor(F.try_divide(F.col("_v") / 2 - F.col("_a") / 2, F.col("_z") / 2 - F.col("_a") / 2) * bins).cast("int")
        place = F.when(F.isnan("_v"), bins + 1).when(F.col("_v") == float("inf"), bins).when(F.col("_v") == -float("inf"), -1).when(F.col("_a") == F.col("_z"), 0).otherwise(F.least(F.coalesce(share, F.when(F.col("_v") == F.col("_a"), 0)), F.lit(bins - 1)))
        binned = inside.groupBy(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), place.alias("_bin")).agg(F.sum("_c").alias("_n"), F.count("*").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        up = Window.partitionBy(*keys, "_from", "_to").orderBy("_bin")
        summed = binned.withColumn("_end", F.sum("_n").over(up))
        hit = _met(large.withColumnsRenamed({"_lo": "_from", "_hi": "_to"}), summed, [*keys, "_from", "_to"]).where("_rank - _below < _end AND _rank - _below >= _end - _n")
        next_ = hit.select(*keys, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_least").alias("_a"), F.col("_most").alias("_z"), F.col("_in").alias("_size"), (F.col("_below") + F.col("_end") - F.col("_n")).alias("_below"))
        open_ = written(next_)
    done.append(_summed(counts, open_.where(f"_lo < _hi AND _size <= {few}"), keys))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _summed(counts: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ranks whose ranges have few values: these are summed up in order."""
    inside = _met(counts, ranges.select(*keys, "_lo", "_hi").distinct(), keys).where("_v BETWEEN _lo AND _hi")
    up = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")
    summed = inside.withColumn("_end", F.sum("_c").over(up))
    met = _met(ranges, summed.select(*keys, "_lo", "_hi", "_v", "_c", "_end"), [*keys, "_lo", "_hi"])
    return met.where("_rank - _below < _end AND _rank - _below >= _end - _c").select(*keys, "_rank", "_v")


def quantiles(counts: DataFrame, keys: Sequence[str], shares: Sequence[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``keys, q``: the quantiles of each group as an array, linear between the two nearest ranks."""
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    at = n.select(*keys, F.posexplode(F.array(*(F.lit(float(s)) * (F.col("_n") - 1) for s in shares))).alias("_q", "_at"))
    parts = at.select(*keys, "_q", (F.col("_at") - F.floor("_at")).alias("_part"), F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
    found = _met(parts, ranked(counts, parts.select(*keys, "_rank"), keys, few, bins), [*keys, "_rank"])
    value = F.min_by("_v", "_rank") * (1 - F.max("_part")) + F.max_by("_v", "_rank") * F.max("_part")
    ends = found.groupBy(*keys, "_q").agg(F.when(F.max("_part") == 0, F.min_by("_v", "_rank")).otherwise(value).alias("_value"))
    return ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_q", "_value"))), lambda s: s["_value"]).alias("q"))
