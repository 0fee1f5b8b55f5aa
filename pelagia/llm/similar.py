"""Classes of similar sets from shared buckets, without ever gathering a bucket in one place.

The pairs of small buckets are proposed at once. Members of a larger bucket are first held against pivots that an
aggregation draws from it, round by round: first the member whose buckets are the largest, which in a group of copies
is the one that they are copies of, then random ones. Most of a group falls into one class that way. Only then are
members of different classes in one bucket held against each other. In all steps the sizes and the bits of two sets
(their parities) rule out pairs that cannot have the similarity, pairs that were proposed before are
left out, and the caller verifies the rest exactly. Every side of a join on a hot key is written first, so that the
join reads plain shuffles and Spark can split it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import components

#: All pairs of a bucket of at most so many rows are proposed at once.
SMALL = 8

#: pairs u, v of ids -> those whose sets have the similarity
Verify = Callable[[DataFrame], DataFrame]


def bits(n: int) -> list[str]:
    """Names of the columns that hold 64 bits of a set each."""
    return [f"b{i}" for i in range(n)]


def parity_words(h: Column, n: int) -> list[Column]:
    """Aggregates over the different hashes ``h`` of a set: n words of 64 bits (n a power of two), of which each bit
    is the parity of how many hashes fall to it. Two sets differ in at least as many elements as their bits differ."""
    bit, word = F.expr("shiftleft(1L, cast(h & 63 AS int))"), F.shiftright(h, 6).bitwiseAND(n - 1)
    return [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(b) for k, b in enumerate(bits(n))]


def members(placed: DataFrame) -> DataFrame:
    """The rows (id, key) of buckets that hold two rows or more, with their number ``c``, written."""
    counted = placed.select("id", "key", F.count("*").over(Window.partitionBy("key")).alias("c"))
    return materialise(counted.where("c > 1"))


def _sizes_fit(mine: str, other: str, threshold: float) -> Column:
    """False only for pairs whose sizes differ too much for the similarity."""
    n, m = F.col(f"{mine}.n"), F.col(f"{other}.n")
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)


def _bits_fit(mine: str, other: str, names: list[str], threshold: float) -> Column:
    """False only for pairs whose bits differ in more places than sets of the similarity and their sizes can."""
    apart = sum((F.bit_count(F.col(f"{mine}.{b}").bitwiseXOR(F.col(f"{other}.{b}"))) for b in names), F.lit(0))
    return apart <= F.lit((1 - threshold) / (1 + threshold)) * (F.col(f"{mine}.n") + F.col(f"{other}.n")) + F.lit(1e-6)


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("m.id", "o.id").alias("u"), F.least("m.id", "o.id").alias("v")).distinct()


def _fitting(pairs: DataFrame, known: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """The pairs u, v that sizes and bits do not rule out."""
    met = pairs.join(known.alias("m"), F.col("u") == F.col("m.id")).join(known.alias("o"), F.col("v") == F.col("o.id"))
    return met.where(_sizes_fit("m", "o", threshold) & _bits_fit("m", "o", names, threshold)).select("u", "v")


def _small_pairs(member: DataFrame, known: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """Every pair of one bucket, for buckets of at most SMALL rows; buckets of the same members count once."""
    held = member.where(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    pairs = held.select("ids", F.explode("ids").alias("v")).select(F.explode(F.filter("ids", lambda x: x > F.col("v"))).alias("u"), "v")
    pairs = materialise(pairs.distinct())
    found = materialise(_fitting(pairs, known, names, threshold))
    discard(pairs)
    return found


def _pivot_pairs(placed: DataFrame, known: DataFrame, names: list[str], threshold: float, by_score: bool) -> DataFrame:
    """The members of buckets that still hold several classes, each with members drawn as pivots: one row for each
    member and pivot at most, so the bits join the pairs afterwards."""
    one = F.struct("id", "class", "n")
    draws = [F.max_by(one, F.struct("score", "id"))] if by_score else [F.min_by(one, F.xxhash64("id", "key", "class", F.lit(i))) for i in range(2)]
    draws = [d.alias(f"p{i}") for i, d in enumerate(draws)]
    lead = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), *draws).where("low < high")
    lead = materialise(lead.select("key", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(len(draws)))))).alias("p")).select("key", "p.*"))
    met = placed.alias("m").join(lead.hint("merge").alias("o"), (F.col("m.key") == F.col("o.key")) & F.expr("m.class <> o.class") & _sizes_fit("m", "o", threshold))
    pairs = materialise(_ordered(met))
    found = materialise(_fitting(pairs, known, names, threshold))
    discard(lead, pairs)
    return found


def _rest(placed: DataFrame, known: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """Every pair of one bucket in two classes, except what sizes and bits rule out within the join: what the
    pivots have left. Members outside their bucket's largest class are held against the others."""
    held = placed.groupBy("key", "class").agg(F.count("*").alias("size"))
    lead = held.groupBy("key").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.count("*").alias("classes"))
    lead = materialise(lead.where("classes > 1").select("key", "main"))
    several = materialise(placed.join(lead.hint("merge"), "key").select("key", "id", "class", "main").join(known.drop("score"), "id"))
    apart = F.expr("m.class <> o.class AND (o.class = o.main OR m.id < o.id)")
    met = several.where("class <> main").alias("m").join(several.hint("merge").alias("o"), (F.col("m.key") == F.col("o.key")) & apart & _sizes_fit("m", "o", threshold) & _bits_fit("m", "o", names, threshold))
    found = materialise(_ordered(met))
    discard(lead, several)
    return found


def _between(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links of ids as links of their classes."""
    left, right = label.select(F.col("id").alias("u"), F.col("class").alias("cu")), label.select(F.col("id").alias("v"), F.col("class").alias("cv"))
    return links.join(left, "u").join(right, "v").select("cu", "cv").distinct()


def linked_classes(member: DataFrame, facts: DataFrame, verify: Verify, threshold: float) -> DataFrame:
    """``id, class`` of every row of ``facts``: the least id that links of the similarity lead to. ``member`` has id,
    key and the bucket's number of rows, every id in several buckets; ``facts`` has id, the set's size ``n`` and
    its parity words."""
    names = [c for c in facts.columns if c not in ("id", "n")]
    known = materialise(facts.join(member.groupBy("id").agg(F.sum("c").alias("score")), "id"))
    label, seen = known.select("id", F.col("id").alias("class")), None
    large = member.where(F.col("c") > SMALL).select("id", "key")
    for propose in (
        lambda p: _small_pairs(member, known, names, threshold).union(_pivot_pairs(p, known, names, threshold, True)).distinct(),
        lambda p: _pivot_pairs(p, known, names, threshold, False),
        lambda p: _rest(p, known, names, threshold),
    ):
        placed = materialise(large.join(label, "id").join(known.select("id", "n", "score"), "id"))
        pairs = propose(placed)
        fresh = pairs if seen is None else pairs.join(seen.hint("merge"), ["u", "v"], "left_anti")
        merged = materialise(components(_between(verify(fresh), label), "cu", "cv"))
        now = materialise(label.join(merged.hint("merge"), label["class"] == merged["node"], "left").select("id", F.coalesce("component", "class").alias("class")))
        seen = pairs if seen is None else seen.union(pairs)
        discard(placed, label, merged)
        label = now
    discard(known)
    return label
