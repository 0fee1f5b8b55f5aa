"""Connected components by alternating large and small stars: every round is two aggregations and joins on
node ids, so no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = turned.groupBy("u").agg(F.min("v").alias("m"))
    near = turned.join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` for every node that has an edge to another node; the component is its least node.
    Loops, repeated and null edges are ignored; no edges give no rows."""
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not now["n"] or (now["n"], now["x"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = (now["n"], now["x"])
        before, edges = edges, materialise(_small_star(_large_star(edges)))
        discard(before)
