"""How filters of documents act on each other in every order: packed counters over failure masks.

A document matters to the audit only by the filters that it fails and by its labels. So rows are counted by part, mask
and labels in Spark first; each such mask is then mapped to one big integer whose 64-bit fields hold all its outcomes, a
field for each order, step and measure, and the integers of a part are summed. No field can overflow into the next, as a
part has fewer than 2**63 rows.

Odd rows: a null text is the empty text, a null part the empty string. Rows that repeat an id are documents each; a row
with a null id has no smaller id, so it is no repetition, and a text is not repeated by one. An id labelled more than
once counts as good (toxic) where any row says so. An empty table has no parts and gives no rows. Further columns of
any name are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: A to E in this order; each is the condition under which a document fails.
LETTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = 8  # bytes of a field
_BLANKS = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"


def text_failures(n_words: Column, n_different: Column, n_capitals: Column, n_chars: Column, marked: Column) -> list[Column]:
    """A to D: under 100 words, under 80 % different words, over 10 % capitals, one of the marks."""
    return [n_words < 100, 100 * n_different < 80 * n_words, 100 * n_capitals > 10 * n_chars, marked]


def failure_counts(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters that they fail (bit 0 is A) and their labels.

    The last filter removes a text that a document of a smaller id has too, wherever that is. Texts meet by their
    SHA-256, and rows of one text are counted before they meet, so a group of copies of any size is a few rows."""
    # each select holds what the next one reads more than once, so that no text is split twice
    body = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    bare = body.select("*", F.expr(f"trim(BOTH '{_BLANKS}' FROM body)").alias("bare"))
    words = bare.select("*", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", SPACE)).alias("words"))
    counted = words.select(
        "id", "part", F.unhex(F.sha2("body", 256)).alias("text_key"), F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_different"),
        F.regexp_count("body", F.lit("[A-Z]")).alias("n_capitals"), F.char_length("body").alias("n_chars"), F.col("body").rlike(r"[#$%&*|]").alias("marked"),
    )
    bits = text_failures(*(F.col(c) for c in ("n_words", "n_different", "n_capitals", "n_chars", "marked")))
    narrow = counted.select("id", "part", "text_key", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).alias("mask"))
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = narrow.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kinds = ["text_key", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("id", *kinds).agg(F.count("*").alias("n"))
    least = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    met = least.withColumn("first", F.min("least").over(Window.partitionBy("text_key")))
    original = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = met.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), original.alias("n")), F.struct(F.lit(1).alias("e"), (F.col("n") - original).alias("n")))).alias("s"))
    return split.where("s.n > 0").groupBy("part", (F.col("mask") + F.col("s.e") * 16).alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("n"))


@lru_cache(maxsize=512)
def packed_outcome(letters: str, mask: int, good: bool, toxic: bool) -> int:
    """What one document with this mask adds to every field: field (order * steps + step) * measures + measure."""
    steps = len(letters)
    orders = list(permutations(range(steps)))
    fields = np.zeros((len(orders), steps, len(MEASURES)), "<u8")
    for i, order in enumerate(orders):
        removed = False
        for j, k in enumerate(order):
            fails = bool(mask >> k & 1)
            here = fails and not removed
            removed |= fails
            fields[i, j] = (not removed, here, fails and not here, mask == 1 << k, here and good, here and toxic)
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, letters: str) -> np.ndarray:
    """The fields of a sum of packed outcomes: orders x steps x measures."""
    steps = len(letters)
    n = len(list(permutations(letters)))
    return np.frombuffer(total.to_bytes(n * steps * len(MEASURES) * FIELD, "little"), "<u8").astype(np.int64).reshape(n, steps, len(MEASURES))


def _audited(letters: str):
    orders = list(permutations(range(len(letters))))

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * packed_outcome(letters, int(m), bool(g), bool(t)) for m, g, t, n in zip(counts["mask"], counts["good"], counts["toxic"], counts["n"], strict=True))
        fields = unpacked(total, letters)
        at = np.array(orders)
        shapley = np.zeros(len(letters), np.int64)
        np.add.at(shapley, at.ravel(), fields[:, :, 1].ravel())
        out = pd.DataFrame({name: fields[:, :, i].ravel() for i, name in enumerate(MEASURES)})
        out["shapley"] = shapley[at.ravel()]
        out.insert(0, "step", np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders)))
        out.insert(0, "filter_order", np.repeat(["".join(letters[k] for k in o) for o in orders], len(letters)))
        out.insert(0, "part", key[0])
        return out

    return run


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, filter_order, step`` with the measures and ``shapley``, from ``part, mask, good, toxic, n``: one row for
    each part, order and step. Of a part only its different masks reach a task: at most 4 * 2**filters rows."""
    whole = ", ".join(f"{c} bigint" for c in (*MEASURES, "shapley"))
    return counts.groupBy("part").applyInPandas(_audited(letters), f"part string, filter_order string, step int, {whole}")


def filter_audit(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every order of the five filters over every part of the documents."""
    return interactions(failure_counts(documents, labels, part))
