"""Rule counts and a hashed n-gram log-likelihood ratio for every document, in built-in functions only.

The ratio compares two multinomials over hashed n-grams, one of a trusted target corpus and one of the raw corpus: the
words, and every two words that follow each other. Both are smoothed alike, so that n-grams without evidence score
nothing. A document's score is the mean of its n-grams' log ratios.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
BUCKETS = 1 << 16
#: Occurrences of a bucket that both corpora are taken to have in proportion to their sizes, before any is seen.
PRIOR = 20.0
#: Documents whose mean log ratio is below this are rejected.
THRESHOLD = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _ngrams(h: Column) -> Column:
    """Hashes of the n-grams of a text, from the hashes of its words: the words, and every two in a row."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.concat(h, F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b)))


def _repeat_words(h: Column) -> Column:
    """Words in 8-word windows that a text has twice or more, from the hashes of its words."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(F.slice(places, F.lit(2), F.size(places)), F.slice(places, F.lit(1), F.size(places) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x))

    def repeated(sorted_windows: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(sorted_windows, j)["h"] == x["h"], F.lit(False))
            return same(i - 1) | same(i + 1)

        return F.sort_array(F.transform(F.filter(sorted_windows, twice), lambda x: x["i"]))

    def count(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(_let(placed, repeated), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    return F.when(F.size(h) <= WINDOW, 0).otherwise(_let(windows, count))


def _dup_lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return _let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _bucket(ngram: Column, buckets: int) -> Column:
    return F.pmod(ngram, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """Log ratio of every bucket: ``docs`` and ``trusted`` have a column ``text``. ``buckets`` bounds the result."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(_let(_hashes(F.col("text")), _ngrams)).alias("g")).groupBy(_bucket(F.col("g"), buckets).alias("b")).agg(F.count("*").alias(name))

    both = counts(docs, "raw").join(counts(trusted, "target"), "b", "full").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for r in both.collect():
        raw[r["b"]] = r["raw"]
        target[r["b"]] = r["target"]
    share = sum(target) / max(sum(raw), 1)
    if not share:
        return [0.0] * buckets
    return [round(log((t + prior * share) / ((r + prior) * share)), 5) for t, r in zip(target, raw, strict=True)]


def rated(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two structs: ``row``, the columns of ``docs``, and ``rating``, those that ``quality_rules`` describes."""
    held = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    # the trusted ids grow with the corpus: they are never broadcast, whatever their size looks like
    target = held.join(trusted.select(trusted[id_col].alias("id")).distinct().hint("merge"), "id", "left_semi")
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(held, target, buckets)))), ",").cast("array<double>")

    def mean_ratio(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(ratios, _bucket(g, buckets)))
        return F.when(F.size(grams) == 0, 0.0).otherwise(total / F.size(grams))

    text = text_of(docs, text_col)
    counts = F.struct(
        _let(_hashes(text), lambda h: F.struct(F.size(h).cast("bigint").alias("n_words"), _repeat_words(h).cast("bigint").alias("n_repeat_words"), _let(_ngrams(h), mean_ratio).alias("log_ratio"))).alias("c"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _dup_lines(text).cast("bigint").alias("n_dup_lines"),
    )

    def verdict(x: Column) -> Column:
        failed = (x["c"]["n_words"] < MIN_WORDS) | (100 * x["c"]["n_repeat_words"] > MAX_REPEAT_PERCENT * x["c"]["n_words"])
        names = {c: x[c] for c in ("word_chars", "n_symbols", "n_dup_lines")}
        columns = {"n_words": x["c"]["n_words"], **names, "n_repeat_words": x["c"]["n_repeat_words"], "base_failed": failed, "kept": ~failed & (x["c"]["log_ratio"] >= threshold), "log_ratio": x["c"]["log_ratio"]}
        return F.struct(*(c.alias(name) for name, c in columns.items()))

    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _let(counts, verdict).alias("rating"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept`` and ``log_ratio``. ``trusted`` is a table of ids whose documents are the target corpus.

    Null and empty texts have no words: all counts are 0, the base rules fail, ``log_ratio`` is 0. Without trusted
    documents or words every ratio is 0. Rows with a null id are rated and count as raw text. Repeated
    rows give equal rows. Other columns are not read. An empty table gives an empty table."""
    return rated(docs.select(id_col, text_col), trusted, id_col, text_col, threshold, buckets).select(F.col("row")[id_col].alias("_id"), "rating").select(F.col("_id").alias(id_col), "rating.*")
