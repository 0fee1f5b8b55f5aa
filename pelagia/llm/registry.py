"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .clustering import centroid_clusters
from .common import table
from .decontamination import contaminated
from .filter_audit import filter_audit
from .line_dedup import deduplicated_lines
from .near_duplicates import near_duplicate_classes
from .packing import packed
from .pii import personal_data, span_digests
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .suffix_dedup import without_repeats
from .topk_search import highest_products
from .toxicity import toxicity_scores
from .url_filter import url_verdicts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without strings that occur twice, as counts and a digest."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans of personal data."""
    return span_digests(personal_data(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return deduplicated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rule counts and verdict; the documents labelled good are the trusted target."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


#: host, path prefix, action
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its verdict."""
    judged = url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 12) for c in ("trust", "distrust")})


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return highest_products(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_filter_audit": op11_filter_audit,
    "op12_topk_search": op12_topk_search,
    "op13_centroid_clusters": op13_centroid_clusters,
}

#: The others hash, sign, align, learn or tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": oracles.url_verdicts(URL_RULES), "op3_suffix_dedup": oracles.without_repeats(), "op10_near_duplicates": oracles.near_duplicate_classes(),
    "op11_filter_audit": oracles.filter_audit(), "op12_topk_search": oracles.highest_products(), "op13_centroid_clusters": oracles.centroid_clusters(),
}
