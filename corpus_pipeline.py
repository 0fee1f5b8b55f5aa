"""From raw documents to packed training sequences: the stages of a corpus build, in order.

Every stage takes any table with ``doc_id`` and ``text`` and keeps its other columns, whatever their names. An empty
table gives an empty table. Rows are never dropped or capped to escape a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagia.llm.common import discard, materialise, table
from pelagia.llm.decontamination import without_contaminated
from pelagia.llm.line_dedup import deduplicated_lines
from pelagia.llm.near_duplicates import one_per_class
from pelagia.llm.packing import packed
from pelagia.llm.quality_rules import rated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; ``labels`` names the trusted ones. Null and empty texts go, as they
    have no words. Rows with a null id and repeated rows are judged each by its text."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return rated(docs, trusted).where("rating.kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated lines taken out; a document that had nothing else stays with an empty text. Null texts
    and rows with a null id stay as they are."""
    return deduplicated_lines(docs, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id. Null and empty texts are equal texts; rows with
    a null id all stay; rows that repeat an id are classed each by its own text."""
    return one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark``. Null and empty texts hold none, nor do null and empty items
    stand in any text; rows with a null id and repeated rows are judged each."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences. Null and empty texts are one piece, the end mark alone; rows with a
    null id and repeated rows are packed each."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_copies), ("decontamination", benchmark), ("packing", sequences)]

#: Hashing, signatures and alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; what a stage has read is
    deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
