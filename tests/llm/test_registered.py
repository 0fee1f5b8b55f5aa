"""The queries as they are registered, against SQL where there is some; the pipeline's stages against plain forms."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pelagia.llm import decontamination, line_dedup, near_duplicates, quality_rules, registry
from pelagia.llm.common import discard, materialise, shared_folder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_decontamination": ["doc_id", "item_id", "edits", "start", "end"], "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op5_line_dedup": ["doc_id", "text", "n_lines", "n_removed"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op7_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"], "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op10_near_duplicates": ["doc_id", "class_id"],
    "op11_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "op12_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op13_centroid_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(values):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in row]) for row in values)


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_query(spark, duck, name):
    made = registry.QUERIES[name](spark, DATA)
    assert made.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = made.collect()
    counts = {"op2_url_filter": "SELECT count(*) FROM pages", "op11_filter_audit": "SELECT 600 * count(DISTINCT lang) FROM documents", "op12_topk_search": "SELECT 20 * count(*) FROM embeddings WHERE vec_id % 20 = 0", "op13_centroid_clusters": "SELECT count(*) FROM embeddings"}
    n = duck.execute(counts.get(name, "SELECT count(*) FROM documents")).fetchone()[0]
    assert len(got) == n if name not in ("op1_decontamination", "op9_packing") else got
    if name in registry.ORACLE_SQL:
        expected = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in expected.description]
        assert rows(map(tuple, made.select(*names).collect())) == rows(expected.fetchall())
    if name in ("op7_quality_classifier", "op8_toxicity"):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.3 if "op7" in name else 0.5)) for r in got)
    if name == "op9_packing":
        assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
        used = len({r["sequence_id"] for r in got})
        assert sum(r["length"] for r in got) > 0.9 * 1024 * (used - 1)  # little padding


def test_pipeline_stages(spark):
    """Each stage on what the one before has kept: columns stay, and its decision is that of its operator."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, DATA))
        if name == "quality_rules":
            assert ids(made) == ids(quality_rules.quality_rules(docs, spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")).where("kept"))
        if name == "line_dedup":
            assert ids(made) == ids(docs)
            expected = line_dedup.deduplicated_lines(docs).select("doc_id", "text")
            assert rows(map(tuple, made.select("doc_id", "text").collect())) == rows(map(tuple, expected.collect()))
        if name == "near_duplicates":
            assert ids(made) == ids(near_duplicates.near_duplicate_classes(docs).where("doc_id = class_id"))
        if name == "decontamination":
            dirty = decontamination.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id")
            assert ids(made) == ids(docs.join(dirty, "doc_id", "left_anti"))
        if name == "packing":
            assert ids(made.select("doc_id").distinct()) == ids(docs)
            assert rows(map(tuple, made.select("doc_id", "start", "ids_crc32").collect())) == rows(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "ids_crc32").collect()))
        else:
            assert made.columns == docs.columns
        docs = made


def test_pipeline_of_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    odd = docs.limit(30).union(docs.limit(5)).withColumns({"text": F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("text")), "doc_id": F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")), "n_lines": F.lit(1), "row": F.lit("x")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_written_frames_are_deleted_again(spark):
    df = materialise(spark.range(5))
    assert df.written_to.startswith(shared_folder(spark)) and df.count() == 5 and os.path.isdir(df.written_to)
    discard(df, spark.range(1))
    assert not os.path.exists(df.written_to)
