"""Every query with SQL gives DuckDB's rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from pelagia import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return None if math.isnan(float(v)) else round(float(v), 5)
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*(f"`{c}`" for c in columns)).collect()
    assert rows
    if name in queries.ORACLE_SQL:
        found = duck.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(map(str, (tuple(map(plain, r)) for r in rows))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", ["s7_video_metadata_files", "s8_cross_reference_files", "s8_frame_files", "s8_matched_files", "s9_annotation_files", "s10_document_files", "s11_manifest_files", "e3_image_sets", "e4_document_files"])
def test_query_where_keys_share_files(spark, duck, monkeypatch, name):
    monkeypatch.setattr(queries.tables, "FOLDERS", 3)
    test_query(spark, duck, name)
