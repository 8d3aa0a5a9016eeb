"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tracewell import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    return str(value)[:26] if isinstance(value, (datetime.datetime, datetime.date)) else str(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        places = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert found == sorted((tuple(plain(r[i]) for i in places) for r in rel.fetchall()), key=str)


def test_triggers_of_odd_items(spark, tmp_path):
    """Items without letters, null and capital ones: their trigger is empty, missing or lower-cased as the SQL does."""
    docs = [(1, "The cat."), (1, "The cat."), (2, "concat"), (3, ""), (4, None), (5, "x, y"), (6, "a.b"), (7, "İstanbul, in"), (None, "the 中 end"), (8, "ISTANBUL\n"), (9, "K\u212a")]
    items = ["The 1", "1 2", "", None, "İSTANBUL is", "中", "cat", "\u212aK", "in"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = connection.sql(catalog.oracle_sql()["j15_glossary_triggers"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["j15_glossary_triggers"](spark, str(tmp_path)).collect()]
    assert ("" in {x for _, x in expected}) and sorted(got, key=str) == sorted(expected, key=str)
