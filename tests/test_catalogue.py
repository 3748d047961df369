from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from toponexus import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rounded(rows, columns, names):
    places = [names.index(c) for c in columns]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in places) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    frame = catalogue.queries()[name](spark, SF)
    rows = frame.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    base = duckdb.connect()
    for table in TABLES.split():
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.sql(catalogue.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    assert rounded(rows, columns, frame.columns) == rounded(want.fetchall(), columns, want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
