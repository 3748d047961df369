from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from toponexus.llm import queries, storage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, new string, score string, row string"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), storage.table(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == columns and docs.where("n_chars <> length(text)").isEmpty()
        if name in ("language_id", "line_dedup", "suffix_dedup"):
            assert docs.count() >= 0.98 * before
    want = sorted(r[:] for r in docs.drop("ids").collect())
    assert want == sorted(r[:] for r in queries.queries()["pipeline"](spark, SF).drop("ids").collect())


@pytest.mark.parametrize("number", range(5))
def test_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    long = "the passage that is repeated in many documents and goes on for some time, longer than a hundred bytes in all"
    rows = [(0, long), (1, long), (2, None), (3, ""), (None, long), (None, None), (4, "one of a kind, quite unlike the others here"), (4, "one of a kind, quite unlike the others here"), (5, "é" * 30_000)]
    frame = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "n", "s", "r") for i, t in rows], SCHEMA)
    got = stage(spark, storage.table(frame), SF).collect()
    empty = stage(spark, storage.table(frame.limit(0)), SF).collect()
    assert empty == []
    kept = sorted(str(r.doc_id) for r in got)
    if name == "language_id":
        assert got == []  # nothing is labelled, so nothing can be named
    elif name == "simhash_near_dedup":
        assert kept == ["0", "2", "4", "4", "5", "None", "None"]
    elif name == "packing":
        assert set(kept) == {"0", "1", "2", "3", "4", "5", "None"}
    else:
        assert kept == sorted(str(i) for i, _ in rows) and {(r.new, r.score, r.row) for r in got} == {("n", "s", "r")}
    if name == "suffix_dedup":
        assert sorted((r.doc_id, len(r.text)) for r in got if r.doc_id in (0, 1)) == [(0, len(long)), (1, 0)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF)
    want = base.sql(queries.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    assert sorted(frame.select(columns).collect()) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_a_result(spark):
    for name, query in queries.queries().items():
        if name != "pipeline":
            assert not query(spark, SF).limit(1).isEmpty(), name
