from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from toponexus import schemas, sinks
from toponexus.functions.text import words
from toponexus.sources import providers, readers, xlsx
from toponexus.streaming.word_cache import keep_filled


def test_discover(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("")
    assert len(readers.discover(spark, str(tmp_path), "*.xlsx")) == 1
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path), "*.none")


def test_pairs_lines_and_literals(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,1\nb,2\na,3\nc,\n")
    assert {r.key: r.value for r in readers.pairs(spark, str(tmp_path / "p.csv")).collect()} == {"a": "3", "b": "2", "c": ""}
    (tmp_path / "l.txt").write_text("x\n\ny\n")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "l.txt")).orderBy("row_id").collect()] == ["x", "y"]
    assert readers.literals(spark, ["b", "a", "b"]).count() == 3


def test_word_cache(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert readers.word_cache(spark, path).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"a": ["x", "y"], "b": []}, indent=1))
    assert {r.token: r.cands for r in readers.word_cache(spark, path).collect()} == {"a": ["x", "y"], "b": []}
    sinks.write_json(readers.word_cache(spark, path), str(tmp_path / "rows"))
    assert {r.token: r.cands for r in readers.word_cache(spark, str(tmp_path / "rows")).collect()} == {"a": ["x", "y"], "b": []}
    (tmp_path / "bad.json").write_text("{nothing")
    assert readers.word_cache(spark, str(tmp_path / "bad.json")).count() == 0


def test_gazetteer_and_shapes(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\t".join(["7", "Name", "Name", "", "33.5", "35.5", "P", "PPL", "LB", "", "", "", "", "", "10", "", "5", "Asia/Beirut", "2020-01-02"]) + "\n")
    row = readers.gazetteer(spark, str(tmp_path / "g.txt")).first()
    assert (row.geonameid, row.latitude, row.population, str(row.modification_date)) == (7, 33.5, 10, "2020-01-02")
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"NAME_3": "V", "NAME_2": "D"}}]}))
    assert readers.shape_names(spark, str(tmp_path / "s.json")).first()[:] == (0, "V", "D")


def test_workbook_round_trip(spark, tmp_path):
    xlsx.register(spark)
    one = spark.createDataFrame([("a<b", None, 1), ("بيت", " x ", 2)], "`Village Name` string, o string, n int")
    two = spark.createDataFrame([("d", "e")], "District string, `District Arabic` string")
    path = str(tmp_path / "b.xlsx")
    xlsx.write_book({"Arabic": one, "Map & more": two}, path)
    got = spark.read.format("xlsx").option("sheet", 0).load(path)
    assert got.columns == ["row_id", "Village Name", "o", "n"]
    assert [tuple(r) for r in got.orderBy("row_id").collect()] == [(0, "a<b", None, "1"), (1, "بيت", " x ", "2")]
    assert spark.read.format("xlsx").option("sheet", 1).load(path).first()[:] == (0, "d", "e")


def test_csv_text_and_literal_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    path = str(tmp_path / "out")
    sinks.replace_csv(rows, path)
    sinks.append_csv(rows, path)
    assert spark.read.option("header", True).csv(path).count() == 4
    sinks.replace_csv(rows, path)
    assert spark.read.option("header", True).csv(path).count() == 2
    sinks.write_lines(rows, str(tmp_path / "lines"), "k", "v")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a,1", "b,"]
    assert sinks.array_literal(rows.withColumn("o", F.lit(0)), "names", "k", "o").first().value == 'names=["a","b"]'
    sinks.append_metrics(rows, str(tmp_path / "m"))
    sinks.append_metrics(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    sinks.write_tables({"t": rows}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "t")).count() == 2


def test_fallback(spark, tmp_path):
    rows = spark.range(1)
    tried = []

    def write(frame, path):
        tried.append(path)
        if path == "a":
            raise OSError("Permission denied")

    assert sinks.with_fallback(write, rows, "a", "b") == "b" and tried == ["a", "b"]


def test_providers(spark):
    cache = spark.createDataFrame([("a", ["x"]), ("miss", [])], schemas.TOKENS)
    keys = spark.createDataFrame([("a",), ("miss",), ("b",), ("b",), ("bad",)], "token string")

    def fetch(key):
        if key == "bad":
            raise ValueError("no")
        return [key.upper()] if key == "b" else ["asked again"]

    got = {r.token: r.cands for r in providers.ask_through_cache(keys, cache, "token", fetch, workers=2).collect()}
    assert got == {"a": ["x"], "miss": [], "b": ["B"], "bad": []}
    tries = []

    def flaky(key):
        tries.append(key)
        if len(tries) < 3:
            raise providers.RetryableError
        return [key]

    assert providers.with_retries(flaky, backoff=0)("k") == ["k"] and len(tries) == 3


def test_streamed_cache(spark, tmp_path):
    names = spark.createDataFrame([(0, "Beit el Din"), (1, "Beit Mery")], "row_id long, name string")
    names.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names.schema).parquet(str(tmp_path / "in"))
    keep_filled(stream, str(tmp_path / "cache"), providers.from_mapping({"Beit": ["b"]}), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "cache"))
    assert {r.token: r.cands for r in got.collect()} == {"Beit": ["b"], "Din": [], "Mery": []}


def test_schema_check(spark):
    with pytest.raises(ValueError, match="missing"):
        schemas.check(spark.range(1), schemas.PAIRS, "pairs")
    assert words is not None
