from __future__ import annotations

from toponexus.operators import assignment
from toponexus.plans import linkage
from toponexus.sources import readers, xlsx


def test_names_are_written_back_district_by_district(spark):
    schema = "row_id long, name string, district string, counterpart string"
    english = spark.createDataFrame([(0, "aaa", "D1", None), (5, "Bob", "D2", None), (10, "BOB", "D1", None)], schema)
    arabic = spark.createDataFrame([(0, "bob", "a1", None), (1, "bob", "a2", None), (2, "aaa", "a1", None)], schema)
    districts = spark.createDataFrame([("D1", "a1"), ("D2", "a2")], "district_en string, district_ar string")
    cache = spark.createDataFrame([], "token string, cands array<string>")
    found = linkage.match(english, arabic, districts, cache)
    assert {r.row_id: r.counterpart for r in found.arabic.collect()} == {0: "BOB", 1: "BOB", 2: "aaa"}


def test_a_group_counts_rows_without_candidates(spark):
    edges = spark.createDataFrame([(1, 1, "g", "a1", 1, 90.0), (1, 1, "g", "a2", 2, 85.0), (2, 2, "g", "a1", 1, 88.0)], "eng_id long, eng_ord long, group string, cand string, cand_ord long, score double")
    rows = spark.createDataFrame([(i, "g") for i in range(1, 10)], "eng_id long, group string")
    pairs = {square: {(r.eng_id, r.cand) for r in assignment.assign(edges, 80.0, square, rows=rows).collect()} for square in (5, 9)}
    assert pairs == {5: {(1, "a1")}, 9: {(1, "a2"), (2, "a1")}}


def test_blank_sheet_rows_keep_their_place(spark, tmp_path):
    data = xlsx.book_bytes({"s": (["name"], iter([("x",), (None,), ("y",)]))})
    assert list(xlsx.sheet_rows(data, 0)) == [["name"], ["x"], [], ["y"]]


def test_last_value_wins_over_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,first\n" + "z,1\n" * 10)
    (tmp_path / "b.csv").write_text("k,last\n")
    assert {r.key: r.value for r in readers.pairs(spark, str(tmp_path)).collect()}["k"] == "last"
