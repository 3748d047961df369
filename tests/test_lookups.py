from __future__ import annotations

from pyspark.sql import functions as F

from toponexus.operators import relational
from toponexus.plans import lookups
from toponexus.sources import providers

NAMES = "row_id long, name string, district string, counterpart string"


def test_dictionary_lookup(spark):
    names = spark.createDataFrame([(0, "El Kfar"), (1, "Beit-Mery"), (2, "None"), (3, "Mina")], "row_id long, name string")
    master = spark.createDataFrame([("الكفر",), ("بيت مري",), ("الميناء",)], "name string")
    answers = spark.createDataFrame([("elkfar", ["x", "الكفر"]), ("beit", ["بيت"]), ("mery", ["ميري", "مري"]), ("elmina", ["الميناء"])], "token string, cands array<string>")
    got = {r.name: r.match for r in lookups.dictionary_lookup(names, master, answers).collect()}
    assert got == {"El Kfar": "الكفر", "Beit-Mery": "بيت مري", "Mina": "الميناء"}


def test_argmin_and_latinise(spark):
    keys = spark.createDataFrame([("k1",), ("key22",), ("new",)], "key string")
    cache = spark.createDataFrame([("k1", "beit"), ("key22", "zahle")], "key string, value string")
    latin = lookups.latinise(keys, cache, providers.from_mapping({"new": ["tyre"]}))
    assert {r.key: r.latin for r in latin.collect()} == {"k1": "beit", "key22": "zahle", "new": "tyre"}
    names = spark.createDataFrame([("Beit", 0), ("Zahla", 1), ("Zahli", 2), ("Tyr", 3)], "name string, ord int")
    got = {r.key: (r.name, r.distance) for r in lookups.argmin_match(latin, names).collect()}
    assert got == {"k1": ("Beit", 0.0), "key22": ("Zahla", 1.0), "new": ("Tyr", 1.0)}


def test_bridge(spark):
    arabic = spark.createDataFrame([(0, "ا", "d", None), (1, "ب", "d", "kept")], NAMES)
    english = spark.createDataFrame([(0, "A", "d", None), (1, "B", "d", None)], NAMES)
    towns_ar = spark.createDataFrame([(0, "ا"), (1, "ب"), (2, None)], "row_id long, town string")
    towns_en = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "row_id long, town string")
    new_arabic, new_english = lookups.bridge(arabic, english, towns_ar, towns_en)
    assert {r.name: r.counterpart for r in new_arabic.collect()} == {"ا": "A", "ب": "kept"}
    assert {r.name: r.counterpart for r in new_english.collect()} == {"A": "ا", "B": None}


def test_geocode(spark):
    english = spark.createDataFrame([(0, "A", "d", None), (1, "B", "d", None), (2, "C", "d", "x"), (3, "D", "d", None)], NAMES)
    cache = spark.createDataFrame([("D", "ديك")], "key string, value string")
    answers = {"A": ['[{"address":{"village":"ا","country_code":"lb"}}]'], "B": ["[]"]}
    filled, found = lookups.geocode(english, cache, providers.from_mapping(answers))
    rows = {r.name: (r.counterpart, r.openMapsData != "") for r in filled.collect()}
    assert rows == {"A": ("ا", True), "B": (None, False), "C": ("x", False), "D": ("ديك", False)}
    assert [r[:] for r in found.collect()] == [("A", "ا")]


def test_updates(spark):
    target = spark.createDataFrame([(0, "k", None), (1, "k", " "), (2, "k", "v"), (3, "z", None)], "row_id long, name string, c string")
    source = spark.createDataFrame([("k", "first", 0), ("k", "last", 1)], "name string, v string, o int")
    fill = {r.row_id: r.c for r in relational.fill_blank(target, source, "name", "c", "v", "o").collect()}
    assert fill == {0: "first", 1: "first", 2: "v", 3: None}
    over = {r.row_id: r.c for r in relational.overwrite(target, source, "name", "c", "v", "o").collect()}
    assert over == {0: "last", 1: "last", 2: "last", 3: None}


def test_reconcile_legacy(spark):
    left = spark.createDataFrame([(0, "a", None), (1, "a", "old")], "row_id long, name string, other string")
    right = spark.createDataFrame([(0, "x", "a"), (1, "old", None)], "row_id long, name string, other string")
    new_left, new_right = relational.reconcile(left, right, "name", "other", "name", "other", "row_id", legacy=True)
    assert {r.row_id: r.other for r in new_left.collect()} == {0: "x", 1: "x"}
    new_left, new_right = relational.reconcile(left, right, "name", "other", "name", "other", "row_id")
    assert {r.row_id: r.other for r in new_left.collect()} == {0: "x", 1: "old"}
    assert {r.row_id: r.other for r in new_right.collect()} == {0: "a", 1: "a"}


def test_bags_and_ordinals(spark):
    left, right = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("xxy", "xz"))
    assert sorted(r.v for r in relational.bag_difference(left, right).collect()) == ["x", "y"]
    got = relational.ordinals(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k").collect()
    assert all(r.ord == r.k + 1 for r in got) and len(got) == 100
