from __future__ import annotations

import random

import duckdb
import pytest

from toponexus import catalogue
from toponexus.functions import name_tree
from toponexus.operators import near_names


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_tree_gives_plain_distances():
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("ab\0é") for _ in range(n))

    names = list({word(rng.randrange(8)) for _ in range(60)} | {word(n) for n in (33, 70, 300)})
    asked = [word(rng.randrange(8)) for _ in range(20)] + [word(n) for n in (0, 31, 32, 33, 64, 65)]
    seen = []
    for places, rows in name_tree.Tree(names).batches(asked):
        for place, row in zip(places, rows, strict=True):
            seen.append(place)
            assert row.tolist() == [plain_distance(asked[place], x) for x in names]
    assert sorted(seen) == list(range(len(asked)))
    assert [len(rows[0]) for _, rows in name_tree.Tree([]).batches(["a"])] == [0]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Copies, ties, cases, empty and null names and nations, and nations of one side only."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("odd")

    def name():
        return rng.choice([None, "", "ABBA", "abba", *("".join(rng.choice("aAbB") for _ in range(rng.randrange(1, 7))) for _ in range(6))])

    suppliers = [(i, name(), rng.choice([0, 0, 1, 2, None])) for i in range(40)]
    customers = [(i, name(), rng.choice([0, 0, 1, 3, None])) for i in rng.sample(range(500), 150)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    frame = catalogue.queries()[name](spark, folder)
    base = duckdb.connect()
    for table in ("supplier", "customer"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = base.sql(catalogue.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    got = sorted(map(repr, (tuple(r) for r in frame.select(want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall())) and got
    return frame


def compares_names_once(frame):
    """No plan of pairs: the engine's own distance is not called for each."""
    return "levenshtein" not in frame._jdf.queryExecution().toString().lower()


@pytest.fixture(params=[1 << 16, 3])
def parts(request, monkeypatch):
    monkeypatch.setattr(near_names, "FOUND", request.param)
    monkeypatch.setattr(near_names, "ASKED", min(request.param, 512))


def test_blocked_levenshtein_top1(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "blocked_levenshtein_top1"))


def test_blocked_topk5(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "blocked_topk5"))


def test_accept_review_split(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "accept_review_split"))


def test_review_pivot_top3(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "review_pivot_top3"))


def test_threshold_filter(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "threshold_filter"))


def test_group_sizes_metrics(spark, odd, parts):
    assert compares_names_once(against_sql(spark, odd, "group_sizes_metrics"))


def test_greedy_one_to_one(spark, odd, parts):
    against_sql(spark, odd, "greedy_one_to_one")


def test_optimal_assignment(spark, tmp_path):
    """Of two names that both suit two rows, each row gets one, copies of names among its five best or not."""
    spark.createDataFrame([(0, "aaaa", 0), (1, "aaaa", 0), (2, "zzzz", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "AAAA", 0), (1, "aaab", 0), (2, None, 0), (3, "aaab", 0)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    frame = catalogue.queries()["optimal_assignment"](spark, str(tmp_path))
    assert {r.cand for r in frame.collect()} == {"AAAA", "aaab"}
    assert compares_names_once(near_names.best(*catalogue._sides(spark, str(tmp_path)), 5))


def test_sequential_match(spark, odd, parts):
    against_sql(spark, odd, "sequential_match")
