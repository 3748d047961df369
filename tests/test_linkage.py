from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toponexus.functions.similarity import pair_score, partial_ratio, ratio, token_set_ratio
from toponexus.operators import assignment
from toponexus.plans import linkage


def test_ratios():
    assert ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert token_set_ratio("", "a") == 0
    assert token_set_ratio("a b", "c d") == pytest.approx(100 * 2 * 1 / 6)
    assert partial_ratio("abc", "xxabcxx") == 100
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(2))
        for kernel in (ratio, token_set_ratio, partial_ratio):
            assert kernel(a, b) == pytest.approx(kernel(b, a))
            assert 0 <= kernel(a, b) <= 100
        if a and b:
            stretches = [(x, y[max(0, e - len(x)) : e]) for x, y in ((a, b), (b, a)) if len(x) <= len(y) for e in range(1, len(y) + len(x))]
            assert partial_ratio(a, b) == pytest.approx(max(ratio(x, y) for x, y in stretches))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert ratio(a, b) == pytest.approx(200 * table[-1, -1] / (len(a) + len(b)) if a or b else 100)


def test_pair_score_takes_the_first_best_phrase():
    assert pair_score("beit", "beit", ["بيت مري", "بيت"], "بيت", False) == ("بيت مري", 100.0)
    assert pair_score("beit", "beit", ["beit"], "بيت", False)[0] == ""


def _brute(rows, columns, scores, threshold):
    best = (0, 0.0)
    for picks in itertools.product(range(-1, columns), repeat=rows):
        used = [p for p in picks if p >= 0]
        if len(set(used)) == len(used) and all(p < 0 or scores.get((i, p), 0) >= threshold for i, p in enumerate(picks)):
            best = max(best, (len(used), sum(scores[i, p] for i, p in enumerate(picks) if p >= 0)))
    return best


def test_optimal_pairs_against_brute_force():
    golden = {(0, 0): 90, (0, 1): 80, (1, 0): 85, (1, 1): 70}
    assert sorted(assignment.optimal_pairs(2, 2, golden, 75)) == [(0, 1), (1, 0)]
    rng = random.Random(2)
    for _ in range(200):
        rows, columns = rng.randrange(1, 5), rng.randrange(1, 5)
        scores = {(i, j): rng.choice([0, 70, 80, 85, 90, 100]) for i in range(rows) for j in range(columns)}
        found = assignment.optimal_pairs(rows, columns, scores, 80)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert (len(found), sum(scores[p] for p in found)) == _brute(rows, columns, scores, 80)


def _edges(rng, rows, columns):
    return [(f"g{i % 2}", i, i, f"c{j}", j, float(rng.choice([60, 80, 85, 90, 95]))) for i in range(rows) for j in range(columns) if rng.random() < 0.6]


SCHEMA = "group string, eng_id long, eng_ord long, cand string, cand_ord long, score double"


@pytest.mark.parametrize("seed", range(3))
def test_in_order_and_greedy_against_loops(spark, seed):
    edges = _edges(random.Random(seed), 8, 6)
    frame = spark.createDataFrame(edges, SCHEMA)
    taken = {}
    for _, group in itertools.groupby(edges, key=lambda e: e[1]):
        for e in sorted(group, key=lambda e: (-e[5], e[4])):
            if e[5] >= 80 and e[3] not in taken.values():
                taken[e[1]] = e[3]
                break
    order = assignment.in_order(frame)
    assert {r.eng_id: r.cand for r in order.collect()} == taken
    free = {r.eng_id: r.cand for r in assignment.next_best(frame, order).collect()}
    assert all(free[e] == c for e, c in taken.items())
    want = set()
    for group in ("g0", "g1"):
        rows, names = set(), set()
        for e in sorted((e for e in edges if e[0] == group and e[5] >= 80), key=lambda e: (-e[5], e[2], e[4])):
            if e[1] not in rows and e[3] not in names:
                rows.add(e[1])
                names.add(e[3])
                want.add((e[1], e[3]))
    assert {(r.eng_id, r.cand) for r in assignment.greedy(frame).collect()} == want
    both = assignment.assign(frame, square=0)
    assert {(r.eng_id, r.cand) for r in both.collect()} == want


NAMES = "row_id long, name string, district string, counterpart string"


def _tables(spark):
    english = spark.createDataFrame(
        [(0, "Beit Mery", "Metn", None), (1, "Al-Bireh", "Akkar", None), (2, "Nowhere", "Lost", None), (3, "Zahle", "Empty", None), (4, "Done", "Metn", "x"), (5, "Beit-Mery", "Metn", None)], NAMES
    )
    arabic = spark.createDataFrame([(0, "بيت مري", "المتن", None), (1, "البيرة", "عكار", None), (2, "بكفيا", "المتن", None), (3, "x", "المتن", "y")], NAMES)
    districts = spark.createDataFrame([("Metn", "المتن"), ("Akkar", "عكار"), ("Empty", "فارغ"), ("Lost", None)], "district_en string, district_ar string")
    cache = spark.createDataFrame([("Beit", ["بيت"]), ("Mery", ["ميري", "مري"]), ("Bireh", ["بيرة"])], "token string, cands array<string>")
    return english, arabic, districts, cache


@pytest.mark.parametrize("options", [linkage.Options(), linkage.sequential()])
def test_matchers_end_to_end(spark, options):
    english, arabic, districts, cache = _tables(spark)
    out = linkage.match(english, arabic, districts, cache, options)
    accepted = {(r[0], r[1]): (r[2], r[3]) for r in out.accepted.collect()}
    assert accepted == {("Beit Mery", "Metn"): ("بيت مري", 100.0), ("Al-Bireh", "Akkar"): ("البيرة", 100.0)} or ("Beit-Mery", "Metn") in accepted
    assert len(accepted) == 2
    results = {r[0]: r for r in out.results.collect()}
    assert set(results) == {"Beit Mery", "Beit-Mery", "Al-Bireh", "Zahle"}
    assert results["Zahle"][2:] == ("", 0.0)
    assert [r.name for r in out.unmapped.collect()] == ["Nowhere"]
    review = {r[0]: r for r in out.review.collect()}
    assert "Zahle" in review and review["Zahle"]["Cand1"] is None and len(out.review.columns) == 13
    filled = {r.row_id: r.counterpart for r in out.arabic.collect()}
    assert filled[1] == "Al-Bireh" and filled[3] == "y" and filled[2] is None
    assert {r.row_id: r.counterpart for r in out.english.collect()}[4] == "x"
    if options.method == "sequential":
        assert results["Beit-Mery"][2] == "بكفيا" and ("Beit Mery", "Metn") in accepted
    sizes = {r.group: (r.eng_count, r.cand_count, r.square_size, r.method) for r in out.metrics.collect()}
    assert sizes["Empty"] == (1, 0, 1, "hungarian")


def test_district_filter(spark):
    english, arabic, districts, cache = _tables(spark)
    assert {r[1] for r in linkage.match(english, arabic, districts, cache, linkage.Options(district="Akkar")).results.collect()} == {"Akkar"}
    assert {r[1] for r in linkage.match(english, arabic, districts, cache, linkage.Options(district="FIRST")).results.collect()} == {"Metn"}


@pytest.mark.parametrize("options", [linkage.Options(threshold=60.0), linkage.Options(threshold=60.0, method="sequential")])
def test_rows_that_share_a_name_are_scored_once(spark, monkeypatch, options):
    """The same results as with a score for every row, for fewer pairs."""
    rng = random.Random(11)
    names = ["".join(rng.choice("abc") for _ in range(5)) for _ in range(6)]
    english = spark.createDataFrame([(i, None if i == 7 else rng.choice(names), f"D{i % 2}", None) for i in range(40)], NAMES)
    arabic = spark.createDataFrame([(i, rng.choice(names) + rng.choice(["", "c"]), f"a{i % 2}", None) for i in range(30)], NAMES)
    districts = spark.createDataFrame([("D0", "a0"), ("D1", "a1")], "district_en string, district_ar string")
    cache = spark.createDataFrame([], "token string, cands array<string>")
    scored, real = [], linkage.score_pairs
    monkeypatch.setattr(linkage, "score_pairs", lambda *a: scored.append(real(*a)) or scored[-1])
    out = linkage.match(english, arabic, districts, cache, options)
    results = sorted(map(repr, out.results.collect()))
    review = sorted(map(repr, out.review.collect()))
    assert scored[0].count() <= 2 * 6 * 12
    # every name its own: a sign that scores do not see tells rows apart
    apart = english.withColumn("name", F.concat("name", F.repeat(F.lit(" "), F.col("row_id").cast("int"))))
    alone = linkage.match(apart, arabic, districts, cache, options)
    bare = lambda frame: frame.withColumn("English Name", F.rtrim("English Name"))
    assert results == sorted(map(repr, bare(alone.results).collect()))
    assert review == sorted(map(repr, bare(alone.review).collect()))
    assert scored[1].count() > 2 * scored[0].count()
