"""The matchers keep what results need of a district's pairs, and nothing they need is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from toponexus.functions.similarity import pair_scores
from toponexus.operators import best_scores
from toponexus.plans import linkage

NAMES = "row_id long, name string, district string, counterpart string"


@pytest.mark.parametrize("by_word", [True, False])
def test_scores_against_pairs_one_by_one(by_word):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(rng.choice(["ab", "abc", "اىبت", "é-\0"])) for _ in range(rng.choice([1, 2, 5, 9, 18, 64, 65])))
    text = lambda: " ".join(word() for _ in range(rng.choice([1, 1, 2, 3]))).strip()
    found = [text() for _ in range(40)] + ["وادي خالد", "", "ال", "St. Mary", "Supplier#012", "a  b"]
    asked = [x for x in [text() for _ in range(36)] + ["mary", "wady khald", "b a b", "supplier#021"] if x.split()]
    candidates = best_scores.Candidates(found, by_word)
    want = [np.array([score for _, score in pair_scores([(x, x, ["-"], y, by_word) for y in found])]) for x in asked]
    for k, threshold in ((5, None), (40, None), (3, 40.0), (None, None)):
        for own, (places, scores) in zip(want, candidates.scores(asked, k, threshold), strict=True):
            assert (own[places] == scores).all()
            least = -np.inf if k is None else min(np.sort(own)[-k], np.inf if threshold is None else threshold)
            assert set(np.flatnonzero(own >= least)) <= set(places.tolist())


def _sides(spark):
    rng = random.Random(4)
    name = lambda: " ".join("".join(rng.choice("abcd") for _ in range(rng.choice([3, 6]))) for _ in range(rng.choice([1, 1, 2])))
    english = [(i, rng.choice(["mary", "beit mary", name(), name()]), f"D{i % 2}", None) for i in range(60)]
    arabic = [(i, rng.choice(["مري", "بيت مري", name(), name(), name()]), f"a{i % 2}", None) for i in range(90)]
    districts = spark.createDataFrame([("D0", "a0"), ("D1", "a1")], "district_en string, district_ar string")
    cache = spark.createDataFrame([("mary", ["مري", "ماري"])], "token string, cands array<string>")
    phrases = {"mary": ["مري", "ماري"], "beit mary": ["beit مري", "beit ماري"]}

    def ranked(row, by_word):
        """All candidates of a row, (score, -place, name, via), best first."""
        _, english_name, district, _ = row
        first = {}
        for i, x, d, _ in arabic:
            if d[1] == district[1]:
                first.setdefault(x, i)
        found = pair_scores([(english_name, english_name, phrases.get(english_name, [english_name]), x, by_word) for x in first])
        return sorted(((score, -i, x, via) for (x, i), (via, score) in zip(first.items(), found, strict=True)), reverse=True)

    return english, spark.createDataFrame(english, NAMES), spark.createDataFrame(arabic, NAMES), districts, cache, ranked


def _small(monkeypatch):
    for name, size in (("ASKED", 4), ("FOUND", 16), ("ALONE", 2)):
        monkeypatch.setattr(best_scores, name, size)


def _review(row):
    return [(row[f"Cand{i}_Score"], row[f"Cand{i}"], row[f"Cand{i}_Lat"]) for i in (1, 2, 3)]


def test_optimal_keeps_the_best_of_each_name(spark, monkeypatch):
    _small(monkeypatch)
    english, left, right, districts, cache, ranked = _sides(spark)
    made, real = [], linkage.score_pairs
    monkeypatch.setattr(linkage, "score_pairs", lambda *a: made.append(real(*a)) or made[-1])
    out = linkage.match(left, right, districts, cache, linkage.Options(threshold=101.0))
    pairs = {}
    for r in made[0].collect():
        pairs.setdefault((r.name, r.district_en), []).append((r.score, -r.cand_ord, r.cand, r.via))
    assert pairs == {(row[1], row[2]): pairs[row[1], row[2]] for row in english}
    for row in english:
        assert sorted(pairs[row[1], row[2]], reverse=True) == ranked(row, True)[:5]
    review = {(r[0], r[1]): r for r in out.review.collect()}
    for row in english:
        assert _review(review[row[1], row[2]]) == [(s, x, via) for s, _, x, via in ranked(row, True)[:3]]


@pytest.mark.parametrize("by_word", [True, False])
def test_sequential_finds_what_is_free_beyond_the_best(spark, monkeypatch, by_word):
    _small(monkeypatch)
    english, left, right, districts, cache, ranked = _sides(spark)
    searches, real = [], best_scores.first_free
    monkeypatch.setattr(best_scores, "first_free", lambda *a: searches.append(1) or real(*a))
    made, scored = [], linkage.score_pairs
    monkeypatch.setattr(linkage, "score_pairs", lambda *a: made.append(scored(*a)) or made[-1])
    options = linkage.Options(method="sequential", threshold=70.0, by_word=by_word)
    out = linkage.match(left, right, districts, cache, options)
    taken, want = set(), []
    for row in english:
        score, _, name, _ = next(x for x in ranked(row, by_word) if x[2] not in taken)
        taken.update([name] if score >= 70.0 else [])
        want.append((row[1], row[2], name, score))
    assert sorted(map(tuple, out.results.collect())) == sorted(want)
    assert (searches or not by_word) and made[0].count() < len({(r[1], r[2]) for r in english}) * 20
    for r in out.review.collect():
        assert _review(r) == [(s, x, via) for s, _, x, via in ranked((0, r[0], r[1], None), by_word)[:3]]
    names = {d: {x[2] for x in ranked((0, "mary", d, None), by_word)} for d in ("D0", "D1")}
    assert {r.group: r.cand_count for r in out.metrics.collect()} == {d: len(x) for d, x in names.items()}
