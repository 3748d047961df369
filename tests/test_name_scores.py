"""The fuzzy ratios over whole tables of names, against their definitions."""

from __future__ import annotations

import random
import time
from functools import lru_cache

import pytest

from toponexus import catalogue
from toponexus.functions import similarity
from toponexus.sources import providers

SF = "/root/testdata/sf0.001"


@lru_cache(maxsize=None)
def indel(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def windows(a, b):
    """Every stretch of the longer text of the shorter one's length, and those cut off at both ends."""
    best = 0.0
    for short, long in ([(a, b), (b, a)] if len(a) == len(b) else [sorted((a, b), key=len)]):
        for start in range(1 - len(short), len(long)):
            piece = long[max(start, 0) : start + len(short)]
            best = max(best, indel(short, piece))
    return best


def word_sets(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    return max(indel(one, two), *((indel(shared, one), indel(shared, two)) if shared else (0.0,)))


@pytest.mark.parametrize("name, kernel", [("partial_ratio_names", windows), ("token_set_names", word_sets)])
def test_ratios_over_names(spark, name, kernel):
    rows = catalogue.queries()[name](spark, SF).collect()
    nations = [r.n_name.lower() for r in spark.read.parquet(f"{SF}/nation.parquet").collect()]
    parts = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert len(rows) == (len(nations) if name == "partial_ratio_names" else len(parts)) * len(parts)
    for r in rows:
        assert r.score == pytest.approx(kernel(r.a, r.b), abs=1e-5), (r.a, r.b)


def test_scores_without_a_word_cache(spark):
    rows = catalogue.queries()["latin_fallback_scores"](spark, SF).collect()
    nations = spark.read.parquet(f"{SF}/nation.parquet").count()
    assert len(rows) == nations * len({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    for r in rows:
        # these names are in Latin letters, so the letters stay as they are
        whole = max(word_sets(r.a, r.b), word_sets(r.bare, r.b))
        words = max(max(word_sets(r.a, w), windows(r.a, w)) for w in r.b.split())
        assert r.whole == pytest.approx(whole, abs=1e-5) and r.by_word == pytest.approx(max(whole, words), abs=1e-5)


def test_latin_scores_of_arabic_names():
    assert similarity.word_score("mry", "بيت مري") == 100.0
    assert similarity.latin_score("albyr@", "byr@", "البيرة", False, True) == 100.0
    # leaving locality words out also takes the article off every word
    assert similarity.latin_score("byr@", "byr@", "البيرة", False, False) == 100.0
    assert similarity.latin_score("byra", "byra", "البيرة", False, False) == pytest.approx(indel("byra", "byr@"))
    assert similarity.latin_score("khalid", "khalid", "خالد", True, False) == pytest.approx(max(indel("khalid", "khald"), windows("khalid", "khald")))
    assert similarity.pair_score("khald", "khald", [], "وادي خالد", True) == ("wady khald", 100.0)


def test_a_fetch_that_hangs_is_a_miss():
    asked = []

    def slow(key):
        asked.append(key)
        time.sleep(30 if key == "slow" else 0)
        return [key]

    fetch = providers.with_retries(slow, timeout=0.5)
    began = time.monotonic()
    assert fetch("slow") == [] and fetch("fast") == ["fast"]
    assert time.monotonic() - began < 10 and asked == ["slow", "fast"]


def test_partial_ratios_together():
    rng = random.Random(5)
    sizes = [0, 1, 2, 5, 18, 40, 63, 64, 65, 80]

    def text():
        return "".join(rng.choice(rng.choice(["ab", "abcd\0", "اىبت"])) for _ in range(rng.choice(sizes)))

    pairs = [(text(), text()) for _ in range(1500)]
    assert similarity.partial_ratios(pairs) == [similarity.partial_ratio(a, b) for a, b in pairs]
    assert similarity.partial_ratios([]) == []


def test_rows_scored_together():
    names = ["khald", "wady", "wady khald", "", "beit mery"]
    arabic = ["وادي خالد", "خالد", "", "بيت مري"]
    rows = [(name, name, phrases, other, by_word) for name in names for phrases in ([], ["خالد"], ["khald"]) for other in arabic for by_word in (True, False)]
    assert similarity.pair_scores(rows) == [similarity.pair_score(*row) for row in rows]
    for (name, bare, phrases, other, by_word), (_, score) in zip(rows, similarity.pair_scores(rows), strict=True):
        if similarity.phrase_score(phrases, other)[1] <= 0:
            assert score == similarity.latin_score(name, bare, other, by_word, not phrases)
