from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from toponexus.llm import near_copies, storage


def shingles(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def kept(rows):
    """Ids that stay, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if like(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def changed(rng, words, n):
    out = list(words)
    for place in rng.sample(range(len(out)), n):
        out[place] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small", [32, 2])
def test_stage_finds_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = random.Random(5)
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([40, 120, 300]))]
        texts += [" ".join(base), *(changed(rng, base, n) for n in (1, 1, 2, 3, 5, 8))]
        texts += [changed(rng, base, len(base) // 40) for _ in range(4)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = storage.table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    want = kept(rows)
    assert len(want) < len(rows) - 40
    assert got == want


def test_no_link_within_a_large_bucket_is_lost(spark, monkeypatch):
    """Families that share many buckets without being like one another, each with a copy of its own."""
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(100)], []
    for family in range(40):
        words = list(base)
        at = rng.randrange(95)
        words[at : at + 3] = [f"f{family}x{i}" for i in range(3)]
        texts += [" ".join(words), changed(rng, words, 1)]
    rows = list(enumerate(texts))
    docs = storage.table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = near_copies.near_copies(docs)
    assert sorted({r.component_id for r in got.collect()}) == kept(rows)
    assert len(kept(rows)) < len(rows) - 30


def test_texts_are_not_exchanged(spark):
    """Only the sets of what is proposed move, not the texts they are looked up in."""
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(6000)) for _ in range(100)]
    texts += [changed(rng, texts[0].split(), 1)]
    docs = storage.table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    setting = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")  # as with more ids than a broadcast takes
    try:
        before = written()
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    finally:
        spark.conf.unset(setting)
    assert got == {**{i: i for i in range(100)}, 100: 0}
    assert 0 < written() - before < 0.1 * sum(map(len, texts))


def test_filter_holds_every_id(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 3000):
        ids = rng.integers(-(2**63), 2**63 - 1, n)
        held = near_copies.id_filter(spark.createDataFrame([(i,) for i in ids.tolist()], "id long"))
        assert near_copies.in_filter(held, ids).all()
        assert near_copies.in_filter(held, rng.integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.05


def test_filter_that_is_full_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MOST_BITS", 64)
    rng = random.Random(10)
    rows = [(None if i == 7 else i // 2 * 2, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, text + " more") for i, (_, text) in enumerate(rows)]
    docs = storage.table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_copies.near_copies(docs).collect())
    want = sorted([(i is None, i or 0, 1007 if i is None else i) for i, _ in rows[:200]] + [(False, 1000 + k, 1007 if i is None else i) for k, (i, _) in enumerate(rows[:200])])
    assert got == want
