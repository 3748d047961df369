from __future__ import annotations

from toponexus.plans import lookups


def test_dictionary_lookup_reads_the_whole_product(spark):
    names = spark.createDataFrame([(0, "ka ra ma"), (1, "ka ka")], "row_id long, name string")
    answers = spark.createDataFrame([(w, [f"{w}{i}" for i in range(10)]) for w in ("ka", "ra", "ma")], "token string, cands array<string>")
    master = spark.createDataFrame([("ka9 ra8 ma7",), ("ka9 ra9 ma9",), ("ka1 ka2",), ("ka1 ka0",), ("ka1",), ("ka1 ka2 x",)], "name string")
    got = {r.row_id: (r.match, int(r.nth)) for r in lookups.dictionary_lookup(names, master, answers, glue=False).collect()}
    assert got == {0: ("ka9 ra8 ma7", 987), 1: ("ka1 ka0", 10)}
