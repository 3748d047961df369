from __future__ import annotations

from toponexus import catalogue


def test_sequential_match_walks_all_candidates(spark, tmp_path):
    suppliers = [(i, "aaaaaaaaa", 0) for i in range(8)]
    customers = [(i, "aaaaaaaa" + c, 0) for i, c in enumerate("abcdefgh")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.eng_id: r.cand for r in catalogue.queries()["sequential_match"](spark, str(tmp_path)).collect()}
    # all scores but that of the first customer are equal, so the order of customers decides
    free, want = [name for _, name, _ in customers], {}
    for row, _, _ in suppliers:
        want[row] = free.pop(0)
    assert got == want
