"""Packing with given clusters: near copies of different sources share no bin."""

from collections import defaultdict

from ruletrace.llm import packing
from tests.llm.samples import docs


def test_clusters_that_are_given(spark):
    rows = [(i, f"words of text {i} " * 5, "en", f"s{i}", 0) for i in range(60)]
    frame = docs(spark, rows).selectExpr("*", "CASE WHEN doc_id < 40 THEN doc_id % 4 END AS component_id")
    got = packing.packing(frame, capacity=200, block_rows=1000, cluster="component_id").collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r["doc_id"])
    for members in bins.values():
        clusters = [i % 4 for i in members if i < 40]
        assert len(clusters) == len(set(clusters)) and len(members) <= 10
    assert sorted(i for m in bins.values() for i in m) == list(range(60)) and max(map(len, bins.values())) > 4
    free = packing.packing(frame, capacity=200, block_rows=1000).collect()
    assert len({r["bin"] for r in free}) < len(bins)
