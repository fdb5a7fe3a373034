"""Shape measures on distributions published with results: value and count, then what was reported."""

import pytest

from ruletrace.operators import distribution as d
from ruletrace.plans import statements as text

# Published distributions of ceilings and the published measures of each.
CEILINGS = {
    "work_per_day": (
        [(1, 34), (2, 19), (3, 12), (4, 10), (5, 13), (6, 10), (7, 8), (8, 4), (9, 3), (10, 1), (13, 1)],
        (13, "taper", 1, 0, 0.0087, 0.0294, 115, 11)),
    "work_per_resource_per_day": ([(1, 1087), (2, 206), (3, 35), (4, 2)], (4, "taper", 2, 35, 0.0015, 0.0018, 1330, 4)),
    "resources_per_work": (
        [(1, 18), (2, 35), (3, 37), (4, 76), (5, 57), (6, 16), (7, 22), (8, 11), (9, 8), (10, 9), (11, 2), (12, 3), (13, 2),
         (14, 1), (15, 1), (18, 1), (20, 1), (25, 1), (26, 1), (27, 2), (31, 1), (37, 1)],
        (37, "taper", 1, 0, 0.0033, 0.0132, 306, 22)),
}
# Heads of two published gap histograms, all pairs, the least gap, and edge, below and floor.
GAPS = {
    "person": ([(0, 7), (30, 4), (60, 62), (90, 39)], 832, (30, 7, "soft")),
    "vehicle": ([(30, 2), (60, 2), (90, 40)], 193, (30, 0, "hard")),
}


@pytest.mark.parametrize("name", sorted(CEILINGS))
def test_published_ceilings(spark, name):
    values, want = CEILINGS[name]
    counts = spark.createDataFrame([(name, v, n) for v, n in values], "dimension string, v bigint, n bigint")
    r = d.right_edge(counts, ["dimension"], "v", text.CLIFF_RATIO).first()
    assert (r.observed_max, r["shape"], r.count_at_max, r.count_below_max, round(r.share_at_max, 4), round(r.max_over_peak, 4),
            r.observations, r.distinct_values) == want


@pytest.mark.parametrize("kind", sorted(GAPS))
def test_published_floors(spark, kind):
    head, pairs, want = GAPS[kind]
    rest = [(1400, pairs - sum(n for _, n in head))]
    counts = spark.createDataFrame([(kind, v, n) for v, n in head + rest], "kind string, v bigint, n bigint")
    r = d.left_edge(counts, ["kind"], "v", text.GAP_BIN_MINUTES, text.GAP_TAIL).first()
    assert (r.edge, r.below, r.floor) == want and r.observations == pairs
    shown = d.histogram(counts, ["kind"], "v", text.GAP_BIN_MINUTES, text.GAP_HEAD_BINS).orderBy("edge").collect()
    assert [(r.edge, r.n) for r in shown] == [(e, dict(head).get(e, 0)) for e in range(0, 120, 5)]
