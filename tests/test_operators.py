import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frames import at, booking, frame
from ruletrace.operators import distribution as d, intervals
from ruletrace.operators.intervals import overlap_counts, overlap_pairs, overlapping_work, sweep
from ruletrace.operators.ordered import next_in_group, numbered
from ruletrace.session import CLEANUP, settled


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and many of its rows share one sort value."""
    rng = random.Random(3)
    data = [("hot" if i % 4 else f"g{i % 7}", at(rng.randint(0, 9) * rng.choice([60, 5000, 90000])), i, rng.randint(1, 5))
            for i in range(600)]
    return spark.createDataFrame(data, "g string, t timestamp_ntz, id int, v bigint").cache()


def expected(df):
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.id)):
        groups.setdefault(r.g, []).append(r)
    return sorted((r.id, -1 if n is None else n.v, str(n and n.t))
                  for members in groups.values() for r, n in zip(members, [*members[1:], None]))


def test_windows_agree_when_groups_are_cut_into_pieces(skewed):
    following = expected(skewed)
    got = next_in_group(skewed, ["g"], ["t", "id"], {"nv": "v", "nt": "t"})
    assert sorted((r.id, -1 if r.nv is None else r.nv, str(r.nt)) for r in got.collect()) == following
    times = next_in_group(skewed, ["g"], ["t", "id"], {"nt": "t"})
    assert sorted((r.id, str(r.nt)) for r in times.collect()) == sorted((i, t) for i, _, t in following)


def test_small_groups_are_windowed_as_they_lie(skewed):
    small = skewed.filter("g <> 'hot'").repartition(3, "g")
    got = next_in_group(skewed.filter("g = 'hot'"), ["g"], ["t", "id"], {"nv": "v", "nt": "t"}, small=small)
    assert sorted((r.id, -1 if r.nv is None else r.nv, str(r.nt)) for r in got.collect()) == expected(skewed)
    plan = next_in_group(skewed.limit(0), ["g"], ["t", "id"], {"nt": "t"}, small=small)
    assert plan.count() == small.count()


def test_numbers_follow_the_order(skewed):
    got = numbered(skewed, [F.col("g"), F.desc("t"), F.col("id")]).collect()
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 601))
    assert [(r.g, r.t, r.id) for r in got] == [(r.g, r.t, r.id) for r in sorted(got, key=lambda r: (r.g, -r.t.timestamp(), r.id))]
    assert numbered(skewed.limit(0), [F.col("g")]).count() == 0


def random_bookings(seed, backwards):
    rng = random.Random(seed)
    out = []
    for n in range(240):
        start = rng.randint(0, 400)
        length = rng.choice([0, 1, 5, 30, 30, 60, rng.choice([3000, 90000]) if rng.random() < 0.05 else 45])
        if backwards and rng.random() < 0.08:
            length = -rng.randint(1, 40)
        out.append(booking(n, f"r{0 if rng.random() < 0.6 else rng.randint(1, 4)}",
                           f"w{rng.randint(0, 60)}", start, start + length))
    out += [booking(900, "r0", "w1", None, 10), booking(901, "r0", "w1", 10, None),
            booking(902, "r0", None, 0, 50)]
    return out


def brute_pairs(bookings):
    known = [b for b in bookings if None not in (b["start_ts"], b["end_ts"], b["work_id"])]
    return [(a, b) for a in known for b in known
            if a["assignment_id"] < b["assignment_id"] and a["resource_id"] == b["resource_id"]
            and a["work_id"] != b["work_id"] and a["start_ts"] < b["end_ts"]
            and b["start_ts"] < a["end_ts"]]


@pytest.mark.parametrize("seed,backwards", [(1, False), (2, True), (3, True)])
def test_overlaps_against_all_pairs(spark, seed, backwards):
    bookings = random_bookings(seed, backwards)
    df = frame(spark, "assignments", bookings).cache()
    pairs = brute_pairs(bookings)

    want = sorted((a["assignment_id"], b["assignment_id"]) for a, b in pairs)
    assert rows(overlap_pairs(df), "a_assignment_id", "b_assignment_id") == want

    per_resource = {}
    for a, _ in pairs:
        per_resource[a["resource_id"]] = per_resource.get(a["resource_id"], 0) + 1
    got = overlap_counts(sweep(df)).filter("pairs > 0")
    assert rows(got, "resource_id", "pairs") == sorted(per_resource.items())

    jobs = {x["work_id"] for pair in pairs for x in pair}
    assert [r[0] for r in rows(overlapping_work(sweep(df)), "work_id")] == sorted(jobs)


@pytest.mark.parametrize("seed,backwards", [(4, False), (5, True)])
def test_resources_in_one_piece_and_in_many(spark, seed, backwards, monkeypatch):
    """Half of the resources are swept in one piece; a narrowed join gives the pairs of the narrow role."""
    bookings = random_bookings(seed, backwards)
    df = frame(spark, "assignments", bookings)
    many = df.withColumn("many", F.when(F.col("resource_id").isin("r0", "r1"), 99).otherwise(1))
    per_resource, per_job = {}, {}
    for a, b in brute_pairs(bookings):
        per_resource[a["resource_id"]] = per_resource.get(a["resource_id"], 0) + 1
        for x in (a, b):
            per_job[x["work_id"]] = per_job.get(x["work_id"], 0) + 1
    monkeypatch.setattr(intervals, "WHOLE", 50)
    swept = sweep(many, many="many")
    assert rows(overlap_counts(swept).filter("pairs > 0"), "resource_id", "pairs") == sorted(per_resource.items())
    assert rows(overlapping_work(swept), "work_id", "overlaps") == sorted(per_job.items())

    pairs = lambda df: rows(df, "a_assignment_id", "b_assignment_id")
    few = df.filter("hash(assignment_id) % 9 = 0")
    chosen = {r[0] for r in rows(few, "assignment_id")}
    got = sorted(set(pairs(overlap_pairs(df, earlier=few)) + pairs(overlap_pairs(df, later=few))))
    assert got == sorted(p for p in pairs(overlap_pairs(df)) if chosen & set(p))


def test_a_sweep_in_parts_is_the_sweep(spark, monkeypatch):
    """Busy resources are cut into pieces, the others are dealt by resource and swept as they lie."""
    bookings = random_bookings(6, True)
    many = frame(spark, "assignments", bookings).withColumn("many", F.when(F.col("resource_id") == "r0", 99).otherwise(1))
    monkeypatch.setattr(intervals, "WHOLE", 50)
    few = many.filter("many = 1").repartition(3, "resource_id")
    whole, parts = sweep(many, many="many"), sweep(many, many="many", parts=[many.filter("many = 99"), few])
    columns = ["resource_id", "work_id", "_piece", "net", "entries", "pairs", "share", "backwards"]
    every = lambda swept: sorted(map(str, swept.table.select(columns).collect()))
    assert every(parts) == every(whole)
    per_resource = {}
    for a, _ in brute_pairs(bookings):
        per_resource[a["resource_id"]] = per_resource.get(a["resource_id"], 0) + 1
    assert rows(overlap_counts(parts).filter("pairs > 0"), "resource_id", "pairs") == sorted(per_resource.items())


def test_what_is_settled_leaves_no_shuffle_files(spark):
    """The frame is still held, so nothing but the end of the statement can have removed them."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {str(p) for folder in folders for p in Path(folder).rglob("shuffle_*.data")}
    before, held = files(), spark.range(20000).groupBy(F.col("id") % 5000).count()
    assert settled(held, "held").count() == 5000
    conf = spark.conf.get(CLEANUP)
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    # What is left belongs to the count after it: one row for each task.
    assert sum(Path(p).stat().st_size for p in left if Path(p).exists()) < 5000
    assert conf == "false" and held.count() == 5000


def test_a_narrowed_join_leaves_out_what_it_cannot_meet(spark):
    """Starts are copied only into tiers that the narrow role has, and only those within its times."""
    df = frame(spark, "assignments", [booking(n, "r", f"w{n}", 30 * n, 30 * n + 50) for n in range(400)])
    plan = overlap_pairs(df, earlier=df.filter("assignment_id < 'as_00010'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, 8" not in plan and "[1,2,3,4,5,6,7,8]" not in plan and "2026-06-01" in plan


def test_touching_windows_do_not_overlap(spark):
    df = frame(spark, "assignments", [booking(1, "r", "w1", 0, 60), booking(2, "r", "w2", 60, 90)])
    assert overlap_pairs(df).count() == 0
    assert overlap_counts(sweep(df)).filter("pairs > 0").count() == 0


def counts(spark, values):
    data = [("k", v, n) for v, n in values.items()]
    return spark.createDataFrame(data, "k string, v bigint, n bigint")


def test_left_edge_soft_hard_and_zero(spark):
    def edge(values):
        r = d.left_edge(counts(spark, values), ["k"], "v", 5, 0.01).first()
        return r.edge, r.below, r.floor

    # 7 of 832 below the first bin that passes one percent: a soft floor at 30.
    assert edge({0: 7, 30: 4, 45: 821}) == (30, 7, "soft")
    assert edge({46: 30, 50: 30}) == (45, 0, "hard")
    assert edge({0: 50, 30: 50}) == (0, 0, "hard")
    assert edge({2: 1, 31: 199}) == (30, 1, "soft")


def test_spread_takes_the_upper_median(spark):
    r = d.spread(counts(spark, {1: 1, 2: 1, 3: 1, 9: 1}), ["k"], "v").first()
    assert (r.observations, r.least, r.upper_median, r.greatest) == (4, 1, 3, 9)
    assert d.spread(counts(spark, {-4: 1, 2: 3}), ["k"], "v").first().upper_median == 2


def test_right_edge_cliff_at_exactly_half(spark):
    def shape(values):
        r = d.right_edge(counts(spark, values), ["k"], "v", 0.5).first()
        return r.observed_max, r.count_at_max, r.count_below_max, r.shape

    assert shape({1: 10, 2: 4, 3: 5}) == (3, 5, 4, "cliff")
    assert shape({1: 10, 3: 4}) == (3, 4, 0, "taper")


def test_histogram_fills_empty_bins(spark):
    df = counts(spark, {1: 2, 12: 1})
    assert rows(d.histogram(df, ["k"], "v", 5), "edge", "n") == [(0, 2), (5, 0), (10, 1)]
    assert rows(d.histogram(df, ["k"], "v", 5, bins=2), "edge", "n") == [(0, 2), (5, 0)]


def test_pieces_are_told_apart_by_a_hash_first(spark):
    rows = spark.createDataFrame([("van", at(m), n) for n, m in enumerate((0, 5, 20_000, 20_000, 40_000))], "k string, t timestamp_ntz, n int")
    follow = next_in_group(rows, ["k"], ["t", "n"], {"then": "n"})
    assert follow.columns == ["k", "t", "n", "then"]
    assert [r.then for r in follow.orderBy("n").collect()] == [1, 2, 3, 4, None]
    assert "Sort [_spread" in follow._jdf.queryExecution().executedPlan().toString()
