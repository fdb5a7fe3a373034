import json
from pathlib import Path

import pytest

from checks import oracle, views
from frames import at, booking, landing, resource
from test_operators import brute_pairs, random_bookings
from ruletrace.guards import Guards
from ruletrace.operators import intervals
from ruletrace.plans.facts import facts
from ruletrace.session import ensure_checkpoint_dir
from ruletrace.plans import (bookings, candidates, ceilings, days, evidence, override_detail, overrides, peaks,
                             population, scoring)

FEW = Guards(min_assignments_per_resource=2, min_instances_per_work_type=3,
             min_populated_rows_per_field=3, min_observations=3, min_change_events=2)


def one(df):
    return df.first().asDict()


def spaced(gap, count, kind="van", first=0):
    """One resource on back to back jobs, ``gap`` minutes apart."""
    out, t = [], 0.0
    for n in range(count):
        out.append(booking(first + n, kind, f"{kind}{n}", t, t + 60))
        t += 60 + gap
    return out


def test_hard_floor(spark):
    t = landing(spark, resources=[resource("van")], assignments=spaced(45, 61))
    row = one(bookings.turnaround(t))
    assert (row["edge"], row["floor"], row["observations"]) == (45, "hard", 60)
    statement = bookings.turnaround_candidates(t).first().statement
    assert statement == ("After a van finishes a job, at least 45 minutes always passes before it starts "
                         "the next one. Across 60 consecutive pairs there is not one exception. Is 45 "
                         "minutes a required turnaround?")


def test_no_floor_when_back_to_back_or_below_the_guard(spark):
    t = landing(spark, resources=[resource("van"), resource("bus", "bus")],
                assignments=spaced(0, 60) + spaced(45, 50, "bus", 500))
    assert bookings.turnaround(t).count() == 0   # the bus has 49 pairs, one too few


def test_gap_counts_minute_marks(spark):
    t = landing(spark, resources=[resource("van")],
                assignments=[booking(1, "van", "w1", 0, 60 + 1 / 60), booking(2, "van", "w2", 90, 95)])
    assert bookings.gaps(t, 2).first().gap_minutes == 30


@pytest.mark.parametrize("whole", [1 << 14, 20])
def test_gaps_and_overlaps_do_not_depend_on_who_is_busy(spark, monkeypatch, whole):
    """With ``whole`` 20 most resources are cut into pieces, two are known twice, and one is not known."""
    for module in (bookings, intervals):
        monkeypatch.setattr(module, "WHOLE", whole)
    booked = [b for b in random_bookings(7, True) if b["resource_id"]]
    known = ["r0", "r0", "r1", "r2", "r2", "r3"]
    t = landing(spark, resources=[resource(r) for r in known], assignments=booked)

    times, kept = {}, {r: known.count(r) for r in known}
    for b in booked:
        if None not in (b["start_ts"], b["end_ts"]):
            times.setdefault(b["resource_id"], []).append(b)
    kept = {r: n for r, n in kept.items() if len(times.get(r, [])) >= 2}
    lengths, least = {}, {}
    for r, n in kept.items():
        rows = sorted(times[r] * n, key=lambda b: (b["start_ts"], b["assignment_id"]))
        own = [(y["start_ts"] - x["end_ts"]).total_seconds() // 60 for x, y in zip(rows, rows[1:])]
        for gap in (g for g in own if g >= 0):
            lengths[gap] = lengths.get(gap, 0) + 1
        if any(g >= 0 for g in own):
            low = min(g for g in own if g >= 0)
            least[low] = least.get(low, 0) + 1
    got = {r.gap_minutes: (r.n, r.resources) for r in bookings.gap_counts(facts(t), 2).collect()}
    assert got == {g: (n, least.get(g, 0)) for g, n in lengths.items()}

    pairs = sum(kept.get(a["resource_id"], 0) ** 2 for a, _ in brute_pairs(booked))
    assert one(bookings.exclusivity(t, FEW))["overlapping_pairs"] == pairs


def test_a_run_copies_neither_bookings_nor_changes(spark):
    """They are the largest tables; what a run writes of them are counts and sums."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    t = landing(spark, resources=[resource("van")], assignments=spaced(45, 61), changes=[
        dict(change_id=f"ch{n}", entity_table="work", entity_id=f"van{n}", field="f", old_value="x",
             new_value="y", changed_at=at(0), changed_by="ann") for n in range(4)])
    assert {r.probe for r in candidates.candidates(t).collect()} >= {"p03", "p08"}
    written = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert "sweep" in written and not {"assignments", "bookings", "changes"} & written


def test_two_roles_make_two_pairs_but_one_pair_of_jobs(spark):
    t = landing(spark, resources=[resource("ann", "person")], assignments=[
        booking(1, "ann", "w1", 0, 60, "lead"), booking(2, "ann", "w1", 0, 60, "driver"),
        booking(3, "ann", "w2", 30, 90)])
    row = one(bookings.exclusivity(t, FEW))
    assert (row["overlapping_pairs"], row["resources_with_an_overlap"]) == (2, 1)
    assert one(bookings.job_pairs(t, FEW)) == {"kind": "person", "overlapping_pairs": 2,
                                               "distinct_job_pairs": 1}
    document = json.loads(bookings.exclusivity_candidates(t, FEW).first().evidence)
    assert [e["work_id_b"] for e in document["examples"]] == ["w2", "w2"]


def test_unknown_resources_and_null_kinds_are_dropped(spark):
    t = landing(spark, resources=[resource("ann", None), resource("bob", "person")], assignments=[
        booking(n, r, f"w{n}", n, n + 5) for n, r in enumerate(["ann"] * 4 + ["bob"] * 3 + ["who"] * 4)])
    rows = {r.kind: r.overlapping_pairs for r in bookings.exclusivity(t, FEW).collect()}
    assert rows == {"person": 3}


def test_examples_come_in_order_and_stop_at_the_limit(spark):
    busy = [booking(n, "r1", f"w{n:02d}", n, 500 - n) for n in range(12)]
    t = landing(spark, resources=[resource("r1"), resource("r0")],
                assignments=busy + [booking(90, "r0", "x", 0, 9), booking(91, "r0", "y", 5, 9)])
    got = [(r.position, r.resource_id, r.work_id_a, r.work_id_b)
           for r in bookings.overlap_examples(t, FEW, 10).orderBy("position").collect()]
    assert got[0] == (1, "r0", "x", "y")
    assert got[1:] == [(i + 1, "r1", "w00", f"w{i:02d}") for i in range(1, 10)]


@pytest.mark.parametrize("seed", [4, 5])
def test_examples_against_all_pairs(spark, seed):
    rows = random_bookings(seed, backwards=True)
    resources = [resource(f"r{i}", "van" if i % 2 else "bus") for i in range(5)]
    kinds = {r["resource_id"]: r["kind"] for r in resources}
    want = {}
    for a, b in brute_pairs(rows):
        want.setdefault(kinds[a["resource_id"]], []).append(
            (a["resource_id"], a["start_ts"], b["start_ts"], a["work_id"], b["work_id"]))
    t = landing(spark, resources=resources, assignments=rows)
    for kind, pairs in want.items():
        got = bookings.overlap_examples(t, FEW, 7).filter(f"kind = '{kind}'").orderBy("position").collect()
        assert [(r.resource_id, r.a_start, r.b_start, r.work_id_a, r.work_id_b) for r in got] == sorted(pairs)[:7]
    totals = {r.kind: r.overlapping_pairs for r in bookings.exclusivity(t, FEW).collect()}
    assert totals == {kind: len(pairs) for kind, pairs in want.items()}


def jobs(values, **more):
    return [dict(work_id=f"op_{n}", work_type=more.get("work_type", "trip"), start_ts=at(n * 1440),
                 end_ts=at(n * 1440 + 60), location_id="lc_1", status=s, customer_count=c)
            for n, (s, c) in enumerate(values)]


def test_cliff_and_statement(spark):
    t = landing(spark, work=jobs([("done", 18)] * 6 + [("done", 4)] * 3))
    row = one(ceilings.ceilings(t, FEW, ("customers_per_work",)))
    assert (row["shape"], row["observed_max"], row["count_at_max"]) == ("cliff", 18, 6)
    found = ceilings.ceiling_candidates(t, FEW).filter("candidate_id = 'p04-ceiling-customers-per-work'")
    assert found.first().statement.startswith("The number of guests on one job never goes above 18.")


def test_dependency_and_exemption(spark):
    t = landing(spark, work=jobs([("it's on", 5)] * 4 + [("off", None)] * 3 + [(None, None)] * 2))
    got = {r.candidate_id: r for r in population.population_candidates(t, FEW).collect()}
    assert set(got) == {"p05-population-customer-count-by-status",
                        "p05-exemption-customer-count-by-status-off"}
    assert "When status is \"it's on\", customer_count is filled in" in \
        got["p05-population-customer-count-by-status"].statement


def test_equal_partitions_go_to_the_first_value(spark):
    t = landing(spark, work=jobs([("b", 1)] * 3 + [("a", 1)] * 3 + [("d", None)] * 3 + [("c", None)] * 3))
    row = one(population.population(t, FEW).filter("field = 'customer_count'"))
    assert (row["high_value"], row["low_value"]) == ("a", "c")


def change(n, field, entity="op_0", old="flagged", by="u1", on=0):
    return dict(change_id=f"ch_{n}", entity_table="work", entity_id=entity, field=field, old_value=old,
                new_value="acknowledged", changed_at=at(on * 1440 + 600), changed_by=by)


def test_override_rank_leads_and_people(spark):
    t = landing(spark, work=jobs([("done", 1)] * 8), changes=[
        change(1, "ovr_a", "op_5", on=1), change(2, "ovr_a", "op_5", on=3, by=None),
        change(3, "ovr_a", "op_6", on=6), change(4, "ovr_a", "op_7", on=2, old=None),
        change(5, "ovr_b"), change(6, "ovr_b", "op_1", on=4), change(7, "ovr_c")])
    ranked = [(r["rank"], r.field, r.events, r.all_changes)
              for r in overrides.override_rank(t, FEW).orderBy("rank").collect()]
    assert ranked == [(1, "ovr_a", 3, 7), (2, "ovr_b", 2, 7)]
    lead = one(overrides.lead_times(t).filter("field = 'ovr_a'"))
    assert (lead["n"], lead["min_days"], lead["median_days"], lead["max_days"],
            lead["same_day_or_later"]) == (4, 0, 4, 5, 1)
    document = json.loads(overrides.override_candidates(t, FEW).orderBy("candidate_id").first().evidence)
    assert document["actors"] == [{"changed_by": "u1", "events": 2},
                                  {"changed_by": "(unrecorded)", "events": 1}]


def test_override_detail(spark):
    t = landing(spark, work=jobs([("done", 1)] * 4), resources=[resource("r1", "van"), resource("r2", "bus")],
                assignments=[booking(1, "r1", "op_0", 0, 60), booking(2, "r1", "op_1", 30, 90),
                             booking(3, "r2", "op_2", 0, 60), booking(4, "gone", "op_3", 0, 60)],
                changes=[change(1, "ovr_a", "op_0"), change(2, "ovr_a", "op_0", by="u2"), change(3, "ovr_b", "mv_9")])
    lift = {r.kind: (r.jobs_here, r.jobs_everywhere, r.more_common_here)
            for r in override_detail.kind_lift(t, "a").collect()}
    assert lift == {"van": (1, 2, True)}
    rate = one(override_detail.overlap_rate(t, "ovr_a"))
    assert (rate["overlap_here"], rate["touched_jobs"], rate["overlap_everywhere"], rate["all_jobs"]) == (1, 1, 2, 4)
    assert one(override_detail.repeated_jobs(t, "a"))["times"] == 2
    assert one(override_detail.jobs_by_source(t, "ovr_b")) == {"source": "Movements", "changes": 1}
    assert one(override_detail.override_tail(t, 1)) == {
        "labels_left_out": 1, "events_left_out": 1, "all_events": 3}
    top = override_detail.top_resources(t, "a").collect()
    assert [(r.resource_id, r.share_here, r.share_everywhere) for r in top] == [("r1", 1.0, 0.5)]


def test_day_sheet_keeps_jobs_without_crew(spark):
    t = landing(spark, work=jobs([("done", 1)] * 3), resources=[resource("r1", None, "Ann")],
                assignments=[booking(1, "r1", "op_1", 1440, 1500)])
    assert [(r.work_id, r.resource, r.kind) for r in days.day_sheet(t, "2026-06-02").collect()] == [
        ("op_1", "Ann", "?")]
    assert days.day_sheet(t, "2026-06-01").first().resource is None


def test_peaks_of_any_size_are_whole(spark):
    """A top group of more than ten thousand rows keeps them all."""
    many = landing(spark, work=[dict(j, start_ts=at(i % 900)) for i, j in enumerate(jobs([("done", 1)] * 10_050))])
    assert peaks.peak_rows(many, "work_per_day").count() == 10_050
    assert [tuple(r) for r in peaks.peaks(many, "work_per_day").collect()] == [("2026-06-01", 10_050, 1, "trip", 10_050)]


def test_long_keys_stay_whole(spark):
    keys = [9_999_999_999_999, 9_999_999_999_998, 7]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r[0] for r in rows.selectExpr(f"{views.padded('k', 10)} AS p").collect()]
    assert got == ["9999999999999", "9999999999998", "0000000007"]
    import duckdb
    sql = f"SELECT {oracle.padded('k', 10)} FROM (SELECT unnest({keys}) AS k)"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == got


def test_verdicts_are_read_without_the_white_space_around_them(spark):
    found = spark.createDataFrame([("c1", "p", "t", "s"), ("c2", "p", "t", "s")],
                                  "candidate_id string, probe string, proposed_type string, statement string")
    key = spark.createDataFrame([("k1",)], "key_id string")
    given = spark.createDataFrame([("1", "c1\t", " k1\n", "MATCH\t", "x"), ("2", "c2", "\xa0", "\u3000new", " "),
                                   ("3", "c2", "", "NEW", "seen")],
                                  "row_no string, candidate_id string, key_id string, verdict string, note string")
    judged = scoring.judged_rows(found, key, given)
    assert scoring.problems(judged).count() == 0
    assert [tuple(r) for r in scoring.covered_keys(judged).collect()] == [("k1", "c1")]
    assert [r.note for r in scoring.new_finds(found, judged).collect()] == ["seen"]
    assert candidates.unjudged(found, given.filter("row_no > '1'")).count() == 1


def test_gap_bins_read_gaps_that_are_worked_out_once(spark):
    t = landing(spark, resources=[resource("van")], assignments=spaced(45, 61))
    bins = evidence.gap_bins(t, FEW)
    assert "assignment_id" not in bins._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.edge, r.n) for r in bins.filter("n > 0").collect()] == [(45, 60)]


def test_candidates_are_ordered_and_repeatable(spark):
    t = landing(spark, resources=[resource("van")], assignments=spaced(45, 61),
                work=jobs([("on", 5)] * 60 + [("off", None)] * 12))
    first, second = [[tuple(r) for r in candidates.candidates(t).collect()] for _ in range(2)]
    assert first == second
    assert [r[:3] for r in first] == sorted((r[:3] for r in first), key=lambda r: (r[0], r[2], r[1]))
    only = {r.probe for r in candidates.candidates(t, probes=["p04"]).collect()}
    assert only == {"p04"}


def test_evidence_gets_names(spark):
    t = landing(spark, resources=[resource("gs_recA", "person", "Ann")], work=jobs([("done", 1)]))
    values = spark.createDataFrame([("gs_recA",), ("2026-06-23",), ("op_0",), ("2026-13-45",)], "value string")
    shown = {r.value: r.shown for r in candidates.described(
        values, candidates.names_of_ids(t), "app1", {"gs_": "tbl1"}).collect()}
    assert shown == {"gs_recA": "Ann (person)  https://airtable.com/app1/tbl1/recA",
                     "2026-06-23": "Tue 2026-06-23", "op_0": "trip on Mon 2026-06-01 00:00  [op_0]",
                     "2026-13-45": "2026-13-45"}


def test_names_of_all_evidence(spark):
    """Ids of every probe meet the names once; an override label goes before an id of the same text."""
    rows = [booking(n, "ann", f"op_{n % 4}", n * 10, n * 10 + 15) for n in range(6)]
    t = landing(spark, resources=[resource("ann", "person", "Ann")], assignments=rows, locations=[dict(location_id="done", name="Pier")],
                work=jobs([("done", 18)] * 4 + [("open", None)] * 3), changes=[change(i, "ovr_a") for i in range(3)] + [change(9, "ovr_b"), change(10, "ovr_b")])
    labels = spark.createDataFrame([("ovr_a", "no van left")], "field string, label string")
    got = {(r["list"], r.position, r.part, r["value"]): r.shown for r in evidence.names(t, FEW, labels).collect()}
    assert got["examples", 1, "resource_id", "ann"] == "Ann (person)  [ann]"
    assert got["examples", 1, "work_id_a", "op_0"] == "trip on Mon 2026-06-01 00:00  [op_0]"
    assert got["examples", 1, "a_start", "2026-06-01 00:00:00"] == "Mon 2026-06-01 00:00:00"
    assert got["all_partitions", None, "value", "done"] == "Pier  [done]" and got["all_partitions", None, "value", "open"] == "open"
    assert got["actors", None, "changed_by", "u1"] == "u1"
    assert got["field", None, "field", "ovr_a"] == "no van left  [ovr_a]" and got["field", None, "field", "ovr_b"] == "ovr_b"


def test_evidence_of_planted_findings(spark):
    """never and sometimes, hard and soft, cliff and taper, and both readings of a field."""
    soft = spaced(45, 200, "bus", 500)
    soft[100]["end_ts"] = soft[101]["start_ts"]  # one gap of no length among 199
    clash = [booking(900 + i, "ann", f"x{i}", i * 10, i * 10 + 15) for i in range(60)]
    work = jobs([("done", 18)] * 60 + [("done", 4)] * 30 + [("open", None)] * 20)
    t = landing(spark, resources=[resource("van"), resource("bus", "bus"), resource("ann", "person")],
                assignments=spaced(45, 61) + soft + clash, work=work, changes=[change(i, "ovr_a") for i in range(3)])
    overlap = {r.candidate_id: r for r in evidence.exclusivity(t).collect()}
    assert overlap["p03-exclusivity-van"].overlap == "never" and overlap["p03-exclusivity-van"].overlapping_pairs == 0
    assert overlap["p03-exclusivity-person"].overlap == "sometimes" and overlap["p03-exclusivity-person"].overlapping_pairs == 59
    floors = {r.candidate_id: (r.proposed_minimum_minutes, r.floor, r.gaps_below_the_edge) for r in evidence.turnaround(t).collect()}
    assert floors == {"p03-turnaround-van": (45, "hard", 0), "p03-turnaround-bus": (45, "soft", 1)}
    bins = [(r.edge, r.n) for r in evidence.gap_bins(t).filter("candidate_id LIKE '%bus'").orderBy("edge").collect()]
    assert len(bins) == 10 and bins[0] == (0, 1) and bins[-1] == (45, 198)
    edge = {r.candidate_id: r for r in evidence.ceiling(t).collect()}
    guests = edge["p04-ceiling-customers-per-work"]
    assert (guests["shape"], guests.share_at_max, guests.max_over_peak) == ("cliff", 0.6667, 1.0)
    values = evidence.ceiling_values(t).filter("candidate_id = 'p04-ceiling-customers-per-work'")
    assert sorted((r["value"], r["count"]) for r in values.collect()) == [(4, 30), (18, 60)]
    filled = {r.candidate_id: r for r in evidence.fill(t).collect()}
    assert set(filled) == {"p05-population-customer-count-by-status", "p05-exemption-customer-count-by-status-open"}
    assert {r.low_fill_rate for r in filled.values()} == {0.0} and {r.high_fill_rate for r in filled.values()} == {1.0}
    row = one(evidence.override(t))
    assert (row["events"], row["share_of_all_overrides"], row["median_days"]) == (3, 1.0, 0)
    assert [(r.changed_by, r.events) for r in evidence.override_people(t).collect()] == [("u1", 3)]


def test_roles_of_touched_crew_are_one_aggregate(spark):
    t = landing(spark, resources=[resource("r1"), resource("r2")], work=jobs([("on", 5)]), changes=[change(1, "ovr_x")],
                assignments=[booking(k, r, "op_0", 0, 1, role) for k, (r, role) in enumerate(
                    [("r1", "b"), ("r1", "a"), ("r1", "b"), ("r1", None), ("r2", None)])])
    crew = override_detail.touched_crew(t, "ovr_x")
    assert sorted((r.resource, r.roles) for r in crew.collect()) == [("r1", "a, b"), ("r2", None)]
    plan = crew._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("role#") and "distinct" not in plan and plan.count("Aggregate") - plan.count("HashAggregate(keys=[work_id") <= 2
