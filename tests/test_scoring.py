import pytest

from ruletrace.plans import candidates, compare, messages, scoring

KEY = [("K1", "capacity", "one", "Head", None), ("K2", "", "two", "sop", "x; SCOPE=interface"),
       ("K3", "gap", "three", None, None), ("K4", "gap", "four", "head", None)]
FOUND = [(f"c{i}", "p03" if i < 4 else "p04", "any", f"s{i}") for i in range(1, 8)]
GIVEN = [("c1", "K1", "match", "a"), ("c1", "K2", "MATCH", "b"), ("c1", "", "NEW", ""), ("c2", "", "NEW", "n"),
         ("c3", "", "FALSE", ""), ("c4", "", "MATCH", ""), ("c5", "K9", "MATCH", ""), ("c6", "", "maybe", ""),
         ("zz", "", "", ""), ("c7", "", " ", ""), (" ", "K1", "NEW", ""), ("c2", "", "NEW", "n")]


@pytest.fixture(scope="module")
def sheets(spark):
    key = spark.createDataFrame(KEY, "key_id string, type string, statement string, source string, notes string")
    found = spark.createDataFrame(FOUND, "candidate_id string, probe string, proposed_type string, statement string")
    given = spark.createDataFrame([(*g, i) for i, g in enumerate(GIVEN)],
                                  "candidate_id string, key_id string, verdict string, note string, row_no bigint")
    return found, key, given


def test_problems_follow_the_five_rules(sheets):
    found, key, given = sheets
    got = [(r.row_no, r.problem) for r in
           scoring.problems(scoring.judged_rows(found, key, given)).orderBy("row_no").collect()]
    assert got == [(2, scoring.DISAGREES), (5, scoring.MATCH_WITHOUT_KEY), (6, scoring.UNKNOWN_KEY),
                   (7, scoring.BAD_VERDICT), (8, scoring.UNKNOWN_CANDIDATE)]


def test_notes_from_one_look_at_the_verdicts(spark, sheets):
    found, key, given = sheets
    more = spark.createDataFrame([("c3", "", "NEW", "late", 20), ("c7", "", "new", "", 21), ("c7", "", "NEW", "why", 22), ("c7", "", "FALSE", "", 23),
                                  ("c2", "K9", "NEW", "of no known rule", 24)], given.schema)
    given = given.unionByName(more).unionByName(more)
    by_rows = [tuple(r) for r in scoring.new_finds(found, scoring.judged_rows(found, key, given)).collect()]
    assert [tuple(r) for r in scoring.new_finds(found, scoring.noted(found, key, given)).collect()] == by_rows
    assert [(r[0], r[3]) for r in by_rows] == [("c2", "n"), ("c7", "why")]


def test_ids_are_told_apart_by_hash_first(sheets):
    found, key, given = sheets
    plan = scoring.tally(found, key, given)._jdf.queryExecution().executedPlan().toString()
    assert scoring.SPREAD in plan and scoring.tally(found, key, given).columns == ["candidate_id", "verdict", "key_id"]


def test_headline_and_buckets(sheets):
    found, key, given = sheets
    judged = scoring.judged_rows(found, key, given)
    head = scoring.headline(found, key, judged).first()
    assert (head.recall_hit, head.recall_total, head.matched, head.novelty, head.false, head.scored,
            head.unscored) == (1, 3, 1, 1, 1, 3, 4)
    assert head.recall_all == 0.5 and head.precision == 2 / 7
    recovered = scoring.recovery(key, judged)
    by = {(r.bucket, r.value): (r.recovered, r.total) for r in scoring.recall_by(recovered).collect()}
    assert by == {("type", "capacity"): (1, 1), ("type", "(untyped)"): (1, 1), ("type", "gap"): (0, 2),
                  ("source", "head"): (1, 2), ("source", "sop"): (1, 1), ("source", "(unrecorded)"): (0, 1),
                  ("scope", "operating"): (1, 3), ("scope", "interface"): (1, 1), ("all", "all"): (2, 4)}
    assert {r.origin: (r.recovered, r.total) for r in scoring.memory_split(recovered).collect()} == {
        "recalled": (1, 2), "document": (1, 2)}
    assert [(r.candidate_id, r["keys"]) for r in scoring.multi_cover(judged).collect()] == [("c1", 2)]
    assert [(r.candidate_id, r.note) for r in scoring.new_finds(found, judged).collect()] == [("c2", "n")]
    plan = scoring.new_finds(found, judged)._jdf.queryExecution().optimizedPlan().toString()
    assert "first_verdict" not in plan  # the notes are judged once and written down
    assert [r.key_id for r in scoring.unrecovered(key, judged).collect()] == ["K3", "K4"]


def test_queue_and_sheet(sheets):
    found, _, given = sheets
    assert [r.candidate_id for r in candidates.unjudged(found, given).collect()] == ["c7"]
    assert candidates.unjudged(found, given, redo=True).count() == 7
    rows = candidates.verdict_sheet(found, given).collect()
    assert [r.candidate_id for r in rows] == ["c1", "c1", "c1", "c2", "c2", "c3", "c4", "c5", "c6", "c7"]
    assert tuple(rows[-1]) == ("c7", "", "", "")


def test_comparison(spark, sheets):
    found, key, given = sheets
    volumes = lambda n: spark.createDataFrame([("work", n)], "landing_table string, rows bigint")
    rich = scoring.Run("full", found, given, volumes(9))
    lean = scoring.Run("lean", found.filter("candidate_id <> 'c2'"), given.filter("key_id <> 'K2'"), volumes(4))
    assert not compare.same_profile(rich, lean)
    delta = {r.measure: (r.rich, r.lean, r.change) for r in compare.headline_delta(rich, lean, key).collect()}
    assert delta["novelty"] == (1, 0, -1) and delta["candidates"] == (7, 6, -1)
    survives = {(r.bucket, r.value): r.survives for r in compare.survival(rich, lean, key).collect()}
    assert survives[("type", "capacity")] == "yes" and survives[("source", "sop")] == "lost entirely"
    assert survives[("type", "gap")] == "neither run found it"
    assert [(r.key_id, r.found_by, r.moved) for r in compare.moved_keys(rich, lean, key).collect()] == [("K2", "c1", "lost")]
    assert [tuple(r) for r in compare.one_sided_candidates(rich, lean).collect()] == [("c2", "rich")]
    plan = compare.one_sided_candidates(rich, lean)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1  # not one for each run, its distinct ids and its difference, all in one task
    assert tuple(compare.volume_delta(rich, lean).first()) == ("work", 9, 4)
    assert {r.probe: (r.rich_candidates, r.lean_candidates) for r in compare.probe_delta(rich, lean).collect()} == {
        "p03": (3, 2), "p04": (4, 4)}


def test_published_recoverability(spark):
    """The event counts behind the two published passes give the published rates."""
    def passed(events, high, entity, rule, actor, lead, messages_):
        data = [(int(i < entity), int(i < rule), int(i < actor), int(i < lead), "high" if i < high else "low")
                for i in range(events)]
        sheet = spark.createDataFrame(data, ", ".join(f"{f} int" for f in messages.FLAGS) + ", confidence string")
        return messages.recoverability(sheet, spark.createDataFrame([(messages_,)], "n bigint"))

    h, a = passed(49, 31, 47, 39, 41, 41, 544), passed(67, 36, 65, 55, 51, 58, 1043)
    for row, want in ((h.first(), (5.7, 9.0, 96, 80, 84, 84)), (a.first(), (3.5, 6.4, 97, 82, 76, 87))):
        assert (round(row.high_per_100, 1), round(row.all_per_100, 1), round(row.entity), round(row.rule),
                round(row.actor), round(row.lead_time)) == want
    gap = {r.measure: r for r in messages.pass_gap(h, a, spark.createDataFrame([(544,)], "n bigint")).collect()}
    assert round(gap["high_per_100_base"].second, 1) == 6.6 and gap["messages"].gap == 499


def test_bands(spark):
    df = spark.createDataFrame([(1.0,), (5.9,), (6.0,), (71.9,), (72.0,), (None,)], "lead_hours double")
    assert {r.band: r.events for r in messages.lead_bands(df).collect()} == {
        "under 6 hours": 2, "6 hours to 2 days": 2, "3 days or more": 1, "n/a": 1}


ODD_SHEET = [
    ("01", "c1", "", "NEW", ""), ("02", "c1", "", "new ", "seen"), ("03", "c1", "", "NEW", "seen"), ("04", "c1", "", "FALSE", "no"),
    ("05", "c2", "kx", "NEW", "first, on no known key"), ("06", "c2", "", "FALSE", ""), ("07", "c2", "", "NEW", "late"),
    ("08", "c3", "k1", "NEW", " "), ("09", "c3", "k2", "NEW", ""), ("10", " c4\t", "", "MATCH", "names no key"),
    ("11", "c4", "", "NEW", "told"), ("12", "", "", "NEW", "nobody's"), (None, " ", "", "NEW", "nobody's"), ("13", None, "k1", "NEW", "x"),
    ("14", "gone", "", "NEW", "y"), ("15", "c5", "", "", "blank"), ("16", "c5", "", "MAYBE", "bad"), ("17", "c5", None, None, None),
]


def odd_sheet(spark):
    found = spark.createDataFrame([(c, "p", "t", "s") for c in ("c1", "c2", "c3", "c4", "c5", "", None)],
                                  "candidate_id string, probe string, proposed_type string, statement string")
    key = spark.createDataFrame([("k1",), ("k2",), (None,)], "key_id string")
    return found, key, spark.createDataFrame(ODD_SHEET, "row_no string, candidate_id string, key_id string, verdict string, note string")


def test_notes_and_tallies_are_those_of_judged_rows(spark):
    found, key, sheet = odd_sheet(spark)
    judged = scoring.judged_rows(found, key, sheet)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(scoring.new_finds(found, scoring.noted(found, key, sheet))) == rows(scoring.new_finds(found, judged))
    assert rows(scoring.tally(found, key, sheet)) == rows(scoring._tally(judged).select("candidate_id", "verdict", "key_id"))
    assert judged.count() == 13 and judged.filter("candidate_id = ''").count() == 0


def test_no_filter_trims_candidates_a_second_time(spark):
    found, key, sheet = odd_sheet(spark)
    for df in (scoring.judged_rows(found, key, sheet), scoring.tally(found, key, sheet)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "trim(coalesce(candidate_id" in line]


def test_rows_without_a_verdict_are_left_out_before_they_meet_candidates(spark):
    found, key, sheet = odd_sheet(spark)
    plan = scoring.tally(found, key, sheet)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[:plan.rindex("IN (MATCH,NEW,FALSE)")]
