"""Every registered query, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import views
from ruletrace.functions import cells, clock, labels
from ruletrace.operators.distribution import histogram
from ruletrace.plans import (bookings, candidates, ceilings, compare, days, evidence, messages, override_detail,
                             overrides, peaks, population, scoring)
from ruletrace.sources import build
from ruletrace.sources.integrity import latest_digests
from ruletrace.sources.landing import Landing, conform, repeated_keys, volumes
from ruletrace.sources.mapping import DEFAULT_MAP
from ruletrace.sources.profiles import PROFILES, thin
from ruletrace.sources.screen import denied

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIELD = "ovr_AF"
DAY = "1997-05-28"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def number(name: str) -> Column:
    """A whole number that may be missing, in a type that compares alike everywhere."""
    return F.col(name).cast("double").alias(name)


def bare(spark: SparkSession, sf_dir: str) -> Landing:
    """Landing tables for plans that need no more of a job than its type and start."""
    return views.landing(spark, sf_dir, "work_type", "start_ts")


# -- bookings --------------------------------------------------------------------------------

@query
def overlap_pairs(spark, sf_dir):
    return bookings.overlaps_on(bare(spark, sf_dir), DAY).select(
        "kind", "resource_id", "a_work_id", "b_work_id", "a_assignment_id", "b_assignment_id",
        *[stamp(c) for c in ("a_start_ts", "a_end_ts", "b_start_ts", "b_end_ts")])


@query
def overlap_job_pairs(spark, sf_dir):
    return bookings.job_pairs(bare(spark, sf_dir))


@query
def exclusivity_by_kind(spark, sf_dir):
    return bookings.exclusivity(bare(spark, sf_dir))


@query
def exclusivity_examples(spark, sf_dir):
    return bookings.overlap_examples(bare(spark, sf_dir)).select(
        "kind", "position", "resource_id", "work_id_a", "work_id_b",
        *[stamp(c) for c in ("a_start", "a_end", "b_start", "b_end")])


@query
def kind_volumes(spark, sf_dir):
    return bookings.kind_volumes(bare(spark, sf_dir))


@query
def gaps_by_kind(spark, sf_dir):
    return bookings.gap_counts(bare(spark, sf_dir), 20).select("kind", "gap_minutes", "n")


@query
def gap_histogram(spark, sf_dir):
    counts = bookings.gap_counts(bare(spark, sf_dir), 20)
    return histogram(counts, ["kind"], "gap_minutes", 5).select("kind", "edge", "n")


@query
def turnaround_floor(spark, sf_dir):
    return bookings.turnaround(bare(spark, sf_dir))


@query
def tight_gaps(spark, sf_dir):
    return bookings.tight_gaps(bare(spark, sf_dir), under=600).select(
        "gap_minutes", "name", "kind", stamp("end_ts"), stamp("next_start"), "finished", "work_id",
        "role", "started", "next_work", "next_role")


@query
def tight_gaps_of_kind(spark, sf_dir):
    return bookings.tight_gaps(bare(spark, sf_dir), under=2000, kind="asia").select(
        "gap_minutes", "name", "kind", "work_id", "next_work")


# -- ceilings --------------------------------------------------------------------------------

def _ceiling(dimension: str) -> None:
    def run(spark, sf_dir):
        needs = {"customers_per_work": "customer_count", "work_per_location_per_day": "location_id"}
        t = views.landing(spark, sf_dir, "start_ts", *filter(None, [needs.get(dimension)]))
        return ceilings.ceilings(t, dimensions=(dimension,))

    def peak(spark, sf_dir):
        needs = {"customers_per_work": "customer_count", "work_per_location_per_day": "location_id"}
        t = views.landing(spark, sf_dir, "work_type", "start_ts",
                          *filter(None, [needs.get(dimension)]))
        return peaks.peaks(t, dimension, 5)

    def rows(spark, sf_dir):
        needs = {"customers_per_work": "customer_count", "work_per_location_per_day": "location_id"}
        t = views.landing(spark, sf_dir, "work_type", "start_ts", *filter(None, [needs.get(dimension)]))
        return peaks.peak_rows(t, dimension, 5).select("grp", "n", "position", "item", stamp("at"), "id")

    QUERIES[f"ceiling_{dimension}"] = run
    QUERIES[f"peak_{dimension}"] = peak
    QUERIES[f"peak_rows_{dimension}"] = rows


for _dimension in ceilings.DIMENSIONS:
    _ceiling(_dimension)


@query
def ceiling_distribution(spark, sf_dir):
    t = views.landing(spark, sf_dir, "start_ts", "location_id", "customer_count")
    parts = [ceilings.distribution(t, d) for d in ceilings.DIMENSIONS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def peak_rows_per_day(spark, sf_dir):
    return peaks.peak_rows(bare(spark, sf_dir), "work_per_day", 3).select(
        "grp", "n", "position", "item", stamp("at"), "id")


# -- population ------------------------------------------------------------------------------

@query
def fill_rates(spark, sf_dir):
    return population.fill_rates(views.landing(spark, sf_dir)).select(
        "partition", "value", "field", "rows", "filled", "fill_rate")


@query
def population_pairs(spark, sf_dir):
    return population.population(views.landing(spark, sf_dir))


@query
def population_statements(spark, sf_dir):
    return population.population_candidates(views.landing(spark, sf_dir)).select(
        "probe", "candidate_id", "proposed_type", "statement")


# -- overrides -------------------------------------------------------------------------------

@query
def override_rank(spark, sf_dir):
    return overrides.override_rank(bare(spark, sf_dir)).select(
        "entity_table", "field", "events", "entities", "actors", stamp("first_seen"),
        stamp("last_seen"), F.col("rank").cast("bigint").alias("rank"), "all_changes")


@query
def override_actors(spark, sf_dir):
    return overrides.override_actors(bare(spark, sf_dir))


@query
def override_lead_times(spark, sf_dir):
    return overrides.lead_times(bare(spark, sf_dir))


@query
def override_list(spark, sf_dir):
    return override_detail.override_list(bare(spark, sf_dir), top=3).select(
        "field", "label", "events", "entities", "actors", stamp("first_seen"), stamp("last_seen"))


@query
def override_list_labelled(spark, sf_dir):
    """Labels that were kept stand beside the ids; the others show the id."""
    return override_detail.override_list(bare(spark, sf_dir), views.override_labels(spark, sf_dir), top=5).select(
        "field", "label", "events", "entities", "actors", stamp("first_seen"), stamp("last_seen"))


@query
def override_tail(spark, sf_dir):
    return override_detail.override_tail(bare(spark, sf_dir), top=3)


@query
def override_changes(spark, sf_dir):
    t = views.landing(spark, sf_dir, "work_type", "start_ts", "customer_count")
    return override_detail.change_rows(t, FIELD).select(
        stamp("changed_at"), "changed_by", "work_id", "source", "work_type", stamp("start_ts"),
        "lead_days", number("customer_count"), "old_value", "new_value")


@query
def override_crew(spark, sf_dir):
    return override_detail.touched_crew(bare(spark, sf_dir), FIELD)


@query
def override_kind_lift(spark, sf_dir):
    return override_detail.kind_lift(bare(spark, sf_dir), FIELD).withColumn(
        "more_common_here", F.col("more_common_here").cast("int"))


@query
def override_top_resources(spark, sf_dir):
    return override_detail.top_resources(bare(spark, sf_dir), FIELD)


@query
def override_sources(spark, sf_dir):
    return override_detail.jobs_by_source(bare(spark, sf_dir), FIELD)


@query
def override_repeats(spark, sf_dir):
    return override_detail.repeated_jobs(bare(spark, sf_dir), FIELD).select(
        "work_id", "times", "work_type", stamp("start_ts"))


@query
def override_overlap_rate(spark, sf_dir):
    return override_detail.overlap_rate(bare(spark, sf_dir), FIELD)


# -- landing tables --------------------------------------------------------------------------

@query
def landing_volumes(spark, sf_dir):
    return volumes(views.landing(spark, sf_dir))


@query
def lean_volumes(spark, sf_dir):
    return volumes(thin(views.landing(spark, sf_dir), PROFILES["lean"]))


@query
def lean_fill(spark, sf_dir):
    work = thin(views.landing(spark, sf_dir), PROFILES["lean"]).work
    return work.groupBy("status").agg(F.count("*").alias("rows"),
                                      F.count("location_id").alias("location_id"),
                                      F.count("customer_count").alias("customer_count"))


@query
def landing_repeated_keys(spark, sf_dir):
    """Copies of a text share the key made from it."""
    t = bare(spark, sf_dir)
    texts = conform(views.table(spark, sf_dir, "documents").selectExpr(
        "sha2(text, 256) AS assignment_id", "source AS resource_id", "lang AS role"), "assignments")
    return repeated_keys(t.replaced(assignments=texts))


@query
def day_sheet(spark, sf_dir):
    return days.day_sheet(views.landing(spark, sf_dir), DAY).select(
        "work_id", "work_type", stamp("start_ts"), stamp("end_ts"), number("customer_count"), "status",
        "place", "resource", "kind", "role")


@query
def names_of_ids(spark, sf_dir):
    return candidates.names_of_ids(bare(spark, sf_dir))


@query
def described_bookings(spark, sf_dir):
    t = bare(spark, sf_dir)
    values = t.assignments.select("assignment_id", F.explode(F.array(
        "resource_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"))).alias("value"))
    return candidates.described(values, candidates.names_of_ids(t)).select(
        "assignment_id", "value", "shown")


# -- ingestion -------------------------------------------------------------------------------

def _landed(spark, sf_dir, profile: str = "full") -> Landing:
    return build.build(spark, views.export(spark, sf_dir), DEFAULT_MAP, datetime(2026, 1, 1),
                       PROFILES[profile])


@query
def landed_work(spark, sf_dir):
    return _landed(spark, sf_dir).work.select(
        "work_id", "work_type", stamp("start_ts"), stamp("end_ts"), "location_id", "status",
        number("customer_count"), "source_system", "source_id", stamp("extracted_at"))


@query
def landed_resources(spark, sf_dir):
    return _landed(spark, sf_dir).resources.select(
        "resource_id", "kind", "name", "home_location_id", "source_id")


@query
def landed_resources_lean(spark, sf_dir):
    return _landed(spark, sf_dir, "lean").resources.select(
        "resource_id", "kind", "name", "home_location_id")


@query
def landed_assignments(spark, sf_dir):
    return _landed(spark, sf_dir).assignments.select(
        "assignment_id", "resource_id", "work_id", "role", stamp("start_ts"), stamp("end_ts"),
        "source_id")


@query
def landed_work_lean(spark, sf_dir):
    """Movements are left out as a whole, and places are blank."""
    return _landed(spark, sf_dir, "lean").work.select(
        "work_id", "work_type", stamp("start_ts"), stamp("end_ts"), "location_id", "status", number("customer_count"))


@query
def landed_assignments_lean(spark, sf_dir):
    """Only the crew that the jobs themselves name."""
    return _landed(spark, sf_dir, "lean").assignments.select(
        "assignment_id", "resource_id", "work_id", "role", stamp("start_ts"), stamp("end_ts"), "source_id")


@query
def landed_locations(spark, sf_dir):
    return _landed(spark, sf_dir).locations


@query
def landed_travel(spark, sf_dir):
    return _landed(spark, sf_dir).location_travel.withColumn(
        "is_estimate", F.col("is_estimate").cast("int"))


@query
def landed_changes(spark, sf_dir):
    return _landed(spark, sf_dir).changes.select(
        "change_id", "entity_table", "entity_id", "field", "old_value", "new_value",
        stamp("changed_at"), "changed_by", "source_id")


@query
def override_labels(spark, sf_dir):
    return build.override_labels(spark, views.export(spark, sf_dir), DEFAULT_MAP)


@query
def parsed_links(spark, sf_dir):
    one, two = views.record("l_suppkey"), views.record("l_partkey")
    shapes = (f"array(to_json(array(named_struct('id', {one}), named_struct('id', {two}))), "
              f"to_json(array({one}, {two})), concat({one}, ' , ', {two}, ','), '[]', 'null')")
    rows = cells.with_cells(views.table(spark, sf_dir, "lineitem").selectExpr(
        f"{views.LINE_KEY} AS line", f"get({shapes}, l_linenumber % 5) AS cell"), ["cell"])
    return rows.selectExpr("line", f"{cells.links('cell')} AS ids").selectExpr(
        "line", "size(ids) AS links", "get(ids, 0) AS first_id", "get(ids, 1) AS second_id")


@query
def parsed_log_lines(spark, sf_dir):
    line = ("CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE concat(l_returnflag, ' :: a :: u', "
            "l_suppkey, ' :: ', date_format(l_shipdate, 'yyyy-MM-dd')) END")
    return (views.table(spark, sf_dir, "lineitem")
            .selectExpr(f"{views.LINE_KEY} AS key", f"{line} AS line")
            .selectExpr("key", f"{cells.override_line('line')} AS e")
            .selectExpr("key AS line", "e.label", "e.who", "e.when"))


@query
def parsed_cells(spark, sf_dir):
    layouts = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss",
               "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    texts = ", ".join(f"date_format(ts, {cells.text(layout)})" for layout in layouts)
    rows = cells.with_cells(views.table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", f"get(array({texts}, 'junk'), CAST(event_id % 7 AS INT)) AS at",
        "concat(' ', value) AS number", "props", "to_json(array(event_type)) AS list"),
        ["at", "number", "props", "list"])
    return rows.selectExpr(
        "event_id", f"date_format({cells.parse_ts('at')}, 'yyyy-MM-dd HH:mm:ss') AS parsed_ts",
        f"{cells.parse_int('number')} AS parsed_int", f"{cells.scalar('props')} AS scalar_of_props",
        f"{cells.scalar('list')} AS scalar_of_list", "date_format(ts, 'yyyy-MM-dd HH:mm') AS at_text",
    ).withColumn("shown", clock.with_weekday("at_text")).drop("at_text")


@query
def opaque_ids(spark, sf_dir):
    ident = cells.opaque_id("o_orderkey", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey END",
                            "o_orderstatus", prefix="as_")
    return views.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{ident} AS opaque")


@query
def label_classes(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{cells.label_class('text')} AS label", f"{labels.slug('source', 'text')} AS slug")


@query
def denied_sources(spark, sf_dir):
    names = views.table(spark, sf_dir, "pages").selectExpr(
        "concat(get(array('Config / Thresholds', 'Old Dispatch-Board ', 'Orders'), "
        "CAST(page_id % 3 AS INT)), page_id, '.csv') AS name")
    plain = names.select(F.regexp_replace("name", r"[0-9]+\.csv$", ".JSON").alias("name"))
    return (denied(names.unionByName(plain))
            .groupBy("name", "norm", "rule").agg(F.count("*").alias("n")))


@query
def record_links(spark, sf_dir):
    tables = {"op_": "tblOrders", "mv_": "tblEvents"}
    return (views.table(spark, sf_dir, "orders")
            .selectExpr("concat(get(array('op_', 'mv_', 'zz_'), CAST(o_orderkey % 3 AS INT)), "
                        f"{views.record('o_orderkey')}) AS id")
            .selectExpr("id", f"{labels.record_url('id', 'appBase', tables)} AS url",
                        f"{labels.source_of('id')} AS source"))


@query
def manifest_latest(spark, sf_dir):
    return latest_digests(views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_no", "CASE WHEN doc_id % 10 = 9 THEN '# noted again' "
        "ELSE concat(sha2(text, 256), '  ', source, '/', lang) END AS value"))


# -- scoring ---------------------------------------------------------------------------------

def _score(spark, sf_dir):
    found, key = views.found(spark, sf_dir), views.known_rules(spark, sf_dir)
    return found, key, scoring.judged_rows(found, key, views.verdicts(spark, sf_dir))


def _tally(spark, sf_dir):
    found, key = views.found(spark, sf_dir), views.known_rules(spark, sf_dir)
    return found, key, scoring.tally(found, key, views.verdicts(spark, sf_dir))


@query
def score_headline(spark, sf_dir):
    return scoring.headline(*_tally(spark, sf_dir))


@query
def score_recall(spark, sf_dir):
    _, key, judged = _tally(spark, sf_dir)
    return scoring.recall_by(scoring.recovery(key, judged))


@query
def score_memory_split(spark, sf_dir):
    _, key, judged = _tally(spark, sf_dir)
    return scoring.memory_split(scoring.recovery(key, judged))


@query
def score_problems(spark, sf_dir):
    return scoring.problems(_score(spark, sf_dir)[2])


@query
def score_new_finds(spark, sf_dir):
    found, key = views.found(spark, sf_dir), views.known_rules(spark, sf_dir)
    return scoring.new_finds(found, scoring.noted(found, key, views.verdicts(spark, sf_dir)))


@query
def score_unrecovered(spark, sf_dir):
    _, key, judged = _tally(spark, sf_dir)
    return scoring.unrecovered(key, judged)


@query
def score_multi_cover(spark, sf_dir):
    return scoring.multi_cover(_tally(spark, sf_dir)[2])


@query
def score_covered_keys(spark, sf_dir):
    return scoring.covered_keys(_tally(spark, sf_dir)[2])


@query
def candidates_per_probe(spark, sf_dir):
    return candidates.per_probe(views.found(spark, sf_dir))


@query
def unjudged(spark, sf_dir):
    return candidates.unjudged(views.found(spark, sf_dir), views.verdicts(spark, sf_dir)).select(
        "candidate_id", "probe")


@query
def verdict_sheet(spark, sf_dir):
    return candidates.verdict_sheet(views.found(spark, sf_dir), views.verdicts(spark, sf_dir))


def _runs(spark, sf_dir) -> tuple[scoring.Run, scoring.Run, DataFrame]:
    full = views.landing(spark, sf_dir, "start_ts")
    rich = scoring.Run("full", views.found(spark, sf_dir), views.verdicts(spark, sf_dir), volumes(full))
    lean = scoring.Run("lean", views.found_lean(spark, sf_dir), views.verdicts_lean(spark, sf_dir),
                       volumes(thin(full, PROFILES["lean"])))
    return rich, lean, views.known_rules(spark, sf_dir)


@query
def delta_headline(spark, sf_dir):
    return compare.headline_delta(*_runs(spark, sf_dir))


@query
def delta_survival(spark, sf_dir):
    return compare.survival(*_runs(spark, sf_dir))


@query
def delta_moved_keys(spark, sf_dir):
    return compare.moved_keys(*_runs(spark, sf_dir))


@query
def delta_candidates(spark, sf_dir):
    rich, lean, _ = _runs(spark, sf_dir)
    return compare.one_sided_candidates(rich, lean)


@query
def delta_probes(spark, sf_dir):
    rich, lean, _ = _runs(spark, sf_dir)
    return compare.probe_delta(rich, lean)


@query
def delta_volumes(spark, sf_dir):
    rich, lean, _ = _runs(spark, sf_dir)
    return compare.volume_delta(rich, lean)


# -- candidates ------------------------------------------------------------------------------

@query
def candidate_statements(spark, sf_dir):
    return candidates.candidates(views.landing(spark, sf_dir)).select(
        "probe", "candidate_id", "proposed_type", "statement")


def _evidence(name: str, *stamps: str) -> None:
    def run(spark, sf_dir):
        rows = getattr(evidence, name)(views.landing(spark, sf_dir))
        return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})

    QUERIES[f"evidence_{name}"] = run


for _name, *_stamps in (("exclusivity",), ("overlap_examples", "a_start", "a_end", "b_start", "b_end"), ("turnaround",),
                        ("gap_bins",), ("ceiling",), ("ceiling_values",), ("fill",), ("fill_values",),
                        ("override", "first_seen", "last_seen"), ("override_people",)):
    _evidence(_name, *_stamps)


@query
def evidence_names(spark, sf_dir):
    return evidence.names(views.landing(spark, sf_dir), override_labels=views.override_labels(spark, sf_dir)).select(
        "candidate_id", "list", number("position"), "part", "value", "label", "shown")


@query
def candidate_documents(spark, sf_dir):
    return candidates.candidates(views.landing(spark, sf_dir))


# -- messages --------------------------------------------------------------------------------

def _messages(spark, sf_dir, *columns: str) -> DataFrame:
    total = sum([F.sum(c) for c in columns], F.lit(0))
    return views.volume(spark, sf_dir).agg(total.alias("messages"))


@query
def recoverability_rates(spark, sf_dir):
    return messages.recoverability(views.event_sheet(spark, sf_dir),
                                   _messages(spark, sf_dir, "operational"))


@query
def recoverability_gap(spark, sf_dir):
    human = _messages(spark, sf_dir, "operational")
    first = messages.recoverability(views.event_sheet(spark, sf_dir), human)
    second = messages.recoverability(views.event_sheet_again(spark, sf_dir),
                                     _messages(spark, sf_dir, "operational", "automation"))
    return messages.pass_gap(first, second, human)


@query
def recurring_kinds(spark, sf_dir):
    return messages.recurring_kinds(views.event_sheet(spark, sf_dir))


@query
def volume_rollup(spark, sf_dir):
    return messages.volume_rollup(views.volume(spark, sf_dir))


@query
def lead_time_bands(spark, sf_dir):
    return messages.lead_bands(views.event_sheet(spark, sf_dir))
