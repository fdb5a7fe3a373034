"""Exclusivity and turnaround: overlapping bookings and the gaps between them.

No step branches on a value of kind or role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ruletrace.functions.clock import minutes_between, within_day
from ruletrace.functions.labels import candidate_id, sentence
from ruletrace.guards import Guards
from ruletrace.operators.distribution import histogram, left_edge
from ruletrace.operators.intervals import Sweep, first_overlaps, overlap_counts, overlap_pairs, sweep, timed, within_first
from ruletrace.operators.ordered import WHOLE, next_in_group
from ruletrace.plans import statements as text
from ruletrace.plans.facts import Facts, facts
from ruletrace.session import settled
from ruletrace.sources.landing import Landing

PROBE = "p03"
# About as many bookings as one task sweeps.
DEALT = 1 << 17


def booked_resources(landing: Landing) -> DataFrame:
    """Known resources with their number of timed bookings.

    Counting before the join leaves one row per resource to match, however many bookings
    the busiest one has.
    """
    if isinstance(landing, Facts):
        return landing.once("booked", lambda: settled(_booked_resources(landing), "booked"))
    return _booked_resources(landing)


def _booked_resources(landing: Landing) -> DataFrame:
    known = landing.resources.filter("kind IS NOT NULL").select("resource_id", "kind", "name")
    return _booking_counts(landing).join(known, "resource_id")


def _booking_counts(landing: Landing) -> DataFrame:
    counts = timed(landing.assignments).groupBy("resource_id").agg(F.count("*").alias("bookings"))
    return landing.once("counts", lambda: settled(counts, "counts")) if isinstance(landing, Facts) else counts


def kind_volumes(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    over = F.col("bookings") >= guards.min_assignments_per_resource
    return booked_resources(landing).groupBy("kind").agg(
        F.count_if(over).alias("resources_over_floor"),
        F.count("*").alias("resources_total"),
        F.coalesce(F.sum(F.when(over, F.col("bookings"))), F.lit(0)).alias("assignments_over_floor"))


def eligible_bookings(landing: Landing, min_assignments: int, *also: str) -> DataFrame:
    """Timed bookings of resources with enough of them, and the kind of the resource.

    Each side is shuffled as it is, so adaptive execution may split a resource that most bookings have. Facts hold
    them written down, with all that the plans need of them.
    """
    if isinstance(landing, Facts):
        return landing.once(f"bookings-{min_assignments}", lambda: settled(_eligible(landing, min_assignments, "name").select(
            "resource_id", "work_id", "assignment_id", "role", "start_ts", "end_ts", "kind", "name"), "bookings"))
    return _eligible(landing, min_assignments, *also)


def _eligible(landing: Landing, min_assignments: int, *also: str, of: DataFrame | None = None) -> DataFrame:
    """The same, not written down. ``of`` narrows them to the resources of a small frame, and adds its columns."""
    enough = (booked_resources(landing).filter(F.col("bookings") >= min_assignments)
              .select("resource_id", "kind", *also))
    rows = timed(landing.assignments)
    if of is not None:
        rows = rows.join(of, "resource_id")
    return rows.join(enough, "resource_id")


def _dealt(landing: Facts, min_assignments: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Eligible bookings with the asked columns, in two frames: those of busy resources, and the others dealt by resource.

    What is windowed by resource then shuffles the others once, as narrow as they were read, and whether kinds are
    broadcast or joined by a sort makes no difference. They become wider after that, so tasks go by their number
    and not by bytes shuffled. Busy resources are few, so their bookings meet them unshuffled.
    """
    few = F.col("bookings") <= WHOLE
    busy = landing.once("busy", lambda: settled(_booking_counts(landing).filter(~few).select("resource_id"), "busy"))
    tasks = landing.once("tasks", lambda: 1 + (_booking_counts(landing).agg(F.sum("bookings")).first()[0] or 0) // DEALT)
    rows = timed(landing.assignments).filter("resource_id IS NOT NULL").select("resource_id", *columns)
    enough = (booked_resources(landing).filter(F.col("bookings") >= min_assignments)
              .select("resource_id", "kind", "bookings"))
    named = settled(enough.filter(~few), "named")
    others = rows.join(busy, "resource_id", "left_anti").repartition(tasks, "resource_id")
    return rows.join(named, "resource_id"), others.join(enough.filter(few), "resource_id")


def _swept(landing: Facts, guards: Guards) -> Sweep:
    """The sweep over all eligible bookings, once for counts, examples and existence.

    It reads few of their columns, so they are not written down for it.
    """
    least = guards.min_assignments_per_resource
    return landing.once(f"sweep-{least}", lambda: sweep(
        _eligible(landing, least, "bookings"), ["kind"], "bookings",
        parts=list(_dealt(landing, least, "work_id", "start_ts", "end_ts"))))


def overlaps_on(landing: Landing, date: str, guards: Guards = Guards()) -> DataFrame:
    """Every pair of overlapping bookings of one eligible resource that has a booking begin on the day.

    All pairs of a table would be quadratic in a busy resource; counts and examples need none of them.
    """
    rows = _eligible(facts(landing), guards.min_assignments_per_resource)
    near = settled(rows.filter(within_day("start_ts", date)), "near")
    pairs = overlap_pairs(rows, keep=["kind"], later=near).unionByName(
        overlap_pairs(rows, keep=["kind"], earlier=near)).distinct()
    return pairs.withColumnRenamed("a_kind", "kind").drop("b_kind")


def job_pairs(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Overlaps per kind as booking pairs and as distinct pairs of jobs.

    Two roles of one resource on a job make two booking pairs but one pair of jobs. A job with one
    window on a resource is in a pair of jobs as often as in a pair of windows, so those are counted by
    the sweep; only jobs with several windows are joined.
    """
    landing = facts(landing)
    rows = _eligible(landing, guards.min_assignments_per_resource, "bookings")
    windows = (rows.filter("work_id IS NOT NULL").groupBy("kind", "bookings", "resource_id", "work_id", "start_ts", "end_ts")
               .agg(F.min("assignment_id").alias("assignment_id")))
    windows = settled(windows, "windows")
    several = (windows.groupBy("resource_id", F.col("work_id").alias("_work")).agg(F.count("*").alias("_n"))
               .filter("_n > 1").withColumnRenamed("resource_id", "_resource").drop("_n"))
    several = settled(several, "several")  # few, and their size is known
    again = (F.col("resource_id") == F.col("_resource")) & (F.col("work_id") == F.col("_work"))
    single, many = windows.join(several, again, "left_anti"), windows.join(several, again, "left_semi")
    counted = (overlap_counts(_swept(landing, guards)).select("kind", F.col("pairs").alias("overlapping_pairs"),
                                                     F.lit(0).cast("bigint").alias("distinct_job_pairs"))
               .unionByName(overlap_counts(sweep(single, ["kind"], "bookings")).select(
                   "kind", F.lit(0).cast("bigint").alias("overlapping_pairs"), F.col("pairs").alias("distinct_job_pairs"))))
    joined = (overlap_pairs(windows, keep=["kind"], later=many)
              .unionByName(overlap_pairs(windows, keep=["kind"], earlier=many))
              .select(F.col("a_kind").alias("kind"), "resource_id", F.least("a_work_id", "b_work_id").alias("job_1"),
                      F.greatest("a_work_id", "b_work_id").alias("job_2")).distinct()
              .select("kind", F.lit(0).cast("bigint").alias("overlapping_pairs"),
                      F.lit(1).cast("bigint").alias("distinct_job_pairs")))
    return (counted.unionByName(joined).groupBy("kind")
            .agg(F.sum("overlapping_pairs").alias("overlapping_pairs"),
                 F.sum("distinct_job_pairs").alias("distinct_job_pairs")).filter("overlapping_pairs > 0"))


def exclusivity(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Per kind with enough bookings: how many pairs overlap and how many resources do it."""
    landing = facts(landing)
    volumes = kind_volumes(landing, guards).filter(
        (F.col("resources_over_floor") > 0)
        & (F.col("assignments_over_floor") >= guards.min_observations))
    found = (overlap_counts(_swept(landing, guards)).groupBy("kind")
             .agg(F.sum("pairs").alias("overlapping_pairs"),
                  F.count_if(F.col("pairs") > 0).alias("resources_with_an_overlap")))
    return (volumes.join(found, "kind", "left")
            .fillna(0, ["overlapping_pairs", "resources_with_an_overlap"]))


def overlap_examples(landing: Landing, guards: Guards = Guards(),
                     size: int = text.OVERLAP_EXAMPLES) -> DataFrame:
    """The first overlapping pairs of each kind, by resource, start times and jobs.

    The order starts with the resource, and each resource with an overlap gives at least one
    example, so the first ``size`` such resources of a kind hold them all. Within a resource
    the sweep tells a time by which as many pairs exist, and a pair beyond it cannot come before them. Only
    those bookings are joined.
    """
    landing = facts(landing)
    least = guards.min_assignments_per_resource
    # The few resources are met before anything else is looked up.
    near = settled(_eligible(landing, least, "bookings", of=first_overlaps(_swept(landing, guards), size)), "near")
    pairs = overlap_pairs(near, keep=["kind"], later=near, earlier=near.filter(within_first("bookings")))
    order = ["resource_id", "a_start_ts", "b_start_ts", "a_work_id", "b_work_id",
             "a_assignment_id", "b_assignment_id"]
    return (pairs.withColumn("position", F.row_number().over(
                Window.partitionBy("a_kind").orderBy(*order)))
            .filter(F.col("position") <= size)
            .select(F.col("a_kind").alias("kind"), "position", "resource_id",
                    F.col("a_work_id").alias("work_id_a"), F.col("b_work_id").alias("work_id_b"),
                    F.col("a_start_ts").alias("a_start"), F.col("a_end_ts").alias("a_end"),
                    F.col("b_start_ts").alias("b_start"), F.col("b_end_ts").alias("b_end")))


def exclusivity_candidates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    landing = facts(landing)
    found = exclusivity(landing, guards)
    # At most ten examples per kind by construction, so this list is short.
    examples = (overlap_examples(landing, guards).groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct(
            "position", "resource_id", "work_id_a", "work_id_b",
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
              for c in ("a_start", "a_end", "b_start", "b_end")]))).alias("examples")))
    shown = F.transform("examples", lambda x: x.dropFields("position"))
    sometimes = sentence(text.OVERLAP_SOMETIMES, pairs="overlapping_pairs",
                         resources="resources_with_an_overlap")
    never = sentence(text.OVERLAP_NEVER, assignments="assignments_over_floor")
    worded = F.expr(f"CASE WHEN overlapping_pairs > 0 THEN {sometimes} ELSE {never} END")
    return found.join(examples, "kind", "left").select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'exclusivity'", "kind"),
        F.lit("exclusivity").alias("proposed_type"), worded.alias("statement"),
        F.to_json(F.struct("overlapping_pairs", "resources_with_an_overlap",
                           F.coalesce(shown, F.array()).alias("examples"))).alias("evidence"),
        F.to_json(F.struct(
            "kind", F.col("assignments_over_floor").alias("assignments_considered"),
            F.col("resources_over_floor").alias("resources_over_assignment_floor"),
            F.col("resources_total").alias("resources_of_this_kind"),
            F.lit(guards.min_assignments_per_resource).alias("min_assignments_per_resource")))
        .alias("confidence_inputs"))


def gaps(landing: Landing, min_assignments: int) -> DataFrame:
    """Minutes from the end of each booking to the resource's next start, never negative."""
    # Read for this alone, so they are not written down.
    busy, others = [part.drop("bookings") for part in _dealt(
        facts(landing), min_assignments, "assignment_id", "start_ts", "end_ts")]
    follow = next_in_group(busy, ["resource_id"], ["start_ts", "assignment_id"], {"next_start": "start_ts"}, small=others)
    return (follow.filter("next_start IS NOT NULL")
            .withColumn("gap_minutes", minutes_between("end_ts", "next_start"))
            .filter("gap_minutes >= 0"))


def gap_counts(landing: Landing, min_assignments: int) -> DataFrame:
    """How often each gap length occurs per kind.

    ``resources`` counts the resources whose least gap it is, so it sums to the number of
    resources that have any gap, without a second pass over the bookings.
    """
    if isinstance(landing, Facts):
        return landing.once(f"gaps-{min_assignments}", lambda: settled(_gap_counts(landing, min_assignments), "gaps"))
    return _gap_counts(landing, min_assignments)


def _gap_counts(landing: Landing, min_assignments: int) -> DataFrame:
    # Gap lengths and resources are counted side by side, both before anything is shuffled again.
    per = (gaps(landing, min_assignments).withColumn("_gap", F.col("gap_minutes"))
           .groupingSets([["kind", "gap_minutes"], ["kind", "resource_id"]], "kind", "gap_minutes", "resource_id")
           .agg(F.grouping("resource_id").alias("_whole"), F.count("*").alias("n"), F.min("_gap").alias("_least")))
    per = settled(per, "per")  # few against the bookings, and read twice
    lengths = per.filter("_whole = 1").select("kind", "gap_minutes", "n", F.lit(0).cast("bigint").alias("resources"))
    least = (per.filter("_whole = 0").withColumn("_all", F.min("_least").over(Window.partitionBy("resource_id")))
             .filter("_least = _all").select("kind", F.col("_least").alias("gap_minutes"), F.lit(0).cast("bigint").alias("n"),
                                             F.lit(1).cast("bigint").alias("resources")))
    return lengths.unionByName(least).groupBy("kind", "gap_minutes").agg(
        F.sum("n").alias("n"), F.sum("resources").alias("resources"))


def turnaround(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Per kind whose gaps do not start at zero: where they start, and what lies below."""
    counts = gap_counts(landing, guards.min_assignments_per_resource)
    return _floors(counts, guards)


def _floors(counts: DataFrame, guards: Guards) -> DataFrame:
    edges = left_edge(counts, ["kind"], "gap_minutes", text.GAP_BIN_MINUTES, text.GAP_TAIL,
                      F.sum("resources").alias("resources_contributing"))
    return edges.filter((F.col("observations") >= guards.min_observations) & (F.col("edge") > 0))


def turnaround_candidates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    counts = gap_counts(facts(landing), guards.min_assignments_per_resource)
    found = _floors(counts, guards)
    # 24 bins per kind by construction.
    head = (histogram(counts, ["kind"], "gap_minutes", text.GAP_BIN_MINUTES, text.GAP_HEAD_BINS)
            .groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("edge", "n"))).alias("bins")))
    hard = sentence(text.FLOOR_HARD, pairs="observations")
    soft = sentence(text.FLOOR_SOFT, pairs="observations", kept="(observations - below)")
    worded = F.expr(f"CASE floor WHEN 'hard' THEN {hard} ELSE {soft} END")
    return found.join(head, "kind").select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'turnaround'", "kind"),
        F.lit("turnaround").alias("proposed_type"), worded.alias("statement"),
        F.to_json(F.struct(
            F.col("edge").alias("proposed_minimum_minutes"), "floor",
            F.col("below").alias("gaps_below_the_edge"),
            F.lit(text.GAP_BIN_MINUTES).alias("bin_minutes"),
            F.lit(text.GAP_TAIL).alias("tail_fraction"),
            F.transform("bins", lambda b: F.array(b["edge"], b["n"])).alias("histogram_head"),
            F.col("least").alias("observed_min_gap"),
            F.col("upper_median").alias("observed_median_gap"))).alias("evidence"),
        F.to_json(F.struct(
            "kind", F.col("observations").alias("consecutive_pairs"), "resources_contributing",
            F.lit(guards.min_assignments_per_resource).alias("min_assignments_per_resource")))
        .alias("confidence_inputs"))


def tight_gaps(landing: Landing, under: int = 30, kind: str = "",
               min_assignments: int = Guards.min_assignments_per_resource) -> DataFrame:
    """The shortest turnarounds by name: who, which job ended, which one started."""
    rows = eligible_bookings(facts(landing), min_assignments, "name").select(
        F.coalesce("name", "resource_id").alias("name"), "kind", "resource_id", "assignment_id",
        "work_id", "role", "start_ts", "end_ts")
    if kind:
        rows = rows.filter(F.lower("kind") == kind.lower())
    follow = next_in_group(rows, ["resource_id"], ["start_ts", "assignment_id"],
                           {"next_start": "start_ts", "next_work": "work_id", "next_role": "role"})
    # Few gaps are this short, so the jobs are named after the cut.
    tight = (follow.filter("next_start IS NOT NULL")
             .withColumn("gap_minutes", minutes_between("end_ts", "next_start"))
             .filter((F.col("gap_minutes") >= 0) & (F.col("gap_minutes") < under)))
    jobs = landing.work.select("work_id", F.coalesce("work_type", F.lit("untyped")).alias("work_type"))
    return (tight
            .join(jobs.select("work_id", F.col("work_type").alias("finished")), "work_id", "left")
            .join(jobs.select(F.col("work_id").alias("next_work"),
                              F.col("work_type").alias("started")), "next_work", "left")
            .select("gap_minutes", "name", "kind", "end_ts", "next_start",
                    F.coalesce("finished", F.lit("untyped")).alias("finished"), "work_id", "role",
                    F.coalesce("started", F.lit("untyped")).alias("started"), "next_work", "next_role")
            .orderBy("gap_minutes", "name", "end_ts", "work_id"))
