"""Overrides: what gets changed after being set, how often, by whom, how long before the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ruletrace.functions.clock import days_between
from ruletrace.functions.labels import UNRECORDED, candidate_id, sentence, shown_ratio
from ruletrace.guards import Guards
from ruletrace.operators.distribution import spread
from ruletrace.operators.ordered import numbered
from ruletrace.plans import statements as text
from ruletrace.plans.facts import Facts
from ruletrace.session import settled
from ruletrace.sources.landing import Landing

PROBE = "p08"
KEYS = ["entity_table", "field"]


def changed_after_set(landing: Landing) -> DataFrame:
    return landing.changes.filter("field IS NOT NULL AND old_value IS NOT NULL")


def override_rank(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Overridden fields with enough events, most frequent first.

    The rank runs over the distinct fields, after counting, by ranges of their order. ``all_changes`` counts every
    change, also those that were never set before.
    """
    if isinstance(landing, Facts):
        return landing.once(f"rank-{guards.min_change_events}", lambda: settled(_override_rank(landing, guards), "rank"))
    return _override_rank(landing, guards)


def _override_rank(landing: Landing, guards: Guards) -> DataFrame:
    events = changed_after_set(landing).groupBy(*KEYS).agg(
        F.count("*").alias("events"), F.countDistinct("entity_id").alias("entities"),
        F.countDistinct("changed_by").alias("actors"),
        F.min("changed_at").alias("first_seen"), F.max("changed_at").alias("last_seen"))
    total = landing.changes.agg(F.count("*")).scalar()
    enough = events.filter(F.col("events") >= guards.min_change_events)
    order = [F.desc("events"), *[F.col(k).asc_nulls_first() for k in KEYS]]
    return numbered(enough, order, "rank").withColumn("all_changes", total)


def override_actors(landing: Landing) -> DataFrame:
    """Events per field and person, including the unrecorded one."""
    who = F.coalesce("changed_by", F.lit(UNRECORDED)).alias("changed_by")
    return changed_after_set(landing).groupBy(*KEYS, who).agg(F.count("*").alias("events"))


def lead_days(landing: Landing) -> DataFrame:
    """How often each number of days lies between an override and its job, as counts.

    Changes are first counted per job and day, so a job changed very often meets the work
    table as a few rows. Unlike the ranking this keeps changes that had no old value.
    """
    stamped = landing.changes.filter("entity_table = 'work' AND changed_at IS NOT NULL")
    per_job = (stamped.groupBy(*KEYS, F.col("entity_id").alias("work_id"),
                               F.to_date("changed_at").alias("changed_on"))
               .agg(F.count("*").alias("n")))
    jobs = landing.work.filter("start_ts IS NOT NULL").select("work_id", "start_ts")
    days = days_between("changed_on", "start_ts").cast("bigint")
    return (per_job.join(jobs, "work_id").groupBy(*KEYS, days.alias("lead_days"))
            .agg(F.sum("n").alias("n")))


def lead_times(landing: Landing) -> DataFrame:
    """Per field: jobs matched, least, upper median and greatest lead, and how many came late."""
    if isinstance(landing, Facts):
        return landing.once("lead", lambda: settled(_lead_times(landing), "lead"))
    return _lead_times(landing)


def _lead_times(landing: Landing) -> DataFrame:
    late = F.when(F.col("lead_days") <= 0, F.col("n")).otherwise(F.lit(0))
    return (spread(lead_days(landing), KEYS, "lead_days",
                   F.sum(late).alias("same_day_or_later"))
            .select(*KEYS, F.col("observations").alias("n"), F.col("least").alias("min_days"),
                    F.col("upper_median").alias("median_days"),
                    F.col("greatest").alias("max_days"), "same_day_or_later"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the keys; a missing key meets a missing one."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return left.join(named, same, "left").drop(*[f"_{k}" for k in KEYS])


def override_candidates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    ranked = override_rank(landing, guards)
    # One entry per person and field, after counting.
    people = override_actors(landing).groupBy(*KEYS).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("events")).alias("order"), "changed_by", "events"))).alias("people"))
    lead = lead_times(landing).select(*KEYS, F.struct(
        "n", "min_days", "median_days", "max_days", "same_day_or_later").alias("lead"))
    found = _beside(_beside(ranked, people), lead)
    typical = sentence(text.OVERRIDE_WHEN, median="lead.median_days", late="lead.same_day_or_later")
    worded = sentence(text.OVERRIDE, table="entity_table",
                      when=f"CASE WHEN lead IS NULL THEN '' ELSE {typical} END")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'override'", "entity_table", "field"),
        F.lit("any").alias("proposed_type"),
        F.expr(worded).alias("statement"),
        F.to_json(F.struct(
            "entity_table", "field", F.col("rank").alias("rank_by_frequency"), "events",
            F.col("entities").alias("distinct_entities"), F.col("actors").alias("distinct_actors"),
            F.transform("people", lambda p: p.dropFields("order")).alias("actors"),
            stamp("first_seen"), stamp("last_seen"), F.col("lead").alias("lead_time_days")))
        .alias("evidence"),
        F.to_json(F.struct(
            F.col("all_changes").alias("change_rows_total"),
            F.col("events").alias("events_for_this_field"),
            F.lit(guards.min_change_events).alias("min_events_per_field"),
            shown_ratio(F.col("events") / F.col("all_changes")).alias("share_of_all_overrides")))
        .alias("confidence_inputs"))
