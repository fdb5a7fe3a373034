"""The override vocabulary, and one override opened: its changes, jobs and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ruletrace.functions.clock import days_between
from ruletrace.functions.labels import UNTYPED, source_of
from ruletrace.operators.intervals import sweep, work_overlaps
from ruletrace.plans import days, statements as text
from ruletrace.sources.landing import Landing


def label_counts(landing: Landing) -> DataFrame:
    """Events, jobs, people and first and last day per label, over every change."""
    return landing.changes.groupBy("field").agg(
        F.count("*").alias("events"), F.countDistinct("entity_id").alias("entities"),
        F.countDistinct("changed_by").alias("actors"), F.min("changed_at").alias("first_seen"),
        F.max("changed_at").alias("last_seen"))


def override_list(landing: Landing, labels: DataFrame | None = None,
                  top: int | None = 40) -> DataFrame:
    """The heaviest override labels; ``top=None`` lists them all."""
    rows = label_counts(landing).orderBy(F.desc("events"), F.asc_nulls_last("field"))
    if top is not None:
        rows = rows.limit(top)
    if labels is None:
        return rows.withColumn("label", F.col("field"))
    return (rows.join(labels, "field", "left").withColumn("label", F.coalesce("label", "field"))
            .orderBy(F.desc("events"), F.asc_nulls_last("field")))


def override_tail(landing: Landing, top: int = 40) -> DataFrame:
    """What the list leaves out: labels and their events, against all events. One row."""
    counts = landing.changes.groupBy("field").agg(F.count("*").alias("events"))
    head = counts.orderBy(F.desc("events"), F.asc_nulls_last("field")).limit(top)
    head_labels = head.agg(F.count("*")).scalar()
    head_events = head.agg(F.coalesce(F.sum("events"), F.lit(0))).scalar()
    return counts.agg(
        (F.count("*") - head_labels).alias("labels_left_out"),
        (F.coalesce(F.sum("events"), F.lit(0)) - head_events).alias("events_left_out"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("all_events"))


def field_id(field: str) -> str:
    return field if field.startswith("ovr_") else f"ovr_{field}"


def changes_of(landing: Landing, field: str) -> DataFrame:
    return landing.changes.filter(F.col("field") == field_id(field))


def touched_jobs(landing: Landing, field: str) -> DataFrame:
    """The entities changed under a field, each once."""
    return (changes_of(landing, field).filter("entity_id IS NOT NULL")
            .select(F.col("entity_id").alias("work_id")).distinct())


def change_rows(landing: Landing, field: str) -> DataFrame:
    """Each change with its job and the days between the two."""
    jobs = landing.work.select("work_id", "work_type", "start_ts", "customer_count")
    return (changes_of(landing, field).withColumnRenamed("entity_id", "work_id")
            .join(jobs, "work_id", "left")
            .select("changed_at", F.coalesce("changed_by", F.lit("unknown")).alias("changed_by"),
                    "work_id", F.expr(source_of("work_id", "?")).alias("source"),
                    F.coalesce("work_type", F.lit(UNTYPED)).alias("work_type"), "start_ts",
                    days_between("changed_at", "start_ts").alias("lead_days"),
                    "customer_count", "old_value", "new_value")
            .orderBy("changed_at", "work_id"))


def touched_crew(landing: Landing, field: str) -> DataFrame:
    """Who was on the touched jobs, with the roles of each as one text."""
    on = days.crew(landing, touched_jobs(landing, field))
    # A set of roles is one aggregate; a distinct list holds the rows of a task in two hash maps before it.
    return (on.groupBy("work_id", "resource", "kind").agg(F.array_sort(F.collect_set("role")).alias("_roles"))
            .select("work_id", "resource", "kind", F.when(F.size("_roles") > 0, F.array_join("_roles", ", ")).alias("roles")))


def _touched(landing: Landing, field: str) -> Column:
    """How many jobs the override touched."""
    return touched_jobs(landing, field).agg(F.count("*")).scalar()


def _staffed(landing: Landing) -> Column:
    """How many jobs have any crew."""
    crewed = landing.assignments.filter("work_id IS NOT NULL").select("work_id").distinct()
    return landing.work.join(crewed, "work_id", "left_semi").agg(F.count("*")).scalar()


def kind_lift(landing: Landing, field: str) -> DataFrame:
    """How common each kind of resource is on the touched jobs, against all jobs."""
    kinds = landing.resources.select("resource_id", "kind")
    on = (landing.assignments.select("work_id", "resource_id").join(kinds, "resource_id", "left")
          .select("work_id", F.coalesce("kind", F.lit("?")).alias("kind")))
    touched = touched_jobs(landing, field).withColumn("touched", F.lit(True))
    # One distinct pass gives both counts.
    per_kind = (on.filter("work_id IS NOT NULL").distinct().join(touched, "work_id", "left")
                .groupBy("kind").agg(F.count_if("touched").alias("jobs_here"),
                                     F.count("*").alias("jobs_everywhere")))
    here, everywhere = F.col("share_here"), F.col("share_everywhere")
    return (per_kind.filter("jobs_here > 0")
            .withColumn("share_here", F.col("jobs_here") / _touched(landing, field))
            .withColumn("share_everywhere", F.col("jobs_everywhere") / _staffed(landing))
            .select("kind", "jobs_here", "jobs_everywhere", "share_here", "share_everywhere",
                    ((here >= text.OVERREPRESENTED_TIMES * everywhere)
                     & (here >= text.OVERREPRESENTED_SHARE)).alias("more_common_here")))


def top_resources(landing: Landing, field: str, size: int = 8) -> DataFrame:
    """The resources most often on the touched jobs, with their share of all jobs."""
    pairs = (landing.assignments.filter("work_id IS NOT NULL")
             .select("resource_id", "work_id").distinct())
    touched = touched_jobs(landing, field).withColumn("touched", F.lit(True))
    both = (pairs.join(touched, "work_id", "left").groupBy("resource_id")
            .agg(F.count_if("touched").alias("jobs_here"), F.count("*").alias("jobs_everywhere")))
    people = landing.resources.select("resource_id", "name", "kind")
    return (both.filter("jobs_here > 0").join(people, "resource_id", "left")
            .orderBy(F.desc("jobs_here"), "resource_id").limit(size)
            .select("resource_id", F.coalesce("name", "resource_id").alias("resource"),
                    F.coalesce("kind", F.lit("?")).alias("kind"), "jobs_here", "jobs_everywhere",
                    (F.col("jobs_here") / _touched(landing, field)).alias("share_here"),
                    (F.col("jobs_everywhere") / _staffed(landing)).alias("share_everywhere"))
            .orderBy(F.desc("jobs_here"), "resource_id"))


def jobs_by_source(landing: Landing, field: str) -> DataFrame:
    source = F.expr(source_of("entity_id")).alias("source")
    return changes_of(landing, field).groupBy(source).agg(F.count("*").alias("changes"))


def repeated_jobs(landing: Landing, field: str) -> DataFrame:
    """Jobs changed more than once under the field."""
    again = (changes_of(landing, field).groupBy(F.col("entity_id").alias("work_id"))
             .agg(F.count("*").alias("times")).filter("times > 1"))
    jobs = landing.work.select("work_id", "work_type", "start_ts")
    return (again.join(jobs, "work_id", "left")
            .select("work_id", "times", F.coalesce("work_type", F.lit(UNTYPED)).alias("work_type"),
                    "start_ts").orderBy(F.desc("times"), "work_id"))


def overlap_rate(landing: Landing, field: str) -> DataFrame:
    """Jobs holding a resource that is also on an overlapping job: touched ones against all.

    One sweep over the assignments names every job with crew, and whether it overlaps; it meets the touched jobs and the
    table of jobs once.
    """
    crewed = work_overlaps(sweep(landing.assignments)).select("work_id", (F.col("overlaps") > 0).alias("overlapping"))
    touched = touched_jobs(landing, field).withColumn("touched", F.lit(True))
    known = landing.work.select("work_id").distinct().withColumn("known", F.lit(True))
    both = crewed.join(touched, "work_id", "full").join(known, "work_id", "left")
    return (both.agg(F.count_if(F.col("touched") & F.col("overlapping")).alias("overlap_here"),
                     F.count_if("overlapping").alias("overlap_everywhere"), F.count_if("touched").alias("touched_jobs"),
                     F.count_if(F.col("known") & F.col("overlapping").isNotNull()).alias("all_jobs"))
            .withColumn("share_here", F.col("overlap_here") / F.col("touched_jobs"))
            .withColumn("share_everywhere", F.col("overlap_everywhere") / F.col("all_jobs")))
