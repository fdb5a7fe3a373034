"""Every job of one day with its crew."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ruletrace.functions.clock import within_day
from ruletrace.functions.labels import UNTYPED
from ruletrace.sources.landing import Landing


def jobs_on(landing: Landing, date: str) -> DataFrame:
    places = landing.locations.select("location_id", F.col("name").alias("place"))
    return (landing.work.filter(within_day("start_ts", date))
            .join(places, "location_id", "left")
            .select("work_id", F.coalesce("work_type", F.lit(UNTYPED)).alias("work_type"),
                    "start_ts", "end_ts", "customer_count", "status",
                    F.coalesce("place", F.lit("")).alias("place")))


def crew(landing: Landing, jobs: DataFrame) -> DataFrame:
    """Who is booked on which of the jobs. ``jobs`` holds each work_id once."""
    people = landing.resources.select("resource_id", F.col("name").alias("resource"), "kind")
    return (landing.assignments.select("work_id", "resource_id", "role")
            .join(jobs.select("work_id"), "work_id", "left_semi")
            .join(people, "resource_id", "left")
            .select("work_id", F.coalesce("resource", "resource_id").alias("resource"),
                    F.coalesce("kind", F.lit("?")).alias("kind"), "role"))


def day_sheet(landing: Landing, date: str) -> DataFrame:
    """One row per job and crew member; a job nobody is on keeps one row with nulls."""
    jobs = jobs_on(landing, date)
    return (jobs.join(crew(landing, jobs), "work_id", "left")
            .orderBy("start_ts", "work_id", "resource", "role"))
