"""Ceilings: do counts pile up at their greatest value, or thin out towards it?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ruletrace.functions.labels import candidate_id, sentence, shown_ratio
from ruletrace.guards import Guards
from ruletrace.operators.distribution import counted, right_edge
from ruletrace.plans import statements as text
from ruletrace.plans.facts import Facts
from ruletrace.session import settled
from ruletrace.sources.landing import Landing

PROBE = "p04"
DIMENSIONS = tuple(text.CEILING_PHRASES)


def measured(landing: Landing, dimension: str) -> DataFrame:
    """One row per thing counted, with its count in ``v``."""
    work, assignments = landing.work, landing.assignments
    if dimension == "customers_per_work":
        return work.filter("customer_count IS NOT NULL").select(
            F.col("customer_count").cast("bigint").alias("v"))
    if dimension == "resources_per_work":
        return (assignments.filter("work_id IS NOT NULL").groupBy("work_id")
                .agg(F.countDistinct("resource_id").alias("v")))
    if dimension == "work_per_day":
        return (work.filter("start_ts IS NOT NULL").groupBy(F.to_date("start_ts").alias("d"))
                .agg(F.count("*").alias("v")))
    if dimension == "work_per_resource_per_day":
        return (assignments.filter("start_ts IS NOT NULL")
                .groupBy("resource_id", F.to_date("start_ts").alias("d"))
                .agg(F.countDistinct("work_id").alias("v")))
    if dimension == "work_per_location_per_day":
        return (work.filter("start_ts IS NOT NULL AND location_id IS NOT NULL")
                .groupBy("location_id", F.to_date("start_ts").alias("d"))
                .agg(F.count("*").alias("v")))
    raise ValueError(f"unknown dimension {dimension!r}. Known: {', '.join(sorted(DIMENSIONS))}")


def distribution(landing: Landing, dimension: str) -> DataFrame:
    """How many things have each count, as (dimension, v, n)."""
    if isinstance(landing, Facts):
        return landing.once(f"ceiling-{dimension}", lambda: settled(_distribution(landing, dimension), dimension))
    return _distribution(landing, dimension)


def _distribution(landing: Landing, dimension: str) -> DataFrame:
    counts = counted(measured(landing, dimension).select("v"), [], "v")
    return counts.select(F.lit(dimension).alias("dimension"), "v", "n")


def ceilings(landing: Landing, guards: Guards = Guards(),
             dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The shape of the right edge of each dimension with enough observations."""
    counts = reduce(DataFrame.unionByName, [distribution(landing, d) for d in dimensions])
    return _shapes(counts, guards)


def _shapes(counts: DataFrame, guards: Guards) -> DataFrame:
    return (right_edge(counts, ["dimension"], "v", text.CLIFF_RATIO)
            .filter(F.col("observations") >= guards.min_observations))


def ceiling_candidates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    counts = reduce(DataFrame.unionByName, [distribution(landing, d) for d in DIMENSIONS])
    # One entry per distinct count, after counting: the length of this list is the number of
    # different values a dimension takes, not the number of rows.
    listed = counts.groupBy("dimension").agg(F.array_sort(F.collect_list(
        F.struct(F.col("v").alias("value"), F.col("n").alias("count")))).alias("distribution"))
    phrase = " ".join(f"WHEN '{d}' THEN '{p}'" for d, p in text.CEILING_PHRASES.items())
    slots = dict(phrase=f"CASE dimension {phrase} END", top="observed_max", at_max="count_at_max")
    worded = F.expr(f"CASE shape WHEN 'cliff' THEN {sentence(text.CEILING_CLIFF, **slots)} "
                    f"ELSE {sentence(text.CEILING_TAPER, **slots)} END")
    return _shapes(counts, guards).join(listed, "dimension").select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'ceiling'", "dimension"),
        F.lit("capacity").alias("proposed_type"), worded.alias("statement"),
        F.to_json(F.struct(
            "dimension", "observed_max", "shape", "count_at_max",
            F.col("count_below_max").alias("count_one_below_max"),
            shown_ratio("share_at_max").alias("share_at_max"),
            shown_ratio("max_over_peak").alias("max_over_busiest_value"),
            F.lit(text.CLIFF_RATIO).alias("cliff_ratio_used"), "distribution")).alias("evidence"),
        F.to_json(F.struct("observations", "distinct_values",
                           F.lit(guards.min_observations).alias("min_observations")))
        .alias("confidence_inputs"))
