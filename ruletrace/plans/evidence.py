"""What stands behind each candidate, as typed rows keyed by candidate_id.

The JSON documents of the candidates hold the same entries; here each entry is a row, so a value list
of any length stays spread and can be compared, joined and checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ruletrace.functions.labels import candidate_id
from ruletrace.guards import Guards
from ruletrace.operators.distribution import histogram
from ruletrace.plans import bookings, ceilings, overrides, population
from ruletrace.plans import candidates, statements as text
from ruletrace.plans.facts import facts, run_facts
from ruletrace.session import settled
from ruletrace.sources.landing import Landing


def _rounded(name: str) -> Column:
    """Ratios are shown with four digits."""
    return F.bround(name, 4).alias(name.rpartition(".")[2])


def exclusivity(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Pairs, resources with a pair and volumes of every kind; a kind without any pair is a finding too."""
    return bookings.exclusivity(landing, guards).select(
        candidate_id(bookings.PROBE, "'exclusivity'", "kind"), "overlapping_pairs", "resources_with_an_overlap",
        "assignments_over_floor", "resources_over_floor", "resources_total",
        F.when(F.col("overlapping_pairs") > 0, "sometimes").otherwise("never").alias("overlap"))


def overlap_examples(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    return bookings.overlap_examples(landing, guards).select(
        candidate_id(bookings.PROBE, "'exclusivity'", "kind"), "position", "resource_id", "work_id_a", "work_id_b",
        "a_start", "a_end", "b_start", "b_end")


def turnaround(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Hard and soft floors with what lies below them."""
    return bookings.turnaround(landing, guards).select(
        candidate_id(bookings.PROBE, "'turnaround'", "kind"), F.col("edge").alias("proposed_minimum_minutes"), "floor",
        F.col("below").alias("gaps_below_the_edge"), F.col("least").alias("observed_min_gap"),
        F.col("upper_median").alias("observed_median_gap"), F.col("observations").alias("consecutive_pairs"),
        "resources_contributing")


def gap_bins(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """The first bins of the gap histogram of each turnaround candidate."""
    counts = bookings.gap_counts(facts(landing), guards.min_assignments_per_resource)  # read three times
    found = bookings._floors(counts, guards).select("kind")
    return histogram(counts, ["kind"], "gap_minutes", text.GAP_BIN_MINUTES, text.GAP_HEAD_BINS).join(found, "kind").select(
        candidate_id(bookings.PROBE, "'turnaround'", "kind"), "edge", "n")


def ceiling(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Cliffs and tapers with the counts at the edge."""
    return ceilings.ceilings(landing, guards).select(
        candidate_id(ceilings.PROBE, "'ceiling'", "dimension"), "observed_max", "shape", "count_at_max",
        "count_below_max", _rounded("share_at_max"), _rounded("max_over_peak"), "observations", "distinct_values")


def ceiling_values(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """How often each count occurs, for the dimensions that became candidates."""
    counts = reduce(DataFrame.unionByName, [ceilings.distribution(landing, d) for d in ceilings.DIMENSIONS])
    enough = counts.groupBy("dimension").agg(F.sum("n").alias("observations")) \
        .filter(F.col("observations") >= guards.min_observations).select("dimension")
    return counts.join(enough, "dimension").select(
        candidate_id(ceilings.PROBE, "'ceiling'", "dimension"), F.col("v").alias("value"), F.col("n").alias("count"))


def _pairs(landing: Landing, guards: Guards) -> DataFrame:
    return population.population(landing, guards).withColumn(
        "required_id", candidate_id(population.PROBE, "'population'", "field", "'by'", "partition")).withColumn(
        "exempt_id", candidate_id(population.PROBE, "'exemption'", "field", "'by'", "partition", "low_value"))


def fill(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Both readings of each sharp pair: required in the one case, or exempt in the other."""
    pairs, out = _pairs(landing, guards), []
    for reading in ("required", "exempt"):
        out.append(pairs.select(
            F.col(f"{reading}_id").alias("candidate_id"), "field", "partition", "high_value", "high_rows", "high_filled",
            _rounded("high_fill_rate"), "low_value", "low_rows", "low_filled", _rounded("low_fill_rate"),
            "partitions_over_row_floor", "rows_in_work", "populated"))
    return out[0].unionByName(out[1])


def fill_values(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """The fill rate of every partition value over the row floor, for each field that became a candidate."""
    found = _pairs(landing, guards).select(F.col("required_id").alias("candidate_id"), "field", "partition")
    return population.fill_rates(landing, guards).join(found, ["field", "partition"]).select(
        "candidate_id", "value", "rows", "filled", _rounded("fill_rate"))


def override(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Frequency, people and lead times of each overridden field."""
    ranked = overrides.override_rank(landing, guards).withColumn(
        "share_of_all_overrides", F.col("events") / F.col("all_changes"))
    return overrides._beside(ranked, overrides.lead_times(landing)).select(
        candidate_id(overrides.PROBE, "'override'", "entity_table", "field"),
        F.col("rank").cast("bigint").alias("rank_by_frequency"), "events", "entities", "actors", "first_seen", "last_seen",
        "all_changes", _rounded("share_of_all_overrides"), "n", "min_days", "median_days", "max_days", "same_day_or_later")


def override_people(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Who overrode each field how often, the unrecorded included."""
    ranked = overrides.override_rank(landing, guards).select(*overrides.KEYS)
    people = overrides.override_actors(landing).withColumnRenamed("events", "times")
    return overrides._beside(ranked, people).select(
        candidate_id(overrides.PROBE, "'override'", "entity_table", "field"), "changed_by", F.col("times").alias("events"))


# Values of evidence that a person may know under another name: what each is taken from, its list, and its parts.
EXAMPLE_PARTS = ("resource_id", "work_id_a", "work_id_b", "a_start", "a_end", "b_start", "b_end")


def shown_values(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Every id, label and time in the evidence of all probes, as (candidate_id, list, position, part, value).

    ``position`` counts the examples; entries of other lists are told apart by their value.
    """
    landing = run_facts(landing)
    nowhere = F.lit(None).cast("int").alias("position")
    examples = overlap_examples(landing, guards)
    parts = [F.struct(F.lit(p).alias("part"), (F.date_format(p, "yyyy-MM-dd HH:mm:ss") if p[1] == "_" else F.col(p)).alias("value"))
             for p in EXAMPLE_PARTS]
    out = [examples.select("candidate_id", F.lit("examples").alias("list"), "position", F.explode(F.array(*parts)).alias("_p"))
           .select("candidate_id", "list", "position", "_p.part", "_p.value"),
           fill_values(landing, guards).select("candidate_id", F.lit("all_partitions").alias("list"), nowhere,
                                               F.lit("value").alias("part"), "value"),
           override_people(landing, guards).select("candidate_id", F.lit("actors").alias("list"), nowhere,
                                                   F.lit("changed_by").alias("part"), F.col("changed_by").alias("value")),
           overrides.override_rank(landing, guards).select(
               candidate_id(overrides.PROBE, "'override'", "entity_table", "field"), F.lit("field").alias("list"), nowhere,
               F.lit("field").alias("part"), F.col("field").alias("value"))]
    return reduce(DataFrame.unionByName, out)


def names(landing: Landing, guards: Guards = Guards(), override_labels: DataFrame | None = None, base: str = "",
          table_ids: dict[str, str] | None = None) -> DataFrame:
    """``shown_values`` with what a person reads: label, weekday or link, by one join for all probes.

    Only names that the evidence asks for are looked up; an id that several tables know goes by the last of them, the
    override labels before all.
    """
    landing = run_facts(landing)
    values = settled(shown_values(landing, guards), "shown")
    known = candidates.names_of_ids(landing, override_labels, ordinal="_nth")
    asked = known.join(values.select(F.col("value").alias("id")).distinct(), "id", "left_semi")
    last = asked.groupBy("id").agg(F.max_by("label", "_nth").alias("label"))
    return candidates.described(values, last, base, table_ids)
