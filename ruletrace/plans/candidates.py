"""All probes together, the judging queue, and the files a run leaves."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ruletrace.functions.cells import strip
from ruletrace.functions.clock import with_weekday
from ruletrace.functions.labels import job_label, record_url
from ruletrace.guards import Guards
from ruletrace.plans import bookings, ceilings, overrides, population
from ruletrace.plans.facts import run_facts
from ruletrace.sources.landing import Landing, volumes
from ruletrace.sources.profiles import Profile
from ruletrace.sources.sink import write_ordered

ORDER = ["probe", "proposed_type", "candidate_id"]
PROBES = {
    "p03": (bookings.exclusivity_candidates, bookings.turnaround_candidates),
    "p04": (ceilings.ceiling_candidates,),
    "p05": (population.population_candidates,),
    "p08": (overrides.override_candidates,),
}
VERDICT_COLUMNS = ["candidate_id", "key_id", "verdict", "note"]


def candidates(landing: Landing, guards: Guards = Guards(),
               probes: list[str] | None = None) -> DataFrame:
    """Candidates of the chosen probes, all by default, in a total order. The probes share the facts of the run."""
    landing = run_facts(landing)
    chosen = [probe for name in PROBES if not probes or name in probes for probe in PROBES[name]]
    return reduce(DataFrame.unionByName, [p(landing, guards) for p in chosen]).orderBy(*ORDER)


def per_probe(found: DataFrame) -> DataFrame:
    return found.groupBy("probe").agg(F.count("*").alias("candidates"))


def write_run(landing: Landing, profile: Profile, path: str, guards: Guards = Guards(),
              probes: list[str] | None = None) -> None:
    """Candidates, input volumes and a blank verdict sheet. No clock is read, and candidates and volumes go to files with
    fixed names in a total order, so a rerun on the same input writes the same bytes."""
    named = F.lit(profile.label).alias("profile")
    landing = run_facts(landing)
    found = candidates(landing, guards, probes)
    write_ordered(found.select(named, "*"), [F.col(c) for c in ORDER], f"{path}/candidates")
    write_ordered(volumes(landing).select(named, "*"), [F.col("landing_table")], f"{path}/volumes")
    spark = found.sparkSession
    spark.createDataFrame([{"profile": profile.label, **asdict(guards)}]).write.mode("overwrite").json(f"{path}/guards")
    written = found.sparkSession.read.json(f"{path}/candidates")
    blank = found.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in VERDICT_COLUMNS))
    write_verdicts(verdict_sheet(written, blank), f"{path}/verdicts")


def verdict_sheet(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each candidate with its verdict rows, or one blank row, in candidate order."""
    given = verdicts.filter(F.expr(f"{strip('coalesce(verdict, \'\')')} <> ''"))
    rows = given.select("candidate_id", "key_id", *[F.expr(strip(c)).alias(c) for c in ("verdict", "note")])
    return (found.select(*ORDER).join(rows, "candidate_id", "left").orderBy(*ORDER, "key_id")
            .select(*VERDICT_COLUMNS).fillna(""))


def write_verdicts(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def unjudged(found: DataFrame, verdicts: DataFrame, redo: bool = False) -> DataFrame:
    """Candidates still waiting for a verdict; with ``redo`` all of them."""
    if redo:
        return found
    judged = verdicts.filter(F.expr(f"{strip('coalesce(verdict, \'\')')} <> ''")).select("candidate_id")
    return found.join(judged, "candidate_id", "left_anti")


def names_of_ids(landing: Landing, override_labels: DataFrame | None = None, ordinal: str = "") -> DataFrame:
    """What a person would call each landing id: (id, label), and the number of the table it is from if that is asked for."""
    res = landing.resources.selectExpr(
        "resource_id AS id", "concat(coalesce(name, 'None'), "
        "CASE WHEN kind <> '' THEN concat(' (', kind, ')') ELSE '' END) AS label")
    work_type = "nullif(work_type, '')"
    jobs = landing.work.selectExpr("work_id AS id",
                                   f"{job_label(work_type, 'start_ts')} AS label")
    places = landing.locations.selectExpr("location_id AS id", "coalesce(name, 'None') AS label")
    parts = [res, jobs, places]
    if override_labels is not None:
        parts.append(override_labels.selectExpr("field AS id", "label"))
    if ordinal:
        parts = [p.withColumn(ordinal, F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, parts)


def described(values: DataFrame, names: DataFrame, base: str = "",
              table_ids: dict[str, str] | None = None) -> DataFrame:
    """Evidence values, in column ``value``, with label and link; a plain time gets its weekday."""
    url = record_url("value", base, table_ids or {})
    return (values.join(names, F.col("value") == F.col("id"), "left")
            .withColumn("plain", with_weekday("value"))
            .withColumn("shown", F.expr(f"CASE WHEN label IS NULL THEN plain ELSE concat(label, "
                                        f"coalesce(concat('  ', {url}), concat('  [', value, ']'))) END"))
            .drop("id", "plain"))
