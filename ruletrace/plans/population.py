"""Fields filled in for one kind of job and never for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ruletrace.functions.labels import BLANK, candidate_id, quoted, sentence, shown_ratio
from ruletrace.guards import Guards
from ruletrace.plans import statements as text
from ruletrace.sources.landing import Landing

PROBE = "p05"


def fill_counts(landing: Landing) -> DataFrame:
    """(partition, value, field, rows, filled, rows_in_work, populated) for every pair.

    One scan serves all fifteen pairs: the partition columns are unpivoted and counted
    map-side, and each partition covers all rows, so the table totals are sums of its rows.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(p).alias("partition"),
                 F.coalesce(F.col(p).cast("string"), F.lit(BLANK)).alias("value"))
        for p in text.FILL_PARTITIONS])).alias("p")
    per_value = (landing.work.select(*text.FILL_FIELDS, values)
                 .groupBy("p.partition", "p.value")
                 .agg(F.count("*").alias("rows"), *[F.count(f).alias(f) for f in text.FILL_FIELDS]))
    long = (per_value.unpivot(["partition", "value", "rows"], list(text.FILL_FIELDS),
                              "field", "filled")
            .filter("field <> partition"))
    totals = (long.groupBy("partition", "field")
              .agg(F.sum("rows").alias("rows_in_work"), F.sum("filled").alias("populated")))
    return long.join(totals, ["partition", "field"])   # fifteen rows on the right


def fill_rates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Fill rate of each field in each partition value big enough to say something."""
    return (fill_counts(landing)
            .filter((F.col("populated") >= guards.min_populated_rows_per_field)
                    & (F.col("rows") >= guards.min_instances_per_work_type))
            .withColumn("fill_rate", F.col("filled") / F.col("rows")))


def sharpest_pairs(rates: DataFrame) -> DataFrame:
    """Per (field, partition), the fullest value against the emptiest one.

    A tie goes to the value with more rows, then to the first one. The picks are aggregates,
    so a partition with very many values is reduced map-side.
    """
    row = F.struct("value", "rows", "filled", "fill_rate")
    high, low = F.col("fill_rate") >= text.HIGH_FILL, F.col("fill_rate") <= text.LOW_FILL
    fullest = F.struct(-F.col("fill_rate"), -F.col("rows"), F.col("value"))
    emptiest = F.struct(F.col("fill_rate"), -F.col("rows"), F.col("value"))
    return (rates.groupBy("field", "partition")
            .agg(F.min_by(row, F.when(high, fullest)).alias("high"),
                 F.min_by(row, F.when(low, emptiest)).alias("low"),
                 F.count_if(high).alias("_high"), F.count_if(low).alias("_low"),
                 F.count("*").alias("partitions_over_row_floor"),
                 F.max("rows_in_work").alias("rows_in_work"),
                 F.max("populated").alias("populated"))
            .filter("_high > 0 AND _low > 0 AND partitions_over_row_floor >= 2")
            .drop("_high", "_low"))


def population(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """The sharpest pairs as flat columns."""
    parts = [F.col(f"{side}.{name}").alias(f"{side}_{name}")
             for side in ("high", "low") for name in ("value", "rows", "filled", "fill_rate")]
    return sharpest_pairs(fill_rates(landing, guards)).select(
        "field", "partition", *parts, "partitions_over_row_floor", "rows_in_work", "populated")


def _slots(side: str) -> dict[str, str]:
    return {side: quoted(f"{side}.value"), f"{side}_rows": f"{side}.rows",
            f"{side}_filled": f"{side}.filled"}


def _rounded(side: Column, *names: str) -> list[Column]:
    return [side[n].alias(n) for n in names] + [shown_ratio(side["fill_rate"]).alias("fill_rate")]


def population_candidates(landing: Landing, guards: Guards = Guards()) -> DataFrame:
    """Two readings of each pair: required in one case, or the other case exempt."""
    rates = fill_rates(landing, guards)
    # After counting, one entry per partition value above the row floor.
    every = rates.groupBy("field", "partition").agg(F.array_sort(F.collect_list(
        F.struct("value", "rows", "filled", shown_ratio("fill_rate").alias("fill_rate"))))
        .alias("all_partitions"))
    found = sharpest_pairs(rates).join(every, ["field", "partition"])
    high, low = F.col("high"), F.col("low")
    volumes = [F.col("rows_in_work"), F.col("populated").alias("rows_with_this_field_populated")]
    floor = F.lit(guards.min_instances_per_work_type).alias("min_partition_rows")
    required = found.select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'population'", "field", "'by'", "partition"),
        F.lit("dependency").alias("proposed_type"),
        F.expr(sentence(text.DEPENDENCY, **_slots("high"), **_slots("low"))).alias("statement"),
        F.to_json(F.struct(
            "field", "partition",
            F.struct(*_rounded(high, "value", "rows", "filled")).alias("required_in"),
            F.struct(*_rounded(low, "value", "rows", "filled")).alias("absent_in"),
            "all_partitions", F.lit(text.HIGH_FILL).alias("high_threshold"),
            F.lit(text.LOW_FILL).alias("low_threshold"))).alias("evidence"),
        F.to_json(F.struct(
            *volumes, "partitions_over_row_floor", floor,
            F.lit(guards.min_populated_rows_per_field).alias("min_populated_rows_per_field")))
        .alias("confidence_inputs"))
    exempt = found.select(
        F.lit(PROBE).alias("probe"),
        candidate_id(PROBE, "'exemption'", "field", "'by'", "partition", "low.value"),
        F.lit("exemption").alias("proposed_type"),
        F.expr(sentence(text.EXEMPTION, **_slots("low"))).alias("statement"),
        F.to_json(F.struct("field", "partition", low["value"].alias("partition_value"),
                           *_rounded(low, "rows", "filled"))).alias("evidence"),
        F.to_json(F.struct(*volumes, low["rows"].alias("rows_in_this_partition"), floor))
        .alias("confidence_inputs"))
    return required.unionByName(exempt)
