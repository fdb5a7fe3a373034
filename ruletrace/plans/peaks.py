"""The rows behind the top of a ceiling: which days, places, people or jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.functions.clock import weekday_minute
from ruletrace.functions.labels import UNTYPED
from ruletrace.sources.landing import Landing

def _job() -> Column:
    return F.expr(f"concat(coalesce(work_type, '{UNTYPED}'), '  ', "
                  f"coalesce({weekday_minute('start_ts')}, 'no start'))")


def _type() -> Column:
    return F.coalesce("work_type", F.lit(UNTYPED))


def _placed(landing: Landing) -> DataFrame:
    names = landing.locations.select("location_id", F.col("name").alias("place"))
    return (landing.work.filter("start_ts IS NOT NULL AND location_id IS NOT NULL")
            .join(names, "location_id", "left")
            .withColumn("place", F.coalesce("place", "location_id")))


def _crewed(landing: Landing) -> DataFrame:
    people = landing.resources.select("resource_id", "kind", F.col("name").alias("resource"))
    return (landing.assignments.join(people, "resource_id", "left")
            .withColumn("resource", F.coalesce("resource", "resource_id"))
            .withColumn("kind", F.coalesce("kind", F.lit("unknown"))))


def _top(groups: DataFrame, size: int) -> DataFrame:
    """The first groups by count, numbered; ties by label, then by whatever else tells groups apart."""
    rest = [c for c in groups.columns if c not in ("grp", "n")]
    order = [F.desc_nulls_last("n"), F.asc_nulls_last("grp"), *[F.asc_nulls_last(c) for c in rest]]
    # The window has the ``size`` rows that are left.
    return groups.orderBy(*order).limit(size).withColumn(
        "position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_groups(landing: Landing, dimension: str, size: int = 5) -> DataFrame:
    """(grp, n, position) of the top groups, with the columns that identify a group."""
    work = landing.work
    if dimension == "work_per_day":
        groups = (work.filter("start_ts IS NOT NULL").groupBy(F.to_date("start_ts").alias("day"))
                  .agg(F.count("*").alias("n")).withColumn("grp", F.col("day").cast("string")))
    elif dimension == "work_per_location_per_day":
        groups = (_placed(landing).groupBy("place", F.to_date("start_ts").alias("day"))
                  .agg(F.count("*").alias("n"))
                  .withColumn("grp", F.concat("place", F.lit("  "), F.col("day").cast("string"))))
    elif dimension == "work_per_resource_per_day":
        # Same-named resources of a kind fall together, as they do for a reader.
        groups = (_crewed(landing).filter("start_ts IS NOT NULL")
                  .groupBy("resource", "kind", F.to_date("start_ts").alias("day"))
                  .agg(F.countDistinct("work_id").alias("n"))
                  .withColumn("grp", F.concat("resource", F.lit("  ("), "kind", F.lit(")  "),
                                              F.date_format("day", "EEE yyyy-MM-dd"))))
    elif dimension == "customers_per_work":
        groups = work.filter("customer_count IS NOT NULL").select(
            _job().alias("grp"), F.col("customer_count").cast("bigint").alias("n"), "work_id")
    elif dimension == "resources_per_work":
        counts = (landing.assignments.filter("work_id IS NOT NULL").groupBy("work_id")
                  .agg(F.countDistinct("resource_id").alias("n")))
        named = work.select("work_id", _job().alias("grp"))
        groups = counts.join(named, "work_id")
    else:
        raise ValueError(f"unknown dimension {dimension!r}")
    return _top(groups, size)


def peak_rows(landing: Landing, dimension: str, size: int = 5) -> DataFrame:
    """Every row behind the top groups, as (grp, n, position, item, at, id)."""
    # As many rows as were asked for, so it is broadcast by construction.
    top = F.broadcast(top_groups(landing, dimension, size))
    at = F.col("start_ts").alias("at")
    if dimension == "work_per_day":
        rows = landing.work.withColumn("day", F.to_date("start_ts"))
        return rows.join(top, "day").select("grp", "n", "position", _type().alias("item"), at,
                                            F.col("work_id").alias("id"))
    if dimension == "work_per_location_per_day":
        rows = _placed(landing).withColumn("day", F.to_date("start_ts"))
        return rows.join(top, ["place", "day"]).select("grp", "n", "position", _type().alias("item"), at,
                                                       F.col("work_id").alias("id"))
    if dimension == "work_per_resource_per_day":
        rows = (_crewed(landing).withColumn("day", F.to_date("start_ts"))
                .join(top, ["resource", "kind", "day"])
                .join(landing.work.select("work_id", "work_type"), "work_id", "left"))
        item = F.concat(_type(), F.lit(" "),
                        F.coalesce(F.date_format("start_ts", "HH:mm"), F.lit("")),
                        F.lit(" as "), "role")
        return rows.select("grp", "n", "position", item.alias("item"), at, F.col("work_id").alias("id"))
    if dimension == "customers_per_work":
        rows = landing.work.select("work_id", "start_ts").join(top, "work_id")
        return rows.select("grp", "n", "position", F.col("work_id").alias("item"), at,
                           F.col("work_id").alias("id"))
    rows = _crewed(landing).join(top, "work_id")
    return rows.select("grp", "n", "position", F.col("resource").alias("item"), at, F.col("work_id").alias("id"))


def peaks(landing: Landing, dimension: str, size: int = 5) -> DataFrame:
    """What is in the top groups: each different item once, with how often it occurs, as
    (grp, n, position, item, times)."""
    return peak_rows(landing, dimension, size).groupBy("grp", "n", "position", "item").agg(
        F.count("*").alias("times"))
