"""How much of a decision its messages still show.

The event sheet has one row per decision: event_id, four 0/1 flags, confidence and
recurring_kind. The volume table has one row per channel: channel, kind, human,
operational, automation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FLAGS = ("entity_recoverable", "rule_recoverable", "actor_recoverable", "lead_time_recoverable")


def recoverability(sheet: DataFrame, operational: DataFrame) -> DataFrame:
    """One row: percent of events with each field, and events per 100 operational messages.

    ``operational`` is one number, a frame of one row and one column.
    """
    messages = operational.scalar()
    shares = [(F.avg(f) * 100).alias(f.removesuffix("_recoverable")) for f in FLAGS]
    return (sheet.agg(F.count("*").alias("events"),
                      F.count_if(F.col("confidence") == "high").alias("high"),
                      F.count_if(F.col("confidence") == "medium").alias("medium"),
                      F.count_if(F.col("confidence") == "low").alias("low"), *shares)
            .withColumn("messages", messages)
            .withColumn("high_per_100", F.col("high") * 100 / F.col("messages"))
            .withColumn("all_per_100", F.col("events") * 100 / F.col("messages")))


def pass_gap(first: DataFrame, second: DataFrame, base: DataFrame) -> DataFrame:
    """Two recoverability rows side by side as (measure, first, second, gap).

    ``base`` is one number: the message count of the first pass, against which the high
    events of both are set once more as ``high_per_100_base``.
    """
    names = ["messages", "events", "high", "high_per_100", "all_per_100",
             *[f.removesuffix("_recoverable") for f in FLAGS], "high_per_100_base"]

    def long(df: DataFrame, value: str) -> DataFrame:
        on_base = df.withColumn("high_per_100_base", F.col("high") * 100 / base.scalar())
        return (on_base.select(*[F.col(n).cast("double").alias(n) for n in names])
                .unpivot([], names, "measure", value))

    return (long(first, "first").join(long(second, "second"), "measure")
            .withColumn("gap", F.col("second") - F.col("first")))


def recurring_kinds(sheet: DataFrame) -> DataFrame:
    return sheet.groupBy("recurring_kind").agg(F.count("*").alias("count"))


def volume_rollup(volume: DataFrame) -> DataFrame:
    """Volumes by channel with a subtotal per kind and a grand total, in one pass."""
    return (volume.rollup("kind", "channel")
            .agg(F.sum("human").alias("human"), F.sum("operational").alias("operational"),
                 F.sum("automation").alias("automation"),
                 F.countDistinct("channel").alias("channels"),
                 F.grouping_id().alias("_level"))
            .withColumn("level", F.when(F.col("_level") == 0, F.lit("channel"))
                        .when(F.col("_level") == 1, F.lit("kind")).otherwise(F.lit("total")))
            .drop("_level"))


def lead_band(hours: Column) -> Column:
    """How long before the job a decision fell. Between two and three days belongs to no
    published band; it goes to the middle one."""
    return (F.when(hours.isNull(), F.lit("n/a")).when(hours < 6, F.lit("under 6 hours"))
            .when(hours < 72, F.lit("6 hours to 2 days")).otherwise(F.lit("3 days or more")))


def lead_bands(events: DataFrame) -> DataFrame:
    """Events per band of ``lead_hours``."""
    return events.groupBy(lead_band(F.col("lead_hours")).alias("band")).agg(
        F.count("*").alias("events"))
