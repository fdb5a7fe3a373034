"""The six landing tables every plan reads."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruletrace.session import settled
from ruletrace.sources.files import path_exists, read_text, remove, replace_text

STAMP = "source_system string, source_id string, extracted_at timestamp_ntz"

SCHEMAS = {
    "work": "work_id string, work_type string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
            f"location_id string, status string, customer_count int, {STAMP}",
    "resources": "resource_id string, kind string, name string, home_location_id string, "
                 f"active_from date, active_to date, {STAMP}",
    "assignments": "assignment_id string, resource_id string, work_id string, role string, "
                   f"start_ts timestamp_ntz, end_ts timestamp_ntz, {STAMP}",
    "locations": "location_id string, name string",
    "location_travel": "from_id string, to_id string, minutes int, is_estimate boolean",
    "changes": "change_id string, entity_table string, entity_id string, field string, "
               "old_value string, new_value string, changed_at timestamp_ntz, "
               f"changed_by string, {STAMP}",
}

TABLES = tuple(SCHEMAS)
PRIMARY_KEYS = {"work": "work_id", "resources": "resource_id", "assignments": "assignment_id",
                "locations": "location_id", "changes": "change_id"}


class Landing:
    """The tables by name. A table given as a function is set up when a plan asks for it."""

    work: DataFrame
    resources: DataFrame
    assignments: DataFrame
    locations: DataFrame
    location_travel: DataFrame
    changes: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def replaced(self, **tables: DataFrame | Callable[[], DataFrame]) -> Landing:
        return Landing(**{**self._tables, **tables})


def types_of(table: str) -> dict[str, str]:
    return dict(part.strip().split(" ") for part in SCHEMAS[table].split(","))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; a column the frame lacks becomes null."""
    has = set(df.columns)
    return df.selectExpr(*[f"CAST({name if name in has else 'NULL'} AS {kind}) AS {name}"
                           for name, kind in types_of(table).items()])


CURRENT = "current.json"


def loads(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published loads under ``path``, the newest first."""
    noted = f"{path}/{CURRENT}"
    return json.loads(read_text(spark, noted))["loads"] if path_exists(spark, noted) else []


def write_landing(landing: Landing, path: str, keep: int = 2) -> None:
    """Write the six tables to a folder of their own below ``path``, then publish them as one.

    What readers are shown is named by one small file that is replaced last, in one step. A load that fails leaves the
    one before as it was. ``keep`` loads stay, for readers that are still on the one before.
    """
    spark = landing.work.sparkSession
    before, load = loads(spark, path), f"load-{uuid4().hex}"
    try:
        for name, df in landing.tables().items():
            df.write.parquet(f"{path}/{load}/{name}")
    except BaseException:
        remove(spark, f"{path}/{load}")
        raise
    kept = [load, *before][:max(1, keep)]
    replace_text(spark, f"{path}/{CURRENT}", json.dumps({"loads": kept}))
    for old in {load, *before} - set(kept):
        remove(spark, f"{path}/{old}")


def read_landing(spark: SparkSession, path: str) -> Landing:
    """The landing tables of the last published load, or those of a folder that holds just tables."""
    published = loads(spark, path)
    folder = f"{path}/{published[0]}" if published else path
    return Landing(**{t: spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}") for t in TABLES})


def volumes(landing: Landing) -> DataFrame:
    """Row count of each landing table."""
    counts = [df.agg(F.count("*").alias("rows")).selectExpr(f"'{name}' AS landing_table", "rows")
              for name, df in landing.tables().items()]
    return reduce(DataFrame.unionByName, counts)


def repeated_keys(landing: Landing, *tables: str) -> DataFrame:
    """Primary key values that occur more than once, in the named tables or all; empty for sound ones.

    Nearly all keys are unique, so counts go by a hash of the key, which takes a fraction of the memory; only keys whose
    hash occurs again are then counted by themselves.
    """
    keys = reduce(DataFrame.unionByName, [
        getattr(landing, t).select(F.lit(t).alias("landing_table"), F.col(key).alias("key"))
        for t, key in PRIMARY_KEYS.items() if not tables or t in tables])
    keys = keys.withColumn("_hash", F.xxhash64("landing_table", "key"))
    again = keys.groupBy(F.col("_hash").alias("_of")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_of")
    again = settled(again, "again")  # few for sound tables, and their size is known
    return (keys.join(again, F.col("_hash") == F.col("_of"), "left_semi").groupBy("_hash", "landing_table", "key")
            .agg(F.count("*").alias("rows")).filter("rows > 1").select("landing_table", "key", "rows"))
