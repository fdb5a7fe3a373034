"""Read exported source tables as rows of text cells.

A table is ``<name>.csv`` or else ``<name>.json``, a file or a folder of part files. JSON is a
list of records, ``{"records": [...]}``, or one record per line, all of which are split among tasks, and a record may keep its cells
under ``fields`` or ``cellValuesByFieldId``. Nested cells stay JSON text, so CSV and JSON exports
meet the same cell functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ruletrace.sources.files import file_system, path_exists
from ruletrace.sources.json_records import records
from ruletrace.sources.mapping import ID_COLUMNS

ENVELOPES = ("fields", "cellValuesByFieldId")


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what an export folder holds."""
    fs, target = file_system(spark, folder)
    if not fs.exists(target):
        raise FileNotFoundError(f"Export directory not found: {folder}")
    return sorted(s.getPath().getName() for s in fs.listStatus(target)
                  if not s.getPath().getName().startswith(("_", ".")))


def table_path(spark: SparkSession, folder: str, table: str) -> tuple[str, str] | None:
    """(format, path) of a source table, or None when the export lacks it."""
    for kind in ("csv", "json"):
        path = f"{folder}/{table}.{kind}"
        if path_exists(spark, path):
            return kind, path
    return None


def _csv(spark: SparkSession, path: str) -> DataFrame:
    # Override logs are quoted cells of several lines. A part file whose header names other columns, or
    # the same in another order, stops the load: its cells must not be read by position.
    return (spark.read.option("header", True).option("multiLine", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").option("escape", '"').csv(path))


def _is_json_lines(spark: SparkSession, path: str) -> bool:
    """One record per line? Two lines tell; of a list on one line only the two ends are looked at."""
    head = spark.read.text(path).filter(F.trim("value") != "").select(
        F.concat(F.substring(F.ltrim("value"), 1, 2), F.right(F.rtrim("value"), F.lit(2)))).limit(2).collect()
    return len(head) == 2 and all(t.startswith("{") and t.endswith("}") and len(t) > 2 for (t,) in head)


def _cell(name: str, envelope: Column) -> Column:
    path = '$["' + name.replace('"', '\\"') + '"]'
    inside = F.coalesce(F.try_variant_get(envelope, path, "string"),
                        F.to_json(F.try_variant_get(envelope, path, "variant")))
    return F.when(envelope.isNull(), F.col(f"rec.`{name}`")).otherwise(inside).alias(name)


CARRIED = "_carried"


def _json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    # Typed as text, a nested value arrives as its JSON source.
    flat = T.StructType([T.StructField(c, T.StringType())
                         for c in dict.fromkeys([*ID_COLUMNS, *columns, *ENVELOPES])])
    raw = (spark.read.text(path).filter(F.trim("value") != "") if _is_json_lines(spark, path) else records(spark, path))
    # A record cut off or otherwise malformed stops the load; it must not vanish.
    rec = raw.select("value", F.from_json("value", flat, {"mode": "FAILFAST"}).alias("rec"))
    inner = F.coalesce(*[F.col(f"rec.{e}") for e in ENVELOPES])
    keys = F.array_union(*[F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")) for c in (F.col("value"), inner)])
    return (rec.withColumn("_envelope", F.try_parse_json(inner))
            .select(*[F.col(f"rec.`{c}`").alias(c) for c in ID_COLUMNS],
                    *[_cell(c, F.col("_envelope")) for c in columns if c not in ID_COLUMNS],
                    F.array_except(keys, F.array(*map(F.lit, ENVELOPES))).alias(CARRIED)))


def carried_columns(rows: DataFrame) -> set[str]:
    """Every column some record of the table carries, of rows read with the names that each of them carries.

    Exports leave out a field whose cell is empty, so presence is judged over all records.
    """
    return {r[0] for r in rows.select(F.explode(CARRIED)).distinct().collect()}


def read_table(spark: SparkSession, folder: str, table: str, columns: list[str], carried: bool = False) -> DataFrame:
    """Id columns and the asked cells of a source table; no rows when the file is absent.

    With ``carried`` each row also names the columns that its record has, in ``CARRIED``, so that one reading tells both.
    """
    names = list(dict.fromkeys([*ID_COLUMNS, *columns]))
    found = table_path(spark, folder, table)
    if found is None:
        rows = spark.createDataFrame([], T.StructType([*[T.StructField(n, T.StringType()) for n in names],
                                                       T.StructField(CARRIED, T.ArrayType(T.StringType()))]))
    elif found[0] == "json":
        rows = _json(spark, found[1], columns)
    else:
        df = _csv(spark, found[1])
        rows = df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names],
                         F.array(*map(F.lit, df.columns)).alias(CARRIED))
    return rows if carried else rows.drop(CARRIED)


def write_table(df: DataFrame, folder: str, table: str) -> None:
    """Write a source table for ``read_table``, in record id order, one record per line.

    Two writes of unchanged records then hold the same lines in the same order.
    """
    df.orderBy("id").write.mode("overwrite").json(f"{folder}/{table}.json")
