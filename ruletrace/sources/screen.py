"""Refuse an export that carries material the run must not see."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Source tables that must not be loaded, name pieces that mark a file as such,
# and columns that are sensitive on an otherwise allowed table. All in normalised form.
DENIED_TABLES = (
    "conflict rules",
    "config thresholds",
    "trip type rules",
    "capacity tiers",
    "movement types",
    "day cap locks",
    "automation registry",
)
DENIED_PIECES = (
    "conflict checker",
    "conflictchecker",
    "dispatch board",
    "dispatchboard",
    "board ui",
)
SENSITIVE_FIELDS = (
    "acknowledged conflicts",
    "conflict status",
    "hard conflict",
    "soft conflict",
    "conflict id",
    "conflict key",
    "conflict signature",
    "guide conflict id",
)
FILE_ENDINGS = r"(?i)\.(csv|tsv|json|ndjson|parquet|xlsx)$"


class DeniedSource(Exception):
    """The export carries a table it must not; nothing was loaded."""


def normalised(name: Column) -> Column:
    """Lower case, no file ending, every run of other characters one space."""
    bare = F.regexp_replace(name, FILE_ENDINGS, "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def folded(name: str) -> str:
    """Accents apart from their letters, so that an accented spelling is seen through."""
    return unicodedata.normalize("NFKD", name)


def denied(names: DataFrame, name: str = "name") -> DataFrame:
    """Every (name, rule) violation: equal to a denied table or holding a denied piece. Names come ``folded``."""
    spark = names.sparkSession
    # The rule list is the constants above, so it is broadcast by construction.
    rules = spark.createDataFrame(
        [(t, True) for t in DENIED_TABLES] + [(p, False) for p in DENIED_PIECES],
        "rule string, exact boolean")
    norm = names.select(F.col(name).alias("name"), normalised(F.col(name)).alias("norm"))
    hit = ((F.col("exact") & (F.col("norm") == F.col("rule")))
           | (~F.col("exact") & F.contains("norm", "rule")))
    return norm.join(F.broadcast(rules), hit).select("name", "norm", "rule", "exact")


def check_names(spark: SparkSession, names: list[str]) -> int:
    """Raise with all violations, not just the first; returns how many names were checked."""
    found = denied(spark.createDataFrame([(folded(n),) for n in names], "name string"))
    rows = found.orderBy("name", "rule").collect()
    if rows:
        listed = "\n".join(f"  {r['name']!r} normalises to {r['norm']!r}, which "
                           f"{'is' if r['exact'] else 'contains'} {r['rule']!r}" for r in rows)
        raise DeniedSource(f"Export rejected. {len(rows)} denied file(s) present:\n{listed}")
    return len(names)


def unlisted_override_columns(columns: DataFrame) -> DataFrame:
    """Mapped override columns, as (source_table, column), that the sensitive list lacks. Columns come ``folded``."""
    listed = columns.sparkSession.createDataFrame(
        [(f,) for f in SENSITIVE_FIELDS], "norm string")
    return (columns.withColumn("norm", normalised(F.col("column")))
            .join(F.broadcast(listed), "norm", "left_anti").select("source_table", "column"))
