"""Load an export: screen it, read it once, write the six landing tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruletrace.session import ensure_checkpoint_dir
from ruletrace.sources import build as builders
from ruletrace.sources.landing import Landing, read_landing, repeated_keys, volumes, write_landing
from ruletrace.sources.mapping import DEFAULT_MAP, specs, wanted_columns
from ruletrace.sources.profiles import Profile, get_profile
from ruletrace.sources.reader import CARRIED, carried_columns, list_names, read_table
from ruletrace.sources.screen import check_names, folded, unlisted_override_columns

LOGGED = "(log)"


class EmptyExport(Exception):
    """The export holds nothing a run could use; nothing was written."""


class RepeatedKeys(Exception):
    """A record id stands for several records; nothing was written."""


@dataclass(frozen=True)
class LoadReport:
    landing: Landing
    profile: Profile
    counts: DataFrame                       # landing_table, rows
    files_checked: int
    skipped_source_tables: list[str]
    missing_columns: list[tuple[str, str]]  # mapped, but carried by no record
    empty_columns: list[tuple[str, str]]    # carried, but blank in every record
    unlisted_override_columns: list[tuple[str, str]]


def column_report(staged: dict[str, DataFrame], carried: dict[str, set[str]],
                  source_map: dict, profile: Profile):
    """Mapped columns that are absent, and those that are present but never filled."""
    read = {}
    for _, spec in specs(source_map, profile.skip_source_tables):
        ignored = {spec.get("work_date")}
        if profile.collapse_resource_kind:
            ignored.add(spec.get("kind_column"))
        names = read.setdefault(spec["table"], {})
        names.update(dict.fromkeys(
            c for c in wanted_columns({"any": [spec]})[spec["table"]] if c not in ignored))
    missing, blank = [], []
    for table, names in read.items():
        df = staged[table]
        filled = df.agg(F.count("*").alias("_rows"),
                        *[F.count(f"`{n}`").alias(n) for n in names]).first()
        if filled["_rows"] == 0:
            continue
        for n in names:
            if n not in carried[table]:
                missing.append((table, n))
            elif filled[n] == 0:
                blank.append((table, n))
    return missing, blank


def load(spark: SparkSession, export_dir: str, out: str, profile: str = "full",
         source_map: dict | None = None, reveal_labels: bool = False,
         extracted_at: datetime | None = None, labels_path: str | None = None,
         staging: str | None = None) -> LoadReport:
    """Screen, read, build, write. ``out`` gets a folder of the load, with one folder per landing table and nothing else,
    and the file that names it; readers of ``out`` see a load as a whole.

    Source files are text and feed several landing tables, so each is parsed once into ``staging``,
    by default a new folder where cut lineage goes, and the builders read those columns. Override
    logs are not staged: they are read from the export, and their labels go to ``labels_path`` only.
    """
    chosen, source_map = get_profile(profile), source_map or DEFAULT_MAP
    names = list_names(spark, export_dir)
    if not names:
        raise EmptyExport(f"Export directory {export_dir} is empty. Nothing was loaded.")
    checked = check_names(spark, names)

    staging = staging or f"{ensure_checkpoint_dir(spark)}/source-{uuid4().hex}"
    logs = {s["table"]: s["ack_column"] for t, s in specs(source_map, chosen.skip_source_tables) if t == "changes"}
    staged, carried = {}, {}
    for table, columns in wanted_columns(source_map, chosen.skip_source_tables).items():
        target = f"{staging}/{table}"
        rows = read_table(spark, export_dir, table, columns, carried=True)
        if table in logs:  # whether there is a log, not what it says
            rows = rows.withColumn(logs[table], F.when(F.col(f"`{logs[table]}`").isNotNull(), F.lit(LOGGED)))
        rows.write.mode("overwrite").parquet(target)
        whole = spark.read.parquet(target)
        staged[table], carried[table] = whole.drop(CARRIED), carried_columns(whole)
    missing, blank = column_report(staged, carried, source_map, chosen)

    present = {t: df.select(*[c for c in df.columns if (t, c) not in missing])
               for t, df in staged.items()}
    stamp = extracted_at or datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
    said = {t: read_table(spark, export_dir, t, [c]) for t, c in logs.items() if (t, c) not in missing}
    landing = builders.build(spark, present, source_map, stamp, chosen, reveal_labels, said)
    if landing.work.isEmpty() and landing.resources.isEmpty():
        raise EmptyExport(f"Export {export_dir} carried no work rows and no resources. "
                          "Nothing was loaded.")
    # Ids of assignments and changes are made here, one row each; the others are the export's.
    twice = repeated_keys(landing, "work", "resources", "locations").orderBy("landing_table", "key")
    if shown := twice.limit(20).collect():
        listed = "\n".join(f"  {r['landing_table']}: {r['key']} ({r['rows']} rows)" for r in shown)
        raise RepeatedKeys(f"{twice.count()} repeated record id(s), the first of them:\n{listed}\nNothing was written.")
    write_landing(landing, out)
    if labels_path and not reveal_labels:
        (builders.override_labels(spark, said, source_map, chosen)
         .write.mode("overwrite").parquet(labels_path))

    overrides = [(s["table"], s["ack_column"]) for t, s in specs(source_map, chosen.skip_source_tables)
                 if t == "changes"]
    unlisted = []
    if overrides and not reveal_labels and "changes" not in chosen.drop_tables:
        frame = spark.createDataFrame([(t, folded(c)) for t, c in overrides], "source_table string, column string")
        named = {(t, folded(c)): (t, c) for t, c in overrides}
        unlisted = [named[tuple(r)] for r in unlisted_override_columns(frame).collect()]
    written = read_landing(spark, out)
    skipped = sorted({s["table"] for _, s in specs(source_map)} & set(chosen.skip_source_tables))
    return LoadReport(written, chosen, volumes(written), checked, skipped, missing, blank, unlisted)
