"""Source records to landing tables, driven by the source map.

``records`` maps a source table name to a frame of text cells (``reader.read_table``). Every
builder is a select over those frames; nothing is looked up row by row.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ruletrace.functions import cells
from ruletrace.functions.cells import NO_TEXT, name, text
from ruletrace.sources.landing import Landing, conform, empty
from ruletrace.sources.mapping import ID_COLUMNS, columns_of, specs
from ruletrace.sources.profiles import PROFILES, Profile, thin

# Fixed values written to landing rows.
SOURCE_SYSTEM = "airtable"
FLAGGED, ACKNOWLEDGED = "flagged", "acknowledged"

Records = dict[str, DataFrame]


class Source:
    """One spec of the map over its source rows, with cleaned cells.

    Every cell is asked for by its key in the spec; what the map or the export lacks is null.
    """

    def __init__(self, spec: dict, df: DataFrame):
        used = [c for c in columns_of(spec) if c in df.columns and c != spec.get("ack_column")]
        self.spec, self.rows = spec, cells.with_cells(df, used)
        self._has = set(used) | set(ID_COLUMNS) & set(df.columns)

    def has(self, column: str | None) -> bool:
        return column in self._has

    def cell(self, key: str) -> str:
        column = self.spec.get(key)
        return name(column) if self.has(column) else NO_TEXT

    def scalar(self, key: str) -> str:
        column = self.spec.get(key)
        return cells.scalar(column) if self.has(column) else NO_TEXT

    def first_link(self, key: str) -> str:
        column = self.spec.get(key)
        return cells.first_link(column) if self.has(column) else NO_TEXT

    def record_id(self, prefix_key: str) -> str:
        return cells.record_id([c for c in ID_COLUMNS if self.has(c)], self.spec.get(prefix_key, ""))

    def source_id(self) -> str:
        return "id" if self.has("id") else NO_TEXT

    def select(self, **columns: str) -> DataFrame:
        return self.rows.selectExpr(*[f"{sql} AS {out}" for out, sql in columns.items()],
                                    f"{self.source_id()} AS source_id")


def _sources(source_map: dict, table: str, records: Records, profile: Profile) -> list[Source]:
    return [Source(spec, records[spec["table"]])
            for landing_table, spec in specs(source_map, profile.skip_source_tables)
            if landing_table == table and spec["table"] in records]


def _union(frames: list[DataFrame], spark: SparkSession, table: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else empty(spark, table)


def work(sources: list[Source], spark: SparkSession) -> DataFrame:
    frames = []
    for s in sources:
        linked_type, linked_place = "work_type_link" in s.spec, "location_link" in s.spec
        frames.append(s.select(
            work_id=s.record_id("id_prefix"),
            work_type=s.first_link("work_type_link") if linked_type else s.scalar("work_type"),
            start_ts=f"coalesce({cells.parse_ts(s.cell('start_ts'))}, "
                     f"{cells.parse_ts(s.cell('fallback_date'))})",
            end_ts=cells.parse_ts(s.cell("end_ts")),
            location_id=(f"concat('lc_', {s.first_link('location_link')})" if linked_place
                         else s.scalar("location_id")),
            status=s.scalar("status"), customer_count=cells.parse_int(s.cell("customer_count")))
            .filter("work_id IS NOT NULL"))
    return _union(frames, spark, "work")


def resources(sources: list[Source], spark: SparkSession, profile: Profile) -> DataFrame:
    frames = []
    for s in sources:
        literal = text(s.spec["kind"]) if s.spec.get("kind") else NO_TEXT
        if profile.collapse_resource_kind:
            fallback = s.spec.get("kind_fallback")
            kind = f"coalesce({literal}, {text(fallback) if fallback else NO_TEXT})"
        else:
            kind = f"coalesce({s.scalar('kind_column')}, {literal})"
        frames.append(s.select(resource_id=s.record_id("id_prefix"), kind=kind, name=s.scalar("name"),
                               home_location_id=s.scalar("home_location_id"))
                      .filter("resource_id IS NOT NULL"))
    return _union(frames, spark, "resources")


def assignments(sources: list[Source], spark: SparkSession, work_rows: DataFrame) -> DataFrame:
    """One row per (job, resource, role) from every link column, with the job's window.

    A resource can reach a job through several source tables. Those rows share the id, and
    the first source in map order, then the first record id, names the source.
    """
    frames = []
    for ordinal, s in enumerate(sources):
        jobs = [f"transform({cells.links(c)}, x -> concat({text(prefix)}, x))"
                for c, prefix in s.spec.get("work_link", {}).items() if s.has(c)]
        own = s.record_id("work_prefix") if s.spec.get("work_prefix") else None
        crew = [f"transform({cells.links(c)}, x -> named_struct('resource_id', "
                f"concat({text(prefix)}, x), 'role', {text(c)}))"
                for c, prefix in s.spec["roles"].items() if s.has(c)]
        if not (jobs or own) or not crew:
            continue
        if jobs and own:
            jobs.insert(0, f"array({own})")
        # The outer forms: for the others the optimizer infers filters that repeat the
        # whole cell expression. Rows without a job or a resource are dropped after.
        work_id = f"explode_outer(concat({', '.join(jobs)}))" if jobs else own
        frames.append(s.select(work_id=work_id, crew=f"concat({', '.join(crew)})")
                      .selectExpr("work_id", "inline_outer(crew)", "source_id", f"{ordinal} AS ordinal")
                      .filter("work_id IS NOT NULL AND resource_id IS NOT NULL"))
    if not frames:
        return empty(spark, "assignments")
    # The windows are looked up first: what then picks the first row of each (job, resource, role) rides
    # on the same shuffle, and only rows that are kept get their id hashed. Ids of jobs begin alike, so rows are sorted by
    # a hash first, which is told apart at a glance.
    spread = F.xxhash64("work_id").alias("_spread")
    first = F.row_number().over(Window.partitionBy("_spread", "work_id", "resource_id", "role")
                                .orderBy("ordinal", "source_id"))
    ident = cells.opaque_id("work_id", "resource_id", "role", prefix="as_")
    return (_union(frames, spark, "assignments")
            .withColumn("_spread", spread)
            .join(work_rows.select(spread, "work_id", "start_ts", "end_ts"), ["_spread", "work_id"], "left")
            .withColumn("_place", first).filter("_place = 1").drop("_place", "_spread")
            .selectExpr("*", f"{ident} AS assignment_id"))


def locations(sources: list[Source], spark: SparkSession) -> DataFrame:
    frames = [s.select(location_id=s.record_id("id_prefix"), name=s.scalar("name"))
              .filter("location_id IS NOT NULL") for s in sources]
    return _union(frames, spark, "locations")


def location_travel(sources: list[Source], spark: SparkSession) -> DataFrame:
    frames = []
    for s in sources:
        prefix = text(s.spec["id_prefix"])
        samples = cells.parse_int(s.cell("sample_count"))
        frames.append(s.select(
            from_id=f"concat({prefix}, {s.first_link('from_link')})",
            to_id=f"concat({prefix}, {s.first_link('to_link')})",
            minutes=cells.parse_int(s.cell("minutes")), is_estimate=f"coalesce({samples}, 0) = 0")
            .filter("from_id IS NOT NULL AND to_id IS NOT NULL AND minutes IS NOT NULL"))
    return _union(frames, spark, "location_travel")


def override_events(source_map: dict, records: Records, profile: Profile,
                    reveal_labels: bool) -> DataFrame | None:
    """Every line of every override log, with its label class and opaque field id."""
    frames = []
    for s in _sources(source_map, "changes", records, profile):
        if s.spec["ack_column"] in s.rows.columns:
            frames.append(s.select(entity_id=s.record_id("entity_prefix"),
                                   line=f"explode_outer({cells.override_lines(s.spec['ack_column'])})")
                          .filter("line IS NOT NULL"))
    if not frames:
        return None
    field = "label" if reveal_labels else cells.opaque_id("label", prefix="ovr_")
    return (reduce(DataFrame.unionByName, frames)
            .selectExpr("entity_id", "source_id", f"{cells.override_line('line')} AS e")
            .selectExpr("entity_id", "source_id", f"{cells.label_class('e.label')} AS label",
                        "e.who", "e.when")
            .selectExpr("*", f"{field} AS field"))


def changes(spark: SparkSession, events: DataFrame | None) -> DataFrame:
    """The override log as changes from flagged to acknowledged.

    The same person clearing the same label on the same job and day is one change.
    """
    if events is None:
        return empty(spark, "changes")
    ident = cells.opaque_id("entity_id", "field", "who", "when", prefix="ch_")
    return events.selectExpr(
        f"{ident} AS change_id", "'work' AS entity_table", "entity_id", "field",
        f"'{FLAGGED}' AS old_value", f"'{ACKNOWLEDGED}' AS new_value",
        f"{cells.parse_ts('when')} AS changed_at", "who AS changed_by", "source_id",
    ).dropDuplicates(["change_id"])


def labels(events: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Opaque field id to label class, kept apart from the landing tables."""
    if events is None:
        return spark.createDataFrame([], "field string, label string")
    return events.select("field", "label").distinct()


def override_labels(spark: SparkSession, records: Records, source_map: dict,
                    profile: Profile = PROFILES["full"]) -> DataFrame:
    if "changes" in profile.drop_tables:
        return labels(None, spark)
    return labels(override_events(source_map, records, profile, False), spark)


def build(spark: SparkSession, records: Records, source_map: dict, extracted_at: datetime,
          profile: Profile = PROFILES["full"], reveal_labels: bool = False,
          logs: Records | None = None) -> Landing:
    """The six landing tables under a profile. All lazy. ``logs`` has the override logs where
    ``records`` does not."""
    def sources(table: str) -> list[Source]:
        return _sources(source_map, table, records, profile)

    def stamped(df: DataFrame, table: str) -> DataFrame:
        return conform(df.selectExpr("*", f"'{SOURCE_SYSTEM}' AS source_system",
                                     f"TIMESTAMP_NTZ'{extracted_at.isoformat(' ')}' AS extracted_at"),
                       table)

    full = Landing(
        work=lambda: stamped(work(sources("work"), spark), "work"),
        resources=lambda: stamped(resources(sources("resources"), spark, profile), "resources"),
        assignments=lambda: stamped(
            assignments(sources("assignments"), spark, full.work), "assignments"),
        changes=lambda: stamped(changes(spark, override_events(
            source_map, records if logs is None else logs, profile, reveal_labels)), "changes"),
        locations=lambda: conform(locations(sources("locations"), spark), "locations"),
        location_travel=lambda: conform(
            location_travel(sources("location_travel"), spark), "location_travel"))
    return thin(full, profile)
