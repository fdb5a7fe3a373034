"""The source map: which export column feeds which landing column.

A map is a dict of landing table -> list of specs, and ``load_map`` reads one from JSON.
``DEFAULT_MAP`` holds the column names of the known export; a spec may also carry the
``table_id`` that record links need, which belongs to one owner's base and so is left to
their own file.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

# Source tables, their columns and the landing id prefixes.
DEFAULT_MAP = {
    "work": [
        {"table": "Daily Ops", "id_prefix": "op_", "work_type": "Trip type",
         "start_ts": "Trip start", "end_ts": "Trip end", "status": "Status",
         "customer_count": "Guest count", "fallback_date": "Date"},
        {"table": "Movements", "id_prefix": "mv_", "work_type_link": "Movement Type",
         "start_ts": "Start", "end_ts": "End", "location_link": "Origin", "status": "Status",
         "customer_count": "Passengers", "fallback_date": "Date"},
    ],
    "resources": [
        {"table": "Guides & Staff", "id_prefix": "gs_", "kind": "person", "name": "Name",
         "home_location_id": "Location base"},
        {"table": "Vehicles", "id_prefix": "vh_", "kind_column": "Type",
         "kind_fallback": "vehicle", "name": "Unit name", "home_location_id": "Location base"},
        {"table": "Boats", "id_prefix": "bt_", "kind": "boat", "name": "Boat number",
         "home_location_id": "Location"},
    ],
    "assignments": [
        {"table": "Daily Ops", "work_prefix": "op_",
         "roles": {"Lead Guide (link)": "gs_", "Other Guides (link)": "gs_",
                   "Drivers (link)": "gs_", "Store Staff": "gs_", "Food Crew": "gs_",
                   "Vehicle": "vh_", "Trailer": "vh_"}},
        {"table": "Movements", "work_prefix": "mv_",
         "roles": {"Driver (link)": "gs_", "Vehicle": "vh_", "Trailer": "vh_"}},
        {"table": "Rig Assignments", "work_link": {"Daily Op": "op_", "Movement": "mv_"},
         "roles": {"Driver": "gs_", "Vehicle": "vh_", "Trailer": "vh_"}},
    ],
    "locations": [
        {"table": "Locations", "id_prefix": "lc_", "name": "Name"},
    ],
    "location_travel": [
        {"table": "Routes", "id_prefix": "lc_", "from_link": "From", "to_link": "To",
         "minutes": "Drive minutes", "sample_count": "Sample count"},
    ],
    "changes": [
        {"table": "Daily Ops", "entity_prefix": "op_", "ack_column": "Acknowledged conflicts",
         "work_date": "Date"},
        {"table": "Movements", "entity_prefix": "mv_", "ack_column": "Acknowledged conflicts",
         "work_date": "Date"},
    ],
}

# Spec entries whose value is not the name of a source column.
NOT_COLUMNS = ("table", "table_id", "id_prefix", "work_prefix", "entity_prefix", "kind",
               "kind_fallback")

# Names a source may give the record id, best first.
ID_COLUMNS = ("id", "Record ID", "record_id")


def load_map(path: str) -> dict:
    """A source map from any path Spark reads."""
    held = SparkSession.active().read.option("wholetext", True).text(path).first()[0]
    return {k: v for k, v in json.loads(held).items() if isinstance(v, list)}


def specs(source_map: dict, skip: tuple[str, ...] = ()):
    """(landing table, spec) for every spec whose source table is read."""
    for landing_table, entries in source_map.items():
        for spec in entries:
            if spec["table"] not in skip:
                yield landing_table, spec


def columns_of(spec: dict) -> list[str]:
    """The source columns one spec reads."""
    found = []
    for key, value in spec.items():
        if isinstance(value, dict):
            found += value
        elif key not in NOT_COLUMNS and value:
            found.append(value)
    return found


def wanted_columns(source_map: dict, skip: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Per source table, the sorted columns any spec reads."""
    wanted: dict[str, set[str]] = {}
    for _, spec in specs(source_map, skip):
        wanted.setdefault(spec["table"], set()).update(columns_of(spec))
    return {table: sorted(columns) for table, columns in wanted.items()}


def table_ids(source_map: dict) -> dict[str, str]:
    """Id prefix to source table id; the first spec of a prefix wins."""
    ids: dict[str, str] = {}
    for _, spec in specs(source_map):
        if spec.get("id_prefix") and spec.get("table_id"):
            ids.setdefault(spec["id_prefix"], spec["table_id"])
    return ids
