"""Profiles: what a thinner export would still carry.

A profile never changes the landing schema. A dropped table stays and is empty, a dropped
column stays and is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruletrace.sources.landing import Landing, empty, types_of


@dataclass(frozen=True)
class Profile:
    label: str
    skip_source_tables: tuple[str, ...] = ()
    drop_tables: tuple[str, ...] = ()
    drop_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    collapse_resource_kind: bool = False


# The two profiles runs are compared on.
PROFILES = {
    "full": Profile("full"),
    "lean": Profile(
        "lean",
        skip_source_tables=("Movements", "Rig Assignments"),
        drop_tables=("location_travel", "changes"),
        drop_columns={"work": ("location_id",), "resources": ("home_location_id",)},
        collapse_resource_kind=True),
}


def get_profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"No profile named {name!r}. Known profiles: {sorted(PROFILES)}")
    return PROFILES[name]


def thin(landing: Landing, profile: Profile) -> Landing:
    """Empty the dropped tables and null the dropped columns. A dropped table is not computed."""
    def without(name: str, columns: tuple[str, ...]) -> DataFrame:
        kinds = types_of(name)
        return getattr(landing, name).withColumns(
            {c: F.lit(None).cast(kinds[c]) for c in columns})

    changed = {name: lambda name=name, columns=columns: without(name, columns)
               for name, columns in profile.drop_columns.items()}
    spark = SparkSession.active()
    changed.update({name: lambda name=name: empty(spark, name) for name in profile.drop_tables})
    return landing.replaced(**changed)
