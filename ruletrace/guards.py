"""Minimum volumes a finding needs before it is worth showing to a person."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Guards:
    min_assignments_per_resource: int = 20
    min_instances_per_work_type: int = 10
    min_populated_rows_per_field: int = 50
    min_observations: int = 50
    min_change_events: int = 3
