"""What the probes of a run share, made once and read by all of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ruletrace.session import settled
from ruletrace.sources.landing import TABLES, Landing


# Bookings and changes are by far the largest tables, plans read few of their columns, and neither is joined from others:
# a copy of them would be most of the disk of a run, so they are read where they lie.
WRITTEN = tuple(t for t in TABLES if t not in ("assignments", "changes"))


class Facts(Landing):
    """A landing that remembers what plans made of it. With ``write`` the tables that views join are written to the shared
    folder too, each when a plan first asks for it, so that they are worked out once a run."""

    def __init__(self, landing: Landing, write: bool = False):
        tables = {t: (lambda t=t: settled(getattr(landing, t), t) if write and t in WRITTEN else getattr(landing, t))
                  for t in TABLES}
        super().__init__(**tables)
        self._made: dict[str, Any] = {}

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]


def facts(landing: Landing) -> Facts:
    """The landing with a memory; one that has it stays what it is."""
    return landing if isinstance(landing, Facts) else Facts(landing)


def run_facts(landing: Landing) -> Facts:
    """The facts of a whole run: what its probes share is made once."""
    return landing if isinstance(landing, Facts) else Facts(landing, write=True)
