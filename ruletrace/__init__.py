"""Find unwritten operating rules in business records, as Spark DataFrame jobs."""

from ruletrace.guards import Guards
from ruletrace.sources.landing import Landing

__all__ = ["Guards", "Landing"]
