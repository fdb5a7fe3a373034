"""Timestamps without a zone: day and minute arithmetic, display text.

The epoch helpers read calendar fields of a TIMESTAMP_NTZ, so their results do not depend
on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"


def epoch_minutes(ts: str) -> str:
    return f"(unix_date(to_date({ts})) * 1440L + hour({ts}) * 60 + minute({ts}))"


def epoch_seconds(ts: str) -> str:
    return f"({epoch_minutes(ts)} * 60 + CAST(second({ts}) AS BIGINT))"


def minutes_between(start: str, end: str) -> Column:
    """How many minute marks lie between two times: 21:00:01 to 21:30:00 is 30."""
    return F.expr(f"{epoch_minutes(end)} - {epoch_minutes(start)}")


def days_between(start: str, end: str) -> Column:
    """How many midnights lie between two times."""
    return F.expr(f"datediff({end}, {start})")


def within_day(ts: str, date: str) -> Column:
    """Range form of ``to_date(ts) = date``, so the filter reaches the file scan."""
    return F.expr(f"{ts} >= CAST(DATE'{date}' AS TIMESTAMP_NTZ) "
                  f"AND {ts} < CAST(date_add(DATE'{date}', 1) AS TIMESTAMP_NTZ)")


def weekday_minute(ts: str) -> str:
    return f"date_format({ts}, 'EEE yyyy-MM-dd HH:mm')"


def with_weekday(text: str) -> Column:
    """Put the day name before a text that is a bare timestamp; leave other text alone."""
    date = f"try_to_timestamp(substr({text}, 1, 10), 'yyyy-MM-dd')"
    return F.expr(f"CASE WHEN {text} RLIKE r'{TIMESTAMP_TEXT}' AND {date} IS NOT NULL "
                  f"THEN concat(date_format({date}, 'EEE'), ' ', {text}) ELSE {text} END")
