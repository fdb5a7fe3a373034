"""Small landing tables with planted structure."""

from datetime import datetime, timedelta

from ruletrace.sources.landing import Landing, SCHEMAS, conform, empty

T0 = datetime(2026, 6, 1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def frame(spark, table, rows):
    """Rows as dicts; the columns a row lacks are null."""
    if not rows:
        return empty(spark, table)
    kinds = dict(p.strip().split(" ") for p in SCHEMAS[table].split(","))
    names = list(rows[0])
    return conform(spark.createDataFrame([tuple(r[n] for n in names) for r in rows],
                                         ", ".join(f"{n} {kinds[n]}" for n in names)), table)


def landing(spark, **tables) -> Landing:
    return Landing(**{t: frame(spark, t, tables.get(t, [])) for t in SCHEMAS})


def booking(n, resource, work, start, end, role="r"):
    return dict(assignment_id=f"as_{n:05d}", resource_id=resource, work_id=work, role=role,
                start_ts=None if start is None else at(start), end_ts=None if end is None else at(end))


def resource(rid, kind="van", name=None):
    return dict(resource_id=rid, kind=kind, name=name or rid)
