"""Ids, names and sentences people read. Arguments and results are SQL text unless noted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruletrace.functions.cells import NO_TEXT, text

# Fallbacks for missing labels, and the link format of the source system.
UNTYPED = "untyped"
BLANK = "(blank)"
UNRECORDED = "(unrecorded)"
RECORD_URL = "https://airtable.com/{base}/{table}/{record}"

SLUG_LIMIT, SLUG_HEAD, SLUG_HASH = 48, 40, 7


def slug(*parts: str) -> str:
    """A readable, stable piece of a candidate id; long ones end in a short hash."""
    joined = ", ".join(f"nullif(CAST({p} AS STRING), '')" for p in parts)
    dashed = f"lower(btrim(regexp_replace(concat_ws('_', {joined}), '[^A-Za-z0-9]+', '-'), '-'))"
    # Named once through a one-element list: the dashed text is used four times.
    return (f"get(transform(array({dashed}), s -> CASE WHEN length(s) > {SLUG_LIMIT} "
            f"THEN concat(substr(s, 1, {SLUG_HEAD}), '-', substr(sha2(s, 256), 1, {SLUG_HASH})) "
            "WHEN s = '' THEN 'unnamed' ELSE s END), 0)")


def candidate_id(probe: str, *parts: str) -> Column:
    return F.expr(f"concat({text(probe + '-')}, {slug(*parts)})").alias("candidate_id")


def shown_ratio(ratio: Column | str) -> Column:
    """A ratio as documents show it: four digits, always written out, so that equal documents are equal texts."""
    return F.bround(ratio, 4).cast("decimal(9,4)")


def quoted(value: str) -> str:
    """Text in quotes inside a sentence: single quotes unless the text holds one."""
    escaped = f"replace({value}, '\\\\', '\\\\\\\\')"
    return (f"CASE WHEN contains({value}, '\\'') AND NOT contains({value}, '\"') "
            f"THEN concat('\"', {escaped}, '\"') "
            f"ELSE concat('\\'', replace({escaped}, '\\'', '\\\\\\''), '\\'') END")


def sentence(template: str, **values: str) -> str:
    """Fill ``{name}`` slots of a template; a slot without a value names a column."""
    pieces, rest = [], template
    while "{" in rest:
        plain, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        pieces += [text(plain), f"CAST({values.get(slot, slot)} AS STRING)"]
    return f"concat({', '.join([*pieces, text(rest)])})"


def job_label(work_type: str, start_ts: str) -> str:
    return (f"concat(coalesce({work_type}, {text(UNTYPED)}), ' on ', "
            f"coalesce(date_format({start_ts}, 'EEE yyyy-MM-dd HH:mm'), 'no start time'))")


def source_of(entity_id: str, other: str = "other") -> str:
    """Which source table a job id comes from, told by its prefix."""
    return (f"CASE WHEN startswith({entity_id}, 'op_') THEN 'Daily Ops' "
            f"WHEN startswith({entity_id}, 'mv_') THEN 'Movements' ELSE {text(other)} END")


def scope_of(notes: str) -> str:
    return (f"CASE WHEN contains(lower({notes}), 'scope=interface') THEN 'interface' "
            "ELSE 'operating' END")


def record_url(landing_id: str, base: str, table_ids: dict[str, str]) -> str:
    """Link to the source record behind a landing id, or null when it has none.

    ``table_ids`` maps an id prefix such as ``op_`` to the table's id. It comes from the
    source map, whose length is fixed by hand, so it becomes a CASE.
    """
    links = [f"WHEN startswith({landing_id}, {text(prefix + 'rec')}) THEN concat("
             + text(RECORD_URL.format(base=base, table=table, record=""))
             + f", substr({landing_id}, {len(prefix) + 1}))"
             for prefix, table in table_ids.items()]
    return f"CASE {' '.join(links)} END" if base and links else NO_TEXT
