"""Source cells to typed values, as SQL expressions.

A cell arrives as text. Linked and select cells may hold JSON text, which is read through
VARIANT so that mixed shapes in one column need no schema. Every function takes and returns
SQL text: the expressions nest deeply, and one parse by Spark is cheaper to set up than a
tree of Column calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# An override log line is "label :: who :: when"; a record id is "rec" and 14
# letters or digits, and a machine label may carry ids of jobs.
OVERRIDE_LINE = r"^(.*?)\s*::\s*(.*?)\s*::\s*(\S+)\s*$"
EMBEDDED_RECORD = r"(?i)(mv_|op_)?rec[a-z0-9]{14}"
UNLABELLED = "unlabelled"
EMPTY_CELLS = "('', 'null')"

# The forms a timestamp may have. A date; a date, a T and a time, which may end
# in Z and before that in a fraction; or a date, a space and a time with or without seconds.
TIMESTAMP = (r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}((\.\d{1,6})?Z)?"
             r"| \d{1,2}:\d{1,2}(:\d{1,2})?)?$")

# The characters Python counts as white space, which cells are stripped of.
WHITE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
         "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Linked cells of one item that hold no escapes: a text, or an object of an id and maybe a name. What stands between
# quotes is taken from them as it is.
ONE_TEXT = r'^\["[A-Za-z0-9_.-]+"\]$'
ONE_OBJECT = r'^\[\{"id": ?"[A-Za-z0-9_.-]+"(, ?"name": ?"[A-Za-z0-9 _.-]*")?\}\]$'

NO_TEXT = "CAST(NULL AS STRING)"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def strip(cell: str) -> str:
    return f"btrim({cell}, {text(WHITE)})"


def cleaned(cell: str) -> str:
    """The text of a cell without white space around it; null when it holds nothing."""
    return strip(f"CASE WHEN {cell} NOT IN {EMPTY_CELLS} THEN {cell} END")


def parsed(cell: str) -> str:
    """The VARIANT behind a cell that looks like JSON; null for other text."""
    return f"CASE WHEN {cell} LIKE '[%' OR {cell} LIKE '{{%' THEN try_parse_json({cell}) END"


def with_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clean the columns, and add what each parses to as ``<column>#json``.

    Two projections, which the optimizer keeps apart because their results are used more
    than once: a cell is cleaned once and parsed once.
    """
    rest = [name(c) for c in df.columns if c not in columns]
    clean = df.selectExpr(*rest, *[f"{cleaned(name(c))} AS {name(c)}" for c in columns])
    return clean.selectExpr("*", *[f"{parsed(name(c))} AS {name(c + '#json')}" for c in columns])


def parse_ts(cell: str) -> str:
    """Wall-clock time of a cleaned cell, or null when it has no known form.

    A trailing Z is dropped, not applied, so no time zone takes part.
    """
    return (f"CASE WHEN {cell} RLIKE {text(TIMESTAMP)} "
            f"THEN try_cast(rtrim('Z', {cell}) AS TIMESTAMP_NTZ) END")


def parse_date(cell: str) -> str:
    return f"to_date({parse_ts(cell)})"


def parse_int(cell: str) -> str:
    """Whole number, cut toward zero. Text that is no number gives null."""
    return f"try_cast(try_cast({cell} AS DOUBLE) AS INT)"


def _plain(value: str) -> str:
    """A VARIANT as text, unless it is an object or a list."""
    return (f"CASE WHEN NOT to_json({value}) RLIKE {text('^[' + chr(92) + '[{]')} "
            f"THEN try_variant_get({value}, '$', 'string') END")


def links(column: str) -> str:
    """The ids in a linked cell: a JSON list of objects or ids, or a comma list.

    The column comes from ``with_cells``. A list of one plain item, as most are, is not parsed.
    """
    cell = name(column)
    # Most items are objects with an id, which the parsed cell gives as it is. Of the others a text may itself be JSON.
    item = "try_variant_get(v, '$', 'string')"
    other = (f"CASE WHEN {item} LIKE '{{%' THEN coalesce(try_variant_get(try_parse_json({item}), '$.id', 'string'), "
             f"CASE WHEN try_parse_json({item}) IS NULL THEN {item} END) ELSE {item} END")
    listed = (f"transform(try_variant_get({parsed(cell)}, '$', 'array<variant>'), "
              f"v -> coalesce(try_variant_get(v, '$.id', 'string'), {other}))")
    written = f"transform(split({cell}, ','), x -> {strip('x')})"
    return (f"CASE WHEN {cell} IS NULL THEN CAST(array() AS ARRAY<STRING>) "
            f"WHEN {cell} LIKE '[\"%' AND {cell} RLIKE {text(ONE_TEXT)} THEN array(split_part({cell}, '\"', 2)) "
            f"WHEN {cell} LIKE '[{{%' AND {cell} RLIKE {text(ONE_OBJECT)} THEN array(split_part({cell}, '\"', 4)) "
            f"ELSE filter(coalesce({listed}, {written}), x -> x IS NOT NULL AND x <> '') END")


def first_link(column: str) -> str:
    return f"get({links(column)}, 0)"


def scalar(column: str) -> str:
    """A select or lookup cell as plain text: the name, else the id, of its first item."""
    json = name(column + "#json")
    named = ", ".join(f"nullif(try_variant_get({json}, '{path}', 'string'), '')"
                      for path in ("$.name", "$.id", "$[0].name", "$[0].id", "$[0][0]"))
    first = _plain(f"try_variant_get({json}, '$[0]', 'variant')")
    return (f"nullif(CASE WHEN {json} IS NULL THEN {name(column)} "
            f"ELSE nullif(coalesce({named}, {first}), 'null') END, '')")


def opaque_id(*parts: str, prefix: str = "", length: int = 12) -> str:
    """A stable id without content: a prefix of the sha-256 of the joined parts.

    A missing part counts as the text ``None``; ``concat_ws`` alone would skip it and give
    two different records one id.
    """
    known = ", ".join(f"coalesce(CAST({p} AS STRING), 'None')" for p in parts)
    return f"concat({text(prefix)}, substr(sha2(concat_ws(char(31), {known}), 256), 1, {length}))"


def record_id(columns: list[str], prefix: str = "") -> str:
    """The first non-empty id column, prefixed; null when a record has none."""
    if not columns:
        return NO_TEXT
    ident = ", ".join(f"nullif({name(c)}, '')" for c in columns)
    return f"concat({text(prefix)}, coalesce({ident}))"


def label_class(label: str) -> str:
    """Lower-case words of an override label, without embedded record ids and digits."""
    bare = f"regexp_replace(lower({label}), {text(EMBEDDED_RECORD)}, '')"
    return f"coalesce(nullif(trim(regexp_replace({bare}, '[^a-z]+', ' ')), ''), {text(UNLABELLED)})"


def override_line(line: str) -> str:
    """``struct(label, who, when)`` of one log line; a line of another form is all label."""
    pattern = text(OVERRIDE_LINE)
    part = [f"CASE WHEN {line} RLIKE {pattern} THEN regexp_extract({line}, {pattern}, {i}) END"
            for i in (1, 2, 3)]
    return f"named_struct('label', coalesce({part[0]}, {line}), 'who', {part[1]}, 'when', {part[2]})"


def override_lines(column: str) -> str:
    """The non-blank lines of an override log cell."""
    return f"filter(transform(split({name(column)}, '\\n'), x -> {strip('x')}), x -> x <> '')"
