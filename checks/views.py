"""Read the test tables as the records of a business: orders are jobs, suppliers are resources,
line items are bookings, returned line items are overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ruletrace.sources.landing import Landing, conform

_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is inferred, which is a Spark job, the first time only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def padded(column: str, width: int) -> str:
    """Zeros in front up to a width; a longer value stays whole. Numbers that fit lose the first digit of a larger one."""
    most = 10 ** width
    return (f"CASE WHEN {column} BETWEEN 0 AND {most - 1} THEN substr(CAST({column} + CAST({most} AS BIGINT) AS STRING), 2) "
            f"ELSE lpad(CAST({column} AS STRING), greatest({width}, length(CAST({column} AS STRING))), '0') END")


# A text key of a line item; the order and line number alone repeat.
LINE_KEY = (f"concat_ws('-', {padded('l_orderkey', 10)}, {padded('l_linenumber', 2)}, "
            f"{padded('l_suppkey', 8)}, {padded('l_partkey', 9)}, "
            f"date_format(l_shipdate, 'yyyyMMdd'), {padded('CAST(l_quantity AS INT)', 3)})")

WORK = {
    "work_type": "o_orderpriority",
    "start_ts": "o_orderdate",
    "end_ts": "o_orderdate + make_dt_interval(0, CAST(hours AS INT))",
    "location_id": "concat('lc_', c_nationkey)",
    "status": "o_orderstatus",
    "customer_count": "CASE WHEN o_orderstatus <> 'P' THEN lines END",
}


def work(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Jobs with the asked columns; what only the others need is not read."""
    columns = columns or tuple(WORK)
    df = table(spark, sf_dir, "orders")
    if {"end_ts", "customer_count"} & set(columns):
        lines = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                 .agg(F.sum("l_quantity").alias("hours"), F.max("l_linenumber").alias("lines")))
        df = df.join(lines, "o_orderkey", "left")
    if "location_id" in columns:
        nations = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey")
        df = df.join(nations, "o_custkey", "left")
    return conform(df.selectExpr("concat('op_', o_orderkey) AS work_id",
                                 *[f"{WORK[c]} AS {c}" for c in columns]), "work")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .selectExpr("n_nationkey AS s_nationkey", "r_name"))
    return conform(table(spark, sf_dir, "supplier").join(home, "s_nationkey").selectExpr(
        "concat('rs_', s_suppkey) AS resource_id", "r_name AS kind", "s_name AS name",
        "concat('lc_', s_nationkey) AS home_location_id"), "resources")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(table(spark, sf_dir, "lineitem").selectExpr(
        f"{LINE_KEY} AS assignment_id", "concat('rs_', l_suppkey) AS resource_id",
        "concat('op_', l_orderkey) AS work_id", "l_linestatus AS role", "l_shipdate AS start_ts",
        "l_shipdate + make_dt_interval(0, CAST(l_quantity AS INT)) AS end_ts"), "assignments")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('lc_', n_nationkey) AS location_id", "n_name AS name")


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS a", "n_regionkey")
    two = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS b", "n_regionkey")
    return one.join(two, "n_regionkey").filter("a <> b")


def location_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_pairs(spark, sf_dir).selectExpr(
        "concat('lc_', a) AS from_id", "concat('lc_', b) AS to_id",
        "CAST(15 + 5 * abs(a - b) AS INT) AS minutes", "(a + b) % 2 = 0 AS is_estimate")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a change; one that nobody sent back had no value before, and overrides nothing."""
    return conform(table(spark, sf_dir, "lineitem").selectExpr(
        f"concat('ch_', {LINE_KEY}) AS change_id", "'work' AS entity_table",
        "concat('op_', l_orderkey) AS entity_id", "concat('ovr_', l_returnflag, l_linestatus) AS field",
        "CASE WHEN l_returnflag <> 'N' AND l_tax > 0 THEN 'flagged' END AS old_value", "'acknowledged' AS new_value",
        "l_shipdate AS changed_at",
        "CASE WHEN l_discount > 0 THEN concat('u', l_suppkey % 7) END AS changed_by"), "changes")


def override_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labels of overrides say, for those whose words were kept."""
    return (table(spark, sf_dir, "lineitem").filter("l_linestatus <> 'F' OR l_returnflag = 'A'")
            .selectExpr("concat('ovr_', l_returnflag, l_linestatus) AS field",
                        "concat('flag ', l_returnflag, ' on ', l_linestatus) AS label").distinct())


def landing(spark: SparkSession, sf_dir: str, *work_columns: str) -> Landing:
    rest = {t.__name__: (lambda t=t: t(spark, sf_dir))
            for t in (resources, assignments, locations, location_travel, changes)}
    return Landing(work=lambda: work(spark, sf_dir, *work_columns), **rest)


# -- source export with text cells -----------------------------------------------------------

def record(column: str) -> str:
    return f"concat('rec', {padded(column, 14)})"


def linked(column: str) -> str:
    """A linked cell as a JSON list of objects."""
    return f"to_json(array(named_struct('id', {record(column)}, 'name', CAST({column} AS STRING))))"


def iso(column: str) -> str:
    return f"date_format({column}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def cells(df: DataFrame, **columns: str) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS `{c}`" for c, sql in columns.items()])


def export(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source records as an export writes them; the three link shapes all occur."""
    read = lambda name: table(spark, sf_dir, name)
    log = (f"concat('dbl-', {record('o_custkey')}, '-', lower(o_orderstatus), ' v2 :: u', o_custkey % 7, "
           "' :: ', date_format(o_orderdate, 'yyyy-MM-dd'), '\n\n', 'No crew ', substr(o_orderpriority, 1, 1))")
    line_id = f"concat('rec', {padded('l_orderkey', 10)}, {padded('l_linenumber', 4)})"
    return {
        "Daily Ops": cells(read("orders"), **{
            "id": record("o_orderkey"), "Trip type": "to_json(named_struct('name', o_orderpriority))",
            "Trip start": f"CASE WHEN o_orderstatus <> 'P' THEN {iso('o_orderdate')} END",
            "Trip end": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm')",
            "Date": "date_format(o_orderdate, 'yyyy-MM-dd')", "Status": "concat(' ', o_orderstatus, ' ')",
            "Guest count": "CAST(o_totalprice AS STRING)", "Lead Guide (link)": linked("o_custkey"),
            "Acknowledged conflicts": f"CASE WHEN o_orderstatus = 'F' THEN {log} END"}),
        "Movements": cells(read("events"), **{
            "id": record("event_id"), "Start": iso("ts"), "Movement Type": "to_json(array(event_type))",
            "Origin": f"concat({record('user_id % 25')}, ', recnone')", "Status": "event_type",
            "Passengers": "CAST(value AS STRING)"}),
        "Rig Assignments": cells(read("lineitem"), **{
            "id": line_id, "Daily Op": f"to_json(array({record('l_orderkey')}))", "Driver": linked("l_suppkey"),
            "Vehicle": f"concat({record('l_partkey')}, ' , ', {record('l_suppkey')})"}),
        "Guides & Staff": cells(read("supplier"), **{
            "id": record("s_suppkey"), "Name": "s_name",
            "Location base": "to_json(array(CAST(s_nationkey AS STRING)))"}),
        "Vehicles": cells(read("part"), **{
            "id": record("p_partkey"), "Unit name": "p_name",
            "Type": "CASE WHEN p_size > 5 THEN p_type END"}),
        "Locations": cells(read("nation"), **{"id": record("n_nationkey"), "Name": "n_name"}),
        "Routes": cells(nation_pairs(spark, sf_dir), **{
            "id": f"concat({record('a')}, {padded('b', 4)})", "From": linked("a"),
            "To": f"to_json(array({record('b')}))",
            "Drive minutes": "CASE WHEN b % 4 <> 3 THEN CAST(a * 10.5D + b AS STRING) ELSE 'unknown' END",
            "Sample count": "CAST(a % 3 AS STRING)"}),
    }


# -- score sheets ----------------------------------------------------------------------------

def known_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        f"concat('K', {padded('p_partkey', 9)}) AS key_id", "p_type AS type", "p_name AS statement",
        "CASE WHEN p_size % 5 = 0 THEN 'Head' ELSE p_brand END AS source",
        "CASE WHEN p_size <= 8 THEN 'seen; scope=interface' END AS notes")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a run: one for each order."""
    return _found(spark, sf_dir, "'c-'")


def found_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a run on thinner data: as many, every fourth by an id of its own."""
    return _found(spark, sf_dir, "CASE WHEN o_orderkey % 4 = 3 THEN 'd-' ELSE 'c-' END")


def _found(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"concat({prefix}, {padded('o_orderkey', 10)}) AS candidate_id",
        "concat('p0', substr(o_orderpriority, 1, 1)) AS probe", "o_orderpriority AS proposed_type",
        "concat('Order of ', date_format(o_orderdate, 'yyyy-MM-dd')) AS statement")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People leave blanks, tabs and line breaks around what they type."""
    return _verdicts(spark, sf_dir, "'c-'",
                     "CASE WHEN l_discount = 0.1D THEN ' \t' WHEN l_discount = 0.09D THEN 'MAYBE' "
                     "WHEN l_returnflag = 'A' THEN 'MATCH\t' WHEN l_returnflag = 'R' THEN '\nNEW' ELSE 'false' END")


def verdicts_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the thinner run: every line, judged by another column."""
    return _verdicts(spark, sf_dir, "CASE WHEN l_orderkey % 4 = 3 THEN 'd-' ELSE 'c-' END",
                     "CASE WHEN l_linestatus <> 'F' THEN 'FALSE' WHEN l_returnflag = 'A' THEN 'MATCH' ELSE 'NEW' END")


def _verdicts(spark: SparkSession, sf_dir: str, prefix: str, verdict: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{LINE_KEY} AS row_no",
        f"concat(CASE WHEN l_tax = 0.08D THEN 'gone-' ELSE {prefix} END, {padded('l_orderkey', 10)}) AS candidate_id",
        "CASE WHEN l_returnflag <> 'A' OR l_quantity = 1 THEN '' WHEN l_quantity = 50 THEN 'Kx' "
        f"ELSE concat('K', {padded('l_partkey', 9)}) END AS key_id",
        f"{verdict} AS verdict", "CASE WHEN l_tax > 0.04D THEN l_linestatus ELSE ' ' END AS note")


# -- message log -----------------------------------------------------------------------------

def event_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .selectExpr("*", "try_variant_get(try_parse_json(props), '$.k', 'int') AS k")
            .selectExpr(
                "event_id", "event_type", "CAST(value > 1 AS INT) AS entity_recoverable",
                "CAST(k < 80 AS INT) AS rule_recoverable", "CAST(user_id % 5 <> 0 AS INT) AS actor_recoverable",
                "CAST(value < 40 AS INT) AS lead_time_recoverable",
                "CASE WHEN k < 50 THEN 'high' WHEN k < 80 THEN 'medium' ELSE 'low' END AS confidence",
                "concat(event_type, ' ', k % 4) AS recurring_kind",
                "CASE WHEN value < 40 THEN value * 3 END AS lead_hours"))


def event_sheet_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass over the same events by a reader who finds less of them recoverable."""
    return event_sheet(spark, sf_dir).withColumns({
        "entity_recoverable": F.expr("CAST(lead_hours > 6 AS INT)"),
        "rule_recoverable": F.expr("CAST(confidence = 'high' AS INT)"),
        "confidence": F.expr("if(event_type = 'error', 'low', confidence)")})


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per channel. A channel is a conversation and its kind goes by the length."""
    return (table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.expr("count_if(role = 'user') AS human"),
        F.expr("count_if(role = 'user' AND length(text) > 60) AS operational"),
        F.expr("count_if(role <> 'user') AS automation"), F.count("*").alias("turns"))
        .selectExpr("concat('#c', conv_id) AS channel",
                    "CASE WHEN turns > 4 THEN 'long' WHEN turns > 2 THEN 'short' ELSE 'single' END AS kind",
                    "human", "operational", "automation"))
