"""The SQL each registered query is compared with, over the same tables."""

from __future__ import annotations


def padded(column: str, width: int) -> str:
    text = f"({column})::VARCHAR"
    return f"lpad({text}, greatest({width}, length({text}))::INT, '0')"


LINE = f"""concat_ws('-', {padded('l_orderkey', 10)}, {padded('l_linenumber', 2)},
  {padded('l_suppkey', 8)}, {padded('l_partkey', 9)},
  strftime(l_shipdate, '%Y%m%d'), {padded('l_quantity::INT', 3)})"""

WORK = """work AS (
  SELECT 'op_' || o.o_orderkey AS work_id, o_orderpriority AS work_type, o_orderdate AS start_ts,
         o_orderdate + to_hours(l.hours::BIGINT) AS end_ts, 'lc_' || c.c_nationkey AS location_id,
         o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN l.lines END AS customer_count
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS hours, max(l_linenumber) AS lines
             FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""
RESOURCES = """resources AS (
  SELECT 'rs_' || s_suppkey AS resource_id, r_name AS kind, s_name AS name,
         'lc_' || s_nationkey AS home_location_id
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
ASSIGNMENTS = f"""assignments AS (
  SELECT {LINE} AS assignment_id, 'rs_' || l_suppkey AS resource_id, 'op_' || l_orderkey AS work_id,
         l_linestatus AS role, l_shipdate AS start_ts,
         l_shipdate + to_hours(l_quantity::BIGINT) AS end_ts
  FROM lineitem)"""
LOCATIONS = """locations AS (SELECT 'lc_' || n_nationkey AS location_id, n_name AS name FROM nation)"""
TRAVEL = """location_travel AS (
  SELECT 'lc_' || a.n_nationkey AS from_id, 'lc_' || b.n_nationkey AS to_id
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""
CHANGES = f"""changes AS (
  SELECT 'ch_' || {LINE} AS change_id, 'work' AS entity_table, 'op_' || l_orderkey AS entity_id,
         'ovr_' || l_returnflag || l_linestatus AS field,
         CASE WHEN l_returnflag <> 'N' AND l_tax > 0 THEN 'flagged' END AS old_value, 'acknowledged' AS new_value,
         l_shipdate AS changed_at, CASE WHEN l_discount > 0 THEN 'u' || (l_suppkey % 7) END AS changed_by
  FROM lineitem)"""
LABELS = """labels AS (
  SELECT DISTINCT 'ovr_' || l_returnflag || l_linestatus AS field, 'flag ' || l_returnflag || ' on ' || l_linestatus AS label
  FROM lineitem WHERE l_linestatus <> 'F' OR l_returnflag = 'A')"""
ALL = [WORK, RESOURCES, ASSIGNMENTS, LOCATIONS, TRAVEL, CHANGES]
KEYS = f"""known_rules AS (
  SELECT 'K' || {padded('p_partkey', 9)} AS key_id, p_type AS type, p_name AS statement,
         CASE WHEN p_size % 5 = 0 THEN 'head' ELSE lower(p_brand) END AS source,
         CASE WHEN p_size <= 8 THEN 'interface' ELSE 'operating' END AS scope FROM part)"""


def _found(name: str, prefix: str) -> str:
    return f"""{name} AS (
  SELECT {prefix} || {padded('o_orderkey', 10)} AS candidate_id,
         'p0' || substr(o_orderpriority, 1, 1) AS probe, o_orderpriority AS proposed_type,
         'Order of ' || strftime(o_orderdate, '%Y-%m-%d') AS statement FROM orders)"""


def _verdicts(name: str, prefix: str, verdict: str) -> str:
    return f"""{name} AS (
  SELECT {LINE} AS row_no,
         CASE WHEN l_tax = 0.08 THEN 'gone-' ELSE {prefix} END || {padded('l_orderkey', 10)} AS candidate_id,
         CASE WHEN l_returnflag <> 'A' OR l_quantity = 1 THEN '' WHEN l_quantity = 50 THEN 'Kx'
              ELSE 'K' || {padded('l_partkey', 9)} END AS key_id,
         {verdict} AS verdict, CASE WHEN l_tax > 0.04 THEN l_linestatus ELSE '' END AS note
  FROM lineitem)"""


FOURTH = "CASE WHEN {}_orderkey % 4 = 3 THEN 'd-' ELSE 'c-' END"
FOUND, FOUND_LEAN = _found("found", "'c-'"), _found("found_lean", FOURTH.format("o"))
VERDICTS = _verdicts("verdicts", "'c-'", """CASE WHEN l_discount = 0.1 THEN '' WHEN l_discount = 0.09 THEN 'MAYBE'
              WHEN l_returnflag = 'A' THEN 'MATCH' WHEN l_returnflag = 'R' THEN 'NEW' ELSE 'FALSE' END""")
VERDICTS_LEAN = _verdicts("verdicts_lean", FOURTH.format("l"), """CASE WHEN l_linestatus <> 'F' THEN 'FALSE'
              WHEN l_returnflag = 'A' THEN 'MATCH' ELSE 'NEW' END""")


def judged(name: str = "judged", found: str = "found", given: str = "verdicts") -> str:
    return f"""{name}_rows AS (
  SELECT v.*, CASE WHEN f.candidate_id IS NULL THEN 'unknown candidate'
                   WHEN verdict NOT IN ('MATCH', 'NEW', 'FALSE') THEN 'bad verdict'
                   WHEN verdict = 'MATCH' AND v.key_id = '' THEN 'match without key'
                   WHEN v.key_id <> '' AND k.key_id IS NULL THEN 'unknown key' END AS fault
  FROM {given} v LEFT JOIN {found} f ON f.candidate_id = v.candidate_id
  LEFT JOIN known_rules k ON k.key_id = v.key_id
  WHERE f.candidate_id IS NULL OR verdict <> ''),
{name} AS (
  SELECT r.*, CASE WHEN fault IS NULL AND verdict <> first_verdict THEN 'verdicts disagree'
                   ELSE fault END AS problem
  FROM {name}_rows r LEFT JOIN (
    SELECT candidate_id, arg_min(verdict, row_no) AS first_verdict FROM {name}_rows
    WHERE fault IS NULL GROUP BY 1) USING (candidate_id)),
{name}_matched AS (SELECT DISTINCT key_id, candidate_id FROM {name}
                   WHERE problem IS NULL AND verdict = 'MATCH'),
{name}_recovery AS (SELECT *, (key_id IN (SELECT key_id FROM {name}_matched))::BIGINT AS hit FROM known_rules),
{name}_each AS (SELECT candidate_id, min(verdict) AS verdict,
                       count(DISTINCT CASE WHEN key_id <> '' THEN key_id END) AS keys
                FROM {name} WHERE problem IS NULL GROUP BY 1),
{name}_head AS (
  SELECT *, recall_hit / recall_total AS recall, (matched + novelty) / candidates AS precision FROM
    (SELECT count(*) FILTER (hit = 1 AND scope = 'operating') AS recall_hit,
            count(*) FILTER (scope = 'operating') AS recall_total,
            sum(hit) / count(*) AS recall_all FROM {name}_recovery),
    (SELECT count(*) FILTER (verdict = 'MATCH') AS matched, count(*) FILTER (verdict = 'NEW') AS novelty,
            count(*) FILTER (verdict = 'FALSE') AS "false", count(*) AS scored FROM {name}_each),
    (SELECT count(*) AS candidates FROM {found})),
{name}_recall AS (
  SELECT 'type' AS bucket, type AS value, sum(hit)::BIGINT AS recovered, count(*) AS total FROM {name}_recovery GROUP BY type
  UNION ALL SELECT 'source', source, sum(hit)::BIGINT, count(*) FROM {name}_recovery GROUP BY source
  UNION ALL SELECT 'scope', scope, sum(hit)::BIGINT, count(*) FROM {name}_recovery GROUP BY scope
  UNION ALL SELECT 'all', 'all', sum(hit)::BIGINT, count(*) FROM {name}_recovery)"""


def sql(body: str, *ctes: str) -> str:
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column.split('.')[-1]}"


ELIGIBLE = """eligible AS (
  SELECT a.*, r.kind, r.name FROM assignments a JOIN resources r USING (resource_id)
  WHERE resource_id IN (SELECT resource_id FROM assignments GROUP BY 1 HAVING count(*) >= 20))"""
PAIRS = """pairs AS (
  SELECT a.kind, a.resource_id, a.work_id AS a_work_id, b.work_id AS b_work_id,
         a.assignment_id AS a_assignment_id, b.assignment_id AS b_assignment_id,
         a.start_ts AS a_start, a.end_ts AS a_end, b.start_ts AS b_start, b.end_ts AS b_end
  FROM eligible a JOIN eligible b ON a.resource_id = b.resource_id AND a.assignment_id < b.assignment_id
   AND a.work_id <> b.work_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts)"""
VOLUMES = """kind_volumes AS (
  SELECT kind, count(*) FILTER (n >= 20) AS resources_over_floor, count(*) AS resources_total,
         coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT AS assignments_over_floor
  FROM (SELECT resource_id, count(*) AS n FROM assignments GROUP BY 1) JOIN resources USING (resource_id)
  GROUP BY 1)"""
GAPS = """gaps AS (
  SELECT *, date_diff('minute', end_ts, next_start) AS gap FROM (
    SELECT *, lead(start_ts) OVER w AS next_start, lead(work_id) OVER w AS next_work,
           lead(role) OVER w AS next_role
    FROM eligible WINDOW w AS (PARTITION BY resource_id ORDER BY start_ts, assignment_id))
  WHERE next_start IS NOT NULL AND date_diff('minute', end_ts, next_start) >= 0)"""
BINS = """bins AS (
  SELECT kind, gap // 5 * 5 AS edge, count(*) AS n FROM gaps GROUP BY 1, 2),
running AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY edge) AS upto,
                   sum(n) OVER (PARTITION BY kind) AS total FROM bins)"""
FLOORS = """floors AS (
  SELECT kind, min(edge) FILTER (upto > total * 0.01::DOUBLE) AS edge,
         coalesce(sum(n) FILTER (upto <= total * 0.01::DOUBLE), 0)::BIGINT AS below
  FROM running GROUP BY 1),
gap_spread AS (
  SELECT kind, count(*) AS observations, min(gap) AS least, list_sort(list(gap))[count(*) // 2 + 1] AS upper_median,
         max(gap) AS greatest, count(DISTINCT resource_id) AS resources_contributing FROM gaps GROUP BY 1),
turnaround AS (
  SELECT kind, observations, least, upper_median, greatest, edge, below, resources_contributing,
         CASE WHEN below = 0 THEN 'hard' ELSE 'soft' END AS floor
  FROM floors JOIN gap_spread USING (kind) WHERE observations >= 50 AND edge > 0)"""
BOOKED = [RESOURCES, ASSIGNMENTS, ELIGIBLE]
GAPPED = [*BOOKED, GAPS]

DISTRIBUTIONS = {
    "customers_per_work": "SELECT customer_count::BIGINT AS v FROM work WHERE customer_count IS NOT NULL",
    "resources_per_work": "SELECT count(DISTINCT resource_id) AS v FROM assignments GROUP BY work_id",
    "work_per_day": "SELECT count(*) AS v FROM work GROUP BY start_ts::DATE",
    "work_per_resource_per_day":
        "SELECT count(DISTINCT work_id) AS v FROM assignments GROUP BY resource_id, start_ts::DATE",
    "work_per_location_per_day": """SELECT count(*) AS v FROM work WHERE location_id IS NOT NULL
                                    GROUP BY location_id, start_ts::DATE""",
}
DISTRIBUTION = "distribution AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, v, count(*) AS n FROM ({body}) GROUP BY 1, 2"
    for d, body in DISTRIBUTIONS.items()) + ")"
SHAPES = """shapes AS (
  SELECT dimension, observed_max, observations, count_at_max, count_below_max, distinct_values,
         count_at_max / observations AS share_at_max, count_at_max / peak AS max_over_peak,
         CASE WHEN count_at_max / peak >= 0.5 THEN 'cliff' ELSE 'taper' END AS shape
  FROM (SELECT dimension, max(top) AS observed_max, sum(n)::BIGINT AS observations,
               sum(n) FILTER (v = top)::BIGINT AS count_at_max,
               coalesce(sum(n) FILTER (v = top - 1), 0)::BIGINT AS count_below_max,
               max(n) AS peak, count(*) AS distinct_values
        FROM (SELECT *, max(v) OVER (PARTITION BY dimension) AS top FROM distribution) GROUP BY 1)
  WHERE observations >= 50)"""

# For each dimension: the groups (key columns, grp, n) and the rows in them (key columns, item, at_ts, id).
DAY_OF = "strftime(start_ts, '%a %Y-%m-%d')"
CREWED = """SELECT coalesce(r.name, resource_id) AS who, coalesce(kind, 'unknown') AS kind, a.* FROM assignments a
  LEFT JOIN resources r USING (resource_id)"""
JOB = "coalesce(work_type, 'untyped') || '  ' || coalesce(strftime(start_ts, '%a %Y-%m-%d %H:%M'), 'no start')"
PEAKS = {
    "work_per_day": (["day"], "SELECT start_ts::DATE AS day, day::VARCHAR AS grp, count(*) AS n FROM work GROUP BY 1",
                     "SELECT start_ts::DATE AS day, work_type AS item, start_ts AS at_ts, work_id AS id FROM work"),
    "work_per_location_per_day": (
        ["place", "day"],
        """SELECT name AS place, start_ts::DATE AS day, place || '  ' || day AS grp, count(*) AS n
           FROM work JOIN locations USING (location_id) GROUP BY 1, 2""",
        """SELECT name AS place, start_ts::DATE AS day, work_type AS item, start_ts AS at_ts, work_id AS id
           FROM work JOIN locations USING (location_id)"""),
    "work_per_resource_per_day": (
        ["who", "kind", "day"],
        f"""SELECT who, kind, start_ts::DATE AS day, any_value(who || '  (' || kind || ')  ' || {DAY_OF}) AS grp,
           count(DISTINCT work_id) AS n FROM ({CREWED}) GROUP BY 1, 2, 3""",
        f"""SELECT who, kind, c.start_ts::DATE AS day, coalesce(work_type, 'untyped') || ' ' || strftime(c.start_ts, '%H:%M')
           || ' as ' || role AS item, c.start_ts AS at_ts, work_id AS id FROM ({CREWED}) c LEFT JOIN work USING (work_id)"""),
    "customers_per_work": (
        ["work_id"], f"SELECT work_id, {JOB} AS grp, customer_count::BIGINT AS n FROM work WHERE customer_count IS NOT NULL",
        "SELECT work_id, work_id AS item, start_ts AS at_ts, work_id AS id FROM work"),
    "resources_per_work": (
        ["work_id"],
        f"""SELECT work_id, {JOB} AS grp, n FROM work JOIN (
           SELECT work_id, count(DISTINCT resource_id) AS n FROM assignments GROUP BY 1) USING (work_id)""",
        f"SELECT work_id, who AS item, start_ts AS at_ts, work_id AS id FROM ({CREWED})"),
}


def peak(dimension: str, body: str, size: int = 5) -> str:
    keys, groups, rows = PEAKS[dimension]
    order = ", ".join(["n DESC", "grp", *keys])
    return sql(body, WORK, ASSIGNMENTS, RESOURCES, LOCATIONS, f"grps AS ({groups})", f"members AS ({rows})",
               f"top AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM grps ORDER BY {order} LIMIT {size})",
               f"shown AS (SELECT grp, n, position, item, at_ts, id FROM members JOIN top USING ({', '.join(keys)}))")


PEAK_ROWS = "SELECT grp, n, position, item, strftime(at_ts, '%Y-%m-%d %H:%M:%S') AS \"at\", id FROM shown"
PEAK_ITEMS = "SELECT grp, n, position, item, count(*) AS times FROM shown GROUP BY 1, 2, 3, 4"

FIELDS = ("work_type", "start_ts", "end_ts", "location_id", "status", "customer_count")
FILL = "fills AS (" + " UNION ALL ".join(
    f"""SELECT '{p}' AS partition, coalesce({p}::VARCHAR, '(blank)') AS value, '{f}' AS field,
        count(*) AS rows, count({f}) AS filled,
        (SELECT count({f}) FROM work) AS populated, (SELECT count(*) FROM work) AS rows_in_work
        FROM work GROUP BY 2 HAVING count(*) >= 10"""
    for p in ("work_type", "location_id", "status") for f in FIELDS if f != p) + """),
rates AS (SELECT *, filled / rows AS fill_rate FROM fills WHERE populated >= 50)"""
SHARP = """sharp AS (
  SELECT h.field, h.partition, h.value AS high_value, h.rows AS high_rows, h.filled AS high_filled,
         h.fill_rate AS high_fill_rate, l.value AS low_value, l.rows AS low_rows, l.filled AS low_filled,
         l.fill_rate AS low_fill_rate, t.parts AS partitions_over_row_floor, h.rows_in_work, h.populated
  FROM (SELECT *, row_number() OVER (PARTITION BY field, partition ORDER BY fill_rate DESC, rows DESC, value) AS rn
        FROM rates WHERE fill_rate >= 0.95) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY field, partition ORDER BY fill_rate, rows DESC, value) AS rn
        FROM rates WHERE fill_rate <= 0.05) l ON l.field = h.field AND l.partition = h.partition AND l.rn = 1
  JOIN (SELECT field, partition, count(*) AS parts FROM rates GROUP BY 1, 2) t
    ON t.field = h.field AND t.partition = h.partition
  WHERE h.rn = 1 AND t.parts >= 2)"""
FILL_WORDS = """fill_words AS (
  SELECT 'p05' AS probe, 'p05-population-' || replace(field || '-by-' || partition, '_', '-') AS candidate_id,
         'dependency' AS proposed_type,
         'When ' || partition || ' is ''' || high_value || ''', ' || field || ' is filled in almost every time ('
         || high_filled || ' of ' || high_rows || '). When it is ''' || low_value
         || ''', it is almost never filled in (' || low_filled || ' of ' || low_rows || '). Is ' || field
         || ' required for one and not the other?' AS statement FROM sharp
  UNION ALL
  SELECT 'p05', 'p05-exemption-' || trim(regexp_replace(lower(field || '-by-' || partition || '-' || low_value), '[^a-z0-9]+', '-', 'g'), '-'),
         'exemption', field || ' is essentially never filled in when ' || partition || ' is ''' || low_value
         || ''' (' || low_filled || ' of ' || low_rows || '), though it is filled in elsewhere. Is that case exempt from needing '
         || field || '?' FROM sharp)"""

RANK = """ranked AS (
  SELECT entity_table, field, count(*) AS events, count(DISTINCT entity_id) AS entities,
         count(DISTINCT changed_by) AS actors, min(changed_at) AS first_seen, max(changed_at) AS last_seen,
         row_number() OVER (ORDER BY count(*) DESC, entity_table, field) AS rank,
         (SELECT count(*) FROM changes) AS all_changes
  FROM changes WHERE old_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"""
LEADS = """leads AS (
  SELECT entity_table, field, count(*) AS n, min(d) AS min_days, list_sort(list(d))[count(*) // 2 + 1] AS median_days,
         max(d) AS max_days, count(*) FILTER (d <= 0) AS same_day_or_later
  FROM (SELECT c.*, date_diff('day', changed_at, start_ts) AS d FROM changes c JOIN work ON work_id = entity_id)
  GROUP BY 1, 2)"""
OF_FIELD = "of_field AS (SELECT * FROM changes WHERE field = 'ovr_AF')"
TOUCHED = f"""{OF_FIELD}, touched AS (SELECT DISTINCT entity_id AS work_id FROM of_field),
sizes AS (SELECT (SELECT count(*) FROM touched) AS touched_jobs,
                 (SELECT count(*) FROM work WHERE work_id IN (SELECT work_id FROM assignments)) AS all_jobs)"""


def record(column: str) -> str:
    return f"('rec' || {padded(column, 14)})"


def opaque(prefix: str, *parts: str) -> str:
    joined = " || chr(31) || ".join(f"coalesce(({p})::VARCHAR, 'None')" for p in parts)
    return f"'{prefix}' || substr(sha256({joined}), 1, 12)"


LANDED_WORK = f"""landed_work AS (
  SELECT 'op_' || {record('o_orderkey')} AS work_id, o_orderpriority AS work_type, o_orderdate AS start_ts,
         o_orderdate AS end_ts, NULL::VARCHAR AS location_id, o_orderstatus AS status,
         trunc(o_totalprice)::INT AS customer_count, {record('o_orderkey')} AS source_id FROM orders
  UNION ALL
  SELECT 'mv_' || {record('event_id')}, event_type, date_trunc('second', ts), NULL,
         'lc_' || {record('user_id % 25')}, event_type, trunc(value)::INT, {record('event_id')} FROM events)"""
LANDED_CREW = f"""crew AS (
  SELECT 'op_' || {record('o_orderkey')} AS work_id, 'gs_' || {record('o_custkey')} AS resource_id,
         'Lead Guide (link)' AS role, {record('o_orderkey')} AS source_id FROM orders
  UNION ALL SELECT 'op_' || {record('l_orderkey')}, 'gs_' || {record('l_suppkey')}, 'Driver',
         'rec' || {padded('l_orderkey', 10)} || {padded('l_linenumber', 4)} FROM lineitem
  UNION ALL SELECT 'op_' || {record('l_orderkey')}, 'vh_' || {record('l_partkey')}, 'Vehicle',
         'rec' || {padded('l_orderkey', 10)} || {padded('l_linenumber', 4)} FROM lineitem
  UNION ALL SELECT 'op_' || {record('l_orderkey')}, 'vh_' || {record('l_suppkey')}, 'Vehicle',
         'rec' || {padded('l_orderkey', 10)} || {padded('l_linenumber', 4)} FROM lineitem)"""
LOG = f"""log AS (
  SELECT 'op_' || {record('o_orderkey')} AS entity_id, {record('o_orderkey')} AS source_id,
         'dbl ' || lower(o_orderstatus) || ' v' AS label, 'u' || (o_custkey % 7) AS who, o_orderdate AS seen,
         strftime(o_orderdate, '%Y-%m-%d') AS said
  FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'op_' || {record('o_orderkey')}, {record('o_orderkey')}, 'no crew', NULL, NULL, NULL
  FROM orders WHERE o_orderstatus = 'F')"""

SHEET = """sheet AS (
  SELECT *, (value > 1)::INT AS entity, (k < 80)::INT AS rule, (user_id % 5 <> 0)::INT AS actor,
         (value < 40)::INT AS lead_time,
         CASE WHEN k < 50 THEN 'high' WHEN k < 80 THEN 'medium' ELSE 'low' END AS confidence,
         event_type || ' ' || (k % 4) AS recurring_kind, CASE WHEN value < 40 THEN value * 3 END AS lead_hours
  FROM (SELECT *, (props::JSON ->> '$.k')::INT AS k FROM events))"""
VOLUME = """volume AS (
  SELECT '#c' || conv_id AS channel,
         CASE WHEN count(*) > 4 THEN 'long' WHEN count(*) > 2 THEN 'short' ELSE 'single' END AS kind,
         count(*) FILTER (role = 'user') AS human,
         count(*) FILTER (role = 'user' AND length(text) > 60) AS operational,
         count(*) FILTER (role <> 'user') AS automation FROM conversations GROUP BY conv_id)"""


def rates(source: str, messages: str) -> str:
    return f"""SELECT count(*) AS events, count(*) FILTER (confidence = 'high') AS high,
      count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
      avg(entity) * 100 AS entity, avg(rule) * 100 AS rule, avg(actor) * 100 AS actor,
      avg(lead_time) * 100 AS lead_time, ({messages})::BIGINT AS messages,
      count(*) FILTER (confidence = 'high') * 100 / ({messages})::BIGINT AS high_per_100,
      count(*) * 100 / ({messages})::BIGINT AS all_per_100 FROM {source}"""


HUMAN = "SELECT sum(operational) FROM volume"
GAP_MEASURES = ("messages", "events", "high", "high_per_100", "all_per_100", "entity", "rule", "actor",
                "lead_time")

SCORE = [KEYS, FOUND, VERDICTS, judged()]
DELTA = [KEYS, FOUND, VERDICTS, FOUND_LEAN, VERDICTS_LEAN, judged("rich"),
         judged("lean", "found_lean", "verdicts_lean")]

STATEMENTS = f"""
  SELECT 'p03' AS probe, 'p03-exclusivity-' || replace(lower(kind), ' ', '-') AS candidate_id, 'exclusivity' AS proposed_type,
         'A ' || kind || ' is sometimes booked on two jobs whose times overlap. This happened ' || count(*)
         || ' times across ' || count(DISTINCT resource_id)
         || ' of them. Is the overlap allowed, or are these mistakes?' AS statement FROM pairs GROUP BY kind
  UNION ALL
  SELECT 'p03', 'p03-turnaround-' || replace(lower(kind), ' ', '-'), 'turnaround', 'After a ' || kind
         || ' finishes a job, at least ' || edge || ' minutes ' || CASE WHEN below = 0
         THEN 'always passes before it starts the next one. Across ' || observations
              || ' consecutive pairs there is not one exception. Is ' || edge || ' minutes a required turnaround?'
         ELSE 'almost always passes before it starts the next one: ' || (observations - below) || ' of ' || observations
              || ' consecutive pairs. The ' || below || ' exception(s) go as low as ' || least || ' minutes. Is ' || edge
              || ' minutes a required turnaround that got broken those times, or is there no minimum?' END FROM turnaround
  UNION ALL
  SELECT 'p04', 'p04-ceiling-' || replace(dimension, '_', '-'), 'capacity', 'The number of ' || phrase
         || CASE WHEN shape = 'cliff' THEN ' never goes above ' || observed_max || '. It reaches ' || observed_max
              || ' ' || count_at_max || ' times out of ' || observations || ' and never once goes higher. Is '
              || observed_max || ' a limit somebody set?'
            ELSE ' tops out at ' || observed_max || ', but only ' || count_at_max || ' times out of ' || observations
              || ', and the numbers just below it thin out gradually. Is ' || observed_max
              || ' a limit, or just the busiest it ever got?' END
  FROM shapes JOIN (VALUES ('customers_per_work', 'guests on one job'),
    ('resources_per_work', 'resources assigned to one job'), ('work_per_day', 'jobs on one day'),
    ('work_per_resource_per_day', 'jobs for one resource on one day'),
    ('work_per_location_per_day', 'jobs at one location on one day')) p(dimension, phrase) USING (dimension)
  UNION ALL SELECT * FROM fill_words
  UNION ALL
  SELECT 'p08', 'p08-override-work-' || replace(lower(field), '_', '-'), 'any', 'Somebody went back and changed '
         || field || ' on ' || entities || ' work records, ' || events || ' times in all, after it had already been set.'
         || ' Typically ' || median_days || ' day(s) before the job, and ' || same_day_or_later
         || ' of them on the day or after. What is the system getting wrong that keeps needing this?'
  FROM ranked JOIN leads USING (entity_table, field)"""


def dashed(head: str, value: str) -> str:
    return f"'{head}' || trim(regexp_replace(lower({value}), '[^a-z0-9]+', '-', 'g'), '-')"


REQUIRED = dashed("p05-population-", "field || '-by-' || partition")
OVERRIDE = dashed("p08-override-", "entity_table || '-' || field")

ORACLE: dict[str, str] = {
    # bookings
    "overlap_pairs": sql(f"""SELECT kind, resource_id, a_work_id, b_work_id, a_assignment_id, b_assignment_id,
        {ts('a_start', 'a_start_ts')}, {ts('a_end', 'a_end_ts')}, {ts('b_start', 'b_start_ts')},
        {ts('b_end', 'b_end_ts')} FROM pairs
        WHERE DATE '1997-05-28' IN (a_start::DATE, b_start::DATE)""", *BOOKED, PAIRS),
    "overlap_job_pairs": sql("""SELECT kind, count(*) AS overlapping_pairs, count(DISTINCT resource_id || ' '
        || least(a_work_id, b_work_id) || ' ' || greatest(a_work_id, b_work_id)) AS distinct_job_pairs
        FROM pairs GROUP BY 1""", *BOOKED, PAIRS),
    "exclusivity_by_kind": sql("""SELECT v.*, coalesce(overlapping_pairs, 0) AS overlapping_pairs,
        coalesce(resources_with_an_overlap, 0) AS resources_with_an_overlap
        FROM kind_volumes v LEFT JOIN (SELECT kind, count(*) AS overlapping_pairs,
          count(DISTINCT resource_id) AS resources_with_an_overlap FROM pairs GROUP BY 1) USING (kind)
        WHERE resources_over_floor > 0 AND assignments_over_floor >= 50""", *BOOKED, PAIRS, VOLUMES),
    "exclusivity_examples": sql(f"""SELECT kind, position::INT AS position, resource_id, a_work_id AS work_id_a,
        b_work_id AS work_id_b, {ts('a_start')}, {ts('a_end')}, {ts('b_start')}, {ts('b_end')}
        FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY resource_id, a_start, b_start, a_work_id,
          b_work_id, a_assignment_id, b_assignment_id) AS position FROM pairs) WHERE position <= 10""",
        *BOOKED, PAIRS),
    "kind_volumes": sql("SELECT * FROM kind_volumes", RESOURCES, ASSIGNMENTS, VOLUMES),
    "gaps_by_kind": sql("SELECT kind, gap AS gap_minutes, count(*) AS n FROM gaps GROUP BY 1, 2", *GAPPED),
    "gap_histogram": sql("""SELECT kind, e AS edge, coalesce(n, 0) AS n FROM (
          SELECT kind, unnest(generate_series(0, max(edge), 5)) AS e FROM bins GROUP BY 1)
        LEFT JOIN (SELECT kind, edge AS e, n FROM bins) USING (kind, e)""", *GAPPED, BINS),
    "turnaround_floor": sql("SELECT * FROM turnaround", *GAPPED, BINS, FLOORS),
    "tight_gaps": sql(f"""SELECT gap AS gap_minutes, g.name, g.kind, {ts('g.end_ts')}, {ts('next_start')},
        coalesce(wa.work_type, 'untyped') AS finished, g.work_id, g.role,
        coalesce(wb.work_type, 'untyped') AS started, next_work, next_role
        FROM gaps g LEFT JOIN work wa ON wa.work_id = g.work_id LEFT JOIN work wb ON wb.work_id = next_work
        WHERE gap < 600""", *GAPPED, WORK),
    "tight_gaps_of_kind": sql("""SELECT gap AS gap_minutes, name, kind, work_id, next_work FROM gaps
        WHERE gap < 2000 AND lower(kind) = 'asia'""", *GAPPED),

    # ceilings and peaks
    **{f"ceiling_{d}": sql(f"SELECT * FROM shapes WHERE dimension = '{d}'", WORK, ASSIGNMENTS,
                           DISTRIBUTION, SHAPES) for d in DISTRIBUTIONS},
    **{f"peak_{d}": peak(d, PEAK_ITEMS) for d in PEAKS},
    **{f"peak_rows_{d}": peak(d, PEAK_ROWS) for d in PEAKS},
    "ceiling_distribution": sql("SELECT * FROM distribution", WORK, ASSIGNMENTS, DISTRIBUTION),
    "peak_rows_per_day": peak("work_per_day", PEAK_ROWS, 3),

    # population
    "fill_rates": sql("SELECT partition, value, field, rows, filled, fill_rate FROM rates", WORK, FILL),
    "population_pairs": sql("SELECT * FROM sharp", WORK, FILL, SHARP),
    "population_statements": sql("SELECT * FROM fill_words", WORK, FILL, SHARP, FILL_WORDS),

    # overrides
    "override_rank": sql(f"""SELECT entity_table, field, events, entities, actors, {ts('first_seen')},
        {ts('last_seen')}, rank, all_changes FROM ranked""", CHANGES, RANK),
    "override_actors": sql("""SELECT entity_table, field, coalesce(changed_by, '(unrecorded)') AS changed_by,
        count(*) AS events FROM changes WHERE old_value IS NOT NULL GROUP BY 1, 2, 3""", CHANGES),
    "override_lead_times": sql("SELECT * FROM leads", WORK, CHANGES, LEADS),
    "override_list": sql(f"""SELECT field, field AS label, count(*) AS events, count(DISTINCT entity_id) AS entities,
        count(DISTINCT changed_by) AS actors, {ts('min(changed_at)', 'first_seen')},
        {ts('max(changed_at)', 'last_seen')} FROM changes GROUP BY 1 ORDER BY events DESC, field LIMIT 3""", CHANGES),
    "override_list_labelled": sql(f"""SELECT field, coalesce(label, field) AS label, events, entities, actors, first_seen, last_seen
        FROM (SELECT field, count(*) AS events, count(DISTINCT entity_id) AS entities, count(DISTINCT changed_by) AS actors,
              {ts('min(changed_at)', 'first_seen')}, {ts('max(changed_at)', 'last_seen')} FROM changes
              GROUP BY 1 ORDER BY events DESC, field LIMIT 5) LEFT JOIN labels USING (field)""", CHANGES, LABELS),
    "override_tail": sql("""SELECT count(*) FILTER (rn > 3) AS labels_left_out,
        coalesce(sum(events) FILTER (rn > 3), 0)::BIGINT AS events_left_out, sum(events)::BIGINT AS all_events
        FROM (SELECT field, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, field) AS rn
              FROM changes GROUP BY 1)""", CHANGES),
    "override_changes": sql(f"""SELECT {ts('changed_at')}, coalesce(changed_by, 'unknown') AS changed_by,
        entity_id AS work_id, 'Daily Ops' AS source, coalesce(work_type, 'untyped') AS work_type, {ts('start_ts')},
        date_diff('day', changed_at, start_ts)::INT AS lead_days, customer_count::DOUBLE AS customer_count, old_value, new_value
        FROM of_field LEFT JOIN work ON work_id = entity_id""", WORK, CHANGES, OF_FIELD),
    "override_crew": sql("""SELECT work_id, coalesce(r.name, a.resource_id) AS resource, coalesce(r.kind, '?') AS kind,
        string_agg(DISTINCT role, ', ' ORDER BY role) AS roles
        FROM assignments a LEFT JOIN resources r USING (resource_id)
        WHERE work_id IN (SELECT work_id FROM touched) GROUP BY 1, 2, 3""", WORK, RESOURCES, ASSIGNMENTS, CHANGES, TOUCHED),
    "override_kind_lift": sql("""SELECT kind, jobs_here, jobs_everywhere, jobs_here / touched_jobs AS share_here,
        jobs_everywhere / all_jobs AS share_everywhere, (jobs_here / touched_jobs >= 2 * jobs_everywhere / all_jobs
          AND jobs_here / touched_jobs >= 0.5)::INT AS more_common_here
        FROM (SELECT kind, count(DISTINCT work_id) AS jobs_everywhere,
                     count(DISTINCT CASE WHEN work_id IN (SELECT work_id FROM touched) THEN work_id END) AS jobs_here
              FROM assignments LEFT JOIN resources USING (resource_id) GROUP BY 1), sizes WHERE jobs_here > 0""",
        WORK, RESOURCES, ASSIGNMENTS, CHANGES, TOUCHED),
    "override_top_resources": sql("""SELECT resource_id, name AS resource, kind, jobs_here, jobs_everywhere,
        jobs_here / touched_jobs AS share_here, jobs_everywhere / all_jobs AS share_everywhere
        FROM (SELECT resource_id, count(DISTINCT work_id) AS jobs_everywhere,
                     count(DISTINCT CASE WHEN work_id IN (SELECT work_id FROM touched) THEN work_id END) AS jobs_here
              FROM assignments GROUP BY 1) JOIN resources USING (resource_id), sizes
        ORDER BY jobs_here DESC, resource_id LIMIT 8""", WORK, RESOURCES, ASSIGNMENTS, CHANGES, TOUCHED),
    "override_sources": sql("SELECT 'Daily Ops' AS source, count(*) AS changes FROM of_field", CHANGES, OF_FIELD),
    "override_repeats": sql(f"""SELECT work_id, times, work_type, {ts('start_ts')} FROM (
        SELECT entity_id AS work_id, count(*) AS times FROM of_field GROUP BY 1 HAVING count(*) > 1)
        JOIN work USING (work_id)""", WORK, CHANGES, OF_FIELD),
    "override_overlap_rate": sql("""SELECT *, overlap_here / touched_jobs AS share_here,
        overlap_everywhere / all_jobs AS share_everywhere FROM (
          SELECT count(DISTINCT a.work_id) AS overlap_everywhere,
                 count(DISTINCT CASE WHEN a.work_id IN (SELECT work_id FROM touched) THEN a.work_id END) AS overlap_here
          FROM assignments a JOIN assignments b ON a.resource_id = b.resource_id AND a.work_id <> b.work_id
           AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts), sizes""", WORK, ASSIGNMENTS, CHANGES, TOUCHED),

    # landing tables
    "landing_volumes": sql(" UNION ALL ".join(
        f"SELECT '{t}' AS landing_table, count(*) AS rows FROM {t}"
        for t in ("work", "resources", "assignments", "locations", "location_travel", "changes")), *ALL),
    "lean_volumes": sql(" UNION ALL ".join(
        f"SELECT '{t}' AS landing_table, {n} AS rows FROM {t}" for t, n in
        (("work", "count(*)"), ("resources", "count(*)"), ("assignments", "count(*)"), ("locations", "count(*)"),
         ("location_travel", "0 * count(*)"), ("changes", "0 * count(*)"))), *ALL),
    "lean_fill": sql("""SELECT status, count(*) AS rows, 0::BIGINT AS location_id,
        count(customer_count) AS customer_count FROM work GROUP BY 1""", WORK),
    "landing_repeated_keys": """SELECT 'assignments' AS landing_table, sha256(text) AS key, count(*) AS rows
        FROM documents GROUP BY 2 HAVING count(*) > 1""",
    "day_sheet": sql(f"""SELECT w.work_id, work_type, {ts('w.start_ts')}, {ts('w.end_ts')}, customer_count::DOUBLE AS customer_count, status,
        coalesce(l.name, '') AS place, r.name AS resource, r.kind, a.role
        FROM work w LEFT JOIN locations l USING (location_id) LEFT JOIN assignments a ON a.work_id = w.work_id
        LEFT JOIN resources r USING (resource_id) WHERE w.start_ts::DATE = DATE '1997-05-28'""",
        WORK, LOCATIONS, ASSIGNMENTS, RESOURCES),
    "names_of_ids": sql("""SELECT resource_id AS id, name || ' (' || kind || ')' AS label FROM resources
        UNION ALL SELECT work_id, work_type || ' on ' || strftime(start_ts, '%a %Y-%m-%d %H:%M') FROM work
        UNION ALL SELECT location_id, name FROM locations""", WORK, RESOURCES, LOCATIONS),
    "described_bookings": sql(f"""SELECT assignment_id, resource_id AS value,
          name || ' (' || kind || ')  [' || resource_id || ']' AS shown FROM assignments JOIN resources USING (resource_id)
        UNION ALL SELECT assignment_id, {ts('start_ts', 'value')}, strftime(start_ts, '%a %Y-%m-%d %H:%M:%S')
        FROM assignments""", ASSIGNMENTS, RESOURCES),

    # ingestion
    "landed_work": sql(f"""SELECT work_id, work_type, {ts('start_ts')}, {ts('end_ts')}, location_id, status,
        customer_count::DOUBLE AS customer_count, 'airtable' AS source_system, source_id, '2026-01-01 00:00:00' AS extracted_at
        FROM landed_work""", LANDED_WORK),
    "landed_resources": sql(f"""SELECT 'gs_' || {record('s_suppkey')} AS resource_id, 'person' AS kind, s_name AS name,
          s_nationkey::VARCHAR AS home_location_id, {record('s_suppkey')} AS source_id FROM supplier
        UNION ALL SELECT 'vh_' || {record('p_partkey')}, CASE WHEN p_size > 5 THEN p_type END, p_name, NULL,
          {record('p_partkey')} FROM part"""),
    "landed_resources_lean": sql(f"""SELECT 'gs_' || {record('s_suppkey')} AS resource_id, 'person' AS kind,
          s_name AS name, NULL::VARCHAR AS home_location_id FROM supplier
        UNION ALL SELECT 'vh_' || {record('p_partkey')}, 'vehicle', p_name, NULL FROM part"""),
    "landed_assignments": sql(f"""SELECT {opaque('as_', 'work_id', 'resource_id', 'role')} AS assignment_id,
        resource_id, work_id, role, {ts('start_ts')}, {ts('end_ts')}, c.source_id
        FROM (SELECT work_id, resource_id, role, min(source_id) AS source_id FROM crew GROUP BY 1, 2, 3) c
        LEFT JOIN landed_work w USING (work_id)""", LANDED_WORK, LANDED_CREW),
    "landed_work_lean": sql(f"""SELECT work_id, work_type, {ts('start_ts')}, {ts('end_ts')}, NULL::VARCHAR AS location_id, status,
        customer_count::DOUBLE AS customer_count FROM landed_work WHERE starts_with(work_id, 'op_')""", LANDED_WORK),
    "landed_assignments_lean": sql(f"""SELECT {opaque('as_', 'work_id', 'resource_id', 'role')} AS assignment_id,
        resource_id, work_id, role, {ts('start_ts')}, {ts('end_ts')}, c.source_id
        FROM (SELECT * FROM crew WHERE role = 'Lead Guide (link)') c
        LEFT JOIN landed_work w USING (work_id)""", LANDED_WORK, LANDED_CREW),
    "landed_locations": sql(f"SELECT 'lc_' || {record('n_nationkey')} AS location_id, n_name AS name FROM nation"),
    "landed_travel": sql(f"""SELECT 'lc_' || {record('a.n_nationkey')} AS from_id, 'lc_' || {record('b.n_nationkey')} AS to_id,
        trunc(a.n_nationkey * 10.5 + b.n_nationkey)::INT AS minutes, (a.n_nationkey % 3 = 0)::INT AS is_estimate
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
        WHERE b.n_nationkey % 4 <> 3"""),
    "landed_changes": sql(f"""SELECT {opaque('ch_', 'entity_id', 'field', 'who', 'said')} AS change_id,
        'work' AS entity_table, entity_id, field, 'flagged' AS old_value, 'acknowledged' AS new_value,
        {ts('seen', 'changed_at')}, who AS changed_by, source_id
        FROM (SELECT *, {opaque('ovr_', 'label')} AS field FROM log)""", LOG),
    "override_labels": sql(f"SELECT DISTINCT {opaque('ovr_', 'label')} AS field, label FROM log", LOG),
    "parsed_links": sql(f"""SELECT {LINE} AS line, CASE WHEN l_linenumber % 5 < 3 THEN 2 ELSE 0 END::INT AS links,
        CASE WHEN l_linenumber % 5 < 3 THEN {record('l_suppkey')} END AS first_id,
        CASE WHEN l_linenumber % 5 < 3 THEN {record('l_partkey')} END AS second_id FROM lineitem"""),
    "parsed_log_lines": sql(f"""SELECT {LINE} AS line, l_returnflag AS label,
        CASE WHEN l_linenumber % 3 <> 0 THEN 'a :: u' || l_suppkey END AS who,
        CASE WHEN l_linenumber % 3 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS "when" FROM lineitem"""),
    "parsed_cells": sql("""SELECT event_id, CASE event_id % 7 WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
          WHEN 5 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 6 THEN NULL
          ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed_ts,
        trunc(value)::INT AS parsed_int, NULL::VARCHAR AS scalar_of_props, event_type AS scalar_of_list,
        strftime(ts, '%a %Y-%m-%d %H:%M') AS shown FROM events"""),
    "opaque_ids": sql(f"""SELECT o_orderkey, {opaque('as_', 'o_orderkey',
        'CASE WHEN o_custkey % 3 > 0 THEN o_custkey END', 'o_orderstatus')} AS opaque FROM orders"""),
    "label_classes": sql("""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(text),
          '(mv_|op_)?rec[a-z0-9]{14}', '', 'g'), '[^a-z]+', ' ', 'g')), ''), 'unlabelled') AS label,
        CASE WHEN length(s) > 48 THEN substr(s, 1, 40) || '-' || substr(sha256(s), 1, 7)
             WHEN s = '' THEN 'unnamed' ELSE s END AS slug
        FROM (SELECT *, lower(trim(regexp_replace(source || '_' || text, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS s
              FROM documents)"""),
    "denied_sources": sql("""SELECT name, norm, rule, count(*) AS n FROM (
          SELECT CASE page_id % 3 WHEN 0 THEN 'Config / Thresholds' ELSE 'Old Dispatch-Board ' END || suffix AS name,
                 CASE page_id % 3 WHEN 0 THEN 'config thresholds' ELSE 'old dispatch board'
                   || CASE WHEN suffix = '.JSON' THEN '' ELSE ' ' || page_id END END AS norm,
                 CASE page_id % 3 WHEN 0 THEN 'config thresholds' ELSE 'dispatch board' END AS rule
          FROM pages, LATERAL (SELECT unnest([page_id || '.csv', '.JSON']) AS suffix)
          WHERE page_id % 3 = 1 OR (page_id % 3 = 0 AND suffix = '.JSON')) GROUP BY 1, 2, 3"""),
    "record_links": sql(f"""SELECT p || {record('o_orderkey')} AS id, CASE p WHEN 'op_' THEN
          'https://airtable.com/appBase/tblOrders/' || {record('o_orderkey')} WHEN 'mv_' THEN
          'https://airtable.com/appBase/tblEvents/' || {record('o_orderkey')} END AS url,
        CASE p WHEN 'op_' THEN 'Daily Ops' WHEN 'mv_' THEN 'Movements' ELSE 'other' END AS source
        FROM (SELECT o_orderkey, ['op_', 'mv_', 'zz_'][o_orderkey % 3 + 1] AS p FROM orders)"""),
    "manifest_latest": sql("""SELECT source || '/' || lang AS path, arg_max(sha256(text), doc_id) AS recorded
        FROM documents WHERE doc_id % 10 <> 9 GROUP BY 1"""),

    # scoring
    "score_headline": sql("""SELECT recall_hit, recall_total, recall, recall_all, matched, novelty, "false", scored,
        candidates - scored AS unscored, candidates, precision FROM judged_head""", *SCORE),
    "score_recall": sql("SELECT * FROM judged_recall", *SCORE),
    "score_memory_split": sql("""SELECT CASE WHEN source = 'head' THEN 'recalled' ELSE 'document' END AS origin,
        sum(hit)::BIGINT AS recovered, count(*) AS total FROM judged_recovery GROUP BY 1""", *SCORE),
    "score_problems": sql("""SELECT row_no, candidate_id, key_id, verdict, problem,
        CASE WHEN problem = 'verdicts disagree' THEN first_verdict END AS first_verdict
        FROM judged WHERE problem IS NOT NULL""",
        KEYS, FOUND, VERDICTS, judged().replace("SELECT r.*, CASE WHEN fault", "SELECT r.*, first_verdict, CASE WHEN fault", 1)),
    "score_new_finds": sql("""SELECT candidate_id, proposed_type, statement, note, row_no FROM (
        SELECT candidate_id, proposed_type, statement, note, min(row_no) AS row_no,
               max(note) OVER (PARTITION BY candidate_id) AS any_note
        FROM judged JOIN found USING (candidate_id) WHERE problem IS NULL AND verdict = 'NEW'
        GROUP BY 1, 2, 3, 4) WHERE note <> '' OR any_note = ''""", *SCORE),
    "score_covered_keys": sql("SELECT key_id, candidate_id FROM judged_matched WHERE key_id <> ''", *SCORE),
    "score_unrecovered": sql("SELECT key_id, type, statement FROM judged_recovery WHERE hit = 0", *SCORE),
    "score_multi_cover": sql("SELECT candidate_id, keys FROM judged_each WHERE keys > 1", *SCORE),
    "candidates_per_probe": sql("SELECT probe, count(*) AS candidates FROM found GROUP BY 1", FOUND),
    "unjudged": sql("""SELECT candidate_id, probe FROM found WHERE candidate_id NOT IN (
        SELECT candidate_id FROM verdicts WHERE verdict <> '')""", FOUND, VERDICTS),
    "verdict_sheet": sql("""SELECT f.candidate_id, coalesce(key_id, '') AS key_id,
        CASE WHEN v.verdict = 'FALSE' THEN 'false' ELSE coalesce(v.verdict, '') END AS verdict, coalesce(note, '') AS note
        FROM found f LEFT JOIN (SELECT * FROM verdicts WHERE verdict <> '') v USING (candidate_id)""", FOUND, VERDICTS),

    # run comparison
    "delta_headline": sql(" UNION ALL ".join(
        f"""SELECT '{m}' AS measure, r.{m}::DOUBLE AS rich, l.{m}::DOUBLE AS lean,
        l.{m}::DOUBLE - r.{m}::DOUBLE AS change FROM rich_head r, lean_head l"""
        for m in ("recall", "precision", "novelty", "candidates")), *DELTA),
    "delta_survival": sql("""SELECT bucket, value, r.recovered AS rich_recovered, l.recovered AS lean_recovered,
        r.total, CASE WHEN r.recovered > 0 AND l.recovered >= r.recovered THEN 'yes'
          WHEN r.recovered > 0 AND l.recovered > 0 THEN 'partly' WHEN r.recovered > 0 THEN 'lost entirely'
          WHEN l.recovered > 0 THEN 'only in the leaner run' ELSE 'neither run found it' END AS survives
        FROM rich_recall r JOIN lean_recall l USING (bucket, value) WHERE bucket IN ('type', 'source')""", *DELTA),
    "delta_moved_keys": sql("""SELECT key_id, type, statement, found_by, moved FROM known_rules JOIN (
          SELECT key_id, candidate_id AS found_by, 'lost' AS moved FROM rich_matched
          WHERE key_id NOT IN (SELECT key_id FROM lean_matched)
          UNION ALL SELECT key_id, candidate_id, 'gained' FROM lean_matched
          WHERE key_id NOT IN (SELECT key_id FROM rich_matched)) USING (key_id)""", *DELTA),
    "delta_candidates": sql("""SELECT candidate_id, 'rich' AS only_in FROM found
        WHERE candidate_id NOT IN (SELECT candidate_id FROM found_lean)
        UNION ALL SELECT candidate_id, 'lean' FROM found_lean
        WHERE candidate_id NOT IN (SELECT candidate_id FROM found)""", FOUND, FOUND_LEAN),
    "delta_probes": sql("""SELECT probe, r.n AS rich_candidates, l.n AS lean_candidates
        FROM (SELECT probe, count(*) AS n FROM found GROUP BY 1) r
        JOIN (SELECT probe, count(*) AS n FROM found_lean GROUP BY 1) l USING (probe)""", FOUND, FOUND_LEAN),
    "delta_volumes": sql(" UNION ALL ".join(
        f"SELECT '{t}' AS landing_table, count(*) AS rich_rows, {k} * count(*) AS lean_rows FROM {t}"
        for t, k in (("work", 1), ("resources", 1), ("assignments", 1), ("locations", 1),
                     ("location_travel", 0), ("changes", 0))), *ALL),

    # candidates
    "candidate_statements": sql(STATEMENTS, *ALL, ELIGIBLE, PAIRS, GAPS, BINS, FLOORS, DISTRIBUTION, SHAPES,
                                FILL, SHARP, FILL_WORDS, RANK, LEADS),

    # evidence
    "evidence_exclusivity": sql(f"""SELECT {dashed('p03-exclusivity-', 'kind')} AS candidate_id,
        coalesce(overlapping_pairs, 0) AS overlapping_pairs, coalesce(resources_with_an_overlap, 0) AS resources_with_an_overlap,
        assignments_over_floor, resources_over_floor, resources_total,
        CASE WHEN overlapping_pairs > 0 THEN 'sometimes' ELSE 'never' END AS overlap
        FROM kind_volumes LEFT JOIN (SELECT kind, count(*) AS overlapping_pairs,
          count(DISTINCT resource_id) AS resources_with_an_overlap FROM pairs GROUP BY 1) USING (kind)
        WHERE resources_over_floor > 0 AND assignments_over_floor >= 50""", *BOOKED, PAIRS, VOLUMES),
    "evidence_overlap_examples": sql(f"""SELECT {dashed('p03-exclusivity-', 'kind')} AS candidate_id, position::INT AS position,
        resource_id, a_work_id AS work_id_a, b_work_id AS work_id_b, {ts('a_start')}, {ts('a_end')}, {ts('b_start')}, {ts('b_end')}
        FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY resource_id, a_start, b_start, a_work_id,
          b_work_id, a_assignment_id, b_assignment_id) AS position FROM pairs) WHERE position <= 10""", *BOOKED, PAIRS),
    "evidence_turnaround": sql(f"""SELECT {dashed('p03-turnaround-', 'kind')} AS candidate_id, edge AS proposed_minimum_minutes,
        floor, below AS gaps_below_the_edge, least AS observed_min_gap, upper_median AS observed_median_gap,
        observations AS consecutive_pairs, resources_contributing FROM turnaround""", *GAPPED, BINS, FLOORS),
    "evidence_gap_bins": sql(f"""SELECT {dashed('p03-turnaround-', 'kind')} AS candidate_id, e AS edge, coalesce(n, 0) AS n
        FROM (SELECT kind, unnest(generate_series(0, least(max(edge), 115), 5)) AS e FROM bins
              WHERE kind IN (SELECT kind FROM turnaround) GROUP BY 1)
        LEFT JOIN (SELECT kind, edge AS e, n FROM bins) USING (kind, e)""", *GAPPED, BINS, FLOORS),
    "evidence_ceiling": sql(f"""SELECT {dashed('p04-ceiling-', 'dimension')} AS candidate_id, observed_max, shape, count_at_max,
        count_below_max, round_even(share_at_max, 4) AS share_at_max, round_even(max_over_peak, 4) AS max_over_peak,
        observations, distinct_values FROM shapes""", WORK, ASSIGNMENTS, DISTRIBUTION, SHAPES),
    "evidence_ceiling_values": sql(f"""SELECT {dashed('p04-ceiling-', 'dimension')} AS candidate_id, v AS value, n AS "count"
        FROM distribution WHERE dimension IN (SELECT dimension FROM shapes)""", WORK, ASSIGNMENTS, DISTRIBUTION, SHAPES),
    "evidence_fill": sql(" UNION ALL ".join(f"""SELECT {i} AS candidate_id, field, partition, high_value, high_rows, high_filled,
        round_even(high_fill_rate, 4) AS high_fill_rate, low_value, low_rows, low_filled,
        round_even(low_fill_rate, 4) AS low_fill_rate, partitions_over_row_floor, rows_in_work, populated FROM sharp"""
        for i in (REQUIRED, dashed('p05-exemption-', "field || '-by-' || partition || '-' || low_value"))), WORK, FILL, SHARP),
    "evidence_fill_values": sql(f"""SELECT {REQUIRED} AS candidate_id, value, rows, filled, round_even(fill_rate, 4) AS fill_rate
        FROM rates JOIN (SELECT field, partition FROM sharp) USING (field, partition)""", WORK, FILL, SHARP),
    "evidence_override": sql(f"""SELECT {OVERRIDE} AS candidate_id, rank AS rank_by_frequency, events, entities, actors,
        {ts('first_seen')}, {ts('last_seen')}, all_changes, round_even(events / all_changes, 4) AS share_of_all_overrides,
        n, min_days, median_days, max_days, same_day_or_later
        FROM ranked LEFT JOIN leads USING (entity_table, field)""", WORK, CHANGES, RANK, LEADS),
    "evidence_override_people": sql(f"""SELECT {OVERRIDE} AS candidate_id, coalesce(changed_by, '(unrecorded)') AS changed_by,
        count(*) AS events FROM changes WHERE old_value IS NOT NULL AND field IN (SELECT field FROM ranked)
        GROUP BY 1, 2""", CHANGES, RANK),

    # messages
    "recoverability_rates": sql(rates("sheet", HUMAN), SHEET, VOLUME),
    "recoverability_gap": sql(" UNION ALL ".join(
        f"SELECT '{m}' AS measure, a.{m}::DOUBLE AS first, b.{m}::DOUBLE AS second, b.{m}::DOUBLE - a.{m}::DOUBLE AS gap FROM one a, two b"
        for m in GAP_MEASURES) + f""" UNION ALL SELECT 'high_per_100_base', a.high * 100 / ({HUMAN})::BIGINT,
        b.high * 100 / ({HUMAN})::BIGINT, b.high * 100 / ({HUMAN})::BIGINT - a.high * 100 / ({HUMAN})::BIGINT FROM one a, two b""",
        SHEET, VOLUME, f"one AS ({rates('sheet', HUMAN)})", """again AS (
          SELECT * REPLACE ((lead_hours > 6)::INT AS entity, (confidence = 'high')::INT AS rule,
                            if(event_type = 'error', 'low', confidence) AS confidence) FROM sheet)""",
        f"two AS ({rates('again', 'SELECT sum(operational + automation) FROM volume')})"),
    "recurring_kinds": sql('SELECT recurring_kind, count(*) AS "count" FROM sheet GROUP BY 1', SHEET),
    "volume_rollup": sql("""SELECT kind, channel, sum(human)::BIGINT AS human, sum(operational)::BIGINT AS operational,
        sum(automation)::BIGINT AS automation, count(DISTINCT channel) AS channels,
        CASE WHEN grouping(channel) = 0 THEN 'channel' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'total' END AS level
        FROM volume GROUP BY ROLLUP (kind, channel)""", VOLUME),
    "lead_time_bands": sql("""SELECT CASE WHEN lead_hours IS NULL THEN 'n/a' WHEN lead_hours < 6 THEN 'under 6 hours'
        WHEN lead_hours < 72 THEN '6 hours to 2 days' ELSE '3 days or more' END AS band, count(*) AS events
        FROM sheet GROUP BY 1""", SHEET),
}

# Evidence under the names people know: the values are those of the evidence queries above.
_parts = " UNION ALL ".join(
    f"SELECT candidate_id, 'examples' AS list, position, '{p}' AS part, {p} AS value FROM ({ORACLE['evidence_overlap_examples']})"
    for p in ("resource_id", "work_id_a", "work_id_b", "a_start", "a_end", "b_start", "b_end"))
ORACLE["evidence_names"] = f"""
WITH shown AS ({_parts}
  UNION ALL SELECT candidate_id, 'all_partitions', NULL, 'value', value FROM ({ORACLE['evidence_fill_values']})
  UNION ALL SELECT candidate_id, 'actors', NULL, 'changed_by', changed_by FROM ({ORACLE['evidence_override_people']})
  UNION ALL SELECT {OVERRIDE}, 'field', NULL, 'field', field FROM ({sql("SELECT entity_table, field FROM ranked", CHANGES, RANK)})),
names AS ({ORACLE['names_of_ids']}),
{LABELS},
known AS (SELECT id, label FROM names WHERE id NOT IN (SELECT field FROM labels) UNION ALL SELECT field, label FROM labels)
SELECT candidate_id, list, position::DOUBLE AS position, part, value, label,
       CASE WHEN label IS NOT NULL THEN label || '  [' || value || ']'
            WHEN regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}([ T]\\d{{2}}:\\d{{2}}(:\\d{{2}})?)?')
            THEN strftime(value::TIMESTAMP, '%a ') || value ELSE value END AS shown
FROM shown LEFT JOIN known ON id = value
"""


# Whole candidate documents. Texts of JSON are put together as the probes write them: compact, fields in order.
def _object(**fields: str) -> str:
    inner = " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in fields.items())
    return f"('{{' || {inner} || '}}')"


def _text(column: str) -> str:
    return f"to_json(({column})::VARCHAR)::VARCHAR"


def _four(column: str) -> str:
    return f"printf('%.4f', round_even({column}, 4))"


def _list(items: str, order: str) -> str:
    return f"('[' || coalesce(string_agg({items}, ',' ORDER BY {order}), '') || ']')"


_TIMES = ("a_start", "a_end", "b_start", "b_end")
_EXAMPLE = _object(**{c: _text(c) for c in ("resource_id", "work_id_a", "work_id_b", *_TIMES)})
_PART = _object(value=_text("value"), rows="rows", filled="filled", fill_rate=_four("fill_rate"))
_WORDS = {side: _object(value=_text(f"{side}_value"), rows=f"{side}_rows", filled=f"{side}_filled", fill_rate=_four(f"{side}_fill_rate"))
          for side in ("high", "low")}
_EXEMPT = dashed("p05-exemption-", "field || '-by-' || partition || '-' || low_value")
ORACLE["candidate_documents"] = f"""
WITH worded AS ({ORACLE['candidate_statements']}),
examples AS (SELECT candidate_id, {_list(_EXAMPLE, 'position')} AS l FROM ({ORACLE['evidence_overlap_examples']}) GROUP BY 1),
bins_of AS (SELECT candidate_id, {_list("'[' || edge || ',' || n || ']'", 'edge')} AS l FROM ({ORACLE['evidence_gap_bins']}) GROUP BY 1),
values_of AS (SELECT candidate_id, {_list(_object(value='"value"', count='"count"'), '"value"')} AS l
              FROM ({ORACLE['evidence_ceiling_values']}) GROUP BY 1),
people AS (SELECT candidate_id, {_list(_object(changed_by=_text('changed_by'), events='events'), 'events DESC, changed_by')} AS l
           FROM ({ORACLE['evidence_override_people']}) GROUP BY 1),
documents_of AS (
  SELECT candidate_id, {_object(overlapping_pairs='overlapping_pairs', resources_with_an_overlap='resources_with_an_overlap',
                                examples="coalesce(l, '[]')")} AS evidence,
         {_object(kind=_text('kind'), assignments_considered='assignments_over_floor', resources_over_assignment_floor='resources_over_floor',
                  resources_of_this_kind='resources_total', min_assignments_per_resource="'20'")} AS confidence_inputs
  FROM ({ORACLE['evidence_exclusivity']}) LEFT JOIN examples USING (candidate_id)
  JOIN (SELECT DISTINCT r_name AS kind FROM region) ON candidate_id = {dashed('p03-exclusivity-', 'kind')}
  UNION ALL
  SELECT candidate_id, {_object(proposed_minimum_minutes='proposed_minimum_minutes', floor=_text('floor'),
                                gaps_below_the_edge='gaps_below_the_edge', bin_minutes="'5'", tail_fraction="'0.01'",
                                histogram_head='l', observed_min_gap='observed_min_gap', observed_median_gap='observed_median_gap')},
         {_object(kind=_text('kind'), consecutive_pairs='consecutive_pairs', resources_contributing='resources_contributing',
                  min_assignments_per_resource="'20'")}
  FROM ({ORACLE['evidence_turnaround']}) JOIN bins_of USING (candidate_id)
  JOIN (SELECT DISTINCT r_name AS kind FROM region) ON candidate_id = {dashed('p03-turnaround-', 'kind')}
  UNION ALL
  SELECT candidate_id, {_object(dimension=_text('dimension'), observed_max='observed_max', shape=_text('shape'), count_at_max='count_at_max',
                                count_one_below_max='count_below_max', share_at_max=_four('share_at_max'),
                                max_over_busiest_value=_four('max_over_peak'), cliff_ratio_used="'0.5'", distribution='l')},
         {_object(observations='observations', distinct_values='distinct_values', min_observations="'50'")}
  FROM ({ORACLE['evidence_ceiling']}) JOIN values_of USING (candidate_id)
  JOIN (VALUES {', '.join(f"('{d}')" for d in DISTRIBUTIONS)}) d(dimension) ON candidate_id = {dashed('p04-ceiling-', 'dimension')}
  UNION ALL
  SELECT {REQUIRED}, {_object(field=_text('field'), partition=_text('partition'), required_in=_WORDS['high'], absent_in=_WORDS['low'],
                              all_partitions='l', high_threshold="'0.95'", low_threshold="'0.05'")},
         {_object(rows_in_work='rows_in_work', rows_with_this_field_populated='populated',
                  partitions_over_row_floor='partitions_over_row_floor', min_partition_rows="'10'", min_populated_rows_per_field="'50'")}
  FROM ({sql('SELECT * FROM sharp', WORK, FILL, SHARP)})
  JOIN (SELECT field, partition, {_list(_PART, 'value')} AS l FROM ({sql('SELECT * FROM rates', WORK, FILL)}) GROUP BY 1, 2)
    USING (field, partition)
  UNION ALL
  SELECT {_EXEMPT}, {_object(field=_text('field'), partition=_text('partition'), partition_value=_text('low_value'), rows='low_rows',
                             filled='low_filled', fill_rate=_four('low_fill_rate'))},
         {_object(rows_in_work='rows_in_work', rows_with_this_field_populated='populated', rows_in_this_partition='low_rows',
                  min_partition_rows="'10'")}
  FROM ({sql('SELECT * FROM sharp', WORK, FILL, SHARP)})
  UNION ALL
  SELECT candidate_id, {_object(entity_table=_text("'work'"), field=_text('field'), rank_by_frequency='rank_by_frequency', events='events',
                                distinct_entities='entities', distinct_actors='actors', actors='l', first_seen=_text('first_seen'),
                                last_seen=_text('last_seen'),
                                lead_time_days=_object(n='n', min_days='min_days', median_days='median_days', max_days='max_days',
                                                       same_day_or_later='same_day_or_later'))},
         {_object(change_rows_total='all_changes', events_for_this_field='events', min_events_per_field="'3'",
                  share_of_all_overrides=_four('share_of_all_overrides'))}
  FROM ({ORACLE['evidence_override']}) JOIN people USING (candidate_id)
  JOIN ({sql('SELECT entity_table, field FROM ranked', CHANGES, RANK)}) ON candidate_id = {OVERRIDE})
SELECT probe, candidate_id, proposed_type, statement, evidence, confidence_inputs
FROM worded JOIN documents_of USING (candidate_id)
"""
