"""Queries on tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketveil.functions import tickets as T
from ticketveil.operators import tickets as K

from . import derived as D
from . import sqltext as S

QUERIES, ORACLES = {}, {}
BASE = f"tickets AS (SELECT * FROM {D.TICKETS_SQL})"


def add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


FIELDS = [
    "ta AS (SELECT ticket_id, string_split(text, '\n') AS a FROM tickets)",
    "tr AS (SELECT ticket_id, unnest(range(0, len(a)))::INTEGER AS line_no, unnest(a) AS raw FROM ta)",
    f"tl AS (SELECT ticket_id, line_no, {S.strip('raw')} AS line FROM tr)",
    rf"fields AS (SELECT ticket_id, line_no, lower({S.strip(f'''regexp_extract(line, '{T.FIELD_LABEL}', 1)''')}) AS field, "
    rf"{S.strip(f'''regexp_extract(line, '{T.FIELD_LABEL}(.*)$', 2)''')} AS value FROM tl "
    rf"WHERE regexp_matches(line, '{T.FIELD_LABEL}'))",
]


def per_ticket(condition: str) -> str:
    return f"coalesce(bool_or(value <> '' AND field IN ({condition})), false)"


_HEADING = (
    f"{per_ticket(repr('configuration item') + ', ' + repr('location'))} AND "
    f"{per_ticket(', '.join(map(repr, ('state', 'pending reason', 'pending'))))} AND "
    f"{per_ticket(repr('service offering'))} AND {per_ticket(repr('category'))}"
)
_CODE = "CASE lower(value) WHEN 'car' THEN 'client action required' WHEN 'client h.' THEN 'client hold' ELSE lower(value) END"
_PENDING = "value <> '' AND field IN ('pending reason', 'pending')"
_STATE = (
    "coalesce(lower(arg_min(value, line_no) FILTER (field = 'incident status' AND value <> '')), "
    "lower(arg_min(value, line_no) FILTER (field = 'state' AND value <> '')), '')"
)
_OWNER = "arg_min(value, line_no) FILTER (field = 'assigned to' AND value <> '')"
CHECKS = {
    "heading": f"CASE WHEN {_HEADING} THEN 'PASS' ELSE 'FAIL' END",
    "pending": f"CASE WHEN count(*) FILTER ({_PENDING}) > 0 AND count(*) FILTER ({_PENDING} AND {_CODE} NOT IN "
    f"{S.in_list(T.PENDING_CODES)}) = 0 THEN 'PASS' ELSE 'FAIL' END",
    "notes": f"CASE WHEN {_STATE} IN {S.in_list(T.OPEN_STATES)} THEN 'N/A' WHEN {per_ticket(repr('close notes'))} "
    "THEN 'PASS' ELSE 'FAIL' END",
    "owner": f"CASE WHEN list_contains(coalesce(list(value) FILTER (field = 'time worked by' AND value <> ''), []), {_OWNER}) "
    "THEN 'PASS' ELSE 'FAIL' END",
    "level": "try_cast(substr(arg_min(value, line_no) FILTER (field = 'priority' AND value <> ''), 1, 1) AS INTEGER)",
}


def amount(unit: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(value, '(?i)([0-9]+(\\.[0-9]+)?)\\s*{unit}', 1), '') AS DECIMAL(12,2)), 0)"


CHECKS_SQL = [
    *FIELDS,
    "checks AS (SELECT ticket_id, " + ", ".join(f"{e} AS {n}" for n, e in CHECKS.items()) + ", "
    f"coalesce(sum({amount('h')} * 60 + {amount('m')}) FILTER (field IN ('time worked', 'duration')), 0)::DOUBLE AS minutes "
    "FROM fields GROUP BY ticket_id)",
]
HEAD = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} - "
UPDATES = [
    "ua AS (SELECT ticket_id, string_split(text, '\n') AS a FROM tickets)",
    "ur AS (SELECT ticket_id, unnest(range(0, len(a))) AS i, unnest(a) AS line FROM ua)",
    f"uh AS (SELECT *, regexp_matches(line, '{HEAD}') AS is_head FROM ur)",
    "un AS (SELECT *, sum(is_head::INTEGER) OVER (PARTITION BY ticket_id ORDER BY i)::INTEGER AS update_no FROM uh)",
    "updates AS (SELECT ticket_id, update_no, any_value(substr(line, 1, 19)) FILTER (is_head)::TIMESTAMP AS ts, "
    f"{S.strip('any_value(substr(line, 23)) FILTER (is_head)')} AS author, "
    f"{S.strip(f'''coalesce(string_agg(line, '{chr(10)}' ORDER BY i) FILTER (NOT is_head), '')''')} AS body "
    "FROM un WHERE update_no > 0 GROUP BY ticket_id, update_no)",
]

add(
    "k1_incident_number",
    lambda spark, d: K.incident_number(D.tickets(spark, d)),
    S.with_(
        [BASE],
        "SELECT ticket_id, coalesce(nullif(regexp_extract(text, 'INC[0-9]{7,8}'), ''), 'Not Found') AS incident FROM tickets",
    ),
)
add(
    "k2_ticket_fields",
    lambda spark, d: K.ticket_fields(D.tickets(spark, d)),
    S.with_([BASE, *FIELDS], "SELECT * FROM fields"),
)
add(
    "k3_heading_fields_check",
    lambda spark, d: K.heading_fields_check(D.tickets(spark, d)),
    S.with_([BASE, *CHECKS_SQL], "SELECT ticket_id, heading AS verdict FROM checks"),
)
_FIRST = "CASE WHEN contains(text, 'First Access: true') OR contains(text, 'First Access verified') THEN 'PASS' ELSE 'FAIL' END"
add(
    "k4_first_access_check",
    lambda spark, d: K.first_access_check(D.tickets(spark, d)),
    S.with_([BASE], f"SELECT ticket_id, {_FIRST} AS verdict FROM tickets"),
)
add(
    "k5_pending_code_check",
    lambda spark, d: K.pending_code_check(D.tickets(spark, d)),
    S.with_([BASE, *CHECKS_SQL], "SELECT ticket_id, pending AS verdict FROM checks"),
)
add(
    "k6_update_timeline",
    lambda spark, d: K.update_timeline(D.tickets(spark, d)),
    S.with_([BASE, *UPDATES], "SELECT * FROM updates"),
)

EVENT_UPDATES = {"ticket_id": "user_id", "ts": "ts"}


def event_tickets(spark, d):
    users = D.table(spark, d, "events").select(F.col("user_id").alias("ticket_id")).distinct()
    return users.withColumn("priority", (F.col("ticket_id") % 4 + 1).cast("int"))


_LIMIT = "CASE {} WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 48 WHEN 4 THEN 72 END * 3600"
add(
    "k7_update_cadence_check",
    lambda spark, d: K.update_cadence_check(
        D.derive(spark, d, "events", EVENT_UPDATES), event_tickets(spark, d)
    ),
    S.with_(
        [
            "gaps AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap FROM events)",
            "g AS (SELECT user_id AS ticket_id, (user_id % 4 + 1)::INTEGER AS priority, count(*) AS updates, "
            "max(gap) / 1000000 AS gap_seconds FROM gaps GROUP BY user_id)",
        ],
        f"SELECT *, CASE WHEN coalesce(gap_seconds, 0) <= {_LIMIT.format('priority')} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g",
    ),
)
OWNED = {"ticket_id": "o_orderkey", "assignee": D.person("o_orderkey")}
WORKED = {"ticket_id": "l_orderkey", "author": D.person("l_partkey")}
add(
    "k8_time_worked_owner_check",
    lambda spark, d: K.time_worked_owner_check(
        D.derive(spark, d, "orders", OWNED), D.derive(spark, d, "lineitem", WORKED)
    ),
    S.with_(
        [
            f"owned AS (SELECT {D.columns(OWNED)} FROM orders)",
            f"worked AS (SELECT {D.columns(WORKED)} FROM lineitem)",
        ],
        "SELECT ticket_id, assignee, CASE WHEN EXISTS (SELECT 1 FROM worked w WHERE w.ticket_id = o.ticket_id "
        "AND w.author = o.assignee) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM owned o",
    ),
)
add(
    "k9_close_notes_check",
    lambda spark, d: K.close_notes_check(D.tickets(spark, d)),
    S.with_([BASE, *CHECKS_SQL], "SELECT ticket_id, notes AS verdict FROM checks"),
)
add(
    "k10_time_worked_total",
    lambda spark, d: K.time_worked_total(D.tickets(spark, d)),
    S.with_([BASE, *CHECKS_SQL], "SELECT ticket_id, minutes FROM checks"),
)
_GAP = [
    *UPDATES,
    "ug AS (SELECT ticket_id, date_diff('second', lag(ts) OVER (PARTITION BY ticket_id ORDER BY ts), ts) AS gap FROM updates)",
    "um AS (SELECT ticket_id, max(gap) AS gap FROM ug GROUP BY ticket_id)",
    f"fa AS (SELECT ticket_id, {_FIRST} AS access FROM tickets)",
    "rules AS (SELECT ticket_id, unnest(['Q2', 'Q3', 'Q6', 'Q10', 'Q14', 'Q15']) AS q, unnest([heading, access, pending, "
    f"CASE WHEN coalesce(coalesce(gap, 0) <= {_LIMIT.format('level')}, false) THEN 'PASS' ELSE 'FAIL' END, "
    "owner, notes]) AS verdict FROM fa JOIN checks USING (ticket_id) LEFT JOIN um USING (ticket_id))",
]
add(
    "k11_rule_verdicts",
    lambda spark, d: K.rule_verdicts(D.tickets(spark, d)),
    S.with_([BASE, *CHECKS_SQL, *_GAP], "SELECT * FROM rules"),
)
add(
    "k11_rule_scorecard",
    lambda spark, d: K.rule_scorecard(D.tickets(spark, d)),
    S.with_(
        [
            BASE,
            *CHECKS_SQL,
            *_GAP,
            "c AS (SELECT ticket_id, count(*) FILTER (verdict = 'PASS')::INTEGER AS pass_count, "
            "count(*) FILTER (verdict = 'FAIL')::INTEGER AS fail_count, "
            "count(*) FILTER (verdict = 'N/A')::INTEGER AS na_responses FROM rules GROUP BY ticket_id)",
        ],
        "SELECT *, 13 - na_responses AS applicable_questions, CASE WHEN pass_count + fail_count > 0 "
        "THEN pass_count / (pass_count + fail_count) * 100 END AS compliance_percentage FROM c",
    ),
)
