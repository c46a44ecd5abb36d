"""Tickets, reports and files derived from the given tables.

The test tables hold no tickets or audit reports, so their text is composed row by row out of
``orders``. The expressions are plain SQL that Spark and DuckDB read alike, and they scale with
the table.
"""

from __future__ import annotations

from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ticketveil.sources import spread, spread_rows

QUESTIONS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15)
NL = "chr(10)"


def s(x) -> str:
    return f"cast({x} as string)"


def pick(words: str, number: str) -> str:
    """One of comma-separated words, by a number."""
    n = words.count(",") + 1
    return f"split_part('{words}', ',', cast(({number}) % {n} + 1 as int))"


def lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


def pad(x: str, n: int) -> str:
    return f"lpad({s(x)}, {n}, '0')"


def person(number: str) -> str:
    first = pick("John,Mary,Caleb,Sarah,Vincent,Andrew,Robert,Kaushal", number)
    family = pick("Smith,Johnson,Franklin,Wilson,Stone,Davis,Manager,Testing,Muñoz", f"{number} + 2")
    return f"{first} || ' ' || {family}"


K = "o_orderkey"
DAY = "substr(cast(o_orderdate as string), 1, 10)"
UPDATE_1 = f"{DAY} || ' 00:10:00 - ' || {person(K)} || {NL} || 'Taking ownership of this case.'"
UPDATE_2 = (
    f"{DAY} || ' ' || {pad(f'{K} % 23 + 1', 2)} || ':15:00 - ' || {person(f'{K} + 1')} "
    f"|| {NL} || 'Checked again.' || {NL} || 'Current status: stable'"
)
TICKET = lines(
    f"'INC' || {pad(K, 7)} || ' - Order alert'",
    "''",
    f"'Configuration Item: PRN-FW' || {s(f'{K} % 50')}",
    f"case when {K} % 5 = 0 then 'Location:' else 'Location: Site ' || {s(f'{K} % 20')} end",
    "'Impact: 2 - Medium Urgency: 3 - Low Assignment group: Field Staff'",
    f"case when {K} % 4 = 0 then 'Service Offering: Network Services Category: Security Device' "
    f"else 'Service Offering: Network Services' || {NL} || 'Category: Security Device' end",
    f"'Priority: ' || {s(f'{K} % 4 + 1')} || ' - ' || o_orderpriority",
    "'State: ' || case o_orderstatus when 'O' then 'In Progress' when 'F' then 'Resolved' "
    "else 'Pending' end",
    f"'Pending reason: ' || {pick('Client Hold,CAR,Client H.,Internal,RMA,Carrier', K)}",
    f"'Assigned to: ' || {person(K)}",
    f"'Caller: ' || {person(f'{K} * 3 + 1')} || ' (555) 123-' || {pad(f'{K} % 10000', 4)}",
    f"'Callback #' || {s(f'{K} % 9 + 1')} || '-555-765-' || {pad(f'{K} % 10000', 4)} "
    f"|| ' TAC 6-5551' || {pad(f'{K} % 1000000', 6)} || ' or 6-555.1' || {pad(f'{K} % 1000000', 6)}",
    f"'Mail: user' || {s(K)} || '@example.com, second.user@mail.example.org'",
    f"'Host 8.8.' || {s(f'{K} % 300')} || '.7 via 10.0.0.' || {s(f'{K} % 250')} || ' and 172.' "
    f"|| {s(f'{K} % 40')} || '.1.9 or 1.2.3.4.5'",
    f"'MAC 00:1A:2b:3C:' || {pad(f'{K} % 100', 2)} || ':5E or AA-BB-CC-DD-EE-F' || {s(f'{K} % 10')}",
    f"'Staff EVE' || {pad(K, 8)} || ', IMEI# 49' || {pad(K, 6)} || ', IMEI 4901542' || {pad(K, 8)}",
    f"'Account 12' || {pad(K, 6)} || '-7, Account 9900' || {pad(K, 6)}",
    f"'see https://tickets.example.org/t/' || {s(K)} || '?u=a.b@example.com&x=1 or http://x.example/'",
    f"'Run By: ' || {person(f'{K} + 5')}",
    "''",
    "'Notes:'",
    f"'Users report slow [code]responses[/code] for order ' || {s(K)} || ' since'",
    "'  the last change<br/>window and'",
    "'ask <b>for</b> a call to Caller: desk'",
    "'1. checked ports'",
    "'* rebooted'",
    "'15 Minutes spent'",
    "'SLA'",
    "'definition is met'",
    f"case {K} % 3 when 0 then 'First Access: true' when 1 then 'First Access verified' else 'none' end",
    "''",
    UPDATE_1,
    UPDATE_2,
    f"'Time worked by: ' || {person(f'{K} + {K} % 3')}",
    f"'Time Worked: ' || {pick('1.5 hours,2 Hours 48 Minutes,10 Minutes,none', K)}",
    f"'Duration: ' || {s(f'{K} % 7')} || 'h'",
    f"case when {K} % 3 < 2 then 'Close Notes: replaced part for order ' || {s(K)} else 'Close Notes:' end",
    f"case when {K} % 7 = 0 then 'Incident Status: Resolved' || {NL} else '' end",
)


def verdict_number(q: int) -> str:
    return f"(({K} * {q} + cast(floor({K} / 7) as bigint)) % 5)"


def verdict(q: int) -> str:
    other = "N/A" if q in (12, 15) else "FAIL"
    return f"(case {verdict_number(q)} when 3 then 'FAIL' when 4 then '{other}' else 'PASS' end)"


TITLES = {
    2: "Heading Fields Documentation", 3: "First Access Verification",
    4: "Engineer Ownership Acknowledgment", 5: "Event Date Management", 6: "Pending Code Usage",
    7: "Status Field Updates", 8: "Client Communication Quality",
    9: "Troubleshooting Documentation", 10: "Timely Update Compliance",
    11: "Procedure Following", 12: "Task Management", 14: "Time Tracking Accuracy",
    15: "Resolution Documentation",
}


def block(q: int) -> str:
    fail = (
        f"'**STATUS**: ❌ FAIL' || {NL} || case when {K} % 2 = 0 then '**WHAT YOU MISSED**:' || {NL} "
        f"|| '* Nothing **written** for order ' || {s(f'{K} % 100')} "
        f"else '**ANALYSIS**: evidence was not found' end"
    )
    return (
        f"'**QUESTION {q}: {TITLES[q]}**' || {NL} || case {verdict(q)} when 'PASS' then "
        f"'**STATUS**: ✅ PASS' when 'N/A' then '**STATUS**: ⚠️ N/A for question {q}' else {fail} end "
        f"|| {NL} || '---'"
    )


FULL_REPORT = lines(*(block(q) for q in QUESTIONS))
OTHER_REPORT = (
    f"case {K} % 8 when 0 then 'Result 07/12 (58%) and then 11/12 (92%)' when 1 then 'Score: 3/0' "
    f"when 2 then '' when 3 then 'Total points 9/10, or 7 out of 8.' "
    f"when 4 then '**QUESTION 4: Ownership: kept?**' || {NL} || 'x' || {NL} || '**ANSWER:** No, not seen' "
    f"when 5 then '❌ fail: first access not done, no time worked; client updates missing' "
    f"when 6 then 'no issues ❌ FAIL found in heading fields of order ' || {s(K)} "
    f"else '❌ FAIL (Score: 2/10) time worked' || {NL} || 'PASS ✅ (Score: 9/10)' || {NL} || '45% done' end"
)
JSON_BODY = "'{' || " + " || ',' || ".join(f"'\"q{q}\":\"' || {verdict(q)} || '\"'" for q in QUESTIONS) + " || '}'"
SUMMARY_LINE = (
    f"case {K} % 6 when 0 then {NL} || 'JSON_SUMMARY: ' || {JSON_BODY} "
    f"when 1 then {NL} || '  JSON_SUMMARY: ```{{“q2”: “pass ”,\"Q3\":\"fail\",\"note\":\"FAIL\",\"q12\":\"NA\"}}``` ok' || {NL} "
    f"when 2 then {NL} || 'JSON_SUMMARY: {{\"q2\":\"PASS\"' "
    f"when 3 then {NL} || 'JSON_SUMMARY: {{}}' else '' end"
)
REPORT = f"(case when {K} % 4 = 3 then {OTHER_REPORT} else {FULL_REPORT} end) || ({SUMMARY_LINE})"

PROVIDER = f"case when {K} % 3 = 0 then 'openai' else 'claude' end"
MODEL = pick("gpt-4,gpt-4o-mini,claude-3-5-sonnet-20241022,other", K)
FILE = "'INC' || lpad(cast(o_custkey as string), 7, '0') || '.pdf'"

SCORE_PERCENT = "cast(floor(o_totalprice) as bigint) % 101"
FILES = {
    "filename": f"'INC' || {pad(K, 8)} || '.pdf'",
    "status": "case when o_orderstatus = 'P' then 'error' else 'success' end",
    "redacted_text": TICKET,
    "audit_report": REPORT,
    "redaction_count": f"cast({K} % 17 as bigint)",
    "audit_score": f"case when {K} % 5 = 0 then 'Score not available' else '3/4 (' || {s(SCORE_PERCENT)} || '%)' end",
    "error_message": f"case when o_orderstatus = 'P' then 'Unexpected error: file ' || {FILE} || ' could not be read on attempt 3' else '' end",
    "processing_time": "cast(cast(floor(o_totalprice) as bigint) % 64 as double) / 4",
    "file_size": "cast(floor(o_totalprice * 200) as bigint)",
}

TICKET_COLUMNS = {"ticket_id": K, "text": TICKET}
REPORT_COLUMNS = {
    "report_id": K, "report": REPORT, "provider": PROVIDER, "model": MODEL, "file": FILE,
    "ts": "o_orderdate",
}


def columns(mapping: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in mapping.items())


TICKETS_SQL = f"(SELECT {columns(TICKET_COLUMNS)} FROM orders)"
REPORTS_SQL = f"(SELECT {columns(REPORT_COLUMNS)} FROM orders)"
FILES_SQL = f"(SELECT {columns(FILES)} FROM orders)"
CORPUS = (
    ("documents", {"doc_id": f"'d' || {s('doc_id')}", "kind": "lang", "text": "text"}),
    ("orders", {"doc_id": f"'t' || {s(K)}", "kind": "'ticket'", "text": TICKET}),
    ("pages", {"doc_id": f"'p' || {s('page_id')}", "kind": "'html'", "text": "html"}),
)
CORPUS_SQL = "(" + " UNION ALL ".join(f"SELECT {columns(c)} FROM {t}" for t, c in CORPUS) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str, mapping: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {n}" for n, e in mapping.items()))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, over as many tasks as the setting ``ticketveil.partitions`` says. It is unset by default: orders, whose
    short rows become long texts, are then dealt by their number, other tables as they are read."""
    partitions, rows = spark.conf.get("ticketveil.partitions", None), table(spark, sf_dir, name)
    if partitions:
        return spread(rows, int(partitions))
    return spread_rows(rows) if name == "orders" else rows


def derive_more(spark: SparkSession, sf_dir: str, name: str, *mappings: dict[str, str]) -> DataFrame:
    """The rows of each mapping, one after the other: given rows and rows added for cases that are not given."""
    first, *rest = (derive(spark, sf_dir, name, m) for m in mappings)
    for other in rest:
        first = first.unionByName(other)
    return first


def more_sql(source: str, *mappings: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns(m)} FROM {source}" for m in mappings)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a session on one machine without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = mkdtemp(prefix="catalog-")
    return f"{folder.rstrip('/')}/{name}-{uuid4().hex}"


def derive_wide(spark: SparkSession, sf_dir: str, name: str, mapping: dict[str, str]) -> DataFrame:
    """As ``derive``, for queries that spend their time on text."""
    wide = spread_table(spark, sf_dir, name)
    return wide.selectExpr(*(f"{e} AS {n}" for n, e in mapping.items()))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_wide(spark, sf_dir, "orders", TICKET_COLUMNS)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_wide(spark, sf_dir, "orders", REPORT_COLUMNS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_wide(spark, sf_dir, "orders", FILES)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = (derive_wide(spark, sf_dir, t, c) for t, c in CORPUS)
    for other in rest:
        first = first.unionByName(other)
    return first
