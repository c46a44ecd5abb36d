"""Queries on audit reports and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketveil.functions import audit as A
from ticketveil.operators import audit as O
from ticketveil.plans import stored
from ticketveil.sources import append_history, keep_groups, kept_groups, read_history

from . import derived as D
from . import sqltext as S

QUERIES, ORACLES = {}, {}
BASE = f"reports AS (SELECT * FROM {D.REPORTS_SQL})"
NOW = "2024-02-01 08:30:00"


def add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


# last summary line of each report as JSON text, null where there is none or it is not valid
JSON = [
    f"jl AS (SELECT *, list_filter(list_transform(string_split_regex(report, '{S.LINE_BREAK}'), "
    f"lambda x: {S.strip('x')}), lambda x: starts_with(x, 'JSON_SUMMARY:'))[-1] AS jline FROM reports)",
    r"jb AS (SELECT *, replace(replace(regexp_extract(jline, '(?s)\{.*\}'), '“', '\"'), '”', '\"') AS jtext FROM jl)".replace('\\"', '"'),
    "js AS (SELECT * EXCLUDE (jline, jtext), CASE WHEN json_valid(jtext) THEN jtext END AS j FROM jb)",
    "je AS (SELECT report_id, k AS key, json_extract_string(j, '$.\"' || k || '\"') AS value "
    "FROM (SELECT report_id, j, unnest(json_keys(j)) AS k FROM js WHERE j IS NOT NULL))",
    f"jv AS (SELECT report_id, key, upper({S.strip('value')}) AS verdict FROM je WHERE lower(key)[1] = 'q')",
]
LINE_VERDICT = (
    "CASE WHEN contains(x, '⚠️') AND contains(x, 'N/A') THEN 'N/A' "
    "WHEN contains(x, '✅') AND contains(x, 'PASS') THEN 'PASS' "
    "WHEN contains(x, '❌') AND contains(x, 'FAIL') THEN 'FAIL' END"
)
_MARKS = " OR ".join(f"contains(x, '{m}')" for m in A.NA_QUESTION_MARKS)
SUMMARY = [
    *JSON,
    "jc AS (SELECT report_id, count(*) FILTER (verdict = 'PASS') AS p, count(*) FILTER (verdict = 'FAIL') AS f, "
    "count(*) FILTER (verdict IN ('N/A', 'NA')) AS n FROM jv GROUP BY report_id)",
    "used AS (SELECT DISTINCT report_id FROM je)",
    "rl AS (SELECT report_id, unnest(string_split(report, '\n')) AS x FROM reports)",
    f"lv AS (SELECT report_id, x, {LINE_VERDICT} AS v FROM rl)",
    f"lc AS (SELECT report_id, count(*) FILTER (v = 'PASS') AS p, count(*) FILTER (v = 'FAIL') AS f, "
    f"count(*) FILTER (v = 'N/A' AND ({_MARKS})) AS n FROM lv GROUP BY report_id)",
    "tally AS (SELECT r.*, used.report_id IS NOT NULL AS json_summary_used, "
    "(CASE WHEN used.report_id IS NOT NULL THEN coalesce(jc.p, 0) ELSE lc.p END)::INTEGER AS p, "
    "(CASE WHEN used.report_id IS NOT NULL THEN coalesce(jc.f, 0) ELSE lc.f END)::INTEGER AS f, "
    "(CASE WHEN used.report_id IS NOT NULL THEN coalesce(jc.n, 0) ELSE lc.n END)::INTEGER AS n "
    "FROM reports r LEFT JOIN used USING (report_id) LEFT JOIN jc USING (report_id) LEFT JOIN lc USING (report_id))",
]

add(
    "a1_parse_json_summary",
    lambda spark, d: D.reports(spark, d).select(
        "report_id", F.explode(A.parse_json_summary(F.col("report"))).alias("key", "value")
    ),
    S.with_([BASE, *JSON], "SELECT report_id, key, value FROM je"),
)
add(
    "a2_a3_audit_summary",
    lambda spark, d: O.audit_summary(D.reports(spark, d)),
    S.with_(
        [BASE, *SUMMARY],
        "SELECT report_id, p AS pass_count, f AS fail_count, p + f AS total_answered, 16 AS total_questions, "
        "13 AS scoreable_questions, 13 - n AS applicable_questions, n AS na_responses, "
        "CASE WHEN p + f > 0 THEN p / (p + f) * 100 END AS compliance_percentage, json_summary_used FROM tally",
    ),
)


def most(patterns) -> str:
    each = ", ".join(
        f"len(regexp_extract_all(report, '(?is){p.replace(S.P.SPACE, S.SPACE)}'))" for p in patterns
    )
    return f"greatest({each})"


def pct(n: str, d: str) -> str:
    return f"round_even({n} / {d} * 100, 0)::BIGINT::VARCHAR"


def ratio(hit: str, pattern: str, on_zero: str | None) -> str:
    n, d = (f"regexp_extract({hit}, '{pattern}', {g})" for g in (1, 2))
    bare = f"{n} || '/' || {d}" if on_zero is None else on_zero
    return (
        f"CASE WHEN {hit} IS NULL THEN NULL WHEN {d}::BIGINT = 0 THEN {bare} ELSE {n}::BIGINT::VARCHAR || '/' || "
        f"{d}::BIGINT::VARCHAR || ' (' || {pct(f'{n}::BIGINT', f'{d}::BIGINT')} || '%)' END"
    )


def last_hit(pattern: str) -> str:
    return f"regexp_extract_all(report, '{pattern}')[-1]"


_FULL = "(?i)" + A.SCORE_WITH_PERCENT.replace(S.P.SPACE, S.SPACE)
_WRITTEN = [
    f"regexp_extract({last_hit(_FULL)}, '{_FULL}', 1) || '/' || regexp_extract({last_hit(_FULL)}, '{_FULL}', 2) "
    f"|| ' (' || regexp_extract({last_hit(_FULL)}, '{_FULL}', 3) || '%)'"
]
for _p in A.SCORE_PATTERNS:
    _p = "(?i)" + _p.replace(S.P.SPACE, S.SPACE)
    _WRITTEN.append(ratio(last_hit(_p), _p, None))
_FRACTION = "([0-9]+)/([0-9]+)"
MARKS_SQL = f"{most(A.PASS_PATTERNS)} AS p, {most(A.FAIL_PATTERNS)} AS f"
SCORE_SQL = (
    f"CASE WHEN p + f > 0 THEN p::VARCHAR || '/' || (p + f)::VARCHAR || ' (' || "
    f"{pct('p', '(p + f)')} || '%)' || CASE WHEN p + f = 13 THEN '' ELSE ' (' || (p + f)::VARCHAR || '/13)' END "
    f"ELSE coalesce({', '.join(_WRITTEN)}, 'Score not available') END"
)
add(
    "a4_a5_audit_scores",
    lambda spark, d: O.audit_scores(D.reports(spark, d)),
    S.with_(
        [BASE, f"counted AS (SELECT *, {MARKS_SQL} FROM reports)"],
        f"SELECT report_id, {SCORE_SQL} AS score, "
        f"coalesce({ratio(last_hit(_FRACTION), _FRACTION, repr('Score not available'))}, "
        f"{last_hit('[0-9]+%')}, 'Score not available') AS simple_score FROM counted",
    ),
)

_TITLE_CASE = "CASE upper(key) " + " ".join(
    f"WHEN 'Q{i}' THEN {S.q(t)}" for i, t in enumerate(A.QUESTION_TITLES, 1)
) + " END"
VERDICTS = [
    *JSON,
    "used AS (SELECT DISTINCT report_id FROM je)",
    "marked AS (SELECT report_id, unnest(string_split(regexp_replace(report, "
    r"'(\*\*QUESTION\s+[0-9]+:)', chr(1) || '\1', 'g'), chr(1))) AS b "
    "FROM reports ANTI JOIN used USING (report_id))",
    r"heads AS (SELECT *, regexp_extract(b, '^\*\*QUESTION\s+([0-9]+):\s*([^\n*]*)', 1) AS n, "
    r"regexp_extract(b, '^\*\*QUESTION\s+([0-9]+):\s*([^\n*]*)', 2) AS title FROM marked "
    r"WHERE regexp_matches(b, '^\*\*QUESTION\s+[0-9]+:'))",
    f"verdicts AS (SELECT report_id, upper(key) AS q, {_TITLE_CASE} AS title, verdict FROM jv UNION ALL "
    f"SELECT report_id, 'Q' || n, {S.strip('title')}, list_filter(list_transform(string_split(b, '\n'), "
    f"lambda x: {LINE_VERDICT}), lambda v: v IS NOT NULL)[1] FROM heads)",
]
add(
    "a6_question_verdicts",
    lambda spark, d: O.question_verdicts(D.reports(spark, d)),
    S.with_([BASE, *VERDICTS], "SELECT report_id, q, title, verdict FROM verdicts"),
)


def plain(x: str, *parts: str) -> str:
    for p in parts:
        x = f"replace({x}, {S.q(p)}, '')"
    return S.strip(x)


def _titled(column: str, rest: str) -> str:
    title = plain(column, "**QUESTION", "**")
    return (
        f"CASE WHEN {column} IS NOT NULL AND {title} <> '' THEN '**' || {plain(title, '*', ':')} || '**: ' || {rest} END"
    )


_OVER = "OVER (PARTITION BY report_id ORDER BY i ROWS BETWEEN {} AND {})"
_FINDINGS = [
    "fa AS (SELECT report_id, string_split(report, '\n') AS a FROM reports)",
    "fr AS (SELECT report_id, unnest(range(0, len(a))) AS i, unnest(a) AS raw FROM fa)",
    f"fl AS (SELECT *, {S.strip('raw')} AS line, {S.strip('lead(raw) OVER (PARTITION BY report_id ORDER BY i)')} AS nxt FROM fr)",
    "fd AS (SELECT *, starts_with(line, '**QUESTION') AS is_head, "
    "CASE WHEN contains(line, 'WHAT YOU MISSED') AND nxt IS NOT NULL THEN nxt "
    "WHEN contains(line, 'ANALYSIS') AND contains(lower(line), 'not') "
    f"THEN {plain('line', '**ANALYSIS**:', 'ANALYSIS:')} END AS reason FROM fl)",
    "fw AS (SELECT *, "
    f"arg_min(line, i) FILTER (WHERE is_head) {_OVER.format('5 PRECEDING', '1 PRECEDING')} AS t5, "
    f"arg_min(line, i) FILTER (WHERE is_head) {_OVER.format('10 PRECEDING', '1 PRECEDING')} AS t10, "
    f"arg_min(reason, i) FILTER (WHERE reason IS NOT NULL) {_OVER.format('CURRENT ROW', '9 FOLLOWING')} AS why FROM fd)",
    "ff AS (SELECT report_id, i, CASE WHEN length(line) <= 10 THEN NULL "
    f"WHEN contains(raw, '❌ FAIL') THEN coalesce(CASE WHEN coalesce(why, '') <> '' THEN {_titled('t5', plain('why', '*'))} "
    f"ELSE {_titled('t5', repr('Failed compliance check'))} END, CASE WHEN coalesce(why, '') <> '' THEN {plain('why', '*')} END) "
    "WHEN (contains(raw, '**ANSWER:** No') OR contains(raw, '**ANSWER: No')) AND NOT contains(raw, '❌') "
    f"THEN {_titled('t10', repr('Answer was No'))} END AS finding FROM fw)",
    "fu AS (SELECT report_id, finding, min(i) AS i FROM ff WHERE finding IS NOT NULL GROUP BY ALL)",
    "fk AS (SELECT report_id, finding, row_number() OVER (PARTITION BY report_id ORDER BY i)::INTEGER AS rank FROM fu)",
]
add(
    "a7_key_findings",
    lambda spark, d: O.key_findings(D.reports(spark, d)),
    S.with_([BASE, *_FINDINGS], "SELECT report_id, rank, finding FROM fk WHERE rank <= 3"),
)
add(
    "a8_strip_summary_line",
    lambda spark, d: D.reports(spark, d).select(
        "report_id", A.strip_summary_line(F.col("report")).alias("report")
    ),
    S.with_(
        [
            BASE,
            f"sl AS (SELECT *, string_split_regex(rtrim(report, {S.q(S.P.SPACES)}), '{S.LINE_BREAK}') AS a FROM reports)",
        ],
        "SELECT report_id, CASE WHEN starts_with(a[-1], 'JSON_SUMMARY:') "
        "THEN array_to_string(a[1:len(a) - 1], '\n') ELSE report END AS report FROM sl",
    ),
)
HISTORY = [
    *SUMMARY,
    "jf AS (SELECT report_id, list_sort(list(upper(key))) AS fails FROM jv WHERE verdict = 'FAIL' GROUP BY report_id)",
    "history AS (SELECT t.ts AS timestamp, t.provider, t.model, t.file, p AS pass, f AS fail, n AS na, p + f AS answered, "
    "13 - n AS applicable, CASE WHEN p + f > 0 THEN printf('%.2f', p / (p + f) * 100) ELSE '' END AS compliance_pct, "
    "coalesce(array_to_string(jf.fails, '|'), '') AS fails FROM tally t LEFT JOIN jf USING (report_id))",
]


def history(spark, d):
    return O.audit_history(D.reports(spark, d), F.col("ts"))


add("a9_audit_history", history, S.with_([BASE, *HISTORY], "SELECT * FROM history"))


def history_round_trip(spark, d):
    """The history appended in two runs, the second one once more after a part of it, and read again."""
    rows, path = stored(history(spark, d), "rows", D.new_folder(spark, "rows")), D.new_folder(spark, "history")
    half = F.pmod(F.xxhash64("file"), F.lit(2))
    append_history(rows.filter(half == 0), path, "run-0")
    append_history(rows.filter((half == 1) & (F.col("pass") > 5)), path, "run-1")
    append_history(rows.filter(half == 1), path, "run-1")
    return read_history(spark, path, rows.schema["timestamp"].dataType.simpleString())


add("s3_history_round_trip", history_round_trip, S.with_([BASE, *HISTORY], "SELECT * FROM history"))
add(
    "a10_failed_questions",
    lambda spark, d: O.failed_questions(D.reports(spark, d)),
    S.with_([BASE, *JSON], "SELECT report_id, upper(key) AS question FROM jv WHERE verdict = 'FAIL'"),
)
add(
    "a11_audit_rollup",
    lambda spark, d: O.audit_rollup(history(spark, d), "provider", "model"),
    S.with_(
        [BASE, *HISTORY],
        "SELECT provider, model, count(*) AS reports, sum(pass)::BIGINT AS pass, sum(fail)::BIGINT AS fail, "
        "sum(na)::BIGINT AS na, sum(answered)::BIGINT AS answered, "
        "CASE WHEN sum(answered) > 0 THEN sum(pass)::BIGINT / sum(answered)::BIGINT * 100 END AS compliance "
        "FROM history GROUP BY ROLLUP (provider, model)",
    ),
)
def kept_rollup(spark, d):
    """Totals of three runs, the second one made twice, from the groups that each has left; the numbers of files are within
    four standard errors of the exact ones."""
    rows, path = history(spark, d), D.new_folder(spark, "totals")
    third = F.pmod(F.xxhash64("file"), F.lit(3))
    for run in (0, 1, 1, 2):
        keep_groups(O.audit_groups(rows.filter(third == run), "provider", "model", files=True), path, f"run-{run}")
    found = O.rollup_audit_groups(kept_groups(spark, path), "provider", "model")
    exact = rows.rollup("provider", "model").agg(F.count_distinct("file").alias("n")).withColumnsRenamed(
        {"provider": "p", "model": "m"}
    )
    same = F.col("provider").eqNullSafe(F.col("p")) & F.col("model").eqNullSafe(F.col("m"))
    near = (F.abs(F.col("files") - F.col("n")) <= F.greatest(F.lit(1), 0.065 * F.col("n"))).alias("files_near")
    return found.join(exact, same).select(*(c for c in found.columns if c != "files"), near)


add(
    "a11_kept_rollup",
    kept_rollup,
    ORACLES["a11_audit_rollup"].replace("AS compliance FROM history", "AS compliance, true AS files_near FROM history"),
)
add(
    "a11_question_rollup",
    lambda spark, d: O.question_rollup(
        O.question_verdicts(D.reports(spark, d), keep=("provider",)), "provider"
    ),
    S.with_(
        [BASE, *VERDICTS],
        "SELECT provider, q, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail, "
        "count(*) FILTER (verdict IN ('N/A', 'NA')) AS na FROM verdicts "
        "JOIN (SELECT report_id, provider FROM reports) USING (report_id) GROUP BY provider, q",
    ),
)
_RULER = "=" * 60
add(
    "a12_report_render",
    lambda spark, d: O.report_render(
        D.reports(spark, d).withColumn("prefix", F.concat("provider", F.lit("_ticket_audit"))), NOW
    ).select("report_id", "path", "content"),
    S.with_(
        [BASE],
        "SELECT report_id, 'reports/' || provider || '_ticket_audit_20240201_083000.txt' AS path, "
        f"'=== INCIDENT AUDIT REPORT (16-QUESTION FRAMEWORK) ===\nGenerated: {NOW}\nAudit Type: ' || "
        f"upper(provider) || '_TICKET\n{_RULER}\n\n' || report || '\n\n{_RULER}\nReport saved to: reports/' || provider "
        "|| '_ticket_audit_20240201_083000.txt\n' AS content FROM reports",
    ),
)

ANSWERS = {
    "audit_id": "conv_id",
    "q": "turn + 1",
    "question": "role",
    "standard": "'Standard ' || cast(turn as string)",
    "response": "text",
}
ANSWERS_OF = (ANSWERS, {**ANSWERS, "audit_id": "-1 - conv_id", "response": "cast(null as string)"})  # audits without answers
add(
    "a13_assemble_question_report",
    lambda spark, d: O.assemble_question_report(D.derive_more(spark, d, "conversations", *ANSWERS_OF), NOW),
    S.with_(
        [
            f"answers AS ({D.more_sql('conversations', *ANSWERS_OF)})",
            "blocks AS (SELECT audit_id, count(response) AS n, string_agg('\n**QUESTION ' || q::VARCHAR || ': ' || question "
            "|| '**\n**Network Team Standard**: ' || standard || '\n\n' || response || '\n\n' || repeat('-', 50) || '\n', '' "
            "ORDER BY q) AS body FROM answers GROUP BY audit_id)",
        ],
        "SELECT audit_id, CASE WHEN n = 0 THEN 'No audit results to report.' ELSE '\n=== STEP-BY-STEP AUDIT REPORT ===\n"
        f"Generated: {NOW}\nTotal Questions: ' || n::VARCHAR || '\n{_RULER}\n\n' || body END AS content FROM blocks",
    ),
)
_SIDE = (
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY timestamp DESC, model DESC, pass DESC, "
    "fail DESC, na DESC) AS rn FROM history WHERE provider = '{}') WHERE rn = 1)"
)
add(
    "a14_compare_providers",
    lambda spark, d: O.compare_providers(history(spark, d), "claude", "openai"),
    S.with_(
        [BASE, *HISTORY],
        "SELECT coalesce(a.file, b.file) AS file, "
        + ", ".join(f"{t}.{k} AS {t}_{k}" for t in "ab" for k in ("pass", "fail", "na", "compliance_pct"))
        + ", coalesce(a.pass = b.pass AND a.fail = b.fail, false) AS same_counts "
        f"FROM {_SIDE.format('claude')} a FULL JOIN {_SIDE.format('openai')} b ON a.file = b.file",
    ),
)
