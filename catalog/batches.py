"""Queries on batch results, documents out of pages, and the output bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketveil.functions.text import strip
from ticketveil.operators import batch as O
from ticketveil.operators import documents as P
from ticketveil.operators import issues as I
from ticketveil.plans import batch_files as plan_batch_files
from ticketveil.plans import stored
from ticketveil.plans.batch import STAT_KEYS
from ticketveil.sources import read_documents, write_bundle, write_ordered

from . import derived as D
from . import sqltext as S
from .audits import MARKS_SQL, SCORE_SQL, last_hit, ratio
from .redaction import NORMALIZED

QUERIES, ORACLES = {}, {}
BASE = f"files AS (SELECT * FROM {D.FILES_SQL})"
NOW = "2024-02-01 08:30:00"


def add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


# --- pages and conversations ----------------------------------------------------------------

PAGES = {
    "doc_id": "conv_id",
    "page_no": "turn",
    "text": "text",
}
# an empty page after every fifth, and documents of empty pages only
EMPTY_PAGES = {"doc_id": "conv_id", "page_no": "turn * 2 + 1", "text": "case when (conv_id + turn) % 5 = 0 then '' else ' ' end"}
EMPTY_DOCS = {"doc_id": "-1 - conv_id", "page_no": "turn", "text": "''"}
PAGES_OF = ({**PAGES, "page_no": "turn * 2"}, EMPTY_PAGES, EMPTY_DOCS)
PAGES_SQL = f"pages_of AS ({D.more_sql('conversations', *PAGES_OF)})"


def pages(spark, d):
    return D.derive_more(spark, d, "conversations", *PAGES_OF)


add(
    "s1_assemble_pages",
    lambda spark, d: P.assemble_pages(pages(spark, d)),
    S.with_(
        [PAGES_SQL],
        "SELECT doc_id, coalesce(string_agg(text, '\n' ORDER BY page_no) FILTER (text <> ''), '') AS text "
        "FROM pages_of GROUP BY doc_id",
    ),
)
add(
    "s1_assemble_first_pages",
    lambda spark, d: P.assemble_pages(pages(spark, d), max_pages=3),
    S.with_(
        [
            PAGES_SQL,
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS rn FROM pages_of)",
        ],
        "SELECT doc_id, coalesce(string_agg(text, '\n' ORDER BY page_no) FILTER (text <> ''), '') AS text "
        "FROM ranked WHERE rn <= 3 GROUP BY doc_id",
    ),
)
add(
    "s1_assemble_page_parts",
    lambda spark, d: P.assemble_pages(pages(spark, d), pages_per_part=3),
    S.with_(
        [PAGES_SQL],
        "SELECT doc_id, floor(page_no / 3)::BIGINT AS part, "
        "coalesce(string_agg(text, '\n' ORDER BY page_no) FILTER (text <> ''), '') AS text "
        "FROM pages_of GROUP BY ALL",
    ),
)
GATED = ({"doc_id": "doc_id", "text": "text"}, {"doc_id": "-1 - doc_id", "text": "'  ' || chr(10)"})
add(
    "s2_no_text_gate",
    lambda spark, d: P.no_text_gate(D.derive_more(spark, d, "documents", *GATED)),
    f"SELECT *, CASE WHEN {S.strip('text')} = '' THEN 'error' ELSE 'processing' END AS status, "
    f"CASE WHEN {S.strip('text')} = '' THEN '{P.NO_TEXT}' ELSE '' END AS error_message "
    f"FROM ({D.more_sql('documents', *GATED)})",
)
add(
    "s3_read_documents",
    lambda spark, d: read_documents(spark, f"{d}/documents.parquet").select(
        "doc_id", F.length("text").alias("chars"), F.length(strip(F.col("text"))).alias("inner_chars")
    ),
    f"SELECT doc_id, length(text)::INTEGER AS chars, length({S.strip('text')})::INTEGER AS inner_chars FROM documents",
)
TURNS = {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}
TURNS_OF = (TURNS, {**TURNS, "turn": "turn + 10", "text": "cast(null as string)"})  # turns without a text
TURNS_SQL = f"turns AS ({D.more_sql('conversations', *TURNS_OF)})"
add(
    "s5_conversation_export",
    lambda spark, d: P.conversation_export(D.table(spark, d, "conversations"), now=NOW),
    "SELECT conv_id, count(*)::INTEGER AS n_turns, sum(length(text))::BIGINT AS text_length, "
    f"to_json({{'timestamp': '{NOW}', 'conversation': list({{'role': role, 'content': text}} ORDER BY turn), "
    "'original_text_length': sum(length(text))::BIGINT})::VARCHAR AS export FROM conversations GROUP BY conv_id",
)
add(
    "s5_conversation_export_parts",
    lambda spark, d: P.conversation_export(D.derive_more(spark, d, "conversations", *TURNS_OF), turns_per_part=2),
    S.with_(
        [TURNS_SQL],
        "SELECT conv_id, floor(turn / 2)::BIGINT AS part, count(*)::INTEGER AS n_turns, "
        "coalesce(sum(length(text)), 0)::BIGINT AS text_length, "
        "to_json({'conversation': list({'role': role, 'content': text} ORDER BY turn), "
        "'original_text_length': coalesce(sum(length(text)), 0)::BIGINT})::VARCHAR AS export FROM turns "
        "GROUP BY conv_id, floor(turn / 2)",
    ),
)

# --- batch ----------------------------------------------------------------------------------

SCORE = "try_cast(nullif(regexp_extract(audit_score, '([0-9]+)%', 1), '') AS INTEGER)"
TOTALS = (
    "SELECT count(*) AS total_files, count(*) FILTER (status = 'success') AS successful_files, "
    "count(*) FILTER (status <> 'success') AS failed_files, "
    "coalesce(sum(redaction_count) FILTER (status = 'success'), 0)::BIGINT AS total_redactions, "
    f"coalesce(sum({SCORE}) FILTER (status = 'success')::BIGINT / count({SCORE}) FILTER (status = 'success'), 0) AS average_score, "
    "sum(processing_time) AS processing_time FROM files"
)
add("b1_b2_batch_summary", lambda spark, d: O.batch_summary(D.files(spark, d)), S.with_([BASE], TOTALS))


def _issue(phrases) -> str:
    def found(p):
        return (
            f"((contains(audit_report, '❌') AND contains(low, '{p}')) OR contains(low, 'no {p}') OR "
            f"contains(low, 'not {p}') OR contains(low, '{p} not') OR "
            f"((contains(low, '**answer:** no') OR contains(low, '**answer: no')) AND contains(low, '{p}'))) "
            f"AND NOT ((contains(audit_report, '✅') AND contains(low, '{p}')) OR contains(low, 'no issues') "
            f"OR contains(low, 'no problems'))"
        )

    return "(" + " OR ".join(f"({found(p)})" for p in phrases) + ")"


_PER_ISSUE = " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS issue, count(*) FILTER ({_issue(ph)}) AS reports, count(*) AS n FROM good"
    for i, (name, ph) in enumerate(O.ISSUES)
)
ISSUES = [
    "good AS (SELECT *, lower(audit_report) AS low FROM files WHERE status = 'success' AND audit_report <> '')",
    f"per_issue AS ({_PER_ISSUE})",
    "shares AS (SELECT position, issue, reports, round_even(reports / n * 100, 0)::INTEGER AS percentage FROM per_issue)",
    "issues AS (SELECT *, issue || ' failing in ' || percentage::VARCHAR || '% of files' AS message FROM shares "
    "WHERE reports > 0 AND percentage >= 20 ORDER BY percentage DESC, position LIMIT 3)",
]
add(
    "b3_common_issues",
    lambda spark, d: O.common_issues(D.files(spark, d)),
    S.with_([BASE, *ISSUES], "SELECT * FROM issues"),
)


def legacy_files(spark, d):
    """Files whose reports have no full question list, so that issues are not hidden by passes."""
    short = {**D.FILES, "audit_report": D.OTHER_REPORT.replace("% 8", "% 4 + 4")}
    return D.derive_wide(spark, d, "orders", short)


_SHORT = D.columns({**D.FILES, "audit_report": D.OTHER_REPORT.replace("% 8", "% 4 + 4")})
add(
    "b3_common_issues_short_reports",
    lambda spark, d: O.common_issues(legacy_files(spark, d)),
    S.with_([f"files AS (SELECT {_SHORT} FROM orders)", *ISSUES], "SELECT * FROM issues"),
)


# reports out of documents, and phrases out of benchmark items, which documents quote: words, and pieces that begin and
# end within words
DOC_REPORTS = {
    "status": "case when doc_id % 11 = 10 then 'error' else 'success' end",
    "audit_report": "case cast(doc_id % 8 as int) when 0 then '❌ fail: ' || text when 1 then '**Answer:** No, ' || text when 2 then 'not ' || text "
    "when 3 then text || ' ✅' when 4 then text || ' not' when 5 then '❌ no issues ' || text when 6 then text "
    "else '❌ ' || substr(text, 1, 200) end",
}
ITEM_PHRASES = (
    {"position": "item_id", "issue": "'item ' || cast(item_id as string)", "phrase": "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)"},
    {"position": "item_id", "issue": "'item ' || cast(item_id as string)", "phrase": "substr(text, 20, 14)"},
    {"position": "1000000 + item_id % 7", "issue": "'common ' || cast(item_id % 7 as string)", "phrase": "split_part(text, ' ', 5)"},
    {"position": "-1 - item_id % 3", "issue": "'short ' || cast(item_id % 3 as string)", "phrase": "lower(substr(text, 1, 3))"},
)
_DOC_REPORTS = f"files AS (SELECT {D.columns(DOC_REPORTS)} FROM documents)"


def issue_table(spark, d):
    files = D.derive_wide(spark, d, "documents", DOC_REPORTS)
    issues = D.derive_more(spark, d, "benchmark", *ITEM_PHRASES)
    return I.issue_counts(files, issues, lambda df: stored(df, "issues", D.new_folder(spark, "issues")))


_LOW = "lower(phrase)"
add(
    "b3_issue_table",
    issue_table,
    S.with_(
        [
            _DOC_REPORTS,
            f"phrases AS (SELECT DISTINCT position, issue, {_LOW} AS phrase FROM ({D.more_sql('benchmark', *ITEM_PHRASES)}) WHERE phrase <> '')",
            "good AS (SELECT audit_report, lower(audit_report) AS low, row_number() OVER () AS report FROM files WHERE status = 'success' AND audit_report <> '')",
            "marked AS (SELECT report, low, contains(audit_report, '❌') OR contains(low, '**answer:** no') OR contains(low, '**answer: no') AS failing "
            "FROM good WHERE NOT contains(audit_report, '✅') AND NOT contains(low, 'no issues') AND NOT contains(low, 'no problems'))",
            "hits AS (SELECT DISTINCT position, issue, report FROM marked JOIN phrases ON contains(low, phrase) AND (failing OR contains(low, 'no ' || phrase) "
            "OR contains(low, 'not ' || phrase) OR contains(low, phrase || ' not')))",
        ],
        "SELECT position, issue, count(*) AS reports, (SELECT count(*) FROM good) AS n FROM hits GROUP BY position, issue",
    ),
)


def detailed_files(spark, d):
    details = F.create_map(
        F.lit("ip_addresses"), (F.col("redaction_count") % 3).cast("int"),
        F.lit("names_truncated"), (F.col("redaction_count") % 5).cast("int"),
    )
    return D.files(spark, d).withColumn("redaction_details", details)


_BLOCK = (
    "'\nFile: ' || filename || '\nStatus: ' || upper(status) || '\n' || CASE WHEN status = 'success' THEN 'Score: ' || audit_score "
    "|| '\nRedactions: ' || redaction_count::VARCHAR || '\nProcessing Time: ' || printf('%.1f', processing_time) "
    "|| 's\nRedaction Details:\n  - ip_addresses: ' || (redaction_count % 3)::VARCHAR || '\n  - names_truncated: ' "
    "|| (redaction_count % 5)::VARCHAR || '\n' ELSE 'Error: ' || error_message || '\n' END || repeat('-', 30) || '\n'"
)
SUMMARY_SQL = S.with_(
    [BASE, *ISSUES, f"totals AS ({TOTALS})"],
    f"SELECT 0 AS section, '' AS filename, '\nBATCH PROCESSING SUMMARY\n{'=' * 24}\nGenerated: {NOW}\n\nOVERVIEW:\n"
    "- Total Files: ' || total_files::VARCHAR || '\n- Successful: ' || successful_files::VARCHAR || '\n- Failed: ' || "
    "failed_files::VARCHAR || '\n- Total Redactions: ' || total_redactions::VARCHAR || '\n- Average Score: ' || "
    "printf('%.1f', average_score) || '%\n- Processing Time: ' || printf('%.1f', processing_time) || "
    "' seconds\n\nCOMMON ISSUES:\n' AS content FROM totals "
    "UNION ALL SELECT 1, '', coalesce(string_agg('- ' || message || '\n', '' ORDER BY percentage DESC, position), "
    f"'- No common issues identified\n') || '\nFILE DETAILS:\n{'=' * 50}\n' FROM issues "
    f"UNION ALL SELECT 2, filename, {_BLOCK} FROM files",
)
add("b4_render_batch_summary", lambda spark, d: O.render_batch_summary(detailed_files(spark, d), NOW), SUMMARY_SQL)
_SHORT_BLOCK = (
    "'\nFile: ' || filename || '\nStatus: ' || upper(status) || '\n' || CASE WHEN status = 'success' THEN 'Redactions: ' "
    f"|| redaction_count::VARCHAR || '\nAudit Score: ' || {SCORE_SQL} || '\n' ELSE 'Error: ' || error_message || '\n' END "
    "|| repeat('-', 30) || '\n'"
)
add(
    "b4_render_short_summary",
    lambda spark, d: O.render_short_summary(D.files(spark, d), NOW),
    S.with_(
        [BASE, f"totals AS ({TOTALS})", f"scored AS (SELECT *, {MARKS_SQL} FROM (SELECT *, audit_report AS report FROM files))"],
        f"SELECT 0 AS section, '' AS filename, 'BATCH PROCESSING SUMMARY\n{'=' * 24}\nGenerated: {NOW}\n\nOVERVIEW:\n"
        "- Total Files: ' || total_files::VARCHAR || '\n- Successful: ' || successful_files::VARCHAR || '\n- Failed: ' || "
        "failed_files::VARCHAR || '\n- Total Redactions: ' || total_redactions::VARCHAR || '\n- Processing Time: ' || "
        f"printf('%.1f', processing_time) || ' seconds\n\nFILE DETAILS:\n{'=' * 13}\n' AS content FROM totals "
        f"UNION ALL SELECT 1, filename, {_SHORT_BLOCK} FROM scored",
    ),
)
add(
    "b5_file_status",
    lambda spark, d: O.file_status(D.files(spark, d)),
    S.with_(
        [BASE],
        "SELECT filename, status, CASE WHEN status = 'success' THEN '✅ **' || filename || '** | Score: ' || audit_score || "
        "' | Redactions: ' || redaction_count::VARCHAR ELSE '❌ **' || filename || '** | Error: ' || "
        "substr(error_message, 1, 50) || '...' END AS line FROM files",
    ),
)
add(
    "b6_size_check",
    lambda spark, d: O.size_check(D.files(spark, d)),
    S.with_(
        [BASE],
        "SELECT filename, round_even(file_size / 1048576, 1) AS size_mb, file_size / 1048576 > 50 AS over_limit FROM files",
    ),
)
BUNDLE_SQL = S.with_(
    [BASE],
    "SELECT 'redacted_' || replace(filename, '.pdf', '.txt') AS path, redacted_text AS content FROM files WHERE status = 'success' "
    "UNION ALL SELECT 'audit_' || replace(filename, '.pdf', '.txt'), audit_report FROM files WHERE status = 'success'",
)
add("s4_result_bundle", lambda spark, d: O.result_bundle(D.files(spark, d)), BUNDLE_SQL)
add(
    "s4_bundle_with_summary",
    lambda spark, d: O.result_bundle(detailed_files(spark, d), NOW),
    f"SELECT path, 0 AS section, '' AS filename, content FROM ({BUNDLE_SQL}) "
    f"UNION ALL SELECT 'batch_summary.txt', section, filename, content FROM ({SUMMARY_SQL})",
)


def bundle_round_trip(spark, d):
    """The result bundle written and read again."""
    path = D.new_folder(spark, "bundle")
    write_bundle(O.result_bundle(D.files(spark, d)), path)
    return spark.read.parquet(path)


def ordered_round_trip(spark, d):
    """The lines of the batch summary, written as ordered text and read again."""
    path = D.new_folder(spark, "summary")
    write_ordered(O.render_batch_summary(detailed_files(spark, d), NOW), path, "section", "filename")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


add("s3_bundle_round_trip", bundle_round_trip, BUNDLE_SQL)
add(
    "s3_ordered_round_trip",
    ordered_round_trip,
    "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(content, '\n$', ''), chr(10))) AS line "
    f"FROM ({SUMMARY_SQL})) GROUP BY line",
)


# --- documents and reports to a batch ---------------------------------------------------------

DOCS = {"filename": D.FILES["filename"], "text": D.TICKET, "processing_time": D.FILES["processing_time"]}
# documents without any text, and without a report
BLANK_DOCS = {**DOCS, "filename": f"'BLANK' || {D.s(D.K)}", "text": "'  ' || chr(10)"}
REPORTS_OF = {"filename": D.FILES["filename"], "audit_report": D.REPORT}
FRACTION = "([0-9]+)/([0-9]+)"
DETAILS = [k for k in STAT_KEYS if k != "ip_redacted"]


def batch_files(spark, d):
    docs = D.derive_wide(spark, d, "orders", DOCS).unionByName(D.derive_wide(spark, d, "orders", BLANK_DOCS))
    found = plan_batch_files(docs, D.derive_wide(spark, d, "orders", REPORTS_OF))
    details = (F.col("redaction_details")[k].alias(k) for k in DETAILS)
    return found.select("*", *details).drop("redaction_details")


add(
    "e2_batch_files",
    batch_files,
    S.with_(
        [
            f"docs AS ({D.more_sql('orders', DOCS, BLANK_DOCS)})",
            f"reports AS (SELECT {D.columns(REPORTS_OF)}, audit_report AS report FROM orders)",
            "corpus AS (SELECT filename AS doc_id, filename AS kind, text AS t FROM docs)",
            *NORMALIZED,
            *S.redaction_ctes("normal"),
        ],
        f"SELECT d.filename, CASE WHEN {S.strip('text')} = '' THEN 'error' ELSE 'success' END AS status, "
        f"CASE WHEN {S.strip('text')} = '' THEN '' ELSE t END AS redacted_text, "
        f"CASE WHEN {S.strip('text')} = '' THEN 0 ELSE total_redactions END::BIGINT AS redaction_count, "
        f"CASE WHEN {S.strip('text')} = '' THEN '{P.NO_TEXT}' ELSE '' END AS error_message, processing_time, "
        f"strlen(text) AS file_size, coalesce(audit_report, '') AS audit_report, CASE WHEN audit_report IS NULL THEN '' ELSE "
        f"coalesce({ratio(last_hit(FRACTION), FRACTION, repr('Score not available'))}, "
        f"{last_hit('[0-9]+%')}, 'Score not available') END AS audit_score, {', '.join(DETAILS)} "
        "FROM docs d JOIN done ON done.doc_id = d.filename LEFT JOIN reports r ON r.filename = d.filename",
    ),
)
