"""Batch results: summary, common issues, file views and output bundle.

``files`` has one row per file: ``filename, status, redacted_text, audit_report,
redaction_count, redaction_details, audit_score, error_message, processing_time, file_size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import FAIL_MARK, PASS_MARK, audit_score
from ..functions.text import contains_any, let

# --- fixed values: issue groups and their phrases, in report order -----------------------
ISSUES = (
    ("First Access", ("first access",)),
    ("Time Tracking", ("time worked", "time tracking")),
    ("Heading Fields", ("heading fields", "ci/location", "service offering")),
    ("Client Communication", ("client communication", "client updates")),
    ("Resolution Documentation", ("resolution", "resolution documentation")),
)
REPORT_FROM_PERCENT = 20
TOP_ISSUES = 3
MAX_FILE_MB = 50
ERROR_CHARS = 50


def _ok() -> Column:
    return F.col("status") == "success"


def score_percent(score: Column) -> Column:
    """First percentage in a score text, null without one; one of any size, exact up to 2^53."""
    return F.regexp_extract(score, r"([0-9]+)%", 1).try_cast("double")


def batch_summary(files: DataFrame) -> DataFrame:
    """One row: counts, redactions and the average score (0 when no file has a score)."""
    return files.agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(_ok()).alias("successful_files"),
        F.count_if(~_ok()).alias("failed_files"),
        F.coalesce(F.sum(F.when(_ok(), F.col("redaction_count"))), F.lit(0)).alias(
            "total_redactions"
        ),
        F.coalesce(F.avg(F.when(_ok(), score_percent(F.col("audit_score")))), F.lit(0.0)).alias(
            "average_score"
        ),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("processing_time"),
    ]


def issue_flags(report: Column) -> Column:
    """One flag per issue group, 1 where a phrase is mentioned with a sign of failure.

    Every sign of failure comes with the phrase itself, and a pass mark anywhere or an
    all-clear rules out every group, so these are tested first and once.
    """
    none = F.array(*(F.lit(0) for _ in ISSUES))

    def mentioned(lowered, phrase, failing):
        return lowered.contains(phrase) & (
            failing | contains_any(lowered, (f"no {phrase}", f"not {phrase}", f"{phrase} not"))
        )

    def flags(lowered):
        failing = report.contains(FAIL_MARK) | contains_any(lowered, ("**answer:** no", "**answer: no"))
        groups = []
        for _, phrases in ISSUES:
            hit = F.lit(False)
            for phrase in phrases:
                hit = hit | mentioned(lowered, phrase, failing)
            groups.append(hit.cast("int"))
        return F.when(contains_any(lowered, ("no issues", "no problems")), none).otherwise(
            F.array(*groups)
        )

    return F.when(report.contains(PASS_MARK), none).otherwise(let(F.lower(report), flags))


def common_issues(files: DataFrame, top: int = TOP_ISSUES) -> DataFrame:
    """``(position, issue, reports, percentage, message)`` of the issues most reports share.

    Phrases are tested inside each report and summed up in one aggregation: no phrase table is
    joined, and what is shuffled is one row of counts per task.
    """
    flagged = files.filter(_judged()).select(issue_flags(F.col("audit_report")).alias("flags"))
    return flagged.agg(*_issue_counts()).select(F.inline(_top_issues(top)))


def _judged() -> Column:
    return _ok() & (F.col("audit_report") != "")


def _issue_counts() -> list[Column]:
    """Reports with flags, and reports with each issue."""
    return [
        F.count("flags").alias("n"),
        *(F.sum(F.col("flags")[i]).alias(f"c{i}") for i in range(len(ISSUES))),
    ]


def _top_issues(top: int) -> Column:
    """Of one row of counts: the issues as an array, the most frequent first."""

    def row(i, name):
        count = F.col(f"c{i}")
        percentage = F.bround(count / F.when(F.col("n") > 0, F.col("n")) * 100).cast("int")
        message = F.concat(F.lit(f"{name} failing in "), percentage.cast("string"), F.lit("% of files"))
        return F.struct(
            (-percentage).alias("order"), F.lit(i).alias("position"), F.lit(name).alias("issue"),
            count.alias("reports"), percentage.alias("percentage"), message.alias("message"),
        )

    rows = F.array(*(row(i, name) for i, (name, _) in enumerate(ISSUES)))
    frequent = F.filter(rows, lambda r: (r["reports"] > 0) & (r["percentage"] >= REPORT_FROM_PERCENT))
    return F.transform(F.slice(F.array_sort(frequent), 1, top), lambda r: r.dropFields("order"))


def file_status(files: DataFrame) -> DataFrame:
    """One display line per file: score and redactions, or the start of the error."""
    ok_line = F.concat(
        F.lit(f"{PASS_MARK} **"), F.col("filename"), F.lit("** | Score: "), F.col("audit_score"),
        F.lit(" | Redactions: "), F.col("redaction_count").cast("string"),
    )
    bad_line = F.concat(
        F.lit(f"{FAIL_MARK} **"), F.col("filename"), F.lit("** | Error: "),
        F.substring("error_message", 1, ERROR_CHARS), F.lit("..."),
    )
    return files.select("filename", "status", F.when(_ok(), ok_line).otherwise(bad_line).alias("line"))


def size_check(files: DataFrame, limit_mb: int = MAX_FILE_MB) -> DataFrame:
    mb = F.col("file_size") / (1024 * 1024)
    return files.select(
        "filename", F.bround(mb, 1).alias("size_mb"), (mb > limit_mb).alias("over_limit")
    )


def _out_name(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.col("filename"), F.lit(".pdf"), F.lit(".txt")))


SUMMARY_FILE = "batch_summary.txt"


def result_bundle(files: DataFrame, summary_at: str | None = None) -> DataFrame:
    """``(path, content)``: redacted text and audit report of each successful file.

    With ``summary_at``, the time to print, the batch summary is in it too, as ``(path, section, filename,
    content)``: in order of section and filename its blocks make up the file ``SUMMARY_FILE``, and every other file is
    one block. ``sources.write_ordered`` writes them in order.
    """
    entry = lambda prefix, text: F.struct(
        _out_name(prefix).alias("path"), F.col(text).alias("content")
    )
    entries = F.array(entry("redacted_", "redacted_text"), entry("audit_", "audit_report"))
    bundle = files.filter(_ok()).select(F.inline_outer(entries))
    if summary_at is None:
        return bundle
    summary = render_batch_summary(files, summary_at).withColumn("path", F.lit(SUMMARY_FILE))
    whole = bundle.withColumns({"section": F.lit(0), "filename": F.lit("")})
    return whole.unionByName(summary).select("path", "section", "filename", "content")


def _number(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def file_block(files: DataFrame) -> DataFrame:
    """``(filename, content)``: the block of each file in the batch summary."""
    details = F.transform(
        F.map_entries("redaction_details"),
        lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"].cast("string"), F.lit("\n")),
    )
    good = F.concat(
        F.lit("Score: "), F.col("audit_score"),
        F.lit("\nRedactions: "), F.col("redaction_count").cast("string"),
        F.lit("\nProcessing Time: "), _number(F.col("processing_time")), F.lit("s\n"),
        F.when(
            F.size("redaction_details") > 0,
            F.concat(F.lit("Redaction Details:\n"), F.array_join(details, "")),
        ).otherwise(""),
    )
    bad = F.concat(F.lit("Error: "), F.col("error_message"), F.lit("\n"))
    content = F.concat(
        F.lit("\nFile: "), F.col("filename"), F.lit("\nStatus: "), F.upper("status"), F.lit("\n"),
        F.when(_ok(), good).otherwise(bad),
        F.lit("-" * 30 + "\n"),
    )
    return files.select("filename", content.alias("content"))


def render_batch_summary(files: DataFrame, now: str) -> DataFrame:
    """The batch summary as ``(section, filename, content)``.

    In order of ``section, filename`` the contents make up the text. It stays a table of
    blocks, because one text for all files of a large batch would have to pass through one
    task. ``sources.write_ordered`` writes it as ordered part files.
    """
    flags = F.when(_judged(), issue_flags(F.col("audit_report")))
    counted = files.withColumn("flags", flags).agg(*_totals(), *_issue_counts())
    overview = F.concat(
        F.lit(f"\nBATCH PROCESSING SUMMARY\n{'=' * 24}\nGenerated: {now}\n\nOVERVIEW:\n"),
        F.lit("- Total Files: "), F.col("total_files").cast("string"),
        F.lit("\n- Successful: "), F.col("successful_files").cast("string"),
        F.lit("\n- Failed: "), F.col("failed_files").cast("string"),
        F.lit("\n- Total Redactions: "), F.col("total_redactions").cast("string"),
        F.lit("\n- Average Score: "), _number(F.col("average_score")),
        F.lit("%\n- Processing Time: "), _number(F.col("processing_time")),
        F.lit(" seconds\n\nCOMMON ISSUES:\n"),
    )
    messages = F.array_join(
        F.transform(_top_issues(TOP_ISSUES), lambda r: F.concat(F.lit("- "), r["message"], F.lit("\n"))), ""
    )
    issues = F.concat(
        F.when(messages == "", F.lit("- No common issues identified\n")).otherwise(messages),
        F.lit(f"\nFILE DETAILS:\n{'=' * 50}\n"),
    )
    head = counted.select(F.inline(_sections(overview, issues)))
    blocks = file_block(files).select(F.lit(2).alias("section"), "filename", "content")
    return head.unionByName(blocks)


def _sections(*contents: Column) -> Column:
    return F.array(
        *(
            F.struct(F.lit(i).alias("section"), F.lit("").alias("filename"), c.alias("content"))
            for i, c in enumerate(contents)
        )
    )


def render_short_summary(files: DataFrame, now: str) -> DataFrame:
    """The shorter form of the batch summary, as ``(section, filename, content)`` like ``render_batch_summary``:
    no average and no issues, and the score of each file is read from its audit report."""
    overview = F.concat(
        F.lit(f"BATCH PROCESSING SUMMARY\n{'=' * 24}\nGenerated: {now}\n\nOVERVIEW:\n"),
        F.lit("- Total Files: "), F.col("total_files").cast("string"),
        F.lit("\n- Successful: "), F.col("successful_files").cast("string"),
        F.lit("\n- Failed: "), F.col("failed_files").cast("string"),
        F.lit("\n- Total Redactions: "), F.col("total_redactions").cast("string"),
        F.lit("\n- Processing Time: "), _number(F.col("processing_time")),
        F.lit(f" seconds\n\nFILE DETAILS:\n{'=' * 13}\n"),
    )
    good = F.concat(
        F.lit("Redactions: "), F.col("redaction_count").cast("string"),
        F.lit("\nAudit Score: "), audit_score(F.col("audit_report")), F.lit("\n"),
    )
    block = F.concat(
        F.lit("\nFile: "), F.col("filename"), F.lit("\nStatus: "), F.upper("status"), F.lit("\n"),
        F.when(_ok(), good).otherwise(F.concat(F.lit("Error: "), F.col("error_message"), F.lit("\n"))),
        F.lit("-" * 30 + "\n"),
    )
    blocks = files.select(F.lit(1).alias("section"), "filename", block.alias("content"))
    return batch_summary(files).select(F.inline(_sections(overview))).unionByName(blocks)
