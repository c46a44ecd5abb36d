"""Operators on a table of audit reports and on the audit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audit as A
from .assemble import joined_in_order
from .rows import inline_rows, numbered_rows

HISTORY_COLUMNS = (
    "timestamp", "provider", "model", "file", "pass", "fail", "na", "answered", "applicable",
    "compliance_pct", "fails",
)


def audit_summary(reports: DataFrame, id: str = "report_id", report: str = "report") -> DataFrame:
    return reports.select(id, A.audit_summary(F.col(report)).alias("s")).select(id, "s.*")


def audit_scores(reports: DataFrame, id: str = "report_id", report: str = "report") -> DataFrame:
    r = F.col(report)
    return reports.select(
        id, A.audit_score(r).alias("score"), A.simple_score(r).alias("simple_score")
    )


def question_verdicts(
    reports: DataFrame, id: str = "report_id", report: str = "report", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, q, title, verdict)``, one row per question."""
    return inline_rows(reports, [id, *keep], A.question_verdicts(F.col(report)), "q")


def key_findings(
    reports: DataFrame, k: int = 3, id: str = "report_id", report: str = "report"
) -> DataFrame:
    """``(id, rank, finding)``, at most ``k`` per report."""
    found = A.key_findings(F.col(report), k)
    return numbered_rows(reports, [id], found, "rank", "finding").withColumn(
        "rank", F.col("rank") + 1
    )


def failed_questions(reports: DataFrame, id: str = "report_id", report: str = "report") -> DataFrame:
    """``(id, question)``, one row per failed question."""
    failed = A.failed_questions(F.col(report))
    return numbered_rows(reports, [id], failed, "n", "question").drop("n")


def audit_history(
    reports: DataFrame,
    now: Column,
    report: str = "report",
    provider: str = "provider",
    model: str = "model",
    file: str = "file",
) -> DataFrame:
    """One history row per report. Append it with ``sources.append_history``."""
    r = F.col(report)
    s = F.col("both")["summary"]
    pct = s["compliance_percentage"]
    return reports.select(
        now.alias("timestamp"),
        F.col(provider).alias("provider"),
        F.col(model).alias("model"),
        F.col(file).alias("file"),
        A.summary_and_failed(r).alias("both"),
    ).select(
        "timestamp",
        "provider",
        "model",
        "file",
        s["pass_count"].alias("pass"),
        s["fail_count"].alias("fail"),
        s["na_responses"].alias("na"),
        s["total_answered"].alias("answered"),
        s["applicable_questions"].alias("applicable"),
        F.when(pct.isNull(), F.lit(""))
        .otherwise(F.format_string("%.2f", F.bround(pct, 2)))
        .alias("compliance_pct"),
        F.array_join(F.col("both")["failed"], "|").alias("fails"),
    )


COUNTS = ("pass", "fail", "na", "answered")
#: Binary logarithm of the buckets of a sketch of distinct files: its standard error is 1.04 / 2^6, about 1.6 %.
SKETCH = 12


def audit_groups(history: DataFrame, *by: str, files: bool = False) -> DataFrame:
    """One row of counts per group. Groups of several runs are groups again, so they can be kept (``sources.keep_groups``)
    and added to. With ``files`` there is a sketch of the distinct files, too."""
    sketch = [F.hll_sketch_agg("file", SKETCH).alias("files")] if files else []
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("reports"), *(F.sum(k).alias(k) for k in COUNTS), *sketch)


def rollup_audit_groups(groups: DataFrame, *by: str) -> DataFrame:
    """Verdict counts and compliance for every prefix of ``by`` from ``audit_groups``, of one run or of many; where these have
    sketches, the number of distinct files as well, an estimate over a few thousand."""
    total = {k: F.sum(k) for k in ("reports", *COUNTS)}
    distinct = [F.hll_sketch_estimate(F.hll_union_agg("files")).alias("files")] if "files" in groups.columns else []
    return groups.rollup(*by).agg(
        *(c.alias(k) for k, c in total.items()),
        F.when(total["answered"] > 0, total["pass"] / total["answered"] * 100).alias("compliance"),
        *distinct,
    )


def audit_rollup(history: DataFrame, *by: str) -> DataFrame:
    """Verdict counts and compliance for every prefix of ``by``, made from one row per group."""
    return rollup_audit_groups(audit_groups(history, *by), *by)


def question_rollup(verdicts: DataFrame, *by: str) -> DataFrame:
    """Verdicts per question and ``by``, one column per verdict."""
    return verdicts.groupBy(*by, "q").agg(
        F.count_if(F.col("verdict") == "PASS").alias("pass"),
        F.count_if(F.col("verdict") == "FAIL").alias("fail"),
        F.count_if(F.col("verdict").isin("N/A", "NA")).alias("na"),
    )


def report_render(reports: DataFrame, now: str, prefix: str = "prefix", report: str = "report") -> DataFrame:
    """Add ``path`` and ``content`` of each report file; ``now`` is ``YYYY-MM-DD HH:MM:SS``."""
    p = F.col(prefix)
    stamp = now.replace("-", "").replace(":", "").replace(" ", "_")
    path = F.concat(F.lit("reports/"), p, F.lit(f"_{stamp}.txt"))
    ruler = "=" * 60
    return reports.withColumn("path", path).withColumn(
        "content",
        F.concat(
            F.lit("=== INCIDENT AUDIT REPORT (16-QUESTION FRAMEWORK) ===\n"),
            F.lit(f"Generated: {now}\nAudit Type: "),
            F.upper(F.replace(p, F.lit("_audit"), F.lit(""))),
            F.lit(f"\n{ruler}\n\n"),
            F.col(report),
            F.lit(f"\n\n{ruler}\nReport saved to: "),
            F.col("path"),
            F.lit("\n"),
        ),
    )


def assemble_question_report(answers: DataFrame, now: str, audit: str = "audit_id") -> DataFrame:
    """``(audit, content)`` from ``(audit, q, question, standard, response)``.

    An audit has at most one answer per rubric question, so a group is small. An audit whose
    rows hold no response at all gets the text for an empty audit.
    """
    block = F.concat(
        F.lit("\n**QUESTION "), F.col("q").cast("string"), F.lit(": "), F.col("question"),
        F.lit("**\n**Network Team Standard**: "), F.col("standard"), F.lit("\n\n"),
        F.col("response"), F.lit(f"\n\n{'-' * 50}\n"),
    )
    body = joined_in_order(answers.select(audit, "q", block.alias("block")), audit, "q", "block", "")
    head = F.concat(
        F.lit(f"\n=== STEP-BY-STEP AUDIT REPORT ===\nGenerated: {now}\nTotal Questions: "),
        F.col("n").cast("string"),
        F.lit(f"\n{'=' * 60}\n\n"),
    )
    return body.select(
        audit,
        F.when(F.col("n") == 0, F.lit("No audit results to report."))
        .otherwise(F.concat(head, F.col("block")))
        .alias("content"),
    )


def compare_providers(history: DataFrame, a: str, b: str) -> DataFrame:
    """Latest audit of each file by two providers side by side.

    Both sides come out of one aggregation by file, which needs one shuffle and no join.
    """
    row = F.struct("timestamp", "model", "pass", "fail", "na", "compliance_pct")
    latest = {
        side: F.max(F.when(F.col("provider") == name, row)) for side, name in (("a", a), ("b", b))
    }
    grouped = (
        history.filter(F.col("provider").isin(a, b))
        .groupBy("file")
        .agg(*(c.alias(side) for side, c in latest.items()))
    )
    columns = [
        F.col(side)[k].alias(f"{side}_{k}")
        for side in ("a", "b")
        for k in ("pass", "fail", "na", "compliance_pct")
    ]
    agree = (F.col("a")["pass"] == F.col("b")["pass"]) & (F.col("a")["fail"] == F.col("b")["fail"])
    return grouped.select("file", *columns, F.coalesce(agree, F.lit(False)).alias("same_counts"))
