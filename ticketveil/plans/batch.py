"""Documents and their audit reports to batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.audit import simple_score
from ..functions.redaction import DEFAULT_TERMS, PreserveTerms
from ..operators.documents import no_text_gate
from ..operators.prompts import build_prompts, route_prompt
from ..operators.redaction import redact_documents

STAT_KEYS = (*P.KINDS, "total_redactions")


def batch_files(
    docs: DataFrame, reports: DataFrame, terms: PreserveTerms = DEFAULT_TERMS, normalize: bool = True
) -> DataFrame:
    """``docs (filename, text, processing_time)`` and ``reports (filename, audit_report)`` to the
    table of files that the batch operators read.

    A file without text ends as an error. Texts are redacted before the join, so it moves the
    redacted text and the report, once each.
    """
    gated = no_text_gate(docs.withColumn("file_size", F.octet_length("text").cast("long")))
    keep = ("file_size", "processing_time", "status", "error_message")
    redacted = redact_documents(gated, "filename", "text", keep, terms, normalize)
    details = F.create_map(*(x for k in STAT_KEYS for x in (F.lit(k), F.col("stats")[k])))
    failed = F.col("status") == "error"
    scored = reports.select(
        "filename", "audit_report", simple_score(F.col("audit_report")).alias("audit_score")
    )
    files = redacted.select(
        "filename",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, "").otherwise(F.col("redacted_text")).alias("redacted_text"),
        F.when(failed, F.lit(0)).otherwise(F.col("stats")["total_redactions"]).cast("long").alias("redaction_count"),
        details.alias("redaction_details"),
        "error_message",
        "processing_time",
        "file_size",
    )
    return files.join(scored, "filename", "left").na.fill("", ["audit_report", "audit_score"])


def prompt_table(
    redacted: DataFrame, template: str, questions: str, procedures: str, model: str, id: str = "doc_id"
) -> DataFrame:
    """Prompts of redacted documents with the model and text to send."""
    prompts = build_prompts(redacted, template, questions, procedures, id, "redacted_text")
    return route_prompt(prompts.withColumn("model", F.lit(model)))
