"""Shape of the physical plans: what is shuffled, and what runs outside the JVM."""

import pytest

import __spark_entry__ as entry_point
from tests.conftest import DATA
from ticketveil.operators import audit, batch, lines, redaction, tickets


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NAMES = [name for name, query in entry_point.queries().items() if query.__module__.startswith("catalog.")]


@pytest.mark.parametrize("name", NAMES)
def test_no_python_no_cross_join_no_text_dealt_anew(spark, name):
    plan = plan_of(entry_point.queries()[name](spark, DATA))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobin"):
        assert word not in plan


ROW_OPERATORS = {
    "normalize": lines.normalize_document,
    "split": lines.split_lines,
    "redact": redaction.redact_documents,
    "find": redaction.find_pii,
    "fields": lambda df: tickets.ticket_fields(df, "doc_id"),
    "rules": lambda df: tickets.rule_scorecard(df, "doc_id"),
    "summary": lambda df: audit.audit_summary(df, "doc_id", "text"),
    "findings": lambda df: audit.key_findings(df, 3, "doc_id", "text"),
}


@pytest.mark.parametrize("name", ROW_OPERATORS)
def test_row_operators_do_not_shuffle(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = plan_of(ROW_OPERATORS[name](docs))
    assert "Exchange" not in plan
    if name != "normalize":  # keeps all columns
        assert "lang" not in plan.split("ReadSchema")[1]


def test_filter_on_result_does_not_multiply_the_work(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once = plan_of(redaction.redact_documents(docs)).count("[REDACTED EMAIL]")
    filtered = redaction.redact_documents(docs).filter("stats.total_redactions > 0 and stats.urls = 0")
    assert plan_of(filtered).count("[REDACTED EMAIL]") <= 3 * once


def test_find_is_evaluated_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert plan_of(redaction.find_pii(docs)).count("@[\\p{Alnum}") == 1


def test_common_issues_shuffles_counts_only(spark):
    files = spark.createDataFrame([("success", "x")], "status string, audit_report string")
    plan = plan_of(batch.common_issues(files))
    assert plan.count("Exchange SinglePartition") == 1
