"""Rule checks on tickets. Text rules are row expressions: no ticket leaves its partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audit as A
from ..functions import tickets as K
from ..functions.times import epoch_micros
from .rows import inline_rows

HOUR_MICROS = 3_600_000_000


def incident_number(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return tickets.select(id, K.incident_number(F.col(text)).alias("incident"))


def ticket_fields(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    """``(id, line_no, field, value)``."""
    return inline_rows(tickets, [id], K.fields(F.col(text)), "line_no")


def _field_check(tickets, id, text, check, name="verdict"):
    return (
        tickets.select(id, K.fields(F.col(text)).alias("f"))
        .select(id, check(F.col("f")).alias(name))
    )


def heading_fields_check(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return _field_check(tickets, id, text, K.heading_fields)


def first_access_check(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return tickets.select(id, K.first_access(F.col(text)).alias("verdict"))


def pending_code_check(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return _field_check(tickets, id, text, K.pending_codes)


def close_notes_check(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return _field_check(tickets, id, text, K.close_notes)


def time_worked_total(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    return _field_check(tickets, id, text, K.minutes_worked, "minutes")


def update_timeline(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    """``(id, update_no, ts, author, body)``."""
    return inline_rows(tickets, [id], K.updates(F.col(text)), "update_no")


def longest_gaps(updates: DataFrame, id: str = "ticket_id", ts: str = "ts") -> DataFrame:
    """``(id, updates, gap_seconds)`` from a table of updates.

    Equal instants are merged before the shuffle. Gaps are found within one hour of a ticket
    first, and then between the hours of a ticket, so the longest sorted group is the number
    of hours a ticket is active, however many updates it has.
    """
    at = updates.groupBy(F.col(id), epoch_micros(updates, ts).alias("at")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hour = F.floor(F.col("at") / HOUR_MICROS).alias("hour")
    inside = Window.partitionBy(id, "hour").orderBy("at")
    hours = (
        at.withColumn("hour", hour)
        .withColumn("gap", F.col("at") - F.lag("at").over(inside))
        .groupBy(id, "hour")
        .agg(
            F.sum("n").alias("n"),
            F.min("at").alias("first"),
            F.max("at").alias("last"),
            F.max("gap").alias("gap"),
        )
    )
    between = Window.partitionBy(id).orderBy("hour")
    return (
        hours.withColumn("gap", F.greatest("gap", F.col("first") - F.lag("last").over(between)))
        .groupBy(id)
        .agg(F.sum("n").alias("updates"), (F.max("gap") / 1_000_000).alias("gap_seconds"))
    )


def update_cadence_check(
    updates: DataFrame, tickets: DataFrame, id: str = "ticket_id", ts: str = "ts"
) -> DataFrame:
    """Verdict per ticket of ``tickets (id, priority)`` on the longest time between updates."""
    gaps = longest_gaps(updates, id, ts)
    hours = K.cadence_hours(F.col("priority"))
    within = F.coalesce(F.col("gap_seconds"), F.lit(0.0)) <= hours * 3600
    return tickets.join(gaps, id, "left").select(
        id, "priority", "updates", "gap_seconds", K.verdict(F.coalesce(within, F.lit(False))).alias("verdict")
    )


def time_worked_owner_check(
    tickets: DataFrame, entries: DataFrame, id: str = "ticket_id"
) -> DataFrame:
    """Whether the assignee of ``tickets (id, assignee)`` wrote one of ``entries (id, author)``."""
    authors = entries.select(id, F.col("author").alias("assignee")).distinct().withColumn(
        "wrote", F.lit(True)
    )
    return tickets.join(authors, [id, "assignee"], "left").select(
        id, "assignee", K.verdict(F.coalesce("wrote", F.lit(False))).alias("verdict")
    )


def _rules(tickets: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, rules)``; fields and updates are read once per ticket."""
    f, u, t = F.col("f"), F.col("u"), F.col(text)
    rules = (
        ("Q2", K.heading_fields(f)),
        ("Q3", K.first_access(t)),
        ("Q6", K.pending_codes(f)),
        ("Q10", K.update_cadence(f, u)),
        ("Q14", K.time_worked_owner(f)),
        ("Q15", K.close_notes(f)),
    )
    rows = F.array(*(F.struct(F.lit(q).alias("q"), v.alias("verdict")) for q, v in rules))
    return tickets.select(id, text, K.fields(t).alias("f"), K.updates(t).alias("u")).select(
        id, rows.alias("rules")
    )


def rule_verdicts(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    """``(id, q, verdict)`` of all text rules."""
    return inline_rows(_rules(tickets, id, text), [id], F.col("rules"), "q")


def rule_scorecard(tickets: DataFrame, id: str = "ticket_id", text: str = "text") -> DataFrame:
    """Counts and compliance per ticket over the text rules."""
    n = lambda v: F.size(F.filter("rules", lambda r: r["verdict"] == v))
    counts = _rules(tickets, id, text).select(
        id,
        n(K.PASS).alias("pass_count"),
        n(K.FAIL).alias("fail_count"),
        n(K.NOT_APPLICABLE).alias("na_responses"),
    )
    answered = F.col("pass_count") + F.col("fail_count")
    return counts.withColumn(
        "applicable_questions", F.lit(A.SCOREABLE_QUESTIONS) - F.col("na_responses")
    ).withColumn(
        "compliance_percentage", F.when(answered > 0, F.col("pass_count") / answered * 100)
    )
