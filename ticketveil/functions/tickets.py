"""Checks on the text of one ticket. The criteria are our reading of the handling rules that
can be decided from the text alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, line_array, strip

# --- fixed values: rules ------------------------------------------------------------------
INCIDENT = r"INC[0-9]{7,8}"
NOT_FOUND = "Not Found"
FIELD_LABEL = r"^([A-Za-z][A-Za-z0-9 #/()-]*):"
LABEL_TEXT = r"^[A-Za-z][A-Za-z0-9 #/()-]*\z"
UPDATE_HEAD = r"(?md)^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} - [^\n]+"
FIRST_ACCESS = r"First Access(?:: true| verified)"
PENDING_CODES = (
    "client action required", "client hold", "future enhancement", "rma", "carrier",
    "customer maintenance", "internal ticket", "problem management", "change management",
)
PENDING_SHORT = (("car", "client action required"), ("client h.", "client hold"))
PENDING_FIELDS = ("pending reason", "pending")
OPEN_STATES = ("new", "open", "in progress", "pending", "on hold")
# Longest time between updates, in hours, by priority.
CADENCE_HOURS = {1: 1, 2: 1, 3: 48, 4: 72}
PASS, FAIL, NOT_APPLICABLE = "PASS", "FAIL", "N/A"


def verdict(condition: Column) -> Column:
    return F.when(condition, PASS).otherwise(FAIL)


def incident_number(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, INCIDENT, 0), F.lit("")), F.lit(NOT_FOUND))


def fields(text: Column) -> Column:
    """``array<(line_no, field, value)>`` of the ``Label: value`` lines, label in lower case.

    A label holds no colon, so it is the text before the first one; only that is tested against the pattern."""

    def parse(line: Column, i: Column) -> Column:
        return F.when(
            line.contains(":"),
            let(
                strip(line),
                lambda s: let(
                    F.substring_index(s, ":", 1),
                    lambda label: F.when(
                        label.rlike(LABEL_TEXT),
                        F.struct(
                            i.alias("line_no"),
                            F.lower(strip(label)).alias("field"),
                            strip(F.substr(s, F.length(label) + 2)).alias("value"),
                        ),
                    ),
                ),
            ),
        )

    return F.filter(F.transform(line_array(text), parse), lambda f: f.isNotNull())


def values_of(all_fields: Column, *names: str) -> Column:
    """Non-empty values of the named fields, in text order."""
    return F.transform(
        F.filter(all_fields, lambda f: f["field"].isin(*names) & (f["value"] != "")),
        lambda f: f["value"],
    )


def has_value(all_fields: Column, *names: str) -> Column:
    return F.exists(all_fields, lambda f: f["field"].isin(*names) & (f["value"] != ""))


def heading_fields(all_fields: Column) -> Column:
    return verdict(
        has_value(all_fields, "configuration item", "location")
        & has_value(all_fields, "state", *PENDING_FIELDS)
        & has_value(all_fields, "service offering")
        & has_value(all_fields, "category")
    )


def first_access(text: Column) -> Column:
    return verdict(text.rlike(FIRST_ACCESS))


def pending_code(value: Column) -> Column:
    """Full lower-case name of a pending code or its short form."""
    lowered = F.lower(strip(value))
    expr = lowered
    for short, full in PENDING_SHORT:
        expr = F.when(lowered == short, full).otherwise(expr)
    return expr


def pending_codes(all_fields: Column) -> Column:
    return let(
        values_of(all_fields, *PENDING_FIELDS),
        lambda v: verdict(
            (F.size(v) > 0) & F.forall(v, lambda x: pending_code(x).isin(*PENDING_CODES))
        ),
    )


def priority(all_fields: Column) -> Column:
    return F.regexp_extract(
        F.coalesce(F.get(values_of(all_fields, "priority"), F.lit(0)), F.lit("")), "^[0-9]", 0
    ).try_cast("int")


def cadence_hours(level: Column) -> Column:
    expr = F.lit(None).cast("int")
    for p, hours in CADENCE_HOURS.items():
        expr = F.when(level == p, hours).otherwise(expr)
    return expr


def updates(text: Column) -> Column:
    """``array<(update_no, ts, author, body)>``; a body runs to the next update."""
    heads = F.regexp_extract_all(text, F.lit(UPDATE_HEAD), F.lit(0))
    bodies = F.split(text, UPDATE_HEAD, -1)
    return let(
        bodies,
        lambda b: F.transform(
            heads,
            lambda h, i: F.struct(
                (i + 1).alias("update_no"),
                F.substring(h, 1, 19).try_cast("timestamp_ntz").alias("ts"),
                strip(F.substr(h, F.lit(23))).alias("author"),
                strip(F.get(b, i + 1)).alias("body"),
            ),
        ),
    )


def seconds_of(ts: Column) -> Column:
    day = F.unix_date(ts.cast("date")).cast("long") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def longest_gap_seconds(all_updates: Column) -> Column:
    """Largest difference between neighbouring updates in time order; null below two updates."""
    times = F.array_sort(F.transform(all_updates, lambda u: seconds_of(u["ts"])))
    return let(
        times,
        lambda t: F.array_max(F.transform(t, lambda x, i: x - F.get(t, i - 1))),
    )


def update_cadence(all_fields: Column, all_updates: Column) -> Column:
    hours = cadence_hours(priority(all_fields))
    gap = F.coalesce(longest_gap_seconds(all_updates), F.lit(0))
    return verdict(F.coalesce(gap <= hours * 3600, F.lit(False)))


def time_worked_owner(all_fields: Column) -> Column:
    owner = F.get(values_of(all_fields, "assigned to"), F.lit(0))
    authors = values_of(all_fields, "time worked by")
    return verdict(F.coalesce(F.array_contains(authors, owner), F.lit(False)))


def close_notes(all_fields: Column) -> Column:
    state = F.lower(
        F.coalesce(
            F.get(values_of(all_fields, "incident status"), F.lit(0)),
            F.get(values_of(all_fields, "state"), F.lit(0)),
            F.lit(""),
        )
    )
    return F.when(state.isin(*OPEN_STATES), NOT_APPLICABLE).otherwise(
        verdict(has_value(all_fields, "close notes"))
    )


def minutes_worked(all_fields: Column) -> Column:
    """Minutes in all time-worked entries of a ticket; null if one has a number of more than 26 digits."""

    def amount(value, unit):
        n = F.regexp_extract(value, rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1)
        return F.when(n == "", F.lit(0).cast("decimal(28,2)")).otherwise(n.try_cast("decimal(28,2)"))

    entries = F.transform(
        values_of(all_fields, "time worked", "duration"),
        lambda v: (amount(v, "h") * 60 + amount(v, "m")).cast("decimal(38,2)"),
    )
    return F.aggregate(
        entries, F.lit(0).cast("decimal(38,2)"), lambda acc, x: (acc + x).cast("decimal(38,2)")
    ).cast("double")
