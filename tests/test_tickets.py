from datetime import datetime


from ticketveil.operators import tickets as K

TICKET = """INC0123456 - Connection trouble

Configuration Item: FW01
Location: Hall 2
Service Offering: Network Services
Category: Security Device Management
Priority: 3 - Moderate
State: In Progress
Assigned to: John Smith

Updates:

2025-01-15 14:45:00 - John Smith
Taking ownership.

First Access verified - connecting now.

2025-01-15 15:15:00 - John Smith
Checked ports.

Pending: Client H.
Time Worked: 1.5 hours

2025-01-16 09:30:00 - Mary Major
Follow-up done.

Time Worked: 2 Hours 48 Minutes
Time worked by: John Smith
Close Notes: limited backup traffic
Incident Status: Resolved
"""
OTHER = "no number\nState: Pending\nClose Notes:\nPending reason: Internal\nFirst Access: no"


def tickets(spark):
    return spark.createDataFrame([(1, TICKET), (2, OTHER), (3, "")], "ticket_id int, text string")


def test_rules(spark):
    got = {(r.ticket_id, r.q): r.verdict for r in K.rule_verdicts(tickets(spark)).collect()}
    assert [got[1, q] for q in ("Q2", "Q3", "Q6", "Q10", "Q14", "Q15")] == ["PASS"] * 6
    assert [got[2, q] for q in ("Q2", "Q3", "Q6", "Q10", "Q14", "Q15")] == ["FAIL"] * 5 + ["N/A"]
    card = {r.ticket_id: r for r in K.rule_scorecard(tickets(spark)).collect()}
    assert (card[1].compliance_percentage, card[2].applicable_questions) == (100.0, 12)
    assert card[3].fail_count == 6


def test_single_checks(spark):
    df = tickets(spark)
    assert [r.incident for r in K.incident_number(df).orderBy("ticket_id").collect()] == ["INC0123456", "Not Found", "Not Found"]
    assert [r.minutes for r in K.time_worked_total(df).orderBy("ticket_id").collect()] == [258.0, 0.0, 0.0]
    fields = {(r.field, r.value) for r in K.ticket_fields(df).filter("ticket_id = 2").collect()}
    assert ("close notes", "") in fields and ("pending reason", "Internal") in fields


def test_timeline(spark):
    rows = K.update_timeline(tickets(spark)).orderBy("update_no").collect()
    assert [(r.update_no, r.ts, r.author) for r in rows] == [
        (1, datetime(2025, 1, 15, 14, 45), "John Smith"),
        (2, datetime(2025, 1, 15, 15, 15), "John Smith"),
        (3, datetime(2025, 1, 16, 9, 30), "Mary Major"),
    ]
    assert rows[0].body.startswith("Taking ownership.") and rows[0].body.endswith("connecting now.")


def test_cadence_limits(spark):
    at = lambda h: datetime(2024, 1, 1, 0) if h == 0 else datetime(2024, 1, 1 + h // 24, h % 24)
    updates = spark.createDataFrame(
        [(1, at(0)), (1, at(1)), (2, at(0)), (2, at(2)), (3, at(0)), (3, at(48)), (4, at(0)), (4, at(73))],
        "ticket_id int, ts timestamp",
    )
    priorities = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 9)], "ticket_id int, priority int")
    got = {r.ticket_id: r.verdict for r in K.update_cadence_check(updates, priorities).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL", 5: "PASS", 6: "FAIL"}


def test_time_worked_owner(spark):
    owned = spark.createDataFrame([(1, "A"), (2, "A")], "ticket_id int, assignee string")
    entries = spark.createDataFrame([(1, "B"), (1, "A"), (1, "A"), (2, "B")], "ticket_id int, author string")
    got = [r.verdict for r in K.time_worked_owner_check(owned, entries).orderBy("ticket_id").collect()]
    assert got == ["PASS", "FAIL"]
