import pytest
from pyspark.sql import functions as F

from ticketveil.functions import audit as A
from ticketveil.operators import audit as O
from ticketveil.operators import batch as B

JSON = 'JSON_SUMMARY: {"q2":"PASS","q3":"FAIL","q12":"N/A"}'
Q14 = (
    "\n    ...existing audit output...\n    **QUESTION 14: Did the engineer document time?**\n"
    "    **STATUS**: ✅ PASS\n    **EVIDENCE**: x\n    **ANALYSIS**: fine\n"
)

# report: (score, simple score, pass, fail, na, compliance, json used)
CASES = [
    (JSON, ("Score not available", "Score not available", 1, 1, 1, 50.0, True)),
    ("**STATUS**: ✅ PASS\n**STATUS**: ❌ FAIL", ("1/2 (50%) (2/13)", "Score not available", 1, 1, 0, 50.0, False)),
    ("Result 11/12 (92%)", ("11/12 (92%)", "11/12 (92%)", 0, 0, 0, None, False)),
    ("Score: 3/0", ("3/0", "Score not available", 0, 0, 0, None, False)),
    ("", ("Score not available", "Score not available", 0, 0, 0, None, False)),
    (Q14, ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ("Score: 5/8", ("5/8 (62%)", "5/8 (62%)", 0, 0, 0, None, False)),
    ("7 out of 8, then 1 out of 8", ("1/8 (12%)", "Score not available", 0, 0, 0, None, False)),
    ("x 10% y 20%", ("Score not available", "20%", 0, 0, 0, None, False)),
    ("Score: 05/10 and 1/2/3", ("5/10 (50%)", "1/2 (50%)", 0, 0, 0, None, False)),
    ("pass ✅ and ❌ fail", ("1/2 (50%) (2/13)", "Score not available", 0, 0, 0, None, False)),
    ("\n".join(["✅ PASS"] * 13), ("13/13 (100%)", "Score not available", 13, 0, 0, 100.0, False)),
    ("⚠️ N/A for 7\n⚠️ N/A Close Notes\n⚠️ N/A ✅ PASS", ("1/1 (100%) (1/13)", "Score not available", 0, 0, 1, None, False)),
    (JSON + "\ntrailing", ("Score not available", "Score not available", 1, 1, 1, 50.0, True)),
    ("✅ PASS\nJSON_SUMMARY: {bad}", ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ("✅ PASS\nJSON_SUMMARY: {'q2':'FAIL'}", ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ('JSON_SUMMARY: {"q2":"FAIL","q2":"PASS"}', ("Score not available", "Score not available", 1, 0, 0, 100.0, True)),
    ('✅ PASS\nJSON_SUMMARY: {"q2":"FAIL"} or {"q3":"FAIL"}', ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ('✅ PASS\nJSON_SUMMARY: {"q2":"FAIL"},{"q3":"FAIL"}', ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ('✅ PASS\nJSON_SUMMARY: [1, 2]', ("1/1 (100%) (1/13)", "Score not available", 1, 0, 0, 100.0, False)),
    ('JSON_SUMMARY: {"q2":null,"Q3":"n/a","x":"FAIL"}', ("Score not available", "Score not available", 0, 0, 1, None, True)),
    (JSON + "\n\nJSON_SUMMARY: nothing", ("Score not available", "Score not available", 0, 0, 0, None, False)),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "report_id int, report string")
    both = O.audit_scores(df).join(O.audit_summary(df), "report_id")
    return {r.report_id: r for r in both.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(scored, i):
    r = scored[i]
    assert (
        r.score, r.simple_score, r.pass_count, r.fail_count, r.na_responses,
        r.compliance_percentage, r.json_summary_used,
    ) == CASES[i][1]


def test_findings(spark):
    report = "\n".join(
        [
            "**QUESTION 2: Heading Fields**", "x", "**STATUS**: ❌ FAIL", "**WHAT YOU MISSED**:", "* The **CI** was empty",
            "---", "**QUESTION 3: Access**", "**STATUS**: ❌ FAIL", "**ANALYSIS**: Not seen anywhere", "---",
            "a", "b", "c", "d", "e", "**STATUS**: ❌ FAIL", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10",
            "**QUESTION 5: Dates**", "1", "2", "3", "4", "5", "6", "**ANSWER:** No, missing",
        ]
    )
    df = spark.createDataFrame([(1, report), (2, "❌ FAIL"), (3, "all fine")], "report_id int, report string")
    got = [tuple(r) for r in O.key_findings(df).orderBy("report_id", "rank").collect()]
    assert got == [
        (1, 1, "**2 Heading Fields**: The CI was empty"),
        (1, 2, "**3 Access**: Not seen anywhere"),
        (1, 3, "**5 Dates**: Answer was No"),
    ]


def test_history_row(spark, tmp_path):
    from ticketveil.sources import append_history, read_history

    df = spark.createDataFrame(
        [(JSON.replace("q12", "q9").replace("N/A", "FAIL"), "a", "m", "f.pdf")],
        "report string, provider string, model string, file string",
    )
    history = O.audit_history(df, F.lit("2024-01-01T00:00:00"))
    row = history.first()
    assert (row["pass"], row.fail, row.na, row.answered, row.applicable) == (1, 2, 0, 3, 13)
    assert (row.compliance_pct, row.fails) == ("33.33", "Q3|Q9")
    path = str(tmp_path / "history")
    append_history(history, path, "a")
    append_history(history, path, "2024-01-01")
    append_history(history, path, "a")  # once more
    rows = read_history(spark, path, "string", run=True).collect()
    assert sorted(r.run for r in rows) == ["2024-01-01", "a"] and {r["pass"] for r in rows} == {1}
    assert read_history(spark, path, "string").schema.names == history.schema.names
    append_history(history.limit(0), path, "a")
    assert [r.run for r in read_history(spark, path, "string", run=True).collect()] == ["2024-01-01"]
    with pytest.raises(ValueError):
        append_history(history, path, "a/b")


def test_strip_summary_line(spark):
    df = spark.createDataFrame([("a\r\nb\nJSON_SUMMARY: {}  \n",), ("JSON_SUMMARY: {}\nb",)], "t string")
    got = [r[0] for r in df.select(A.strip_summary_line(F.col("t"))).collect()]
    assert got == ["a\nb", "JSON_SUMMARY: {}\nb"]


FILES = "filename string, status string, audit_report string, audit_score string, redaction_count long, processing_time double"


def batch(spark, rows):
    return spark.createDataFrame([(f"f{i}.pdf", *r) for i, r in enumerate(rows)], FILES)


def test_batch_all_failed(spark):
    r = B.batch_summary(batch(spark, [("error", "", "", 5, 0.0)] * 2)).first()
    assert (r.total_files, r.successful_files, r.failed_files, r.total_redactions, r.average_score) == (2, 0, 2, 0, 0.0)


def test_batch_scores_without_percentage(spark):
    files = batch(spark, [("success", "x", "3/0", 2, 1.0), ("success", "x", "1/2 (50%)", 3, 1.0), ("error", "", "90%", 9, 1.0)])
    r = B.batch_summary(files).first()
    assert (r.total_redactions, r.average_score) == (5, 50.0)


def test_common_issues(spark):
    bad, tie = "❌ first access, no time worked", "not client updates"
    rows = [("success", bad, "", 0, 0.0), ("success", "ok", "", 0, 0.0), ("success", tie, "", 0, 0.0),
            ("success", bad + " ✅", "", 0, 0.0), ("success", bad + " No issues", "", 0, 0.0), ("error", bad, "", 0, 0.0)]
    got = [r.message for r in B.common_issues(batch(spark, rows)).collect()]
    assert got == [
        "First Access failing in 20% of files",
        "Time Tracking failing in 20% of files",
        "Client Communication failing in 20% of files",
    ]
    fewer = rows + [("success", "ok", "", 0, 0.0)]
    assert B.common_issues(batch(spark, fewer)).count() == 0


def test_kept_groups(spark, tmp_path):
    """Totals after three runs, one of them repeated and one empty, are those of all rows at once."""
    from ticketveil.sources import keep_groups, kept_groups

    rows = [("pq"[i % 2], f"m{i % 3}", f"f{i % 50}.pdf", i % 5, i % 3, 1, i % 5 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "provider string, model string, file string, pass int, fail int, na int, answered int")
    path = str(tmp_path / "totals")
    for run, low in (("a", 0), ("b", 50), ("b", 100), ("c", 200), ("d", 1000)):
        part = spark.createDataFrame(rows[low : {"a": 100, "b": 200}.get(run, 300)], df.schema)
        keep_groups(O.audit_groups(part, "provider", "model", files=True), path, run)
    got = O.rollup_audit_groups(kept_groups(spark, path), "provider", "model").collect()
    want = O.audit_rollup(df, "provider", "model").collect()
    assert sorted(map(repr, (r[:-1] for r in got))) == sorted(map(repr, (tuple(r) for r in want)))
    assert {r.files for r in got if r.provider is None} == {50}
