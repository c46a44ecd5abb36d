"""Numbers of any width, limits and vocabularies as tables, busy minutes."""

import random

from pyspark.sql import functions as F

from ticketveil.functions import audit as A
from ticketveil.functions.redaction import DEFAULT_TERMS
from ticketveil.functions.tickets import minutes_worked
from ticketveil.operators import batch as B
from ticketveil.operators import monitor as M
from ticketveil.operators import prompts as P
from ticketveil.operators import redaction as R
from ticketveil.sources import write_ordered


def test_wide_scores(spark):
    n = "1234567890" * 4
    rows = [(f"Score: {n}/{n}",), ("Score: 007/0010",), ("Score: 3/000",), (f"Score: {n}/1",), ("12 out of 48",)]
    got = [r[0] for r in spark.createDataFrame(rows, "r string").select(A.audit_score(F.col("r"))).collect()]
    assert got[0] == f"{n}/{n} (100%)"
    assert got[1] == "7/10 (70%)"
    assert got[2] == "3/000"
    assert got[3].startswith(f"{n}/1 (12345678901234") and got[3].endswith("%)")
    assert got[4] == "12/48 (25%)"


def test_history_parses_as_its_parts(spark):
    rows = [('x\nJSON_SUMMARY: {"q2": "PASS", "q3": "fail", "q1": "FAIL"}',), ("✅ PASS\n❌ FAIL",), (None,), ("",)]
    r = F.col("r")
    both = A.summary_and_failed(r)
    df = spark.createDataFrame(rows, "r string").select(
        both["summary"].alias("s"), A.audit_summary(r).alias("t"), both["failed"].alias("f"), A.failed_questions(r).alias("g")
    )
    out = df.collect()
    assert all(x.s == x.t and x.f == x.g for x in out) and out[0].f == ["Q1", "Q3"]


def test_wide_minutes_and_percentages(spark):
    hours = spark.createDataFrame([("99999999999 hours",), ("1.5 hours 3 minutes",), ("9" * 30 + " hours",), ("none",)], "t string")
    lines = F.array(F.struct(F.lit("time worked").alias("field"), F.col("t").alias("value")))
    assert [r[0] for r in hours.select(minutes_worked(lines)).collect()] == [99999999999 * 60.0, 93.0, None, 0.0]
    score = spark.createDataFrame([("99999999999%",), ("5%",), ("none",)], "s string").select(B.score_percent(F.col("s")))
    assert [r[0] for r in score.collect()] == [99999999999.0, 5.0, None]


def test_wide_durations(spark):
    calls = [("a", True, 1e20), ("a", True, 2.0), ("b", True, 0.25), ("b", True, 0.5), ("b", False, 9.0), ("c", True, None)]
    got = {r.function_name: r.avg_duration for r in M.performance_summary(
        spark.createDataFrame(calls, "function_name string, success boolean, duration double")).collect()}
    assert got["a"] == (1e20 + 2) / 2 and got["b"] == 0.375 and got["c"] is None


def test_limits_in_a_table(spark):
    calls = spark.createDataFrame([(1, "m", 10), (2, "n", 10), (3, None, 9000), (4, "o", 8000)], "id long, model string, tokens long")
    limits = {"m": (5, 9), "n": (5, 100)}
    table = spark.createDataFrame([("m", 5, 9), ("m", 7, 50), ("n", 5, 100), ("o", None, None)], "model string, rpm int, tpm int")
    a, b = P.token_check(calls, limits), P.token_check(calls, table)
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    timed = calls.filter("model is not null").withColumn("ts", F.lit(100).cast("timestamp")).withColumnRenamed("id", "request_id")
    for f in (P.window_usage, P.limit_breaches):
        assert sorted(map(repr, f(timed, limits).collect())) == sorted(map(repr, f(timed, table).collect()))


def test_usage_of_busy_minutes(spark):
    """Instants around bucket and window edges, null models and times before 1970, against brute force."""
    rng = random.Random(3)
    edges = [0, 1, 99_999, 100_000, 59_900_000, 59_999_999, 60_000_000, 60_000_001, 60_100_000, 120_000_000]
    at = [rng.choice(edges) + rng.choice((0, 0, 1, -1, 50_000)) for _ in range(150)] + [rng.randrange(-70_000_000, 130_000_000) for _ in range(250)]
    rows = [(rng.choice(("m", "n", None)), t, rng.randrange(1, 9)) for t in at]
    sums = {}
    for m, t, k in rows:
        n, total = sums.get((m, t), (0, 0))
        sums[m, t] = n + 1, total + k
    instants = spark.createDataFrame([(m, t, n, k) for (m, t), (n, k) in sums.items()], "model string, at long, n long, tokens long")
    for until in (0, -1):
        want = {
            (m, t): tuple(sum(v[i] for (m2, t2), v in sums.items() if m2 == m and t - 60_000_000 <= t2 <= t + until) for i in (0, 1))
            for m, t in sums
        }
        got = {(r.model, r.at): (r.used_requests, r.used_tokens) for r in P._trailing(instants, until).collect()}
        assert got == want


def test_vocabulary_in_a_table(spark):
    text = "Caleb Stone met Mary Wilson near Zulu Point. Run by: X\nJohn.Smith@a.com Peter Zulu, Anna  Stone; Caleb Stone"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "Mary Wilson"), (3, None), (4, ""), (None, "Caleb Stone")], "doc_id long, text string")
    words, phrases = ["zulu", "WILSON"], ["Caleb stone", "anna stone"]
    terms = [(w, "word") for w in words * 2] + [(p, "phrase") for p in phrases] + [(None, "word")]
    table = spark.createDataFrame(terms, "term string, kind string")
    want = R.redact_documents(docs, terms=DEFAULT_TERMS.plus(words, phrases)).collect()
    got = R.redact_with_table(docs, table).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any("Caleb Stone" in (r.redacted_text or "") for r in got)
    plain = R.redact_documents(docs).collect()
    assert sorted(map(repr, R.redact_with_table(docs, table.limit(0)).collect())) == sorted(map(repr, plain))


def test_ordered_text_is_in_order(spark, tmp_path):
    rows = [(1, "b", "B1\nB2\n"), (0, "", "head\n"), (1, "a", "\nA\n")]
    path = str(tmp_path / "out")
    write_ordered(spark.createDataFrame(rows, "section int, filename string, content string"), path, "section", "filename")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "head\n\nA\nB1\nB2\n"
