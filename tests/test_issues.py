import random

import pytest

from ticketveil.operators import batch, issues
from ticketveil.plans import stored

PHRASES = [(i, name, p) for i, (name, phrases) in enumerate(batch.ISSUES) for p in phrases]
ISSUES = "position long, issue string, phrase string"
FILES = "filename string, status string, audit_report string"


def by_hand(files, table):
    """Reports per position by testing each phrase in each report."""
    out, n = {}, 0
    for _, status, report in files:
        if status != "success" or not report:
            continue
        n += 1
        low = report.lower()
        if "✅" in report or "no issues" in low or "no problems" in low:
            continue
        failing = "❌" in report or "**answer:** no" in low or "**answer: no" in low
        hit = set()
        for position, _, phrase in table:
            p = (phrase or "").lower()
            if p and p in low and (failing or any(s in low for s in (f"no {p}", f"not {p}", f"{p} not"))):
                hit.add(position)
        for position in hit:
            out[position] = out.get(position, 0) + 1
    return out, n


def check(spark, files, table, store=None):
    df = spark.createDataFrame(files, FILES)
    got = issues.issue_counts(df, spark.createDataFrame(table, ISSUES), store).collect()
    want, n = by_hand(files, table)
    assert {r.position: r.reports for r in got} == want
    assert {r.n for r in got} <= {n}


WORDS = "time worked first access not no heading fields client café 𝒳y resolution a b ok".split()


def reports(seed, n, words=WORDS):
    rng = random.Random(seed)
    marks = ("❌ ", "", "", "", "✅ ", "**Answer:** No ", "No issues ")
    return [
        (f"f{i}", rng.choice(("success",) * 5 + ("error",)), rng.choice(("", rng.choice(marks) + " ".join(rng.choices(words, k=rng.randrange(1, 30))))))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_by_hand(spark, shared_dir, seed):
    rng = random.Random(seed)
    files = reports(seed, 300)
    files += files[:50] * 3 + [("x", "success", None), ("y", None, "❌ time")]
    table = PHRASES + [(9, "one", "a"), (9, "one", "Ed FI"), (10, "none", "zzzzzzz"), (11, "wide", "𝒳y"), (12, "e", ""), (12, "e", None), (12, "e", "  "), (13, "gaps", " a "), (14, "two", "not  no"), (14, "two", " fields client"), (9, "one", "a")]
    table += [(20 + i, f"n{i}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 4)))[rng.randrange(2) :]) for i in range(60)]
    check(spark, files, table)
    check(spark, files, table, lambda df: stored(df, "issues", shared_dir))


def test_given_issues_are_unchanged(spark):
    for seed in (3, 4):
        df = spark.createDataFrame([f for f in reports(seed, 200) if f[2]], FILES)
        old = batch.common_issues(df).collect()
        new = issues.common_issues(df, spark.createDataFrame(PHRASES, ISSUES)).collect()
        assert [tuple(r) for r in old] == [tuple(r) for r in new] and old


def test_ten_thousand_phrases(spark, shared_dir):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(150)]
    files = reports(6, 200, words + ["no", "not"])
    files += [("hot", "success", "❌ " + " ".join(words[:40]))] * 100  # a third of all rows
    table = [(i, f"n{i}", " ".join(rng.choices(words, k=2))) for i in range(10_000)]
    check(spark, files, table, lambda df: stored(df, "issues", shared_dir))


def test_empty_tables_and_long_reports(spark):
    none = spark.createDataFrame([], FILES)
    table = spark.createDataFrame(PHRASES, ISSUES)
    assert issues.common_issues(none, table).collect() == []
    some = spark.createDataFrame(reports(1, 20), FILES)
    assert issues.common_issues(some, table.limit(0)).collect() == []
    check(spark, [("f", "success", "❌ " + "ab " * 200_000 + "time worked")], PHRASES)


def test_plan_pairs_nothing(spark):
    df = spark.createDataFrame(reports(1, 20), FILES)
    plan = issues.common_issues(df, spark.createDataFrame(PHRASES, ISSUES))._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert word not in plan
