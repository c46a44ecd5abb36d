import random

import pytest
from pyspark.sql import functions as F

from ticketveil.functions import lines as L
from ticketveil.functions.text import line_array, strip

JOIN_CASES = [
    ("alpha\nbeta", "alpha beta"),
    ("alpha\n\nbeta", "alpha\n\nbeta"),
    ("Notes:\nfoo\nbar", "Notes: foo bar\n"),
    ("foo\n1. bar", "foo\n\n1. bar"),
    ("foo\n* bar", "foo\n* bar"),
    ("  foo \n  bar  ", "  foo  bar"),
    ("", ""),
    ("\n", ""),
    ("a\r\nb\x85c\n", "a b c"),
    ("Location: x\nCompany: y", "Location: x\n\nCompany: y\n"),
    ("Location: x\n\ny", "Location: x\n\ny"),
    ("SLA\ndefinition of it\nName: z", "SLA definition of it\n\nName: z"),
    ("Time worked\n10 Minutes", "Time worked 10 Minutes\n"),
    ("foo\nNotes", "foo Notes"),
    ("foo\n\nNotes", "foo\n\nNotes\n"),
    ("foo\nA b: c", "foo\nA b: c"),
]
MARKUP_CASES = [
    ("a [code]x[/code]<BR/>b", "a x\nb"),
    ("<b>x</b><br><br  />", "x\n\n"),
    ("[CODE]<B>", "[CODE]<B>"),
]
LABEL_CASES = [
    ("1 - High Urgency: 2", "1 - High\nUrgency: 2"),
    ("Somebody Impact: 1", "Somebody Impact: 1"),
    ("THE  Caller name: x and Caller: y", "THE\nCaller name: x and\nCaller: y"),
    ("éto Impact: x", "éto Impact: x"),
]
VALUE_CASES = [
    ("2 - Medium Responsible party: x", "2 - Medium\nResponsible party: x"),
    ("Delaware North Companies Urgency: 1", "Delaware North Companies\nUrgency: 1"),
    ("1 - High Assignment group: x", "1 - High\nAssignment group: x"),
    ("true Service Offering: y", "true\nService Offering: y"),
    ("Jane Doe Customer Assignment Group: y", "Jane Doe\nCustomer Assignment Group: y"),
    ("Network Services Category: y", "Network Services\nCategory: y"),
]


def apply(spark, cases, fn):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    return [r.out for r in df.select("i", fn(F.col("text")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "cases, fn",
    [
        (JOIN_CASES, lambda t: L.field_group_breaks(L.join_wrapped_lines(t))),
        (MARKUP_CASES, L.clean_markup),
        (LABEL_CASES, L.break_before_labels),
        (VALUE_CASES, L.break_value_label),
    ],
    ids=["join", "markup", "labels", "values"],
)
def test_cases(spark, cases, fn):
    assert apply(spark, cases, fn) == [c[1] for c in cases]


def test_lines_and_strip_follow_unicode(spark):
    rng = random.Random(7)
    alphabet = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u2029\u3000\u200b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    for r in df.select(t, line_array(t).alias("lines"), strip(t).alias("stripped")).collect():
        assert r.lines == r.text.splitlines()
        assert r.stripped == r.text.strip()


def test_join_loses_no_character(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    bad = docs.filter(squeeze(L.join_wrapped_lines(F.col("text"))) != squeeze(F.col("text")))
    assert bad.count() == 0
