"""The Java patterns find what the plain patterns find under Unicode rules, on random text."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from catalog import expected as X
from ticketveil.functions import lines as L
from ticketveil.functions import patterns as P
from ticketveil.functions import redaction as R

# The patterns in plain notation, where \w, \d, \s and \b follow Unicode.
PLAIN = {
    "ip": (P.IP_ADDRESS, None, r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    "mac": (P.MAC_ADDRESS, P.MAC_PART, r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
    "phone": (P.PHONE, P.PHONE_PART, r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
    "email": (P.EMAIL, "@", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "imei": (P.IMEI, "IMEI", r"IMEI[#\s]*\d+"),
    "account": (P.ACCOUNT, "Account", r"Account\s+\d{8,}(?:-\d+)?"),
    "url": (P.URL, "://", r"https?://\S+"),
    "run_by": (P.RUN_BY, "Run ", r"Run [Bb]y\s*:\s*[^\n]+"),
    "name": (P.NAME, None, r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
}
PARTS = {
    "ip": ["1.2.3", "10.0.0.1", "8.8.", "1", "10", "255", "1234", ".", ".", "é", "_", " ", "٣", "-"],
    "mac": ["00:1A:", "2b-3C:4d", ":5E", "00", "1A", "f", ":", "-", ":", "g", " "],
    "phone": ["555", "123", "4567", "1", "+", "(", ")", "-", ".", " ", "\xa0", "\x1c", "é", "55"],
    "email": ["a", "B", "9", "_", ".", "%", "@", "|", "é", " ", "-", "com", "@x.org"],
    "imei": ["IMEI", "#", " ", "\u2003", "12", "x", "٣"],
    "account": ["Account", " ", "\x1f", "12345678", "-1", "9", "x"],
    "url": ["http://", "https://", "a", "/", " ", "\u3000", "\x85", "é", "\u200b"],
    "run_by": ["Run ", "By", "by", ":", " ", "\n", "x", "\u2028"],
    "name": ["Ab", "Cde", "x", "é", "Ä", "_", " ", "\n", "\xa0", "1", "A", "."],
}


def texts(parts, seed, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", PLAIN)
def test_pattern(spark, name):
    java, hint, plain = PLAIN[name]
    sample = texts(PARTS[name], name)
    df = spark.createDataFrame([(t,) for t in sample], "text string")
    got = {r.text: list(r.hits) for r in df.select("text", R.find_all(F.col("text"), java, hint).alias("hits")).collect()}
    assert any(got.values())
    for t in sample:
        assert got[t] == [m.group(0) for m in re.finditer(plain, t)], repr(t)


def test_label_breaks(spark):
    parts = ["to", "THE", "high", "ahigh", "é", " ", "  ", "\n", "Impact:", "Caller:", "Caller name:", "Category:", "x"]
    sample = texts(parts, 11)
    df = spark.createDataFrame([(t,) for t in sample], "text string")
    got = {r.text: r.out for r in df.select("text", L.break_before_labels(F.col("text")).alias("out")).collect()}
    words = "|".join(P.BREAK_WORDS)
    labels = "|".join(re.escape(x) for x in P.FIELD_LABELS)
    for t in sample:
        expected = re.sub(rf"(?<!\w)((?i:{words}))\s+({labels})", r"\1" + "\n" + r"\2", t)
        assert got[t] == expected, repr(t)


def test_pieces_and_hits(spark):
    sample = texts(PARTS["phone"], 5)
    df = spark.createDataFrame([(t,) for t in sample], "text string")
    t = F.col("text")
    bad = df.filter(F.size(F.split(t, P.PHONE, -1)) != F.size(R.find_all(t, P.PHONE)) + 1)
    assert bad.count() == 0
    # in turn, with one search or, where the text holds the mark, with two
    for u in (t, F.concat(t, F.lit(f" {P.MARK} 555-123-4567{P.MARK}"))):
        turns = R.split_at(u, P.PHONE)
        same = F.concat_ws("", turns) == u
        same = same & (R.matches_of(turns) == R.find_all(u, P.PHONE)) & (F.size(turns) % 2 == 1)
        assert df.filter(~same).count() == 0


def test_breaks_between_values_and_labels(spark):
    """The rules, which look at the text before a label, against the plain patterns."""
    parts = [
        "High", "Medium", "xLow", "2", "9", "-", " - ", " ", "  ", "\n", "\xa0", "Presidio", "Delaware North", "Companies", ":",
        "Responsible party:", "Urgency:", "Urgency: ", "Assignment group:", "Customer Assignment Group:", "Service Offering:",
        "Category:", " Category:", "MSC Network Engineer", "Network Services", "Abc Def", "Abc", " Def", "aBc", "true", "untrue", "false", "é",
    ]
    sample = [t for seed in range(20, 24) for t in texts(parts, seed)]
    df = spark.createDataFrame([(t,) for t in sample], "text string")
    got = {r.text: r.out for r in df.select("text", L.break_value_label(F.col("text")).alias("out")).collect()}
    changed = 0
    for t in sample:
        expected = t
        for value, label in X.VALUE_LABELS:
            expected = regex.sub(rf"({value})\s+({label})", r"\1" + "\n" + r"\2", expected)
        changed += expected != t
        assert got[t] == expected, repr(t)
    assert changed > 100
