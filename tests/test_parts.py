import random

import pytest
from pyspark.sql import functions as F

from ticketveil.operators import lines as L
from ticketveil.operators import parts as O
from ticketveil.operators import redaction as R

WORDS = [
    "Impact: 2", "John", "Smith", "Delaware North", "Presidio", "Urgency: 1", "the", "to", "Location: x", "Caller:", "6-",
    "555 123-4567", "(555) 123.4567", "5551234567", "#", "#1-555-765-4321", "8.8.8.8", "10.0.0.1", "1.2.3.4.5", "00:1A:2b:3C:4D:5E", "AA-BB-CC-DD-EE-FF",
    "a.b@example.com", "EVE12345678", "IMEI# 49015420", "IMEI", "Account", "12345678-9", "https://x.example/a?b", "Run By:", "Run by", ":", "run of the mill",
    "<br", "<br/>", "/>", ">", "> a:", "<b>", "</b>", "[code]", "[/code]", "SLA", "definition", "Notes", "Notes:", "Last", "R.:", "1. one", "* two", "15 Minutes",
    "Time worked", "High", "Medium", "Responsible party: x", "Customer Assignment Group: y", "Network Services", "Category: z", "true", "Service Offering: s",
    "alpha beta gamma delta epsilon", "it was a long day for all of them", "and so on, it went", "über straße", "\U0001f600",
]
GLUE = [" ", " ", " ", "\n", "\n", "\n\n", ".\n", ".\n", ";\n", "  ", "\r\n", "\t", "\n \n", "", "\x85", "."]


def texts(seed, n, words):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(GLUE) for _ in range(words)) for _ in range(n)]


def cut_anywhere(spark, bodies, seed, most):
    """Each text cut at random places, with empty parts between and gaps in the part numbers."""
    rng, rows = random.Random(seed), []
    for i, t in enumerate(bodies):
        places = sorted(rng.choices(range(len(t) + 1), k=rng.randrange(most)))
        number = 0
        for a, b in zip([0, *places], [*places, len(t)]):
            number += rng.choice([1, 1, 1, 2000])
            rows.append((i, number, t[a:b]))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, part long, text string").repartition(4)


def whole(df, text="text"):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.doc_id, []).append((r.part, r[text]))
    return {i: "".join(t for _, t in sorted(p)) for i, p in rows.items()}


def documents(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_normalize_random_parts(spark, seed):
    bodies = [*texts(seed, 400, 12), *texts(seed + 50, 60, 80), "", "\n", "\n\n", "x", "Notes", "Notes\n"]
    want = {r.doc_id: r.text for r in L.normalize_document(documents(spark, bodies)).collect()}
    got = whole(O.normalize_parts(cut_anywhere(spark, bodies, seed, 9)))
    assert {bodies[i]: got[i] for i in got if got[i] != want[i]} == {} and got.keys() == want.keys()


@pytest.mark.parametrize("seed", [3, 4])
def test_redact_random_parts(spark, seed):
    bodies = [*texts(seed, 400, 12), *texts(seed + 50, 60, 80), "", "\n"]
    whole_rows = R.redact_documents(documents(spark, bodies)).collect()
    redacted = O.redact_parts(cut_anywhere(spark, bodies, seed, 9))
    got = whole(redacted, "redacted_text")
    assert {bodies[r.doc_id]: got[r.doc_id] for r in whole_rows if got[r.doc_id] != r.redacted_text} == {}
    counts = {r.doc_id: r for r in O.part_stats(redacted).collect()}
    for r in whole_rows:
        assert {k: counts[r.doc_id][k] for k in R.STATS} == r.stats.asDict()


FIXTURE = (
    "Impact: 2 - Medium Urgency: 3\nCaller: John Smith (555) 123-4567 rang in today, it was a very long call.\n"
    "Delaware North people met there and talked of it.\nhe was at 8.8.8.8 via 10.0.0.1 for all of the morning;\n"
    "so then Urgency: 4 came to Mary Jones about #1-555-765-4321 and TAC 6-5551234567.\nthe end of the long line is near.\n"
    "Notes\nRun By: Andrew Stone\nMail a.b@example.com EVE12345678 IMEI# 49015420 Account 12345678-9 of this and that\n"
    "see https://x.example/a?b and 00:1A:2b:3C:4D:5E<br\n/>done it is now all quite over,\nVincent Davis [code]x[/code]"
)


def test_cut_at_every_place(spark):
    """The fixture in two parts, cut at each of its places, and in parts of one to nine characters."""
    rows = [(i, p, t) for i in range(len(FIXTURE) + 1) for p, t in enumerate((FIXTURE[:i], FIXTURE[i:]))]
    rows += [(-n, a // n, FIXTURE[a : a + n]) for n in range(1, 10) for a in range(0, len(FIXTURE), n)]
    parts = spark.createDataFrame(rows, "doc_id long, part int, text string").repartition(4)
    one = documents(spark, [FIXTURE])
    assert set(whole(O.normalize_parts(parts)).values()) == {L.normalize_document(one).first().text}
    redacted = O.redact_parts(parts)
    want = R.redact_documents(one).first()
    assert want.stats.total_redactions > 9 and set(whole(redacted, "redacted_text").values()) == {want.redacted_text}
    counts = O.part_stats(redacted).drop("doc_id").distinct().collect()
    assert [r.asDict() for r in counts] == [want.stats.asDict()]


def test_segments_are_no_longer_than_they_have_to_be(spark):
    text = "Impact: 2\nhe said that it was so.\nand so on it went for all.\n" * 400
    parts = O.cut_text(documents(spark, [text]), 500)
    for rows in (O.normalize_parts(parts), O.redact_parts(parts).withColumnRenamed("redacted_text", "text")):
        sizes = [r.n for r in rows.select(F.length("text").alias("n")).collect()]
        assert len(sizes) > 40 and max(sizes) < 700


def test_pages(spark):
    """Parts with a separator between those that are not empty; documents without any text."""
    bodies = texts(7, 30, 20)
    pages = [(i, p, t) for i, b in enumerate(bodies) for p, t in enumerate(["", *b.split("\n"), "", None])] + [(99, 0, ""), (99, 1, None)]
    parts = spark.createDataFrame(pages, "doc_id long, part int, text string")
    joined = documents(spark, ["\n".join(x for x in b.split("\n") if x) for b in bodies])
    want = {r.doc_id: r.text for r in L.normalize_document(joined).collect()} | {99: ""}
    assert whole(O.normalize_parts(parts, sep="\n")) == want


def test_previous(spark):
    rng = random.Random(1)
    rows = [(d, o, rng.choice([None, None, None, o])) for d in range(3) for o in rng.sample(range(-50, 500), 200)]
    got = {(r.doc, r.at): r.previous for r in O.previous(spark.createDataFrame(rows, "doc long, at long, v long"), "doc", "at", "v", 16).collect()}
    for d, o, _ in rows:
        earlier = [(x, v) for e, x, v in rows if e == d and x < o and v is not None]
        assert got[d, o] == (max(earlier)[1] if earlier else None)
