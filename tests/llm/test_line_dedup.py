import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketveil.llm.linededup import dedup_lines, drop_common_lines

from .helpers import empty_docs, odd_docs

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, threshold):
    keys = [[x.strip("\t\n\x0b\x0c\r ").translate(UPPER) for x in (t or "").split("\n")] for _, t in rows]
    having = defaultdict(set)
    for i, ks in enumerate(keys):
        for k in ks:
            having[k].add(i)
    out = []
    for (doc, t), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not (k and len(having[k]) >= threshold)]
        out.append((doc, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return out


def run(df, threshold):
    found = drop_common_lines(df, threshold=threshold)
    return sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect())))


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    assert run(odd_docs(spark), 2) == sorted(map(repr, brute(rows, 2)))
    assert drop_common_lines(empty_docs(spark)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", " A", "b", "", "Ä", "ä", "K", "k", "c\r"]), max_size=6), min_size=1, max_size=12))
def test_brute_force(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 3) == sorted(map(repr, brute(rows, 3)))


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = odd_docs(spark)
    out = dedup_lines(docs, threshold=2)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "" and texts[3] is None and texts[1] == "Alpha beta.\ngamma"


def test_every_line_common_in_a_long_text(spark):
    long = "\n".join(["same"] * 5000 + ["own"])
    df = spark.createDataFrame([(i, long) for i in range(12)] + [(99, "other")], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in drop_common_lines(df).collect()}
    assert got[3] == (5001, hashlib.sha256(b"").hexdigest()) and got[99][0] == 0


def test_columns_named_like_those_within(spark):
    names = ("kept", "n_lines", "n_dropped", "__row", "__also", "__gone", "c0", "keys")
    rows = [(i, "same line\nown" + str(i), *[f"{c}{i}" for c in names]) for i in range(12)]
    for own in (names, (*(c.upper() for c in names),)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in own))
        out = dedup_lines(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert r.text == f"own{r.doc_id}" and tuple(r)[2:] == tuple(f"{c}{r.doc_id}" for c in names)
        added = drop_common_lines(docs)
        assert added.columns[-3:] == ["n_lines", "n_dropped", "kept"] and added.filter("n_dropped = 1").count() == 12
