import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticketveil.llm import decontaminate as D
from ticketveil.llm.common import words

from .helpers import empty_docs, odd_docs, prose


def brute(text, items, window):
    doc = words((text or "").encode())
    hit, names = set(), set()
    for name, content in items:
        item = words((content or "").encode())
        size = min(window, len(item))
        if not size:
            continue
        wanted = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(doc), len(hit), sorted(names)


word = st.sampled_from(list("abc"))
sentence = st.lists(word, max_size=14).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(sentence, max_size=5), st.lists(word, max_size=40).map(" ".join), st.integers(1, 6))
def test_automaton(items, text, window):
    named = list(enumerate(items))
    machine = D.Automaton([(str(i), words(t.encode())) for i, t in named], window)
    tokens = words(text.encode())
    hit, names = set(), set()
    for a, b, found in machine.matches(tokens):
        hit |= set(range(a, b))
        names |= found
    assert (len(tokens), len(hit), sorted(names)) == brute(text, named, window)


def tables(spark):
    rng = random.Random(2)
    items = [(i, prose(1000 + i, rng.randrange(12, 40), 60)) for i in range(30)] + [(50, "short item"), (51, ""), (52, None), (None, prose(7, 15, 60))]
    docs = []
    for i in range(40):
        body = prose(i, 80, 60).split()
        if i % 3 == 0:
            piece = (items[i % 30][1] or "").split()
            body[20:20] = piece[: rng.randrange(8, 14)]
        docs.append((i, " ".join(body) + (" Short, ITEM!" if i % 7 == 0 else "")))
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_tables(spark):
    docs, items, left, right = tables(spark)
    named = [(i, t) for i, t in items if i is not None]
    want = {i: brute(t, named, 10) for i, t in docs}
    for block in (50_000, 45, 12):  # the last cuts items
        got = D.contamination(left, right.filter("item_id is not null"), block_words=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert sum(n > 0 for _, n, _ in want.values()) > 5


def test_automata_are_built_once_for_all_documents(spark, monkeypatch):
    docs, items, _, _ = tables(spark)
    built, made = [], D.Automaton
    monkeypatch.setattr(D, "Automaton", lambda block, window: built.append(1) or made(block, window))
    monkeypatch.setattr(D, "_built", {})

    class Block:
        def __init__(self, i, item):
            self.value = (i, [(str(item[0]), words((item[1] or "").encode()))])

    blocks = [Block(i, item) for i, item in enumerate(items)]
    found = D._hits([words(t.encode()) for _, t in docs], blocks, 10)
    assert len(built) == len(blocks)
    assert [(sum(b - a for a, b in spans), sorted(n)) for spans, n in found] == [brute(t, items, 10)[1:] for _, t in docs]


def test_groups_hold_all_texts(monkeypatch):
    monkeypatch.setattr(D, "HELD_BYTES", 10)
    texts = [b"", b"12345678", b"123", b"x" * 50, b"", b"1"]
    groups = list(D._held(texts))
    assert [t for g in groups for t in g] == texts and len(groups) == 4
    assert list(D._held([])) == []


def test_cut_out(spark):
    docs, items, left, right = tables(spark)
    out = D.decontaminate(left, right.filter("item_id is not null")).collect()
    named = [(i, t) for i, t in items if i is not None]
    texts = dict(docs)
    assert {r.doc_id for r in out} == set(texts)
    for r in out:
        assert brute(r.text, named, 10)[1] == 0
        assert r.text == texts[r.doc_id] or brute(texts[r.doc_id], named, 10)[1] > 0


def test_mostly_benchmark_goes(spark):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 30) + " and a few more"), (2, prose(2, 90) + " " + prose(1, 30))], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in D.decontaminate(docs, items).collect()] == [(2, prose(2, 90) + " ")]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha BETA shared"), (2, None), (3, "word word word")], "item_id long, text string")
    docs = odd_docs(spark)
    got = {(r.doc_id, r.n_words, r.n_hit) for r in D.contamination(docs, items).collect()}
    assert (1, 5, 3) in got and (3, 0, 0) in got and (6, 20_001, 20_000) in got
    none = items.limit(0)
    assert D.contamination(docs, none).filter("n_hit > 0").count() == 0
    assert D.contamination(empty_docs(spark), items).count() == 0
    kept = D.decontaminate(docs, none)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def test_digest_of_no_items(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_items_without_an_id(spark):
    """They count like others, under an empty id."""
    passage = prose(77, 12)
    docs = spark.createDataFrame([(1, f"x {passage} y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (5, passage), (None, None)], "item_id long, text string")
    row = D.contamination(docs, items).first()
    assert (row.n_hit, row["items"]) == (12, ["", "5"])
    assert D.decontaminate(docs, items, max_coverage=0.9).first().text == "x  y"
