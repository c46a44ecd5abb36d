import hashlib
import random
import re

import pytest

from ticketveil.llm import infill

from .helpers import empty_docs, odd_docs, prose

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"1:{'' if id is None else id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return id, n, "plain", None, None, sha(text), sha(text), text
    pre, mid, suf = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    spm = h4 % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return id, n, "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text), out


def check(df):
    names = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
    got = sorted(repr((r.doc_id, *(r[c] for c in names))) for r in infill.fill_in_middle(df).collect())
    assert got == sorted(repr(brute(r.doc_id, r.text)) for r in df.collect())
    got = sorted(repr((r.doc_id, *(r[c] for c in names[:-1]))) for r in infill.digests(df).collect())
    assert got == sorted(repr(brute(r.doc_id, r.text)[:-1]) for r in df.collect())


def test_odd_rows(spark):
    check(odd_docs(spark))
    assert infill.digests(empty_docs(spark)).count() == 0


def test_every_form_and_false_markers(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "P", "S", ">", "M", "é", "ab", " ", "\U0001f600", "1", "\n"]) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    assert {r.form for r in infill.digests(df).select("form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units, piece, block", [(1, 1, 7), (3, 5, 16), (4, 1000, 64)])
def test_small_pieces(units, piece, block, monkeypatch):
    """Pieces and blocks of any size give the same output and the same text; no Spark needed."""
    monkeypatch.setattr(infill, "UNITS", units)
    monkeypatch.setattr(infill, "PIECE", piece)
    monkeypatch.setattr(infill, "BLOCK", block)
    for id in range(200):
        text = prose(id, 12) + "é<漢 aaaaaaaaaaaaaaaaaaaa<S\U0001f600"
        want = brute(id, text)
        data = text.encode()
        n, form, middle, suffix = infill.plan(data, str(id))
        cut = list(infill.cut(data, form, middle, suffix))
        assert (n, form, b"".join(cut).decode()) == (want[1], want[2], want[-1])
        assert max(map(len, cut)) <= piece + 3
        found = infill._Found(form)
        stretches = [s for i, p in enumerate(cut) for s in found.feed(p, i == len(cut) - 1)]
        assert b"".join(b for _, b in sorted(stretches, key=lambda s: s[0])) == data


def test_long_text_and_repeated_rows(spark):
    long = prose(3, 400_000) + "\U0001f600" * 1000 + "x" * 200_000
    rows = [(i, long) for i in (1, 2, 3, 4)] + [(7, "one two")] * 5000 + [(7, "another text")] * 3 + [(None, f"t {i}") for i in range(500)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    sizes = infill.pieces(spark.createDataFrame([(1, long)], "doc_id long, text string")).selectExpr("max(length(piece)) AS m").first()
    assert sizes.m <= infill.PIECE + 3
