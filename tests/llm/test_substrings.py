import random
from collections import defaultdict

import numpy as np
import pytest

from ticketveil.llm import substrings as S

from .helpers import empty_docs, odd_docs, prose


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = defaultdict(lambda: float("inf"))
    for i, t in texts:
        if i is not None:
            for a in range(len(t) - length + 1):
                w = t[a : a + length]
                least[w] = min(least[w], i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if i is not None and least[t[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        runs = [k for k in range(len(t)) if gone[k] and (not k or not gone[k - 1])]
        out.append((i, len(t), sum(gone), len(runs), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def check(df, length=50):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = S.remove_repeats(df, length=length).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr)
    assert mine == brute(rows, length)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return got


def passages(seed, n):
    """Texts with shared passages, copies, cuts inside of passages, negative and repeated ids."""
    rng = random.Random(seed)
    shared = [prose(1000 + i, 40, 5000) for i in range(4)] + ["é漢" * 30, "-" * 200, prose(2000, 9, 50)]
    out = []
    for i in range(n):
        t = prose(seed * n + i, rng.randrange(120), 5000)
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            k = rng.randrange(len(t) + 1)
            t = t[:k] + p[a:] + t[k:]
        out.append((rng.choice([i, i, -i, 7, 2**40 + i]), t))
        if rng.random() < 0.2:
            out.append((rng.randrange(n), rng.choice(out)[1]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 5000)
    df = spark.createDataFrame(passages(seed, 120), "doc_id long, text string").repartition(5)
    assert sum(r.n_removed for r in check(df)) > 5000


def test_other_lengths(spark):
    rows = [(i % 10**6, t) for i, t in passages(3, 60)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    assert S.remove_repeats(df).schema["doc_id"].dataType == df.schema["doc_id"].dataType
    for length in (32, 100):
        check(df, length)
    with pytest.raises(ValueError):
        S.remove_repeats(df, length=10)


def test_crowded_anchors(spark, monkeypatch):
    """Stretches of one anchor that are too many to be sorted together: the same rows, joined or broadcast."""
    rows = passages(4, 80) + [(5000 + i, prose(i, 3, 9000) + "=" * (45 + i % 40) + prose(9000 + i % 7, 20)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(S, "CROWD", 2000)
    check(df)
    monkeypatch.setattr(S, "BROADCAST_ANCHORS", 0)
    check(df)


def test_odd_rows(spark):
    check(odd_docs(spark).drop("id", "h", "g"))
    check(odd_docs(spark))
    assert S.remove_repeats(empty_docs(spark)).count() == 0


def test_long_text_and_hot_copies(spark):
    long = prose(1, 150_000, 20_000)
    rows = [(1, long), (2, long[1000:-1000] + "x"), (3, "a" * 100_000), (0, "a" * 60)] + [(10 + i, prose(3, 60)) for i in range(2000)]
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[1].n_removed == 0 and bytes(got[2].kept) == b"x"
    assert (got[3].n_removed, got[3].n_spans, got[0].n_removed) == (100_000, 1, 0)
    assert got[10].n_removed == 0 and all(got[10 + i].n_removed == got[10].n_bytes for i in range(1, 2000))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh \n", "\xff\x00a"])
def test_two_stage_sort(alphabet):
    rng = random.Random(1)
    for _ in range(20):
        texts = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(90))).encode("latin1") for _ in range(25)} | {b"", b"a" * 90})
        symbols = np.array([x for t in texts for x in (*(c + 1 for c in t), 0)])
        order, words = S.two_stage_sort(symbols, 50)
        suffixes = [tuple(symbols[i : i + 50].tolist()) for i in order]
        suffixes = [s + (0,) * (50 - len(s)) for s in suffixes]
        assert sorted(order.tolist()) == list(range(len(symbols))) and suffixes == sorted(suffixes)
        same = S.common_prefix(order, words, 50)
        assert same.tolist() == [i > 0 and suffixes[i] == suffixes[i - 1] for i in range(len(order))]


def test_stretches_cover_all_windows(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    ends = np.array([0, 30, 79, 80, 1000, 1000, 4990, 5000])
    want = {a for a in range(len(data) - 49) if np.searchsorted(ends, a, "right") == np.searchsorted(ends, a + 49, "right")}
    for size in (64, 1000, 1 << 18):
        monkeypatch.setattr(S, "SLICE", size)
        got = [w for _, first, last in S.stretches(data, ends, 50) for a, b in zip(first, last) for w in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == want
