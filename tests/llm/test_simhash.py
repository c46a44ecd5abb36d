import random

import numpy as np
import xxhash

from ticketveil.llm import simhash as S
from ticketveil.llm.components import connected_components

from .helpers import empty_docs, odd_docs, prose


def plain(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    n = len(fps)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_fingerprints():
    for text in ("", "one", "One two", "one two three", prose(1, 50), "ä Ö x " * 40, "\x1c\x0b a"):
        assert S.fingerprint(text.encode()) == plain(text)


def test_masks_cover_the_radius():
    rng = random.Random(3)
    for level in (0, 1, 2):
        masks = S.masks(3, level)
        assert len(masks) == 15
        for _ in range(500):
            differing = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & differing == 0 for m in masks)


def groups(pairs):
    by = {}
    for node, component in pairs:
        by.setdefault(component, set()).add(node)
    return sorted(map(sorted, by.values()))


def test_links_of_dense_groups(spark):
    """Chains and balls of near fingerprints, in buckets that fit and in buckets that are dealt anew."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            centre ^= sum(1 << b for b in rng.sample(range(64), 2))
            fps |= {centre, centre ^ 1 << rng.randrange(64), centre ^ 15 << rng.randrange(60)}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    ids = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in ids]
    want = groups((signed[i], signed[r]) for i, r in enumerate(brute(ids)))
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (4096, 4):
        found = connected_components(S.links(df, 3, bucket)).collect()
        linked = groups((r.node, r.component) for r in found)
        assert linked == [g for g in want if len(g) > 1]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(300, 300), (7, 6), (7, 6)]
    rng.shuffle(edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain(t) for _, t in rows]
    roots = brute(fps)
    want = []
    for (doc, _), fp, r in zip(rows, fps, roots):
        same = [d for (d, _), x in zip(rows, roots) if x == r and d is not None]
        want.append((doc, f"{fp:016x}", min(same, default=None)))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert S.near_duplicates(empty_docs(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    text = prose(11, 300)
    rows = [(5, text), (3, text), (9, text + " tail"), (1, prose(12, 300)), (None, text)]
    out = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {1, 3, None}


def test_one_row_of_repeated_ids_stays(spark):
    text, other = prose(11, 300), prose(12, 300)
    rows = [(3, text, "a"), (3, text, "b"), (5, text, "c"), (5, other, "d"), (3, text + " tail", "e"), (7, None, "f"), (7, "", "g"), (8, "", "h")]
    out = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect()
    # one of id 3, the other text of id 5, one of the empty texts
    assert sorted(r.doc_id for r in out) == [3, 5, 7]
    assert {r.text for r in out if r.doc_id == 5} == {other}
    assert S.keep_one(odd_docs(spark)).columns == odd_docs(spark).columns
    assert S.keep_one(empty_docs(spark)).count() == 0
