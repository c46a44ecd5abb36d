import random
import zlib

from ticketveil.llm import sharding as S

from .helpers import empty_docs, odd_docs, prose


def test_tree_finds_the_tightest():
    rng, tree, bins = random.Random(1), S.CapacityTree(), {}
    for step in range(3000):
        size = rng.randrange(1, 50)
        want = min(((room, b) for b, room in bins.items() if room >= size), default=None)
        got = tree.take_tightest(size)
        assert got == want
        if got is not None:
            del bins[got[1]]
        room = rng.randrange(0, 80)
        tree.add(room, step)
        bins[step] = room


def test_pack():
    assert S.pack([], 3) == []
    assert S.best_fit_decreasing([6, 5, 4, 3, 2], 10, 2) == [0, 1, 0, 1, 1]
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 1000) for _ in range(5000)), reverse=True)
    loads = [0] * 24
    for size, b in zip(sizes, S.pack(sizes, 24)):
        loads[b] += size
    assert max(loads) - min(loads) < 0.01 * max(loads)
    # one size over its fair share has a bin of its own, the others stay near equal
    loads = [0] * 24
    for size, b in zip([10**6, *sizes], S.pack([10**6, *sizes], 24)):
        loads[b] += size
    rest = sorted(loads)[:-1]
    assert max(loads) == 10**6 and rest[-1] - rest[0] < 0.01 * rest[-1]


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(0 <= r.shard < shards for r in rows)


def test_rows(spark):
    docs = [(i, prose(i % 300, 5 + i % 40)) for i in range(500)] + [(1000 + i, "copy of one text") for i in range(300)]
    rows = S.assign_shards(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(rows, docs, 24)
    sizes = {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == sizes


def test_odd_rows(spark):
    rows = S.assign_shards(odd_docs(spark), shards=3).collect()
    check(rows, odd_docs(spark).collect(), 3)
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {8}
    assert S.assign_shards(empty_docs(spark)).count() == 0


def test_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 10)) for i in range(50)], "doc_id long, text string")
    S.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_written_without_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 7, 8), (None, "b", 7, 8)], "doc_id long, text string, shard int, slot int")
    S.write_shards(docs, str(tmp_path / "shards"), shards=2)
    rows = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert {(r.doc_id, r.text) for r in rows} == {(1, "a"), (None, "b")} and {r.shard for r in rows} <= {0, 1}
