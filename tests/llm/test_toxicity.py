import random
import zlib

from pyspark.sql import functions as F

from ticketveil.llm import toxicity as T

from .helpers import empty_docs, odd_docs, prose


def counts(text, lexicon=(b"fool",)):
    n = T.Grammar(list(lexicon), [b"blar"]).matches(text.encode())
    return {m: int(c) for m, c in zip(T.MATCHES, n) if c}


def test_clauses():
    assert counts("A fool.") == {"I": 1}
    assert counts("you are a FOOL") == {"Ip": 1}
    assert counts("you. A fool") == {"I": 1}  # the target is in another clause
    assert counts("you are not a fool") == {"Ipn": 1}
    assert counts("not one two three four fool") == {"I": 1}  # out of the negation's reach
    assert counts("she said you fool") == {"Ipr": 1}
    assert counts("he wrote that a fool is never a fool") == {"Ipr": 1, "Ipnr": 1}
    assert counts("I will kill you. you kill") == {"T": 1, "Tp": 1}
    assert counts("blarney, blar, bla") == {"I": 2}
    assert counts("") == counts("no match") == {}


def test_composition_is_the_cascade():
    rng, machine = random.Random(1), T.grammar()
    for _ in range(200):
        symbols, state, out = [rng.choice(T.READ) for _ in range(12)], machine.start, []
        for s in symbols:
            state, o = machine.step(state, s)
            out.append(o)
        target = report = reach = 0
        for s, o in zip(symbols, out):
            if s in "IT":
                assert o == s + "p" * target + "n" * (reach > 0) + "r" * report
                reach = max(0, reach - 1)
            else:
                target, report = target or s == "P", report or s == "R"
                reach = T.SCOPE if s == "N" else max(0, reach - 1)


def planted(spark, n=400):
    bad = ["glorp", "snarf", "blixword"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 3]} here." if i % 5 == 0 else "."), int(i % 5 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = planted(spark)
    scored = T.score(docs, T.learn(docs, labels)).withColumn("out", T.held_out()).join(labels, "doc_id").collect()
    held = [r for r in scored if r.out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((r.score >= 0.5) == bool(r.toxic) for r in held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = planted(spark, 200)
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.learn(docs, labels) == T.learn(docs, flipped)


def test_odd_rows(spark):
    docs, labels = planted(spark, 200)
    model = T.learn(docs, labels)
    out = T.score(odd_docs(spark), model)
    assert out.count() == 9 and out.filter("score between 0 and 1").count() == 9
    assert T.score(empty_docs(spark), model).count() == 0
    none = labels.limit(0)
    assert T.learn(docs, none)[0] == []
    assert T.reject_toxic(odd_docs(spark), labels).columns == odd_docs(spark).columns


def test_null_and_repeated_labels(spark):
    docs, labels = planted(spark, 200)
    extra = spark.createDataFrame([(None, 1, 1), (3, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert T.learn(docs, labels.unionAll(extra).unionAll(labels)) == T.learn(docs, labels)


def learned(spark, toxic, clean, header="", copied=0, bad=("glorp", "snarf", "blixword")):
    """The lexicon of texts of which each toxic one has an insult."""
    texts = [(f"{header}{prose(i, 60)} {bad[i % len(bad)]} here.", 1) for i in range(toxic)]
    texts += [(f"{header}{prose(-1 - i, 60)} here.", 0) for i in range(clean)]
    texts += [(f"{prose(9999, 300)} copied {'x' * (i + 1)}", 1) for i in range(copied)]
    ids = [i for i in range(2 * len(texts) + 50) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    rows = [(i, t, y) for i, (t, y) in zip(ids, texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    own, stems, _ = T.learn(docs, spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    return set(own) | {b"^" + s for s in stems}


INSULTS = {b"glorp", b"snarf", b"blixword"}


def test_most_labels_are_toxic(spark):
    assert learned(spark, 450, 100) >= INSULTS
    assert len(learned(spark, 450, 100) - INSULTS) <= 8  # their beginnings, and about one term by chance


def test_shared_header(spark):
    found = learned(spark, 150, 450, "Transcript of the support line, channel 7, all rights reserved: ")
    assert found >= INSULTS and not {b"transcript", b"support"} & found


def test_few_rows(spark):
    assert learned(spark, 50, 10, bad=("glorp",)) >= {b"glorp"}
    assert learned(spark, 10, 5, bad=("glorp",)) - {b"^glor"} == {b"glorp"}
    assert learned(spark, 60, 0) == set()


def test_copies_are_one_row(spark):
    found = learned(spark, 60, 200, copied=100)
    assert found >= INSULTS and b"copied" not in found


def test_copies():
    fps = [5, 5, 0, 7, 0xFFFF0000, 0xFFF00000, 0xFF000000, 1 << 63]
    groups = T.copies(T.np.array(fps, T.np.uint64), 3).tolist()
    assert groups[:4] == [0] * 4 and groups[7] == 0 and len(set(groups[4:7])) == 3


def test_bars_can_be_reached():
    for toxic, clean in ((3000, 1000), (3000, 700), (3000, 20), (50, 10), (10, 5), (5, 50), (3, 3), (3, 9000)):
        assert T.bars(toxic, clean, 100_000)[0] <= toxic
    assert T.bars(3000, 1000, 100_000)[0] < 64 > T.bars(3000, 700, 100_000)[0]
    assert T.bars(50, 0, 1) == T.bars(0, 50, 1) == T.bars(0, 0, 0) == []


def test_stage_keeps_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, prose(i, 20), 0.9, i) for i in range(20)], "doc_id long, text string, score double, c0 long")
    out = T.reject_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.columns == docs.columns and {(r.score, r.c0 == r.doc_id) for r in out.collect()} == {(0.9, True)}
