"""Small tables with the cases that every operator has to stand: nulls, empty and long texts, ties,
repeated rows, extra columns with clashing names."""

import random

ODD = [
    (1, "Alpha beta.\nshared line\ngamma", "a"),
    (2, "", "b"),
    (3, None, "c"),
    (None, "no id here, only text", None),
    (5, " SHARED line \t\nx" * 3, "e"),
    (5, " SHARED line \t\nx" * 3, "e"),
    (6, "word " * 20_000 + "end", "f"),
    (7, "\n\n \n", "g"),
    (8, "ÄÖÜ ñ 漢字   x y \U0001f600\x00\x1f tail  ", "h"),
]
#: Names that operators use for themselves.
EXTRA = ("h", "g", "id", "t", "w", "key", "fp", "score", "kept", "n_lines", "shard", "spans", "items", "ids")


def odd_docs(spark, rows=ODD):
    names = ", ".join(f"{c} string" for c in EXTRA)
    data = [(i, t, *[x] * len(EXTRA)) for i, t, x in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {names}")


def empty_docs(spark):
    return odd_docs(spark, [])


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
