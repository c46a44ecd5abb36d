import math
import random
import re
import textwrap

from ticketveil.llm import licenses as L

from .helpers import empty_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(UPPER))
    places = [
        (i, label)
        for phrase, label in L.PHRASES
        for p in [phrase.split()]
        for i in range(len(words) - len(p) + 1)
        if words[i : i + len(p)] == p
    ]
    shares = []
    for line in (text or "").split("\n"):
        own = set(WORD.findall(line.lower()))
        for sentence, label in L.TEMPLATES:
            wanted = set(sentence.split())
            if (share := len(own & wanted) / len(wanted)) >= 0.8:
                shares.append((share, label))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return (
        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x for _, x in shares})), 1.0 if at else max([s for s, _ in shares], default=0.0),
    )


TEXTS = [
    "Released under the MIT License.",
    "x UNDER--the\nmit  LICENSE, under the mit license! thunder the mit license under the mit licenses",
    "Licensed under the Apache License, Version 2.0.",
    "apache license version 20 and Apache License Version 2",
    "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "All rights reserved.",
    "rights, all reserved in other words\nnothing",
    "this work is under license of the gnu general version 3",
    "éunder the mit license",
    "under the mit licenseé\nunder the mit license",
    "",
    None,
    "this is free and public domain software released " * 50,
]


def test_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in L.scan(df).collect():
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_prefix_index_loses_nothing():
    order = sorted({w for s, _ in L.TEMPLATES for w in s.split()})
    for token, p, n, overlap, words, _ in L.prefix_index(L.TEMPLATES, order, 0.8):
        assert words[p] == token and n - p >= overlap


def test_odd_rows(spark):
    assert L.scan(odd_docs(spark)).count() == 9
    for r in L.scan(odd_docs(spark)).filter("doc_id in (2, 3)").collect():
        assert tuple(r)[1:] == (0, 0, None, None, "", "", 0.0)
    assert L.scan(empty_docs(spark)).count() == 0
    assert L.scan(odd_docs(spark), templates=(), phrases=L.PHRASES[:1]).count() == 9


def test_native(spark):
    plan = L.scan(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_runs(text):
    """Labels and score by each line and each run of words in a paragraph."""
    shares = []
    for paragraph in re.split(r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n", text.lower()):
        words = WORD.findall(paragraph)
        for sentence, label in L.TEMPLATES:
            wanted, run = set(sentence.split()), math.floor(len(sentence.split()) / 0.8 + 1e-9)
            own = [WORD.findall(line) for line in paragraph.split("\n")] + [words[i : i + run] for i in range(len(words))]
            if (share := max(len(wanted & set(b)) / len(wanted) for b in own)) >= 0.8:
                shares.append((share, label))
    return ",".join(sorted({x for _, x in shares})), max([s for s, _ in shares], default=0.0)


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.labels, r.score) for r in L.scan(df, phrases=(("no such phrase", "none"),)).collect()}


def test_wrapped_notices(spark):
    texts, want = [], []
    for sentence, label in L.TEMPLATES:
        for width, prefix in ((80, ""), (80, " * "), (60, "// "), (44, "# "), (70, "dnl "), (30, "")):
            lines = textwrap.wrap(sentence, width, initial_indent=prefix, subsequent_indent=prefix)
            texts.append("some words before it\n" + "\r\n".join(lines) + "\nand more words after it\n" + "w " * 500)
            want.append(label)
    out = scanned(spark, texts)
    for i, label in enumerate(want):
        assert label in out[i][0].split(",") and out[i][1] == 1.0, texts[i]


def test_paragraphs_and_distance(spark):
    head, tail = "permission is hereby granted free of charge to any", "person obtaining a copy of this software and associated documentation files"
    texts = [f"{head}\n{tail}", f"{head}\n *\n{tail}", f"{head}\n{'w ' * 20}\n{tail}", f"{head} {'w ' * 20} {tail}", "all\nw w rights\nw reserved"]
    assert scanned(spark, texts) == {0: ("mit", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("mit", 1.0), 4: ("", 0.0)}


def test_brute_force_over_lines(spark):
    rng, texts = random.Random(5), []
    for _ in range(300):
        words = []
        for sentence, _ in rng.sample(L.TEMPLATES, 3):
            own = [w for w in sentence.split() if rng.random() < 0.93]
            words += own + ["x"] * rng.randrange(6)
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n# ", "\n\n" if rng.random() < 0.2 else " "]) for w in words))
    for i, got in scanned(spark, texts).items():
        assert got == brute_runs(texts[i]), texts[i]


def test_phrases_that_begin_with_a_digit(spark):
    phrases = (("0bsd license", "0bsd"), ("3 clause bsd", "bsd-3"), ("mit", "mit"))
    texts = ["the 0BSD License, 10bsd license", "3-clause BSD x 13 clause bsd", "MIT summit", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    got = {r.doc_id: (r.n_base, r["base"]) for r in L.base(rows, phrases).collect()}
    assert got == {0: (1, ["0bsd"]), 1: (1, ["bsd-3"]), 2: (1, ["mit"]), 3: (0, [])}
