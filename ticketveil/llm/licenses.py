"""License notices by an exact set-similarity join with templates: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, GAP = f"[^{_OTHER}]+", f"[{_OTHER}]+"
#: Lines without words, and the line ends around them.
BREAK = f"\\n[{_OTHER}]*\\n"

# Phrases that are a notice wherever they stand, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences of common notices, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _phrase(phrase: str) -> str:
    """The phrase as whole words, A-Z in either case, with any separators. What stands before it is tested after
    its first character, so that a search stops at few places."""
    spelled = GAP.join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in phrase.split())
    first = f"[{phrase[0]}{phrase[0].upper()}]" if phrase[0].isalpha() else phrase[0]
    rest = spelled[len(first) :]
    return f"{first}(?<![^{_OTHER}]{first}){rest}(?![^{_OTHER}])"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _places(text: Column, phrase: str) -> Column:
    """``(n, first, last)``: how often the phrase stands in the text, and the word numbers of its first and
    last place, from the words before the first and after the last."""
    kind = "struct<n: long, first: long, last: long>"
    none = F.struct(F.lit(0).alias("n"), F.lit(None).alias("first"), F.lit(None).alias("last")).cast(kind)
    found = _let(
        F.split(text, _phrase(phrase), -1),
        lambda p: F.struct(
            (F.size(p) - 1).alias("n"),
            n_words(p[0]).alias("first"),
            (n_words(text) - n_words(F.element_at(p, -1)) - len(phrase.split())).alias("last"),
        ).cast(kind),
    )
    return F.when(text.rlike(_phrase(phrase)), found).otherwise(none)


def base(rows: DataFrame, phrases: tuple) -> DataFrame:
    """The rows' places of phrases, each in one projection, without the text ``t``."""
    found = rows.select(
        *(c for c in rows.columns if c != "t"),
        n_words(F.col("t")).alias("n_words"),
        *(_places(F.col("t"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)),
    )
    places = [F.col(f"p{i}") for i in range(len(phrases))]
    total = F.lit(0).cast("long")
    for p in places:
        total = total + p["n"]
    labels = F.array(*(F.when(p["n"] > 0, F.lit(label)) for p, (_, label) in zip(places, phrases)))
    return found.select(
        *(c for c in rows.columns if c != "t"),
        "n_words",
        total.alias("n_base"),
        F.array_min(F.array(*(p["first"] for p in places))).alias("first_word"),
        F.array_max(F.array(*(p["last"] for p in places))).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
    )


def prefix_index(templates: tuple, order: list[str], threshold: float) -> list[tuple]:
    """``(token, p, n, overlap, words, label)``: the prefix of each template, with the token's position ``p`` among
    its ``n`` words. Words are in the global order, rare ones first: a block with the least overlap
    has one of the first ``n - overlap + 1``."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for sentence, label in templates:
        words = sorted(set(sentence.split()), key=rank.__getitem__)
        overlap = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, p, len(words), overlap, words, label) for p, w in enumerate(words[: len(words) - overlap + 1])]
    return rows


def _most(paragraph: str, words: str, run: str) -> Column:
    """The most of ``words`` that some line of the paragraph has, or ``run`` words that follow each other in it."""

    def shared(block: Column) -> Column:
        return F.size(F.array_intersect(block, F.col(words)))

    lines = F.array_max(F.transform(F.split(paragraph, "\n", -1), lambda line: shared(F.split(line, GAP))))
    runs = _let(
        F.split(paragraph, GAP),
        lambda all: F.array_max(
            F.transform(
                all,
                lambda word, i: F.when(
                    F.array_contains(words, word), shared(F.slice(all, i + 1, F.col(run)))
                ).otherwise(0),
            )
        ),
    )
    return F.greatest(lines, runs)


def contained(rows: DataFrame, keys: list[str], templates: tuple, threshold: float) -> DataFrame:
    """``(keys, labels, share)``: rows that have a line, or a notice wrapped over lines, with at least ``threshold``
    of a template's distinct words.

    A wrapped notice is a run of words within a paragraph (the lines between two without words), at most so long
    that the whole template would still be ``threshold`` of it: comment signs are no words, and a few other words
    between the lines do no harm. Each paragraph is a block and is left with its words that stand in some
    template, in the global order of their frequency in the corpus, which is counted first.
    Blocks meet templates by an equi-join on prefix words; length and positional bounds leave out pairs that
    cannot reach the overlap, the others are counted exactly, and where a paragraph of several lines has the
    overlap its lines and runs are. The index has a row for each prefix word of the fixed templates.
    """
    vocabulary = sorted({w for sentence, _ in templates for w in sentence.split()})

    def blocks(order: list[str]) -> DataFrame:
        parts = rows.select(*keys, F.explode(F.split(F.lower("t"), BREAK, -1)).alias("paragraph"))
        own = F.array_intersect(F.array(*map(F.lit, order)), F.split("paragraph", GAP))
        return parts.select(*keys, "paragraph", own.alias("w"))

    counts = blocks(vocabulary).select(F.explode("w").alias("w")).groupBy("w").count()
    frequency = {r.w: r["count"] for r in counts.collect()}  # at most one row for each word of the templates
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    runs: dict[frozenset, int] = {}
    for sentence, _ in templates:
        n = math.floor(len(sentence.split()) / threshold + 1e-9)
        runs[frozenset(sentence.split())] = max(n, runs.get(frozenset(sentence.split()), 0))
    index = [(*r, runs[frozenset(r[4])]) for r in prefix_index(templates, order, threshold)]
    least = min((r[3] for r in index), default=1)
    prefixes = F.array(*(F.lit(w) for w in sorted({r[0] for r in index})))
    table = rows.sparkSession.createDataFrame(
        index or [("", 0, 1, 1, [""], "", 1)],
        "token string, p int, n int, overlap int, words array<string>, label string, run int",
    )
    tokens = (
        blocks(order)
        .filter((F.size("w") >= least) & F.arrays_overlap("w", prefixes))
        .select(*keys, "paragraph", "w", F.size("w").alias("m"), F.posexplode("w").alias("q", "token"))
    )
    pairs = tokens.join(F.broadcast(table), "token").filter(
        (F.col("m") >= F.col("overlap"))
        & (F.least("p", "q") + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= F.col("overlap"))
    )
    shared = F.array_intersect("w", "words")
    # the first shared word is in both prefixes, so each pair is looked at once
    met = pairs.filter((F.size(shared) >= F.col("overlap")) & (shared[0] == F.col("token")))
    most = F.when(F.instr("paragraph", "\n") > 0, _most("paragraph", "words", "run")).otherwise(F.size(shared))
    matches = met.select(*keys, "label", "overlap", "n", most.alias("shared"))
    enough = F.col("shared") >= F.col("overlap")
    return matches.groupBy(*keys).agg(
        F.collect_set(F.when(enough, F.col("label"))).alias("own"),
        F.max(F.when(enough, F.col("shared") / F.col("n"))).alias("share"),
    )


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8,
    phrases: tuple = PHRASES, templates: tuple = TEMPLATES,
) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row of ``docs``.

    ``n_base`` counts the places where a phrase's words stand one after the other; ``base_labels`` has their
    labels, ``labels`` also those of templates that some line, or some run of words over the lines of a paragraph,
    contains to the ``threshold``. ``score`` is the largest such share of a template's words, 1 for a phrase, 0 for nothing. Null and empty
    texts have no words. Every row is judged by its text alone; rows with equal id and text share
    the same result. Other columns are not read, and texts are not shuffled.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), content.alias("t"))
    keyed = rows.select("id", F.xxhash64("id", "t").alias("r"), F.xxhash64(F.lit(1), "id", "t").alias("s"), "t")
    own = stored(contained(keyed, ["r", "s"], templates, threshold))
    judged = base(keyed, phrases).join(own, ["r", "s"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return judged.select(
        F.col("id").alias(id),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
