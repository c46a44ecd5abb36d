"""Lines that many documents share are dropped: DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, stored

BLANK = "\t\n\x0b\x0c\r "
#: Frequent lines that may be broadcast: 16 bytes each, so 4 MB at most. More are joined by a shuffle.
BROADCAST_LINES = 250_000


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. ``lower`` does that
    where the line is ASCII."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def drop_common_lines(
    docs: DataFrame, text: str = "text", threshold: int = 10, min_length: int = 1
) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept`` (the text without its common lines) to ``docs``.

    A line whose key has at least ``min_length`` code points and is found in at least ``threshold`` rows
    of ``docs`` is dropped wherever it stands; the others stay in order, joined by a line feed.
    Null and empty texts are one empty line. Each row is a document, repeated rows too. Columns that
    are named like the new ones (in any case) are replaced.

    Lines are counted and joined by 128 bits of hash of their key, rows by 128 bits of hash of all
    their columns; rows that are equal in all of them may share that. Only the last join, by row,
    moves texts. The hashes are stored once, so that texts are normalised once.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    # within, columns have names that none of the others has
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    text = f"c{columns.index(text)}"
    keyed = F.transform(
        _lines(text),
        lambda line: _let(
            line_key(line),
            lambda key: F.when(
                F.length(key) >= min_length,
                F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")),
            ),
        ),
    )
    row, other = _row_id(plain)
    hashed = stored(plain.select(row.alias("__row"), other.alias("__also"), keyed.alias("keys")))
    # array_distinct: a document counts once for a line
    each = hashed.select(F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null")
    common = stored(
        each.groupBy("k.h", "k.g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold).select("h", "g")
    )
    if fits(common, BROADCAST_LINES):
        common = F.broadcast(common)
    places = hashed.select("__row", "__also", F.posexplode("keys").alias("pos", "k")).filter("k is not null")
    dropped = (
        places.select("__row", "__also", "pos", "k.h", "k.g")
        .join(common, ["h", "g"], "left_semi")
        .groupBy("__row", "__also")
        .agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
    )
    numbered = plain.withColumns({"__row": row, "__also": other})
    joined = numbered.join(dropped, ["__row", "__also"], "left")
    return joined.select(
        *plain.columns,
        F.size(_lines(text)).cast("long").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__dropped"),
        F.when(F.col("__gone").isNull(), F.coalesce(F.col(text), F.lit("")))
        .otherwise(_let(_lines(text), lambda lines: F.array_join(_without(lines, F.col("__gone")), "\n")))
        .alias("__kept"),
    ).toDF(*columns, "n_lines", "n_dropped", "kept")


def _row_id(docs: DataFrame) -> tuple[Column, Column]:
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in docs.columns]
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def _without(lines: Column, gone: Column) -> Column:
    """The stretches between the dropped positions, so the work is linear in the lines."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, text: str = "text", threshold: int = 10, min_length: int = 1) -> DataFrame:
    """``docs`` with the common lines taken out of the text, same columns. A document that had text and
    has only blanks left is dropped; documents without a common line stay as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = drop_common_lines(docs.toDF(*names), names[docs.columns.index(text)], threshold, min_length)
    changed = F.col("n_dropped") > 0
    out = found.filter(~changed | (F.btrim(F.col("kept"), F.lit(BLANK)) != ""))
    new = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(
        *(F.when(changed, new[c]).otherwise(F.col(n)).alias(n) if c in new else F.col(n) for n, c in zip(names, docs.columns))
    ).toDF(*docs.columns)
