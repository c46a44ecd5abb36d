"""Normalisation and redaction of documents that are too long for a row.

Such a document is a table of parts ``(doc, part, text)`` with whole part numbers from 0 on, in any number of rows. The
parts are cut at any place, within a word too. They are first put together to segments, which begin and end where
neither line joining nor a redaction rule reaches from one side to the other: a part keeps what lies behind its first
such place and gives the rest to the segment before. A segment grows over parts without such a place, so it is a
part long as a rule, and the longest stretch without one has to fit in a row. The row expressions then work on segments, and
the little that one segment has to know of those before is handed on in rows of flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import parts as C
from ..functions import patterns as P
from ..functions.redaction import DEFAULT_TERMS, PreserveTerms, redact
from ..functions.text import strip
from .redaction import STATS

#: Part numbers whose flags are read in one group.
BLOCK = 1024
#: Segment of the text before the first cut of a document.
FIRST = -1


def previous(rows: DataFrame, doc: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """``(doc, order, value, previous)``: of the rows before each one in its document, the last value that is not null.

    Values are carried within blocks of order numbers, then from block to block, so that no group holds the rows of a
    whole document."""
    # dealt once for the blocks' last values and for the rows before each one, so that ``value`` is made once; the join
    # below leaves out null keys, and would do so in one of the two only
    numbered = rows.select(doc, order, value, F.floor(F.col(order) / block).alias("__block"))
    numbered = numbered.filter(F.col(doc).isNotNull() & F.col("__block").isNotNull()).repartition(doc, "__block")
    here = Window.partitionBy(doc, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    ends = numbered.groupBy(doc, "__block").agg(F.max_by(value, known).alias("__end"))
    across = Window.partitionBy(doc).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(doc, "__block", F.last("__end", True).over(across).alias("__before"))
    carried = numbered.withColumn("__here", F.last(value, True).over(here)).join(before, [doc, "__block"])
    return carried.select(doc, order, value, F.coalesce("__here", "__before").alias("previous"))


def segments(parts: DataFrame, cut: str, doc: str, part: str, text: str, sep: str = "") -> DataFrame:
    """``(doc, segment, text)``: the parts' text, in which ``sep`` stands between those that are not empty, cut at
    places of the pattern ``cut``, which are behind a line feed. Each segment is named by the part that it begins in, the first by ``FIRST``."""
    plain = parts.select(doc, F.col(part).cast("long").alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if sep:
        later = F.when(F.col("t") != "", F.lit(True))
        seen = previous(plain.select(doc, "part", later.alias("some")), doc, "part", "some").select(doc, "part", "previous")
        glue = F.when((F.col("t") != "") & F.col("previous"), F.lit(sep)).otherwise(F.lit(""))
        plain = plain.join(seen, [doc, "part"]).select(doc, "part", F.concat(glue, F.col("t")).alias("t"))
    # the text up to the first cut, which stands behind a line feed; empty without one. ``split`` would compile the
    # pattern for each text
    head = F.regexp_extract("t", rf"\A((?s:.*?)\n){cut}", 1)
    opens = plain.select(doc, "part", F.when(head != "", F.col("part")).alias("opens"))
    owner = previous(opens, doc, "part", "opens").select(doc, "part", F.coalesce("previous", F.lit(FIRST)).alias("segment"))
    parted = plain.select(doc, "part", "t", head.alias("head"))
    piece = F.when(F.col("head") != "", F.col("head")).otherwise(F.col("t"))
    heads = parted.select(doc, "part", piece.alias("piece")).join(owner, [doc, "part"])
    rest = F.substr(F.col("t"), F.length("head") + 1)
    bodies = parted.filter(F.col("head") != "").select(doc, "part", rest.alias("piece"), F.col("part").alias("segment"))
    pieces = heads.select(bodies.columns).unionAll(bodies)
    # a body stands before the heads of later parts
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece")))
    return pieces.groupBy(doc, "segment").agg(F.array_join(F.transform(ordered, lambda s: s["piece"]), "").alias("text"))


def normalize_parts(
    parts: DataFrame, doc: str = "doc_id", part: str = "part", text: str = "text", sep: str = "", store=None
) -> DataFrame:
    """``(doc, part, text)`` whose texts, one after the other, are ``normalize_document`` of the whole text.

    A segment opens an output line, so joining stays within it. What it has to know of the one before is whether that
    ended with a blank line or with a listed label, which decides on the empty line between them. ``store`` (such as
    ``plans.stored`` with its folder) writes the joined segments once, as they are read for the flags and for the text.
    """
    first_line, last_line = F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)
    body = strip(F.regexp_extract(first_line, r"^[^\r\n\x0B\f\x1c-\x1e\x85\u2028\u2029]*", 0))
    labels = P.any_of(P.BREAK_AFTER_LABELS)
    ended = F.when(last_line.rlike(rf"\A{P.INLINE_SPACE}*\z"), "blank").when(
        last_line.rlike(rf"\A{P.INLINE_SPACE}*(?:{labels})"), "listed"
    )
    joined = segments(parts, C.LINE_CUT, doc, part, text, sep).select(
        doc,
        "segment",
        L.join_wrapped_lines(F.col("text")).alias("text"),
        (L.is_label(body) & L.is_table_row(body)).alias("row_label"),
    )
    joined = store(joined) if store else joined
    flags = joined.select(doc, "segment", F.coalesce(ended, F.lit("other")).alias("ended"))
    before = previous(flags, doc, "segment", "ended").select(doc, "segment", "previous")
    last = flags.groupBy(doc).agg(F.max("segment").alias("last_segment"))
    context = before.join(last, doc).select(doc, "segment", "previous", (F.col("segment") == F.col("last_segment")).alias("last"))
    apart = (F.col("previous") == "listed") | ((F.col("previous") == "other") & F.col("row_label"))
    glue = F.when(F.col("previous").isNull(), "").when(apart, "\n\n").otherwise("\n")
    broken = L.clean_markup(L.field_group_breaks(F.col("text"), F.col("last")))
    return joined.join(context, [doc, "segment"]).select(
        doc, (F.col("segment") + 1).alias("part"), F.concat(glue, broken).alias("text")
    )


def redact_parts(
    parts: DataFrame,
    doc: str = "doc_id",
    part: str = "part",
    text: str = "text",
    sep: str = "",
    terms: PreserveTerms = DEFAULT_TERMS,
) -> DataFrame:
    """``(doc, part, redacted_text, stats)`` whose texts, one after the other, are what ``redact_documents`` makes of the
    whole text, and whose counts have its counts for sum (``part_stats``).

    A match belongs to the segment that it starts in, as none reaches over the end. One value of the label breaks holds for any
    text up to the next colon; whether it is open is handed on from segment to segment.
    """
    cut = segments(parts, C.REDACTION_CUT, doc, part, text, sep)
    tail = F.substring_index("text", ":", -1)
    opened = tail.contains(P.OPEN_VALUE)
    flags = cut.select(doc, "segment", F.when(F.col("text").contains(":") | opened, opened).alias("opened"))
    before = previous(flags, doc, "segment", "opened").select(doc, "segment", F.coalesce("previous", F.lit(False)).alias("open"))
    redacted = redact(F.col("text"), terms, open_value=F.col("open"))
    return (
        cut.join(before, [doc, "segment"])
        .select(doc, (F.col("segment") + 1).alias("part"), redacted.alias("redacted"))
        .select(doc, "part", "redacted.redacted_text", "redacted.stats")
    )


def part_stats(redacted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts per document of ``redact_parts``."""
    return redacted.groupBy(doc).agg(*(F.sum(F.col("stats")[k]).alias(k) for k in STATS))


def cut_text(df: DataFrame, size: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, part, text)``: texts in parts of ``size`` characters. A text without characters is one part."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    pieces: Column = F.transform(starts, lambda a: F.substr(F.col(text), a + 1, F.lit(size)))
    return df.select(doc, F.posexplode(F.coalesce(pieces, F.array(F.lit("")))).alias("part", "text"))
