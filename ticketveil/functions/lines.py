"""Line and markup normalisation as column expressions.

A document is one row, so neighbouring lines are neighbouring array elements: nothing is
exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let, line_array, strip


def is_label(stripped: Column) -> Column:
    return stripped.rlike(P.LABEL_LINE)


def is_table_row(stripped: Column) -> Column:
    return stripped.rlike(P.TABLE_ROW_LINE)


def _starts_with(line: Column, pattern: str) -> Column:
    """Whether the line without white space at its ends begins with ``pattern``, which no empty text matches. A match
    at the first place is always there, so a search ends with it, and white space need not be cut off."""
    return F.regexp_extract(line, rf"\A{P.SPACE}*+({pattern.removeprefix('^')}|)", 1) != ""


def join_wrapped_lines(text: Column) -> Column:
    """Append continuation lines to the line before, with one space.

    A line opens a new output line when it is the first one, is blank, starts like a label, or
    follows a blank line. A label that also looks like a table row gets an empty line before
    it unless there is one already.
    """
    # a label has no body here, as only other lines are blank or appended
    rows = F.transform(
        line_array(text),
        lambda line: F.struct(line.alias("raw"), F.when(~_starts_with(line, P.LABEL_LINE), strip(line)).alias("body")),
    )

    def piece(all_rows: Column):
        def render(row: Column, i: Column) -> Column:
            raw, body = row["raw"], row["body"]
            after_text = F.coalesce(F.get(all_rows, i - 1)["body"] != "", F.lit(True))
            return (
                F.when(i == 0, raw)
                .when(body.isNotNull() & (body != "") & after_text, F.concat(F.lit(" "), body))
                .when(body.isNull() & after_text & _starts_with(raw, P.TABLE_ROW_LINE), F.concat(F.lit("\n\n"), raw))
                .otherwise(F.concat(F.lit("\n"), raw))
            )

        return render

    return let(rows, lambda r: F.array_join(F.transform(r, piece(r)), ""))


def field_group_breaks(joined: Column, last: Column | None = None) -> Column:
    """Empty line after each line that starts with one of the listed labels, unless the next
    line is blank. Where ``last`` is false more text follows, and the last line is left as it is."""
    line = rf"(?md)^({P.INLINE_SPACE}*(?:{P.any_of(P.BREAK_AFTER_LABELS)})[^\n]*)"
    before = rf"\n{P.INLINE_SPACE}*{P.NOT_SPACE}"
    whole = F.regexp_replace(joined, rf"{line}(?={before}|\z)", "$1\n")
    if last is None:
        return whole
    return F.when(last, whole).otherwise(F.regexp_replace(joined, rf"{line}(?={before})", "$1\n"))


def _rewrite(text: Column, hint: str, pattern: str, replacement: str) -> Column:
    """Replace ``pattern``, skipping the regex where ``hint`` (part of every match) is absent."""
    return let(
        text,
        lambda t: F.when(t.contains(hint), F.regexp_replace(t, pattern, replacement)).otherwise(t),
    )


def clean_markup(text: Column) -> Column:
    """Remove code and bold tags, turn line-break tags into line breaks."""
    text = _rewrite(text, "code]", P.CODE_TAG, "")
    text = _rewrite(text, "b>", P.BOLD_TAG, "")
    return _rewrite(text, "<", P.BREAK_TAG, "\n")


#: What the text before the colon of a label ends with.
_LABEL_ENDS = tuple(sorted({label[-4:-1] for label in P.FIELD_LABELS}))


def _before_colons(text: Column, rewrite: Callable[[Column, Column], Column]) -> Column:
    """``rewrite(piece, place)`` of the text between two colons, where its end may be a label's.

    Neither a label nor a value before it has a colon but the label's last character, so a piece is judged by itself, and
    the few pieces that end like a label are all that is searched."""
    pieces = F.split(text, ":", -1)
    return F.when(
        text.contains(":"),
        let(
            pieces,
            lambda p: F.array_join(
                F.transform(
                    p,
                    # the last piece has no colon behind it
                    lambda piece, i: F.when(
                        F.substring(piece, -3, 3).isin(*_LABEL_ENDS) & (i < F.size(p) - 1), rewrite(piece, i)
                    ).otherwise(piece),
                ),
                ":",
            ),
        ),
    ).otherwise(text)


def _break_before_label(piece: Column) -> Column:
    """The search starts at white space between a word character and a capital, which is rare;
    only there are the word before and the label after looked at."""
    word = rf"(?<={P.NO_WORD_BEFORE}(?i:{P.any_of(P.BREAK_WORDS)}){P.SPACE})"
    labels = P.any_of(label.removesuffix(":") for label in P.FIELD_LABELS)
    pattern = rf"(?!\w){P.SPACE}(?<={P.WORD}{P.SPACE})(?={P.SPACE}*[A-Z]){word}{P.SPACE}*({labels})\z"
    return F.regexp_replace(piece, pattern, "\n$1")


def break_before_labels(text: Column) -> Column:
    """Line break between one of a few common words and a known field label."""
    return let(text, lambda t: _before_colons(t, lambda piece, i: _break_before_label(piece)))


def _ends_with_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.endswith(w) for w in words))


def _ends_with_rating(text: Column) -> Column:
    """A number, a dash and a rating, with or without white space around the dash."""
    spaces = F.lit(P.SPACES)
    found = F.lit(False)
    for word in P.RATINGS:
        left = F.rtrim(F.substr(text, F.lit(1), F.length(text) - len(word)), spaces)
        number = F.rtrim(F.substr(left, F.lit(1), F.length(left) - 1), spaces)
        found = found | (text.endswith(word) & left.endswith("-") & F.right(number, F.lit(1)).rlike(P.DIGIT))
    return found


def _ends_with_pair(text: Column) -> Column:
    """Two capitalised words with one space between them."""
    return F.substring_index(text, " ", -2).rlike(r"[A-Z][a-z]+ [A-Z][a-z]+\z")


#: Whether the text before a label, without white space at its end, ends with a value of that kind.
_VALUE_ENDS = {
    "rating": lambda t: _ends_with_any(t, P.RATINGS),
    "company": lambda t: t.endswith(P.CLOSED_VALUE),
    "numbered rating": _ends_with_rating,
    "engineer or pair": lambda t: t.endswith(P.ENGINEER) | _ends_with_pair(t),
    "truth": lambda t: _ends_with_any(t, P.TRUTHS),
    "network or pair": lambda t: t.endswith(P.NETWORK) | _ends_with_pair(t),
}


def _break_value(piece: Column, i: Column, open_value: Column | None) -> Column:
    """The white space before a label at the end of the piece becomes a line break where a value of its kind stands before it.

    All values end with something else than white space but the open one, which takes up to the next colon whatever
    there is, so the last space alone is its own. No label ends with another."""

    def broken(before: Column, bare: Column, kind: str, name: str) -> Column:
        whole = F.when(_VALUE_ENDS[kind](bare), F.concat(bare, F.lit(f"\n{name}"))).otherwise(piece)
        if kind == "company":
            opened = before.contains(P.OPEN_VALUE)
            if open_value is not None:
                opened = opened | (open_value & (i == 0))
            cut = F.concat(F.substr(before, F.lit(1), F.length(before) - 1), F.lit(f"\n{name}"))
            whole = F.when(opened, cut).otherwise(whole)
        return F.when(F.octet_length(bare) < F.octet_length(before), whole).otherwise(piece)

    def judged(kind: str, name: str) -> Column:
        before = F.substr(piece, F.lit(1), F.length(piece) - len(name))
        return let(before, lambda b: let(F.rtrim(b, F.lit(P.SPACES)), lambda bare: broken(b, bare, kind, name)))

    found = piece
    for kind, label in P.VALUE_LABEL_RULES:
        name = label.removesuffix(":")
        found = F.when(piece.endswith(name), judged(kind, name)).otherwise(found)
    return found


def break_value_label(text: Column, open_value: Column | None = None) -> Column:
    """Line break between some known values and the label that follows.

    One of the values reaches up to the next colon. ``open_value`` tells, for a text that is the continuation of
    another, that this value stands in the other one after its last colon."""
    return let(text, lambda t: _before_colons(t, lambda piece, i: _break_value(piece, i, open_value)))


def break_labels(text: Column, open_value: Column | None = None) -> Column:
    """``break_value_label`` of ``break_before_labels``, in one pass over the pieces between colons."""

    def both(piece: Column, i: Column) -> Column:
        return let(_break_before_label(piece), lambda b: _break_value(b, i, open_value))

    return let(text, lambda t: _before_colons(t, both))


def normalize_text(text: Column) -> Column:
    """Line joining, group breaks and markup removal, in that order."""
    return clean_markup(field_group_breaks(join_wrapped_lines(text)))
