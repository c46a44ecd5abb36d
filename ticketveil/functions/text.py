"""Text helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LINE_BREAK, RARE_LINE_BREAKS, SPACES, Part


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove white space (Unicode) at both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def line_array(text: Column) -> Column:
    """Lines of a text; a final line break ends the last line instead of opening a new one.

    Every kind of line break counts. Splitting on the line feed alone is quick, so the others
    are turned into line feeds first in the texts that have them.
    """
    feeds = F.when(
        contains_any(text, RARE_LINE_BREAKS), F.regexp_replace(text, LINE_BREAK, "\n")
    ).otherwise(text)
    return let(
        F.split(feeds, "\n", -1),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


def clip(text: Column, n: int) -> Column:
    """First ``n`` characters, with ``...`` when something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def contains_any(text: Column, literals) -> Column:
    hit = F.lit(False)
    for literal in literals:
        hit = hit | text.contains(literal)
    return hit


def may_match(text: Column, hint: str | Part) -> Column:
    """Cheap necessary condition for a match: a literal, or a simpler pattern."""
    return text.contains(hint) if isinstance(hint, str) else text.rlike(hint.pattern)
