"""Prompt and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import NOT_SPACE
from .text import clip, let

# --- fixed values: limits per minute, model order, lengths ----------------------------------
MODEL_LIMITS = {
    "gpt-4": (10, 10000),
    "gpt-4o-mini": (500, 200000),
    "gpt-3.5-turbo": (3500, 90000),
    "claude-3-5-sonnet-20241022": (50, 40000),
}
DEFAULT_RPM, DEFAULT_TPM = 10, 8000
CHEAPER = ("gpt-4", "gpt-4o-mini", "gpt-3.5-turbo")
TRUNCATED = "\n\n[...TRUNCATED...]\n\n"
KEEP_SHARE = 0.8
PROCEDURE_CHARS = 2000
LONG_TEXT, SHORT_TEXT = 15000, 5000


def limit_of(model: Column, which: int, limits: dict | None = None) -> Column:
    """Requests (0) or tokens (1) per minute of a model, with the default for other models."""
    table = limits or MODEL_LIMITS
    default = (DEFAULT_RPM, DEFAULT_TPM)[which]
    expr = F.lit(default)
    for name, values in table.items():
        expr = F.when(model == name, values[which]).otherwise(expr)
    return expr


def build_prompt(template: Column, procedures: Column, questions: Column, text: Column) -> Column:
    """Fill the three places of a template, in this order."""
    filled = F.replace(template, F.lit("{{PROCEDURES_SNIPPET}}"), clip(procedures, PROCEDURE_CHARS))
    filled = F.replace(filled, F.lit("{{QUESTION_BLOCKS}}"), questions)
    return F.replace(filled, F.lit("{{INCIDENT_TEXT}}"), text)


def word_count(text: Column) -> Column:
    """Number of white-space separated words: the estimate used without a token column."""
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def truncate_middle(text: Column, max_tokens: Column) -> Column:
    """Keep the first and last half of ``max_tokens`` words when there are more."""

    def cut(words):
        half = F.floor(max_tokens / 2).cast("int")
        tail = F.when(half == 0, words).otherwise(
            F.slice(words, F.greatest(F.size(words) - half, F.lit(0)) + 1, F.greatest(half, F.lit(1)))
        )
        return F.concat(
            F.array_join(F.slice(words, 1, half), " "), F.lit(TRUNCATED), F.array_join(tail, " ")
        )

    words = F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) <= max_tokens, text).otherwise(cut(w)))


def suggest_cheaper_model(model: Column) -> Column:
    expr = F.lit(CHEAPER[1])
    for current, following in zip(CHEAPER, CHEAPER[1:], strict=False):
        expr = F.when(model == current, following).otherwise(expr)
    return expr


def route_by_length(length: Column, model: Column) -> Column:
    return (
        F.when((length > LONG_TEXT) & (model == "gpt-4o-mini"), "gpt-4")
        .when((length < SHORT_TEXT) & (model == "gpt-4"), "gpt-4o-mini")
        .otherwise(model)
    )
