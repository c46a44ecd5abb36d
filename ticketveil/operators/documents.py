"""Documents out of pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .assemble import joined_in_order

NO_TEXT = "No text could be extracted from PDF"


def assemble_pages(
    pages: DataFrame,
    doc: str = "doc_id",
    page_no: str = "page_no",
    text: str = "text",
    max_pages: int | None = None,
    pages_per_part: int | None = None,
) -> DataFrame:
    """``(doc, text)``: non-empty pages in order, one per line.

    ``max_pages`` takes the first pages of a document, empty ones included. A document becomes
    one row, so it has to fit in one. For documents that do not, ``pages_per_part`` gives
    ``(doc, part, text)`` with a fixed number of page numbers per part, and a document of any
    length is then spread over many groups.
    """
    if max_pages:
        first = Window.partitionBy(doc).orderBy(page_no)
        pages = (
            pages.withColumn("__rank", F.row_number().over(first))
            .filter(F.col("__rank") <= max_pages)
            .drop("__rank")
        )
    if pages_per_part is None:
        return joined_in_order(pages, doc, page_no, text, "\n").drop("n")
    keyed = pages.withColumn(
        "__key", F.struct(doc, F.floor(F.col(page_no) / pages_per_part).alias("part"))
    )
    return joined_in_order(keyed, "__key", page_no, text, "\n").select("__key.*", text)


def no_text_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``status`` and ``error_message``; split with a filter on ``status``."""
    empty = F.col(text).isNull() | (strip(F.col(text)) == "")
    return df.withColumn("status", F.when(empty, "error").otherwise("processing")).withColumn(
        "error_message", F.when(empty, NO_TEXT).otherwise("")
    )


def conversation_export(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    now: str | None = None,
    turns_per_part: int | None = None,
) -> DataFrame:
    """``(conversation, n_turns, text_length, export)`` with the turns in order as JSON.

    Like a document, a conversation becomes one row; with ``turns_per_part`` it becomes one row
    per range of turn numbers.
    """
    keys = [F.col(conversation)]
    if turns_per_part is not None:
        keys.append(F.floor(F.col(turn) / turns_per_part).alias("part"))
    item = F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")
    )
    length = F.coalesce(F.sum(F.length(text)), F.lit(0))
    names = [conversation] + (["part"] if turns_per_part is not None else [])
    messages = F.transform(
        F.col("items"), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))
    )
    return (
        turns.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("items"), length.alias("text_length"))
        .select(
            *names,
            F.size("items").alias("n_turns"),
            "text_length",
            F.to_json(
                F.struct(
                    *([F.lit(now).alias("timestamp")] if now else []),
                    messages.alias("conversation"),
                    F.col("text_length").alias("original_text_length"),
                ),
                {"ignoreNullFields": "false"},  # a turn without a text keeps its content, null
            ).alias("export"),
        )
    )
