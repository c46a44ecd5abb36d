"""One text per key out of ordered pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(items: Column) -> Column:
    """Array of the texts of ``(order, text)`` structs, by order and without empty ones."""
    return F.filter(
        F.transform(F.array_sort(items), lambda s: s["text"]),
        lambda t: t.isNotNull() & (t != ""),
    )


def joined_in_order(df: DataFrame, key: str, order: str, text: str, sep: str) -> DataFrame:
    """``(key, text, n)``: the non-empty texts of a key, by ``order``, and their number.

    A key without any text keeps its row, with an empty one.
    """
    pieces = F.collect_list(F.struct(F.col(order).alias("order"), F.col(text).alias("text")))
    return df.groupBy(key).agg(ordered(pieces).alias("pieces")).select(
        key, F.array_join("pieces", sep).alias(text), F.size("pieces").alias("n")
    )
