"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(df: DataFrame, keys: list, items: Column, never_null: str) -> DataFrame:
    """One row per struct in ``items``.

    For a plain ``inline`` the optimizer adds a filter on the size of the array below it, and
    with that evaluates the array twice. The outer form keeps documents without items, which
    are then dropped by a field that is never null.
    """
    return df.select(*keys, F.inline_outer(items)).filter(F.col(never_null).isNotNull())


def numbered_rows(df: DataFrame, keys: list, items: Column, number: str, item: str) -> DataFrame:
    """One row per element of ``items`` with its position from 0."""
    return df.select(*keys, F.posexplode_outer(items).alias(number, item)).filter(
        F.col(number).isNotNull()
    )
