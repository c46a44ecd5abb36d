"""Points in time as numbers, the same in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without zone counts as UTC."""
    ts = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = (
            F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
        )
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_micros(ts)


def age_seconds(df: DataFrame, name: str, now_micros: int | Column) -> Column:
    return (now_micros - epoch_micros(df, name)) / 1_000_000


def from_micros(df: DataFrame, name: str, micros: Column) -> Column:
    """Inverse of ``epoch_micros``, in the type that column ``name`` of ``df`` has."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.timestamp_micros(micros)
