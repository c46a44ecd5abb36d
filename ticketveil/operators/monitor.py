"""Statistics on calls and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from .rows import numbered_rows


def performance_summary(calls: DataFrame) -> DataFrame:
    """Per function: counts, durations of successful calls, success rate. A function without a
    successful call is left out. Durations are summed as decimals to 1e-9, so the average does not
    depend on the order of the rows; those of 1e19 and more, infinite or NaN are added as doubles."""
    ok = F.col("success")
    n, good = F.count(F.lit(1)), F.count_if(ok)
    exact = F.when(ok, F.col("duration").try_cast("decimal(28,9)"))
    huge = F.when(ok & F.col("duration").try_cast("decimal(28,9)").isNull(), F.col("duration"))
    total = F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(huge), F.lit(0.0))
    return (
        calls.groupBy("function_name")
        .agg(
            n.alias("total_calls"),
            good.alias("successful_calls"),
            (n - good).alias("failed_calls"),
            F.when(F.count(F.when(ok, F.col("duration"))) > 0, total / good).alias("avg_duration"),
            F.max(F.when(ok, F.col("duration"))).alias("max_duration"),
            F.min(F.when(ok, F.col("duration"))).alias("min_duration"),
            (good / n * 100).alias("success_rate"),
        )
        .filter("successful_calls > 0")
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    """Add ``error_type`` and ``suggested_action`` to ``(message, model, ...)``."""
    return errors.withColumn("error_type", E.classify_error(F.col("message"))).withColumn(
        "suggested_action",
        E.suggest_action(F.col("error_type"), F.col("message"), F.col("model")),
    )


def error_history(errors: DataFrame) -> DataFrame:
    """Errors per function and class with the first and last time.

    The single entries are the rows of ``classify_errors`` ordered by function and time; they are
    not gathered into one list per function, which would grow without bound.
    """
    return (
        classify_errors(errors)
        .groupBy("function_name", "error_type")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def retry_schedule(errors: DataFrame, retries: int = 2, delay: float = 1.0) -> DataFrame:
    """One row per error and retry: ``attempt`` from 0 and ``wait_seconds``."""
    typed = errors.withColumn("error_type", E.classify_error(F.col("message")))
    waits = E.retry_waits(F.col("error_type"), retries, delay)
    return numbered_rows(typed, ["*"], waits, "attempt", "wait_seconds")
