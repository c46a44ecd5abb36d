"""Error classes and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# --- fixed values: class and the texts that tell it, in the order they are tried ----------
ERROR_TERMS = (
    ("rate_limit", ("rate limit", "too many requests", "429")),
    ("token_limit", ("token", "context length", "too large")),
    ("api_error", ("api", "400", "401", "403", "500")),
    ("file_error", ("file not found", "permission denied")),
    ("network_error", ("connection", "timeout", "network")),
)
OTHER_ERROR = "validation_error"
NOT_RETRIED = ("validation_error", "file_error")
RATE_GPT4 = "Switch to gpt-4o-mini for higher rate limits"
RATE_GPT = "Wait 60 seconds and retry, or switch to gpt-3.5-turbo"
RATE_REST = "Wait 60 seconds before retrying"
TOKEN_ACTION = "Reduce input text size or switch to a model with larger context window"
API_401, API_403 = "Check API key configuration", "Verify API permissions and quota"
API_REST = "Check API service status and retry"
FILE_MISSING = "Check file path and ensure file exists"
FILE_REST = "Verify file permissions and disk space"
NETWORK_ACTION = "Check internet connection and retry"


def classify_error(message: Column) -> Column:
    lowered = F.lower(message)
    expr = F.lit(OTHER_ERROR)
    for name, terms in reversed(ERROR_TERMS):
        expr = F.when(contains_any(lowered, terms), name).otherwise(expr)
    return expr


def suggest_action(error_type: Column, message: Column, model: Column) -> Column:
    """Advice per class; null for validation errors."""
    model = F.coalesce(model, F.lit("unknown"))
    return (
        F.when(
            error_type == "rate_limit",
            F.when(model == "gpt-4", RATE_GPT4)
            .when(model.contains("gpt"), RATE_GPT)
            .otherwise(RATE_REST),
        )
        .when(error_type == "token_limit", TOKEN_ACTION)
        .when(
            error_type == "api_error",
            F.when(message.contains("401"), API_401)
            .when(message.contains("403"), API_403)
            .otherwise(API_REST),
        )
        .when(
            error_type == "file_error",
            F.when(F.lower(message).contains("not found"), FILE_MISSING).otherwise(FILE_REST),
        )
        .when(error_type == "network_error", NETWORK_ACTION)
    )


def retry_waits(error_type: Column, retries: int, delay: float) -> Column:
    """Seconds to wait before each retry; empty for errors that are not retried."""
    waits = F.array(*(F.lit(float(delay * 2**i)) for i in range(retries)))
    none = F.array().cast("array<double>")
    return F.when(error_type.isin(*NOT_RETRIED), none).otherwise(waits.cast("array<double>"))
