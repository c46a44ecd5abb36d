"""Redaction keeps no state, so a stream goes through the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.redaction import DEFAULT_TERMS, PreserveTerms
from ..operators.redaction import redact_documents


def redact_stream(
    docs: DataFrame, terms: PreserveTerms = DEFAULT_TERMS, normalize: bool = False
) -> DataFrame:
    """``(doc_id, redacted_text, stats)`` of a streaming ``(doc_id, text)``."""
    return redact_documents(docs, terms=terms, normalize=normalize)


def start_redaction(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    schema: str = "doc_id long, text string",
    files_per_trigger: int = 1000,
    once: bool = False,
) -> StreamingQuery:
    """Redact parquet files as they arrive in ``source`` and append the results to ``sink``.

    File source, file sink and ``checkpoint``, a folder of this stream's own that all executors share, make the
    result exactly once through restarts. ``once`` works off what is there and stops.
    """
    docs = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
    )
    writer = (
        redact_stream(docs)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
