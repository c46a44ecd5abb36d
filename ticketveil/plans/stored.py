"""Results that several steps read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and go on with the written table: redaction and parsing are not repeated for each step that
    follows, nor when an executor is lost. ``folder`` is one that all executors see, by default the
    one that ``spark.checkpoint.dir`` names; there is no other default. What has been shuffled for it is dropped when it
    is written, and its texts are packed closely, as they are on disk together with the shuffles of the steps that follow."""
    folder = folder or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
    path = f"{folder.rstrip('/')}/{name}-{uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
