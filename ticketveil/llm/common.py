"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lower-cased; every ASCII byte that is no digit or letter becomes a space.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return text.translate(_WORDS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of ``words(text)``."""
    flat, at, spans = text.translate(_WORDS), 0, []
    for word in flat.split():
        at = flat.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    return spans


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty; Python then need not decode it."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets its own; a
    cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: its lineage ends there,
    so nothing is computed again when executors are lost or when several steps read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether the stored table has at most so many rows, for broadcasts of a checked size."""
    return df.limit(most_rows + 1).count() <= most_rows
