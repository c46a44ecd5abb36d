"""A training-data pipeline: documents without toxic ones, shared lines, near copies and benchmark passages, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ticketveil.llm import bpe, decontaminate, linededup, simhash, toxicity
from ticketveil.llm.common import stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity grammar rejects."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that ten or more documents share; documents of nothing else go."""
    return linededup.dedup_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of benchmark items; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", unique_lines),
    ("simhash_near_dedup", unique_documents),
    ("benchmark_decontamination", uncontaminated),
    ("byte_bpe", tokens),
]

#: A learned grammar, similarity links and merges are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
