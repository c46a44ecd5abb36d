"""Reuse of responses and of unchanged files.

Keys are hashes, so rows spread evenly unless many requests are equal. Equal requests are
reduced before the shuffle where one row per key is wanted. Where every request keeps its row, it is
joined with one row per key; against a stored table adaptive execution splits the requests of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..functions.times import age_seconds

# --- fixed values: key length, age limit, words that keep a response out ---------------------
KEY_CHARS = 500
MAX_AGE_SECONDS = 24 * 3600
NOT_CACHED = ("error", "failed", "rate limit")


def cache_key(text: Column, audit_type: Column, model: Column) -> Column:
    """Requests are the same when type, model and the first 500 characters are."""
    return F.md5(F.concat_ws("_", F.substring(text, 1, KEY_CHARS), audit_type, model))


def newest_admitted(responses: DataFrame, id: str = "response_id") -> DataFrame:
    """``(key, response, ts, id)``: newest response per key, of equal times the greatest id, that is not empty and
    reports no error.

    Keys, times and ids alone are aggregated. A response is then fetched by them, without sorting: it moves through one
    shuffle, dealt by key, time and id, so a hot key is spread. Rows that repeat all three are one."""
    admitted = responses.filter((F.col("response") != "") & ~contains_any(F.lower("response"), NOT_CACHED)).select(
        "key", "response", "ts", F.col(id).alias("id")
    )
    newest = admitted.groupBy("key").agg(F.max(F.struct("ts", "id")).alias("n")).select(
        F.col("key").alias("k"), F.col("n.ts").alias("t"), F.col("n.id").alias("i")
    )
    same = (F.col("key") == F.col("k")) & F.col("ts").eqNullSafe(F.col("t")) & F.col("id").eqNullSafe(F.col("i"))
    found = admitted.join(newest.hint("shuffle_hash"), same, "left_semi")
    return found.dropDuplicates(["key", "ts", "id"])


def cache_admit(responses: DataFrame, id: str = "response_id") -> DataFrame:
    """``(key, response, ts)``: newest response per key that is not empty and reports no error."""
    return newest_admitted(responses, id).select("key", "response", "ts")


def cache_lookup(requests: DataFrame, cache: DataFrame, now_micros: int | Column) -> DataFrame:
    """Requests with ``response`` and ``hit``; an entry of 24 hours or more is no hit. ``cache`` has a row per key;
    store it (``plans.stored``) if it is a result and keys may be hot."""
    fresh = cache.filter(age_seconds(cache, "ts", now_micros) < MAX_AGE_SECONDS).select("key", "response")
    return requests.join(fresh, "key", "left").withColumn("hit", F.col("response").isNotNull())


def cache_misses(requests: DataFrame, cache: DataFrame, now_micros: int | Column) -> DataFrame:
    """Requests that have to be sent. No response takes part in the join."""
    fresh = cache.filter(age_seconds(cache, "ts", now_micros) < MAX_AGE_SECONDS).select("key")
    return requests.join(fresh, "key", "left_anti")


def cache_expire(cache: DataFrame, now_micros: int | Column) -> DataFrame:
    """Entries that stay; one of exactly 24 hours still does."""
    return cache.filter(age_seconds(cache, "ts", now_micros) <= MAX_AGE_SECONDS)


def file_cache_valid(entries: DataFrame, sources: DataFrame, now_micros: int | Column) -> DataFrame:
    """``(key, valid)``: the source, where there is one, is unchanged and the entry is not older than a day.

    ``sources`` is ``(key, content)`` with the present source text. Only keys and hashes are joined; an entry's
    content is left where it is."""
    current = sources.select("key", F.md5("content").alias("current_hash"))
    unchanged = F.coalesce(F.col("source_hash") == F.col("current_hash"), F.col("current_hash").isNull())
    young = age_seconds(entries, "ts", now_micros) <= MAX_AGE_SECONDS
    return (
        entries.select("key", "source_hash", young.alias("young"))
        .join(current, "key", "left")
        .select("key", (unchanged & F.col("young")).alias("valid"))
    )


def dedupe_requests(requests: DataFrame, id: str = "request_id", key: str = "key") -> DataFrame:
    """``(key, id, n_requests, n_reused)``: the request to send per key, and how many use it."""
    return requests.groupBy(key).agg(
        F.min(id).alias(id),
        F.count(F.lit(1)).alias("n_requests"),
        (F.count(F.lit(1)) - 1).alias("n_reused"),
    )


def assign_requests(
    requests: DataFrame, id: str = "request_id", key: str = "key", store: Callable | None = None
) -> DataFrame:
    """Every request with the id of the request that is sent for it.

    ``store`` (such as ``plans.stored`` with its folder) writes the one row per key and reads it back; adaptive
    execution can then split the requests of a hot key."""
    first = requests.groupBy(key).agg(F.min(id).alias("sent_as"))
    joined = requests.select(id, key).join(store(first) if store else first, key)
    return joined.select(id, key, "sent_as", (F.col(id) == F.col("sent_as")).alias("is_call"))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``(name, hash)`` of the files ``(name, content)`` whose content hash differs from the one in
    ``seen (name, hash)``. The content is hashed where it is read and joins nothing."""
    hashed = files.select("name", F.md5("content").alias("hash"))
    return hashed.join(seen.select("name", "hash"), ["name", "hash"], "left_anti")
