"""Reuse of responses over streams of requests and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import epoch_micros
from ..operators.reuse import MAX_AGE_SECONDS
from ..sources.cache import _day, _days, merge_cache


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_first_requests(
    requests: DataFrame, sent: str, checkpoint: str, ts: str = "ts", key: str = "key", id: str = "request_id", once: bool = False
) -> StreamingQuery:
    """Append to the table ``sent`` (``key, ts, id``, by day and trigger) the requests of a stream that have to be sent: of each
    key the first one of a trigger by time and id, unless one was sent by an earlier trigger less than 24 hours before it,
    or after it. Requests of one trigger share a response, whatever lies between them.

    The sent table is the state; a trigger reads the days that can still count. What a trigger writes depends on the requests
    alone and takes the place of what it wrote before, so a restart repeats nothing. Null keys are equal to each other;
    requests without a time are left out. One stream per table."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"{key} {kinds[key]}, {ts} {kinds[ts]}, {id} {kinds[id]}, day string, trigger long"

    def send(batch: DataFrame, number: int) -> None:
        timed = batch.filter(F.col(ts).isNotNull())
        first = timed.groupBy(key).agg(F.min(F.struct(ts, id)).alias("f")).select(key, f"f.{ts}", f"f.{id}")
        first = first.withColumn("day", _day(first, ts)).withColumn("trigger", F.lit(number).cast("long"))
        since = first.agg(F.date_sub(F.min(F.col("day").cast("date")), 1).cast("string")).first()[0]
        if since is None:
            return
        if _days(batch.sparkSession, sent):
            before = batch.sparkSession.read.schema(schema).parquet(sent)
            before = before.filter((F.col("day") >= since) & (F.col("trigger") < number))
            newest = before.groupBy(F.col(key).alias("__key")).agg(F.max(epoch_micros(before, ts)).alias("__at"))
            age = epoch_micros(first, ts) - F.col("__at")
            first = first.join(newest, F.col(key).eqNullSafe(F.col("__key")), "left")
            first = first.filter(F.col("__at").isNull() | (age >= MAX_AGE_SECONDS * 1_000_000)).drop("__key", "__at")
        first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "trigger").parquet(sent)

    return _start(requests.writeStream.foreachBatch(send), checkpoint, once)


def start_cache(
    responses: DataFrame,
    path: str,
    checkpoint: str,
    now_micros: Callable[[], int],
    id: str = "response_id",
    once: bool = False,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Merge a stream of responses ``(key, response, ts, id)`` into the cache that is kept by day in ``path``.

    The kept table is the state: after each trigger it is what ``cache_admit`` and ``cache_expire`` make of all responses so
    far. A merge can be repeated, so a trigger that is run again after a restart changes nothing. ``now_micros`` is asked for the time
    of each trigger. One stream per table."""

    def merge(batch: DataFrame, _: int) -> None:
        merge_cache(batch, path, now_micros(), id, store)

    return _start(responses.writeStream.foreachBatch(merge), checkpoint, once)
