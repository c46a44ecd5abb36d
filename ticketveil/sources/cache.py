"""The response cache as a table that is kept between runs, partitioned by day.

Entries live for 24 hours, so a merge reads and writes the partitions of two or three days, however long the table
has been kept. Expiry drops whole partitions; entries of the day that has partly expired are left out when they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_micros
from ..operators.reuse import MAX_AGE_SECONDS, cache_expire, newest_admitted

DAY_MICROS = 86_400_000_000


def _day(df: DataFrame, ts: str = "ts") -> Column:
    """Day of the entry in UTC, as text."""
    return F.date_from_unix_date(F.floor(epoch_micros(df, ts) / DAY_MICROS).cast("int")).cast("string")


def _oldest_day(now_micros: int) -> str:
    """The first day with an entry that is not expired."""
    start = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=now_micros) - timedelta(seconds=MAX_AGE_SECONDS)
    return start.strftime("%Y-%m-%d")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm.org.apache.hadoop.fs.Path


def _days(spark: SparkSession, path: str) -> list[str]:
    """The days that the table has partitions for."""
    fs, folder, _ = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removeprefix("day=") for n in names if n.startswith("day="))


def _drop_days(spark: SparkSession, path: str, days) -> None:
    fs, _, to_path = _folder(spark, path)
    for day in days:
        fs.delete(to_path(f"{path}/day={day}"), True)


def _read(spark: SparkSession, path: str, schema: str, since: str) -> DataFrame:
    return spark.read.schema(f"{schema}, day string").parquet(path).filter(F.col("day") >= since)


def read_cache(spark: SparkSession, path: str, now_micros: int, ts: str = "timestamp", id: str = "long") -> DataFrame:
    """``(key, response, ts)`` of the entries that are not expired, one for each key: what ``cache_lookup`` takes. Only
    the partitions of days with such entries are read. ``ts`` and ``id`` are the types of these columns."""
    schema = f"key string, response string, ts {ts}, id {id}"
    if not _days(spark, path):
        return spark.createDataFrame([], schema).drop("id")
    entries = _read(spark, path, schema, _oldest_day(now_micros))
    return cache_expire(entries, now_micros).select("key", "response", "ts")


def expire_cache(spark: SparkSession, path: str, now_micros: int) -> list[str]:
    """Drop the partitions of which all entries are expired; returns their days."""
    gone = [day for day in _days(spark, path) if day < _oldest_day(now_micros)]
    _drop_days(spark, path, gone)
    return gone


def merge_cache(
    responses: DataFrame,
    path: str,
    now_micros: int,
    id: str = "response_id",
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Admit responses to the table: the newest one of each key stays, among those kept and those that come. Returns the
    days that were written.

    Expired partitions are dropped first. Then only days that lose or gain an entry are written anew, each replaced as a
    whole when the job ends, so a merge can be repeated. Which days these are is found from keys, times and ids, without
    responses. ``store`` writes the admitted responses once, as they are read in three steps. One merge at a time."""
    spark = responses.sparkSession
    expire_cache(spark, path, now_micros)
    admitted = cache_expire(newest_admitted(responses, id), now_micros)
    admitted = admitted.withColumn("day", _day(admitted))
    admitted = store(admitted) if store else admitted
    writer = {"partitionOverwriteMode": "dynamic"}
    if not _days(spark, path):
        admitted.write.mode("overwrite").options(**writer).partitionBy("day").parquet(path)
        return _days(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in admitted.schema}
    kept = _read(spark, path, f"key string, response string, ts {kinds['ts']}, id {kinds['id']}", _oldest_day(now_micros))
    mine = admitted.select("key", F.struct("ts", "id").alias("new"), F.col("day").alias("new_day"))
    theirs = kept.select("key", F.struct("ts", "id").alias("old"), F.col("day").alias("old_day"))
    met = mine.join(theirs, "key", "full").select(
        "key", "old_day", "new_day", F.coalesce(F.col("new") >= F.col("old"), F.col("old").isNull()).alias("wins")
    )
    touched = F.explode(F.array_compact(F.array("old_day", "new_day")))
    days = [r.day for r in met.filter("wins").select(touched.alias("day")).distinct().collect()]
    beaten = met.filter("wins and old_day is not null").select("key")
    late = met.filter("not wins and new_day is not null").select("key")
    stay = kept.filter(F.col("day").isin(days)).join(beaten, "key", "left_anti")
    rows = stay.unionByName(admitted.join(late, "key", "left_anti"))
    if days:
        left = {r.day for r in rows.select("day").distinct().collect()}
        rows.write.mode("overwrite").options(**writer).partitionBy("day").parquet(path)
        _drop_days(spark, path, set(days) - left)  # days without entries, which nothing has replaced
    return sorted(days)
