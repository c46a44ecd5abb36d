import random

from pyspark.sql import functions as F

from ticketveil.operators import reuse as C
from ticketveil.plans import stored
from ticketveil.sources import read_cache
from ticketveil.streaming import start_cache, start_first_requests

HOUR = 3_600_000_000
START = 19_700 * 24 * HOUR
RESPONSES = "key string, response string, ts timestamp, response_id long"
REQUESTS = "key string, ts timestamp, request_id long"


def frame(spark, rows, schema):
    at = schema.replace("ts timestamp", "at long")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(rows, at).withColumn("ts", F.timestamp_micros("at")).select(names)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cache_of_a_stream_equals_all_at_once(spark, tmp_path, shared_dir):
    rng = random.Random(3)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "check"))
    seen, now = [], START + 40 * HOUR

    def run():
        query = start_cache(
            stream(spark, source, RESPONSES), path, checkpoint, lambda: now, once=True, store=lambda df: stored(df, "merge", shared_dir)
        )
        assert query.awaitTermination(120)

    for trigger in range(4):
        rows = [
            (rng.choice((None, *(f"k{rng.randrange(30)}" for _ in range(9)))), rng.choice(("", "failed", "x", "y")) + f" {i}", START + rng.randrange(40 * HOUR) // HOUR * HOUR, trigger * 100 + i)
            for i in range(80)
        ]
        rows += [("hot", f"h {i}", START + 30 * HOUR + i, trigger * 100 + 80 + i) for i in range(20)]
        seen += [r for r in rows if r[0] is not None]
        frame(spark, [r for r in rows if r[0] is not None], RESPONSES).coalesce(1).write.mode("append").parquet(source)
        if trigger != 1:  # two files wait after the second, and each run is a restart
            run()
            want = C.cache_expire(C.cache_admit(frame(spark, seen, RESPONSES)), now)
            assert {tuple(r) for r in read_cache(spark, path, now).collect()} == {tuple(r) for r in want.collect()}
    run()  # nothing new
    assert read_cache(spark, path, now).count() == want.count() > 10


def test_first_requests_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "sent", "check"))
    seen = []
    for trigger in range(3):  # within 20 hours, not in order
        rows = [(f"k{rng.randrange(40)}", START + rng.randrange(20 * HOUR), trigger * 60 + i) for i in range(40)]
        rows += [("hot", START + rng.randrange(20 * HOUR), trigger * 60 + 40 + i) for i in range(20)]
        seen += rows
        frame(spark, rows, REQUESTS).coalesce(1).write.mode("append").parquet(source)
        assert start_first_requests(stream(spark, source, REQUESTS), sink, checkpoint, once=True).awaitTermination(120)
    sent = spark.read.parquet(sink).collect()
    batch = C.dedupe_requests(frame(spark, seen, REQUESTS)).collect()
    assert sorted(r.key for r in sent) == sorted(r.key for r in batch)
    first = {}
    for key, at, id in sorted(seen, key=lambda r: (r[2] // 60, r[1], r[2])):
        first.setdefault(key, id)
    assert {r.key: r.request_id for r in sent} == first


def test_a_request_is_sent_again_after_a_day(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "sent", "check"))
    for n, hours in enumerate((0, 10, 23, 24, 47, 60, 130, 129)):
        frame(spark, [("a", START + hours * HOUR, n), (None, START + hours * HOUR, n), ("b", None, n)], REQUESTS).coalesce(1).write.mode("append").parquet(source)
        assert start_first_requests(stream(spark, source, REQUESTS), sink, checkpoint, once=True).awaitTermination(120)
    sent = spark.read.parquet(sink)
    for key in ("a", None):
        assert [r.request_id for r in sent.filter(F.col("key").eqNullSafe(key)).orderBy("request_id").collect()] == [0, 3, 5, 6]
    assert sent.count() == 8


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sent")
    frame(spark, [("a", START, 1), ("b", START + HOUR, 2), ("a", START + 1, 3)], REQUESTS).coalesce(1).write.parquet(source)
    for checkpoint in ("one", "two"):  # the second stream runs trigger 0 again
        assert start_first_requests(stream(spark, source, REQUESTS), sink, str(tmp_path / checkpoint), once=True).awaitTermination(120)
        assert sorted(r.request_id for r in spark.read.parquet(sink).collect()) == [1, 2]
