import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketveil.functions import errors as E
from ticketveil.functions import prompts as P
from ticketveil.operators import monitor as M
from ticketveil.operators import prompts as O
from ticketveil.operators import reuse as C
from ticketveil.operators import tickets as K
from ticketveil.plans import stored

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", params=["timestamp_ntz", "timestamp"])
def requests(request, spark):
    """A hot model, many equal instants, and gaps of exactly 60 seconds."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        model = "hot" if i % 3 else f"m{i % 4}"
        seconds = rng.choice([0, 30, 60, 60, 120, 180, rng.randint(0, 400)])
        rows.append((i * 70_000, model, START + timedelta(seconds=seconds, microseconds=rng.choice([0, 0, 1])), rng.randint(1, 900)))
    df = spark.createDataFrame(rows, "request_id long, model string, ts timestamp, tokens long")
    return rows, df.withColumn("ts", F.col("ts").cast(request.param))


def test_window_usage(requests):
    rows, df = requests
    got = {(r.model, r.ts.replace(tzinfo=None)): (r.rpm_used, r.tpm_used) for r in O.window_usage(df).collect()}
    expected = {}
    for _, model, ts, _ in rows:
        inside = [r for r in rows if r[1] == model and ts - timedelta(seconds=60) <= r[2] <= ts]
        expected[model, ts] = (len(inside), sum(r[3] for r in inside))
    assert got == expected


def test_limit_breaches(requests):
    rows, df = requests
    limits = {"hot": (40, 30_000), "m0": (3, 800)}
    got = {
        r.request_id: (r.prior_requests, r.prior_tokens, r.over_rpm, r.over_tpm, r.too_large)
        for r in O.limit_breaches(df, limits).collect()
    }
    expected = {}
    for i, model, ts, tokens in rows:
        rpm, tpm = limits.get(model, (P.DEFAULT_RPM, P.DEFAULT_TPM))
        prior = [r for r in rows if r[1] == model and r[2] >= ts - timedelta(seconds=60) and (r[2], r[0]) < (ts, i)]
        used = sum(r[3] for r in prior)
        flags = (len(prior) >= rpm, used + tokens > tpm, tokens > tpm)
        if any(flags):
            expected[i] = (len(prior), used, *flags)
    assert got == expected


@pytest.mark.parametrize("kind", ["dense", "sparse", "string"])
def test_limit_breaches_of_a_crowded_instant(spark, shared_dir, kind):
    """One instant has most rows and is split, whatever the ids are; no window holds it whole."""
    rng = random.Random(3)
    ids = rng.sample(range(10**15), 400) if kind == "sparse" else rng.sample(range(400), 400)
    ids = [f"{hash_:04d}-{i}" for i, hash_ in enumerate(ids)] if kind == "string" else ids
    rows = [(i, "hot", START if n < 300 else START + timedelta(seconds=rng.randint(1, 90)), rng.randint(1, 9)) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"request_id {'string' if kind == 'string' else 'long'}, model string, ts timestamp, tokens long")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.request_id: (r.prior_requests, r.prior_tokens) for r in O.limit_breaches(df, {"hot": (0, 1)}, rows_per_part=20).collect()}
    expected = {}
    for i, _, ts, _ in rows:
        prior = [r for r in rows if r[2] >= ts - timedelta(seconds=60) and (r[2], r[0]) < (ts, i)]
        expected[i] = (len(prior), sum(r[3] for r in prior))
    assert got == expected
    base = df.select("request_id", "model", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "tokens")
    crowded = base.groupBy("model", "at").count().filter("count > 20")
    sizes = O._with_parts(base, crowded.drop("count"), 20).filter("part is not null").groupBy("at", "part").count()
    assert sizes.count() == 15 and sizes.agg(F.max("count")).first()[0] <= 21
    stored_too = O.limit_breaches(df, {"hot": (0, 1)}, rows_per_part=20, store=lambda t: stored(t, "instants", shared_dir))
    assert {r.request_id: (r.prior_requests, r.prior_tokens) for r in stored_too.collect()} == expected


def test_ids_with_a_common_beginning(spark):
    """200,000 string ids at one instant: no range has more than twice its share."""
    df = spark.range(200_000).selectExpr("format_string('request-%06d', id) AS request_id", "'hot' AS model", "0L AS at", "1L AS tokens")
    crowded = df.select("model", "at").distinct()
    sizes = [r["count"] for r in O._with_parts(df, crowded, 10_000).groupBy("part").count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 20_000
    requests = df.withColumn("ts", F.timestamp_micros("at"))
    found = O.limit_breaches(requests, {"hot": (199_990, 10**9)}, rows_per_part=10_000)
    assert sorted((r.request_id, r.prior_requests) for r in found.collect()) == [(f"request-{i}", i) for i in range(199_990, 200_000)]


def test_longest_gaps(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 5), START + timedelta(seconds=rng.randint(0, 200_000))) for _ in range(300)]
    rows += [(9, START)]
    df = spark.createDataFrame(rows, "ticket_id int, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.ticket_id: (r.updates, r.gap_seconds) for r in K.longest_gaps(df).collect()}
    for ticket in {r[0] for r in rows}:
        times = sorted(t for i, t in rows if i == ticket)
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:], strict=False)]
        assert got[ticket] == (len(times), max(gaps, default=None))


ERRORS = [
    ("Rate limit exceeded: 429", "gpt-4", "rate_limit", "Switch to gpt-4o-mini for higher rate limits"),
    ("Too Many Requests", "gpt-4o-mini", "rate_limit", "Wait 60 seconds and retry, or switch to gpt-3.5-turbo"),
    ("429", None, "rate_limit", "Wait 60 seconds before retrying"),
    ("rapid failure", "x", "api_error", "Check API service status and retry"),
    ("HTTP 403", "x", "api_error", "Verify API permissions and quota"),
    ("File not found", "x", "file_error", "Check file path and ensure file exists"),
    ("Permission denied", "x", "file_error", "Verify file permissions and disk space"),
    ("read timeout", "x", "network_error", "Check internet connection and retry"),
    ("token 401", "x", "token_limit", E.TOKEN_ACTION),
    ("bad value", "x", "validation_error", None),
]


def test_errors(spark):
    rows = [(i, m, model) for i, (m, model, _, _) in enumerate(ERRORS)]
    df = spark.createDataFrame(rows, "i int, message string, model string")
    got = M.classify_errors(df).orderBy("i").collect()
    assert [(r.error_type, r.suggested_action) for r in got] == [(t, a) for _, _, t, a in ERRORS]
    waits = M.retry_schedule(df, 3, 1.0)
    assert waits.filter("error_type in ('validation_error', 'file_error')").count() == 0
    assert [r.wait_seconds for r in waits.filter("i = 0").orderBy("attempt").collect()] == [1.0, 2.0, 4.0]


def test_performance_summary_leaves_out_failures(spark):
    calls = spark.createDataFrame([("a", 1.0, True), ("a", 9.0, False), ("b", 1.0, False)], "function_name string, duration double, success boolean")
    assert [tuple(r) for r in M.performance_summary(calls).collect()] == [("a", 2, 1, 1, 1.0, 1.0, 1.0, 50.0)]


def test_cache_ages(spark):
    now = datetime(2024, 1, 2)
    day = timedelta(hours=24)
    rows = [("fresh", now - day + timedelta(seconds=1)), ("edge", now - day), ("old", now - day - timedelta(seconds=1))]
    cache = spark.createDataFrame([(k, k, t) for k, t in rows], "key string, response string, ts timestamp")
    cache = cache.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    micros = 1704153600 * 1_000_000
    wanted = spark.createDataFrame([(k,) for k, _ in rows], "key string")
    hits = {r.key: r.hit for r in C.cache_lookup(wanted, cache, micros).collect()}
    assert hits == {"fresh": True, "edge": False, "old": False}
    assert {r.key for r in C.cache_expire(cache, micros).collect()} == {"fresh", "edge"}
    assert {r.key for r in C.cache_misses(wanted, cache, micros).collect()} == {"edge", "old"}


def test_cache_admit_and_keys(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(1, long + "a", "fine", 1), (2, long + "b", "newer", 2), (3, long + "c", "it Failed", 3), (4, "z", "", 4)],
        "response_id int, text string, response string, ts int",
    ).withColumn("ts", F.timestamp_seconds("ts")).withColumn("key", C.cache_key(F.col("text"), F.lit("g"), F.lit("m")))
    assert df.select("key").distinct().count() == 2
    assert [r.response for r in C.cache_admit(df).collect()] == ["newer"]


def test_truncate_middle_and_routes(spark):
    df = spark.createDataFrame([("a b  c d e",), ("a b c",)], "t string")
    cut = [[r[0] for r in df.select(P.truncate_middle(F.col("t"), F.lit(n))).collect()] for n in (3, 4, 1)]
    mark = P.TRUNCATED
    assert cut[0] == [f"a{mark}e", "a b c"]
    assert cut[1] == [f"a b{mark}d e", "a b c"]
    assert cut[2] == [f"{mark}a b c d e", f"{mark}a b c"]
    models = spark.createDataFrame([("gpt-4", 4999), ("gpt-4o-mini", 15001), ("gpt-4", 5000), ("x", 1)], "m string, n int")
    assert [r[0] for r in models.select(P.route_by_length(F.col("n"), F.col("m"))).collect()] == ["gpt-4o-mini", "gpt-4", "gpt-4", "x"]


def test_assign_requests_with_hot_keys(spark, shared_dir):
    """One key has nine tenths of all requests; plain and with the keys stored."""
    from ticketveil import plans

    rng = random.Random(1)
    rows = [(i, "hot" if i % 10 else f"k{rng.randint(0, 20)}") for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, key string")
    first = {}
    for i, key in rows:
        first.setdefault(key, i)
    for store in (None, lambda t: plans.stored(t, "keys", shared_dir)):
        got = {r.request_id: (r.key, r.sent_as, r.is_call) for r in C.assign_requests(df, store=store).collect()}
        assert got == {i: (key, first[key], first[key] == i) for i, key in rows}


def test_only_keys_and_hashes_are_joined(spark):
    docs = spark.createDataFrame([("a", "x", "h", 1), ("b", "y", "h", 1)], "key string, content string, source_hash string, ts int")
    docs = docs.withColumn("ts", F.timestamp_seconds("ts"))
    plan = C.file_cache_valid(docs, docs, 1)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "content" not in plan[: plan.index("Join")] and "Project [key" in join
