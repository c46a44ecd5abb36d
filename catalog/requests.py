"""Queries on prompts, token limits, response reuse, calls and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketveil.functions import errors as E
from ticketveil.functions import prompts as P
from ticketveil.functions.text import clip
from ticketveil.functions.times import epoch_micros
from ticketveil.operators import monitor as M
from ticketveil.operators import prompts as O
from ticketveil.operators import reuse as C
from ticketveil.plans import stored
from ticketveil.sources import merge_cache, read_cache

from . import derived as D
from . import sqltext as S

QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


# --- prompts ----------------------------------------------------------------------------------

TEMPLATE = "Rules:\n{{PROCEDURES_SNIPPET}}\n\nQuestions:\n{{QUESTION_BLOCKS}}\n\nText:\n{{INCIDENT_TEXT}}\n"
QUESTION_TEXT = "1. Is the heading complete?\n2. Was access verified?"
PROCEDURES = "Take ownership of the ticket and say so. " * 60
_SNIPPET = PROCEDURES[:2000] + "..."

add(
    "p1_build_prompts",
    lambda spark, d: O.build_prompts(
        D.table(spark, d, "documents"), TEMPLATE, QUESTION_TEXT, PROCEDURES
    ),
    f"SELECT doc_id, replace(replace(replace({S.q(TEMPLATE)}, '{{{{PROCEDURES_SNIPPET}}}}', {S.q(_SNIPPET)}), "
    f"'{{{{QUESTION_BLOCKS}}}}', {S.q(QUESTION_TEXT)}), '{{{{INCIDENT_TEXT}}}}', text) AS prompt FROM documents",
)
_LENGTHS = (5000, 2000, 1000, 500, 200)
add(
    "p2_context_clip",
    lambda spark, d: D.table(spark, d, "documents").select(
        "doc_id", *(clip(F.col("text"), n).alias(f"first_{n}") for n in _LENGTHS)
    ),
    "SELECT doc_id, "
    + ", ".join(
        f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END AS first_{n}"
        for n in _LENGTHS
    )
    + " FROM documents",
)

MODEL = D.pick("gpt-4,gpt-4o-mini,gpt-3.5-turbo,claude-3-5-sonnet-20241022,other", "doc_id")
PROMPTS = {"doc_id": "doc_id", "model": MODEL, "prompt": "text"}
PROMPTS_SQL = f"prompts AS (SELECT {D.columns(PROMPTS)} FROM documents)"
LIMITS = {"gpt-4": (10, 300), "gpt-4o-mini": (500, 500), "gpt-3.5-turbo": (3500, 101)}
WORDS = f"len(regexp_extract_all(prompt, '{S.NOT_SPACE}+'))::INTEGER"


def limit_sql(which: int, limits: dict) -> str:
    default = (P.DEFAULT_RPM, P.DEFAULT_TPM)[which]
    cases = " ".join(f"WHEN '{m}' THEN {v[which]}" for m, v in limits.items())
    return f"CASE model {cases} ELSE {default} END"


def prompts(spark, d):
    return D.derive(spark, d, "documents", PROMPTS)


add(
    "p3_token_check",
    lambda spark, d: O.token_check(
        prompts(spark, d).withColumn("tokens", P.word_count(F.col("prompt"))).drop("prompt")
    ),
    S.with_(
        [PROMPTS_SQL, f"t AS (SELECT doc_id, model, {WORDS} AS tokens, {limit_sql(1, P.MODEL_LIMITS)} AS token_limit FROM prompts)"],
        "SELECT *, tokens <= token_limit AS within_limit, tokens / token_limit * 100 AS percentage FROM t",
    ),
)


LIMIT_TABLE = "cast(count(1) as int) AS rpm, cast(max(doc_id) % 300 + 20 as int) AS tpm"


def limit_table(spark, d):
    """Limits that are kept as a table: here one row for each model but one."""
    known = prompts(spark, d).filter("model <> 'other'").groupBy("model")
    return known.agg(F.expr("cast(count(1) as int)").alias("rpm"), F.expr("cast(max(doc_id) % 300 + 20 as int)").alias("tpm"))


add(
    "p3_token_check_by_table",
    lambda spark, d: O.token_check(
        prompts(spark, d).withColumn("tokens", P.word_count(F.col("prompt"))).drop("prompt"), limit_table(spark, d)
    ),
    S.with_(
        [
            PROMPTS_SQL,
            f"limits AS (SELECT model, {LIMIT_TABLE} FROM prompts WHERE model <> 'other' GROUP BY model)",
            f"t AS (SELECT doc_id, p.model, {WORDS} AS tokens, coalesce(tpm, 8000) AS token_limit FROM prompts p LEFT JOIN limits l ON p.model = l.model)",
        ],
        "SELECT *, tokens <= token_limit AS within_limit, tokens / token_limit * 100 AS percentage FROM t",
    ),
)


def _truncated(limit: str) -> str:
    half = f"floor(({limit}) / 2)::BIGINT"
    return (
        f"CASE WHEN len(w) <= {limit} THEN prompt ELSE array_to_string(w[1:{half}], ' ') || '\n\n[...TRUNCATED...]\n\n' "
        f"|| array_to_string(w[len(w) - {half} + 1:], ' ') END"
    )


add(
    "p4_truncate_middle",
    lambda spark, d: prompts(spark, d).select(
        "doc_id", P.truncate_middle(F.col("prompt"), F.lit(51)).alias("prompt")
    ),
    S.with_(
        [PROMPTS_SQL, f"t AS (SELECT *, regexp_extract_all(prompt, '{S.NOT_SPACE}+') AS w FROM prompts)"],
        f"SELECT doc_id, {_truncated('51')} AS prompt FROM t",
    ),
)
_SHORT = "(original_tokens > token_limit AND model <> 'gpt-4')"
add(
    "p5_route_prompt",
    lambda spark, d: O.route_prompt(prompts(spark, d), limits=LIMITS).drop("prompt"),
    S.with_(
        [
            PROMPTS_SQL,
            f"t AS (SELECT *, regexp_extract_all(prompt, '{S.NOT_SPACE}+') AS w, {WORDS} AS original_tokens, "
            f"{limit_sql(1, LIMITS)} AS token_limit FROM prompts)",
        ],
        "SELECT doc_id, model, original_tokens, token_limit, "
        "CASE WHEN original_tokens > token_limit AND model = 'gpt-4' THEN 'gpt-4o-mini' ELSE model END AS model_suggestion, "
        f"{_SHORT} AS truncated, CASE WHEN {_SHORT} THEN {_truncated('floor(token_limit * 0.8)::BIGINT')} ELSE prompt END AS optimized_prompt, "
        f"CASE WHEN {_SHORT} THEN 'Text truncated to fit token limit' WHEN original_tokens > token_limit "
        "THEN 'Token limit exceeded, suggested cheaper model' END AS reason FROM t",
    ),
)
add(
    "p6_suggest_cheaper_model",
    lambda spark, d: prompts(spark, d).select(
        "doc_id", "model", P.suggest_cheaper_model(F.col("model")).alias("cheaper")
    ),
    S.with_(
        [PROMPTS_SQL],
        "SELECT doc_id, model, CASE model WHEN 'gpt-4' THEN 'gpt-4o-mini' WHEN 'gpt-4o-mini' THEN 'gpt-3.5-turbo' "
        "ELSE 'gpt-4o-mini' END AS cheaper FROM prompts",
    ),
)
add(
    "p7_route_by_length",
    lambda spark, d: prompts(spark, d).select(
        "doc_id", P.route_by_length(F.length("prompt"), F.col("model")).alias("routed")
    ),
    S.with_(
        [PROMPTS_SQL],
        "SELECT doc_id, CASE WHEN length(prompt) > 15000 AND model = 'gpt-4o-mini' THEN 'gpt-4' "
        "WHEN length(prompt) < 5000 AND model = 'gpt-4' THEN 'gpt-4o-mini' ELSE model END AS routed FROM prompts",
    ),
)

REQUESTS = {
    "request_id": "event_id",
    "model": "event_type",
    "ts": "ts",
    "tokens": "cast(floor(value * 100) as bigint)",
}
# Orders carry dates only, so many requests share an instant.
DAILY = {
    "request_id": "o_orderkey",
    "model": "o_orderpriority",
    "ts": "o_orderdate",
    "tokens": "cast(floor(o_totalprice) as bigint) % 9000",
}
EVENT_LIMITS = {"view": (1, 3000), "click": (2, 5000)}
DAY_LIMITS = {"1-URGENT": (2, 20000), "2-HIGH": (3, 9000)}


def _store(spark, name):
    return lambda df: stored(df, name, D.new_folder(spark, name))


def requests_sql(mapping: dict[str, str], source: str) -> str:
    return f"requests AS (SELECT {D.columns(mapping)} FROM {source})"


_RANGE = "OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)"
_SAME = "OVER (PARTITION BY model, ts ORDER BY request_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def usage_sql(mapping, source, limits) -> str:
    return S.with_(
        [
            requests_sql(mapping, source),
            f"u AS (SELECT DISTINCT model, ts, count(*) {_RANGE} AS rpm_used, (sum(tokens) {_RANGE})::BIGINT AS tpm_used FROM requests)",
        ],
        f"SELECT *, {limit_sql(0, limits)} AS rpm_limit, {limit_sql(1, limits)} AS tpm_limit, "
        f"greatest({limit_sql(1, limits)} - tpm_used, 0)::BIGINT AS tpm_remaining FROM u",
    )


def breaches_sql(mapping, source, limits) -> str:
    rpm, tpm = limit_sql(0, limits), limit_sql(1, limits)
    return S.with_(
        [
            requests_sql(mapping, source),
            f"u AS (SELECT request_id, model, tokens, count(*) {_RANGE} - count(*) {_SAME} AS prior_requests, "
            f"((sum(tokens) {_RANGE}) - (sum(tokens) {_SAME}))::BIGINT AS prior_tokens FROM requests)",
            f"f AS (SELECT *, prior_requests >= {rpm} AS over_rpm, prior_tokens + tokens > {tpm} AS over_tpm, "
            f"tokens > {tpm} AS too_large FROM u)",
        ],
        "SELECT * FROM f WHERE over_rpm OR over_tpm OR too_large",
    )


add(
    "p8_window_usage",
    lambda spark, d: O.window_usage(D.derive(spark, d, "events", REQUESTS), EVENT_LIMITS, store=_store(spark, "instants")),
    usage_sql(REQUESTS, "events", EVENT_LIMITS),
)
add(
    "p8_window_usage_daily",
    lambda spark, d: O.window_usage(D.derive(spark, d, "orders", DAILY), DAY_LIMITS, store=_store(spark, "instants")),
    usage_sql(DAILY, "orders", DAY_LIMITS),
)
add(
    "p9_limit_breaches",
    lambda spark, d: O.limit_breaches(D.derive(spark, d, "events", REQUESTS), EVENT_LIMITS, store=_store(spark, "instants")),
    breaches_sql(REQUESTS, "events", EVENT_LIMITS),
)
add(
    "p9_limit_breaches_daily",
    lambda spark, d: O.limit_breaches(D.derive(spark, d, "orders", DAILY), DAY_LIMITS, store=_store(spark, "instants")),
    breaches_sql(DAILY, "orders", DAY_LIMITS),
)

# --- response reuse -----------------------------------------------------------------------------

CALLS = {
    "id": "o_orderkey",
    "text": "'Order of customer ' || cast(o_custkey as string) || repeat(' more', 120) || cast(o_orderkey as string)",
    "audit_type": "case when o_orderstatus = 'P' then 'general' else 'full' end",
    "model": D.pick("gpt-4,gpt-4o-mini", "o_orderkey"),
    "response": "case o_orderkey % 5 when 0 then '' when 1 then 'Request FAILED' when 2 then 'Rate limit hit' "
    "else 'Answer ' || cast(o_orderkey as string) end",
    "ts": "o_orderdate",
}
CALLS_SQL = (
    f"calls AS (SELECT *, md5(substr(text, 1, 500) || '_' || audit_type || '_' || model) AS key "
    f"FROM (SELECT {D.columns(CALLS)} FROM orders))"
)
NOW = "1999-06-15 00:00:00"
NOW_MICROS = 929404800000000
CACHE_SQL = (
    "cache AS (SELECT key, response, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS rn "
    "FROM calls WHERE response <> '' AND NOT contains(lower(response), 'error') AND NOT contains(lower(response), 'failed') "
    "AND NOT contains(lower(response), 'rate limit')) WHERE rn = 1)"
)


def calls(spark, d):
    df = D.derive(spark, d, "orders", CALLS)
    return df.withColumn("key", C.cache_key(F.col("text"), F.col("audit_type"), F.col("model")))


def cache(spark, d):
    return C.cache_admit(calls(spark, d), "id")


def wanted(spark, d):
    return calls(spark, d).select("id", "key")


FRESH = f"ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"
add(
    "c1_cache_key",
    wanted,
    S.with_([CALLS_SQL], "SELECT id, key FROM calls"),
)
add("c3_cache_admit", cache, S.with_([CALLS_SQL, CACHE_SQL], "SELECT * FROM cache"))
add(
    "c2_cache_lookup",
    lambda spark, d: C.cache_lookup(wanted(spark, d), cache(spark, d), NOW_MICROS),
    S.with_(
        [CALLS_SQL, CACHE_SQL],
        f"SELECT id, key, c.response, c.response IS NOT NULL AS hit FROM (SELECT id, key FROM calls) LEFT JOIN "
        f"(SELECT * FROM cache WHERE {FRESH}) c USING (key)",
    ),
)
add(
    "c2_cache_misses",
    lambda spark, d: C.cache_misses(wanted(spark, d), cache(spark, d), NOW_MICROS),
    S.with_(
        [CALLS_SQL, CACHE_SQL],
        f"SELECT id, key FROM calls WHERE key NOT IN (SELECT key FROM cache WHERE {FRESH})",
    ),
)
add(
    "c4_cache_expire",
    lambda spark, d: C.cache_expire(cache(spark, d), NOW_MICROS),
    S.with_([CALLS_SQL, CACHE_SQL], f"SELECT * FROM cache WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"),
)


KEPT_TS = (
    "cast('2001-07-' || cast(28 + o_orderkey % 4 as string) || ' ' || lpad(cast(o_orderkey * 7 % 24 as string), 2, '0') "
    "|| ':00:00' as {})"
)
KEPT_NOW, KEPT_NOW_MICROS, DAY_MICROS = "2001-07-31 12:00:00", 996580800000000, 86_400_000_000


def kept_cache(spark, d):
    """The cache kept over three runs, a day apart, the last of which is made twice."""
    path = D.new_folder(spark, "cache")
    found = D.derive(spark, d, "orders", {**CALLS, "ts": KEPT_TS.format("timestamp_ntz")})
    found = found.withColumn("key", C.cache_key(F.col("text"), F.col("audit_type"), F.col("model")))
    before = KEPT_NOW_MICROS - epoch_micros(found, "ts")
    for days in (2, 1, 0, 0):
        come = before >= days * DAY_MICROS if days else F.lit(True)
        run = found.filter(come & (before < (days + 1) * DAY_MICROS if days < 2 else F.lit(True)))
        merge_cache(run, path, KEPT_NOW_MICROS - days * DAY_MICROS, "id", store=_store(spark, "admitted"))
    return read_cache(spark, path, KEPT_NOW_MICROS, "timestamp_ntz")


add(
    "c4_kept_cache",
    kept_cache,
    S.with_(
        [CALLS_SQL.replace(CALLS["ts"], KEPT_TS.format("timestamp")), CACHE_SQL],
        f"SELECT * FROM cache WHERE ts >= TIMESTAMP '{KEPT_NOW}' - INTERVAL 24 HOUR",
    ),
)
ENTRIES = {
    "key": "'d' || cast(doc_id as string)",
    "content": "text",
    "ts": "cast('2024-01-0' || cast(doc_id % 4 + 1 as string) || ' 12:00:00' as {})",
    "source_hash": "case when doc_id % 3 = 0 then 'old' else md5(text) end",
}
_FILE_NOW = "2024-01-03 12:00:00"
_FILE_NOW_MICROS = 1704283200000000


def entries(kind: str) -> tuple[dict[str, str], dict[str, str]]:
    """An entry for each document, and one more whose source is gone."""
    given = {**ENTRIES, "ts": ENTRIES["ts"].format(kind)}
    return given, {**given, "key": "'gone' || cast(doc_id as string)"}


def sources(spark, d):
    docs = D.table(spark, d, "documents")
    return docs.select(F.expr(ENTRIES["key"]).alias("key"), F.col("text").alias("content"))


add(
    "c5_file_cache_valid",
    lambda spark, d: C.file_cache_valid(
        D.derive_more(spark, d, "documents", *entries("timestamp_ntz")), sources(spark, d), _FILE_NOW_MICROS
    ),
    S.with_(
        [
            f"entries AS ({D.more_sql('documents', *entries('timestamp'))})",
            "src AS (SELECT 'd' || doc_id::VARCHAR AS key, md5(text) AS h FROM documents)",
        ],
        f"SELECT key, (h IS NULL OR h = source_hash) AND ts >= TIMESTAMP '{_FILE_NOW}' - INTERVAL 24 HOUR AS valid "
        "FROM entries LEFT JOIN src USING (key)",
    ),
)


def document_requests(spark, d):
    docs = D.table(spark, d, "documents")
    return docs.select("doc_id", C.cache_key(F.col("text"), F.lit("general"), F.col("lang")).alias("key"))


_DOC_KEYS = "keys AS (SELECT doc_id, md5(substr(text, 1, 500) || '_general_' || lang) AS key FROM documents)"
add(
    "c6_dedupe_requests",
    lambda spark, d: C.dedupe_requests(document_requests(spark, d), id="doc_id"),
    S.with_(
        [_DOC_KEYS],
        "SELECT key, min(doc_id) AS doc_id, count(*) AS n_requests, count(*) - 1 AS n_reused FROM keys GROUP BY key",
    ),
)
add(
    "c6_assign_requests",
    lambda spark, d: C.assign_requests(document_requests(spark, d), id="doc_id"),
    S.with_(
        [_DOC_KEYS],
        "SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS sent_as, "
        "doc_id = min(doc_id) OVER (PARTITION BY key) AS is_call FROM keys",
    ),
)
NAMED = {"name": "cast(doc_id as string) || '.txt'", "content": "text"}
SEEN = {"name": NAMED["name"], "hash": "md5(case when lang = 'en' then text else text || ' ' end)"}
add(
    "c7_changed_files",
    lambda spark, d: C.changed_files(
        D.derive(spark, d, "documents", NAMED), D.derive(spark, d, "documents", SEEN)
    ),
    "SELECT doc_id::VARCHAR || '.txt' AS name, md5(text) AS hash FROM documents WHERE lang <> 'en'",
)

# --- calls and errors ----------------------------------------------------------------------------

TIMED = {
    "function_name": "event_type",
    "duration": "value",
    "success": "event_type <> 'signup' and event_id % 7 <> 0",
    "ts": "ts",
}
add(
    "m1_performance_summary",
    lambda spark, d: M.performance_summary(D.derive(spark, d, "events", TIMED)),
    S.with_(
        [
            f"timed AS (SELECT {D.columns(TIMED)} FROM events)",
            "g AS (SELECT function_name, count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, "
            "count(*) FILTER (NOT success) AS failed_calls, "
            "sum(duration::DECIMAL(28,9)) FILTER (success)::DOUBLE / count(*) FILTER (success) AS avg_duration, "
            "max(duration) FILTER (success) AS max_duration, min(duration) FILTER (success) AS min_duration, "
            "count(*) FILTER (success) / count(*) * 100 AS success_rate FROM timed GROUP BY function_name)",
        ],
        "SELECT * FROM g WHERE successful_calls > 0",
    ),
)
MESSAGES = (
    "Rate limit exceeded: 429,rapid failure,File not found: a.pdf,read timeout,bad value,Error 401: api key,"
    "Forbidden 403,Context length exceeded,Permission denied,Too Many Requests,Connection reset"
)
FAILURES = {
    "error_id": "event_id",
    "message": D.pick(MESSAGES, "event_id"),
    "model": D.pick("gpt-4,gpt-4o-mini,claude-3-5-sonnet-20241022", "user_id"),
    "function_name": "event_type",
    "ts": "ts",
}


def failures(spark, d):
    return D.derive(spark, d, "events", FAILURES)


def _contains_any(terms) -> str:
    return " OR ".join(f"contains(lower(message), '{t}')" for t in terms)


TYPE_SQL = (
    "CASE " + " ".join(f"WHEN {_contains_any(t)} THEN '{n}'" for n, t in E.ERROR_TERMS) + f" ELSE '{E.OTHER_ERROR}' END"
)
ERRORS = [
    f"failures AS (SELECT {D.columns(FAILURES)} FROM events)",
    f"typed AS (SELECT *, {TYPE_SQL} AS error_type FROM failures)",
]
ACTION_SQL = (
    f"CASE error_type WHEN 'rate_limit' THEN CASE WHEN model = 'gpt-4' THEN {S.q(E.RATE_GPT4)} WHEN contains(model, 'gpt') "
    f"THEN {S.q(E.RATE_GPT)} ELSE {S.q(E.RATE_REST)} END WHEN 'token_limit' THEN {S.q(E.TOKEN_ACTION)} "
    f"WHEN 'api_error' THEN CASE WHEN contains(message, '401') THEN {S.q(E.API_401)} WHEN contains(message, '403') "
    f"THEN {S.q(E.API_403)} ELSE {S.q(E.API_REST)} END WHEN 'file_error' THEN CASE WHEN contains(lower(message), 'not found') "
    f"THEN {S.q(E.FILE_MISSING)} ELSE {S.q(E.FILE_REST)} END WHEN 'network_error' THEN {S.q(E.NETWORK_ACTION)} END"
)
add(
    "m2_m3_classify_errors",
    lambda spark, d: M.classify_errors(failures(spark, d)),
    S.with_(ERRORS, f"SELECT *, {ACTION_SQL} AS suggested_action FROM typed"),
)
add(
    "m4_error_history",
    lambda spark, d: M.error_history(failures(spark, d)),
    S.with_(
        ERRORS,
        "SELECT function_name, error_type, count(*) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM typed GROUP BY ALL",
    ),
)
add(
    "m5_retry_schedule",
    lambda spark, d: M.retry_schedule(failures(spark, d), retries=3, delay=0.5).select(
        "error_id", "error_type", "attempt", "wait_seconds"
    ),
    S.with_(
        [*ERRORS, "tries AS (SELECT unnest(range(0, 3))::INTEGER AS attempt)"],
        "SELECT error_id, error_type, attempt, 0.5::DOUBLE * pow(2, attempt) AS wait_seconds FROM typed, tries "
        "WHERE error_type NOT IN ('validation_error', 'file_error')",
    ),
)
