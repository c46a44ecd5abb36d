"""Prompts, token limits and usage per minute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.times import epoch_micros, from_micros

Limits = dict | DataFrame | None
WINDOW_MICROS = 60_000_000
#: Length of the buckets that time is cut into, a part of the window.
BUCKET_MICROS = 100_000
#: Requests of one instant that are ordered together, about; an instant with more is split into ranges of ids.
ROWS_PER_PART = 100_000
#: Ids that are drawn for each such range, to find where the ranges end.
DRAWN = 64
#: Steps that find the range of an id among up to 2^24 of them.
STEPS = 25


def build_prompts(
    docs: DataFrame, template: str, questions: str, procedures: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    prompt = P.build_prompt(F.lit(template), F.lit(procedures), F.lit(questions), F.col(text))
    return docs.select(id, prompt.alias("prompt"))


def _limited(df: DataFrame, limits: Limits, model: str = "model") -> tuple[DataFrame, Column, Column]:
    """``df`` and the limits (requests, tokens) of its rows. A dict becomes part of the expression. A table ``(model, rpm,
    tpm)`` is joined; of several rows for a model the least limits count, a null one is the default."""
    if limits is None or isinstance(limits, dict):
        return df, *(P.limit_of(F.col(model), i, limits) for i in (0, 1))
    known = limits.groupBy(F.col("model").alias("__model")).agg(F.min("rpm").alias("__rpm"), F.min("tpm").alias("__tpm"))
    joined = df.join(known, F.col(model) == F.col("__model"), "left")
    rpm, tpm = F.coalesce("__rpm", F.lit(P.DEFAULT_RPM)), F.coalesce("__tpm", F.lit(P.DEFAULT_TPM))
    return joined, rpm, tpm


_LIMIT_COLUMNS = ("__model", "__rpm", "__tpm")


def token_check(
    df: DataFrame,
    limits: Limits = None,
    max_tokens: int | None = None,
    tokens: str = "tokens",
    model: str = "model",
) -> DataFrame:
    """Add the limit, whether the text is within it, and the share of it that is used."""
    if max_tokens:
        limit = F.lit(max_tokens)
    else:
        df, _, limit = _limited(df, limits, model)
    used = F.col(tokens)
    return (
        df.withColumn("token_limit", limit)
        .drop(*_LIMIT_COLUMNS)
        .withColumn("within_limit", used <= F.col("token_limit"))
        .withColumn(
            "percentage",
            F.when(F.col("token_limit") > 0, used / F.col("token_limit") * 100).otherwise(100.0),
        )
    )


def route_prompt(df: DataFrame, prompt: str = "prompt", model: str = "model", limits: Limits = None) -> DataFrame:
    """Keep, redirect or shorten each prompt by its model's limit."""
    m, p = F.col(model), F.col(prompt)
    df, _, limit = _limited(df, limits, model)
    over = F.col("original_tokens") > F.col("token_limit")
    shorten = over & (m != "gpt-4")
    return (
        df.withColumn("original_tokens", P.word_count(p))
        .withColumn("token_limit", limit)
        .drop(*_LIMIT_COLUMNS)
        .withColumn(
            "model_suggestion", F.when(over & (m == "gpt-4"), P.suggest_cheaper_model(m)).otherwise(m)
        )
        .withColumn("truncated", shorten)
        .withColumn(
            "optimized_prompt",
            F.when(
                shorten,
                P.truncate_middle(p, F.floor(F.col("token_limit") * P.KEEP_SHARE).cast("int")),
            ).otherwise(p),
        )
        .withColumn(
            "reason",
            F.when(shorten, "Text truncated to fit token limit").when(
                over, "Token limit exceeded, suggested cheaper model"
            ),
        )
    )


def _instants(requests: DataFrame, model: str, ts: str, tokens: str) -> DataFrame:
    """Requests and tokens per model and instant, summed up before the shuffle."""
    return requests.groupBy(
        F.col(model).alias("model"), epoch_micros(requests, ts).alias("at")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"))


def _trailing(instants: DataFrame, until: int) -> DataFrame:
    """Sums over the 60 seconds up to each instant; ``until`` 0 includes it, -1 does not.

    Time is cut into buckets. The 60 seconds are the instant's own bucket up to it, the whole buckets before, and
    the rest of the bucket 60 seconds ago, whose instants are put into the own bucket as gone ones. So no
    ordered group has more than the instants of a bucket twice, or the buckets of a minute twice,
    however busy a model is.
    """
    start = F.col("at") - F.pmod("at", F.lit(BUCKET_MICROS))
    both = (
        instants.withColumn("gone", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("at", F.when(F.col("gone"), F.col("at") + WINDOW_MICROS).otherwise(F.col("at")))
        .withColumn("start", start)
    )
    inside = Window.partitionBy("model", "start").orderBy("at")
    upto = inside.rangeBetween(Window.unboundedPreceding, until)
    since = inside.rangeBetween(0, Window.unboundedFollowing)

    def ends(c):
        own = F.sum(F.when(~F.col("gone"), F.col(c))).over(upto)
        return F.coalesce(own, F.lit(0)) + F.coalesce(F.sum(F.when(F.col("gone"), F.col(c))).over(since), F.lit(0))

    ended = both.select(
        "model", "start", "at", "gone", "n", "tokens", ends("n").alias("n1"), ends("tokens").alias("t1")
    ).filter("not gone")
    buckets = instants.groupBy("model", start.alias("start")).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    minute = F.col("start") - F.pmod("start", F.lit(WINDOW_MICROS))
    spread = buckets.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "minute", F.when(F.col("own"), minute).otherwise(minute + WINDOW_MICROS)
    )
    span = Window.partitionBy("model", "minute").orderBy("start").rangeBetween(
        BUCKET_MICROS - WINDOW_MICROS, -BUCKET_MICROS
    )
    whole = spread.select(
        F.col("model").alias("m"),
        F.col("start").alias("s"),
        "own",
        F.coalesce(F.sum("n").over(span), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("tokens").over(span), F.lit(0)).alias("t0"),
    ).filter("own")
    same = F.col("model").eqNullSafe(F.col("m")) & (F.col("start") == F.col("s"))
    return ended.join(whole, same).select(
        "model",
        "at",
        "n",
        "tokens",
        (F.col("n0") + F.col("n1")).alias("used_requests"),
        (F.col("t0") + F.col("t1")).alias("used_tokens"),
    )


def window_usage(
    requests: DataFrame,
    limits: Limits = None,
    model: str = "model",
    ts: str = "ts",
    tokens: str = "tokens",
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Usage in the trailing 60 seconds (both ends included) at every instant with a request.

    ``store`` (such as ``plans.stored`` with its folder) writes the sums per instant, which are read twice."""
    instants = _instants(requests, model, ts, tokens)
    used, rpm, tpm = _limited(_trailing(store(instants) if store else instants, 0), limits)
    return used.select(
        "model",
        from_micros(requests, ts, F.col("at")).alias("ts"),
        F.col("used_requests").alias("rpm_used"),
        F.col("used_tokens").alias("tpm_used"),
        rpm.alias("rpm_limit"),
        tpm.alias("tpm_limit"),
        F.greatest(tpm - F.col("used_tokens"), F.lit(0)).alias("tpm_remaining"),
    )


def _slot(model: str = "model", at: str = "at", part: str = "part") -> Column:
    """One key for model, instant and id range. As one column it is what Spark partitions by;
    with three it may settle for model and instant, and gather a hot instant in one task."""
    parts = (F.coalesce(F.col(part), F.lit(0)).cast("string"), F.col(at).cast("string"), F.col(model))
    return F.concat_ws("|", *parts)


def _ends(base: DataFrame, crowded: DataFrame, rows_per_part: int) -> DataFrame:
    """``(model, at, ends)`` of crowded instants: ids that cut them into ranges of about ``rows_per_part`` requests.

    They come from about ``DRAWN`` ids for each range, drawn by a hash, so the same ones are drawn each time, however the ids
    are spread and whatever they begin with."""
    one_of = max(1, rows_per_part // DRAWN)
    drawn = base.filter(F.pmod(F.xxhash64("request_id"), F.lit(one_of)) == 0)
    ids = drawn.join(crowded, ["model", "at"], "left_semi").groupBy("model", "at").agg(
        F.sort_array(F.collect_list("request_id")).alias("ids")
    )
    each = max(1, rows_per_part // one_of)
    places = F.sequence(F.lit(each), F.size("ids") - 1, F.lit(each))
    ends = F.transform(F.when(F.size("ids") > each, places).otherwise(F.array().cast("array<int>")), lambda i: F.get("ids", i))
    return ids.select("model", "at", F.array_distinct(ends).alias("ends"))


def _range_of(id: Column, ends: Column) -> Column:
    """How many of the sorted ``ends`` are not greater than ``id``, by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(ends).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        within = s["low"] < s["high"]
        up = within & F.coalesce(F.get(ends, middle) <= id, F.lit(False))
        return F.struct(
            F.when(up, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(within & ~up, middle).otherwise(s["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: s["low"])


def _with_parts(base: DataFrame, crowded: DataFrame, rows_per_part: int) -> DataFrame:
    """Adds ``part``, the range of ids; null at instants that are not crowded."""
    joined = base.join(_ends(base, crowded, rows_per_part), ["model", "at"], "left")
    part = F.when(F.col("ends").isNotNull(), _range_of(F.col("request_id"), F.col("ends")))
    return joined.select(*base.columns, part.alias("part"))


def limit_breaches(
    requests: DataFrame,
    limits: Limits = None,
    id: str = "request_id",
    model: str = "model",
    ts: str = "ts",
    tokens: str = "tokens",
    rows_per_part: int = ROWS_PER_PART,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Requests that would not fit into the requests or tokens per minute of their model.

    What counts are the requests of the 60 seconds before: those of earlier instants, and those
    of the same instant with a smaller id, a whole number or a string. An instant may hold very many requests,
    so they are ordered within ranges of ids, on top of the totals of the ranges before.

    ``store`` (such as ``plans.stored`` with its folder) writes the sums per instant. Where they show no crowded one, the
    requests are then read twice: for the sums and for the result.
    """
    base = requests.select(
        F.col(id).alias("request_id"),
        F.col(model).alias("model"),
        epoch_micros(requests, ts).alias("at"),
        F.col(tokens).alias("tokens"),
    )
    instants = _instants(requests, model, ts, tokens)
    instants = store(instants) if store else instants
    crowded = instants.filter(F.col("n") > rows_per_part).select("model", "at")
    before = _trailing(instants, -1).select("model", "at", "used_requests", "used_tokens")
    if store and crowded.isEmpty():
        base = base.withColumn("part", F.lit(None).cast("int"))
        before = before.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("part", "int"), ("n0", "long"), ("t0", "long"))))
    else:
        base = _with_parts(base, crowded, rows_per_part)
        ranges = base.filter("part is not null").groupBy("model", "at", "part").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")
        )
        earlier = Window.partitionBy("model", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = ranges.select("model", "at", "part", F.sum("n").over(earlier).alias("n0"), F.sum("tokens").over(earlier).alias("t0"))
        before = before.join(sums, ["model", "at"], "left")
    before = before.select(
        _slot().alias("slot"),
        (F.coalesce("n0", F.lit(0)) + F.col("used_requests")).alias("n_before"),
        (F.coalesce("t0", F.lit(0)) + F.col("used_tokens")).alias("t_before"),
    )
    inside = Window.partitionBy("slot").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        base.withColumn("slot", _slot())
        .withColumn("n1", F.count(F.lit(1)).over(inside))
        .withColumn("t1", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(before, "slot")
        .select(
            "request_id",
            "model",
            "tokens",
            (F.col("n_before") + F.col("n1")).alias("prior_requests"),
            (F.col("t_before") + F.col("t1")).alias("prior_tokens"),
        )
    )
    found, rpm, tpm = _limited(found, limits)
    return (
        found.withColumn("over_rpm", F.col("prior_requests") >= rpm)
        .withColumn("over_tpm", F.col("prior_tokens") + F.col("tokens") > tpm)
        .withColumn("too_large", F.col("tokens") > tpm)
        .drop(*_LIMIT_COLUMNS)
        .filter("over_rpm or over_tpm or too_large")
    )
