"""Common issues with a table of issue phrases of any size.

``batch.common_issues`` tests five groups of phrases inside each report. Here the phrases are rows. Each is found by its
rarest part between spaces: the part is looked up in the words of all reports (each different word once, by a short piece
of it), and a phrase is tested only in reports that have a word with that part. Reports and phrases are never paired otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import FAIL_MARK, PASS_MARK
from ..functions.text import contains_any
from .batch import REPORT_FROM_PERCENT, TOP_ISSUES, _judged

#: Characters of a piece. A shorter part of a phrase is a piece by itself.
PIECE = 4


#: Up to this length of a word its pieces are cut out of it; beyond, out of the array of its characters, in linear time.
SHORT = 64


def _pieces(text: Column, n: int) -> Column:
    """Hashes of the different runs of ``n`` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    short = F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))
    long = F.element_at(
        F.transform(F.array(F.split(text, "")), lambda a: F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(a, i, n), "")))), 1
    )
    return F.array_distinct(F.when(F.length(text) <= SHORT, short).otherwise(long))


def _words(text: Column) -> Column:
    """The different words of a text, empty ones left out. Spaces alone divide them."""
    return F.filter(F.array_distinct(F.split(text, " ")), lambda w: w != "")


def _words_of_phrases(phrases: DataFrame, words: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(phrase, word)``: the words that contain the phrase's rarest part, by the number of reports that have the
    rarest piece of it."""
    of_phrases = keep(phrases.select("phrase").distinct().select("phrase", F.explode(_words(F.col("phrase"))).alias("part")))
    least = F.least(F.length("part"), F.lit(PIECE))
    lengths = of_phrases.agg(F.sort_array(F.collect_set(least))).first()[0] or [PIECE]  # at most PIECE numbers
    own = F.element_at(F.array(*(_pieces(F.col("part"), n) for n in lengths)), F.array_position(F.lit(lengths), least).cast("int"))
    wanted = keep(of_phrases.select("part").distinct().select("part", F.explode(own).alias("piece")))
    all_pieces = F.flatten(F.array(*(_pieces(F.col("word"), n) for n in lengths)))
    had = words.select("word", "number", F.explode(all_pieces).alias("piece"))
    number = had.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.sum("number").alias("number"))
    # a piece that no word has keeps its phrase out
    of_part = wanted.join(number, "piece", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("number", F.lit(0)).alias("number"), "piece")).alias("least"))
    rarest = keep(
        of_phrases.join(of_part, "part")
        .groupBy("phrase")
        .agg(F.min(F.struct("least", "part")).alias("r"))
        .select("phrase", "r.part", "r.least.piece")
    )
    return had.join(rarest, "piece").filter(F.contains("word", "part")).select("phrase", "word")


def issue_phrases(issues: DataFrame) -> DataFrame:
    """``(position, issue, phrase)`` as they are looked for: in lower case, each once; null ones and those of spaces only are left out."""
    lowered = issues.select(F.col("position").cast("long"), "issue", F.lower("phrase").alias("phrase"))
    return lowered.filter(F.trim("phrase") != "").distinct()


def issue_counts(files: DataFrame, issues: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(position, issue, reports, n)``: of ``n`` judged reports those that mention a phrase of the issue with a sign of
    failure, for each issue of ``issues (position, issue, phrase)`` with at least one. The rules are those of
    ``batch.common_issues``; a phrase may begin and end within a word.

    Equal reports are one row with a number of copies. Only texts of reports that can count at all move, to find
    equal ones and to be joined with their phrases; all else is words, phrases and numbers of reports (without ``store`` 128-bit hashes). ``store`` (such as ``plans.stored`` with its folder) writes
    what several steps read; adaptive execution can then split a word that very many reports have. An empty table of files or
    issues gives no rows.
    """
    keep = store or (lambda df: df)
    phrases = keep(issue_phrases(issues))
    judged = files.filter(_judged()).select("audit_report")
    low = F.lower("audit_report")
    failing = F.col("audit_report").contains(FAIL_MARK) | contains_any(low, ("**answer:** no", "**answer: no"))
    clear = F.col("audit_report").contains(PASS_MARK) | contains_any(low, ("no issues", "no problems"))
    marked = failing | contains_any(low, ("no ", "not ", " not"))
    open_reports = judged.filter(~clear & marked).select(
        F.unhex(F.md5("audit_report")).alias("key"), low.alias("low"), failing.alias("failing")
    )
    equal = open_reports.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("low").alias("low"), F.first("failing").alias("failing"))
    # numbers are shorter in each row of a word, but only those that are written stay the same
    texts = keep(equal.withColumn("id", F.monotonically_increasing_id()).drop("key") if store else equal.withColumnRenamed("key", "id"))
    had = texts.select("id", F.explode(_words(F.col("low"))).alias("word"))
    words = keep(had.groupBy("word").agg(F.count(F.lit(1)).alias("number")))
    chosen = keep(_words_of_phrases(phrases, words, keep).select("word", "phrase"))
    candidates = had.join(chosen, "word").select("id", "phrase").distinct()

    def mentioned(p: Column) -> Column:
        signs = (F.concat(F.lit("no "), p), F.concat(F.lit("not "), p), F.concat(p, F.lit(" not")))
        near = F.lit(False)
        for sign in signs:
            near = near | F.contains(F.col("low"), sign)
        return F.contains(F.col("low"), p) & (F.col("failing") | near)

    # a phrase of several issues is tested once
    hits = candidates.join(texts, "id").filter(mentioned(F.col("phrase"))).select("id", "copies", "phrase")
    per_issue = hits.join(phrases.select("phrase", "position").distinct(), "phrase").select("id", "copies", "position").distinct()
    counts = per_issue.groupBy("position").agg(F.sum("copies").alias("reports"))
    names = phrases.groupBy("position").agg(F.min("issue").alias("issue"))
    total = judged.agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, "position").select("position", "issue", "reports", total.scalar().alias("n"))


def common_issues(
    files: DataFrame, issues: DataFrame, top: int = TOP_ISSUES, store: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``(position, issue, reports, percentage, message)`` of the issues most reports share, like ``batch.common_issues``."""
    counts = issue_counts(files, issues, store)
    percentage = F.bround(F.col("reports") / F.col("n") * 100).cast("int")
    shares = counts.withColumn("percentage", percentage).filter(F.col("percentage") >= REPORT_FROM_PERCENT)
    message = F.concat("issue", F.lit(" failing in "), F.col("percentage").cast("string"), F.lit("% of files"))
    ordered = shares.orderBy(F.desc("percentage"), "position").limit(top)
    return ordered.select("position", "issue", "reports", "percentage", message.alias("message"))
