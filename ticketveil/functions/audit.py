"""Audit reports: verdict counts, scores, findings. All are expressions on the report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE, SPACES
from .text import let, line_array, strip

# --- fixed values: rubric and report format ------------------------------------------------
TOTAL_QUESTIONS = 16
SCOREABLE_QUESTIONS = 13
SUMMARY_PREFIX = "JSON_SUMMARY:"
SMART_QUOTES = "“”"
PASS_MARK, FAIL_MARK, NA_MARK = "✅", "❌", "⚠️"
# A line verdict of N/A counts only for the questions that may have one.
NA_QUESTION_MARKS = ("12", "15", "Task Management", "Close Notes", "Resolution Documentation")
NO_SCORE = "Score not available"
PASS_PATTERNS = (
    rf"{PASS_MARK}{SPACE}*PASS",
    rf"STATUS.*?{PASS_MARK}.*?PASS",
    rf"PASS.*?{PASS_MARK}",
    rf"{PASS_MARK}.*?PASS",
)
FAIL_PATTERNS = (
    rf"{FAIL_MARK}{SPACE}*FAIL",
    rf"STATUS.*?{FAIL_MARK}.*?FAIL",
    rf"FAIL.*?{FAIL_MARK}",
    rf"{FAIL_MARK}.*?FAIL",
)
# Score notations in the order they are tried; the first one also holds a percentage.
SCORE_WITH_PERCENT = rf"([0-9]+)/([0-9]+){SPACE}*\(([0-9]+)%\)"
SCORE_PATTERNS = (
    rf"\(Score:{SPACE}*([0-9]+)/([0-9]+)\)",
    rf"Score:{SPACE}*([0-9]+)/([0-9]+)",
    r"TOTAL.*?([0-9]+)/([0-9]+)",
    r"SCORE.*?([0-9]+)/([0-9]+)",
    rf"([0-9]+){SPACE}*out{SPACE}*of{SPACE}*([0-9]+)",
)
QUESTION_HEAD = "**QUESTION"
QUESTION_TITLES = (
    "Incident Number Identification",
    "Heading Fields Documentation",
    "First Access Verification",
    "Engineer Ownership Acknowledgment",
    "Event Date Management",
    "Pending Code Usage",
    "Status Field Updates",
    "Client Communication Quality",
    "Troubleshooting Documentation",
    "Timely Update Compliance",
    "Procedure Following",
    "Task Management",
    "Activity & Change Task Deficiencies",
    "Time Tracking Accuracy",
    "Resolution Documentation",
    "Audit Notes",
)


# --- summary ------------------------------------------------------------------------------


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def parse_json_summary(report: Column) -> Column:
    """Map in the last summary line; null without such a line or when it does not parse."""
    lines = F.filter(
        F.transform(line_array(report), strip), lambda line: line.startswith(SUMMARY_PREFIX)
    )

    def parse(raw: Column) -> Column:
        found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
        payload = F.translate(F.when(found == "", raw).otherwise(found), SMART_QUOTES, '""')
        # Read as the only item of a list: alone, text after the object would go unnoticed.
        items = F.from_json(
            F.concat(F.lit("["), payload, F.lit("]")),
            "array<map<string,string>>",
            {"allowSingleQuotes": "false"},
        )
        return let(
            items, lambda a: F.when(F.size(a) == 1, let(F.map_entries(F.get(a, F.lit(0))), unique))
        )

    def unique(entries: Column) -> Column:
        """Of equal keys the last one counts."""
        return F.map_from_entries(
            F.filter(
                entries,
                lambda e, i: ~F.exists(
                    F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
                ),
            )
        )

    raw = strip(F.substr(let(lines, last), F.lit(len(SUMMARY_PREFIX) + 1)))
    return F.when(report.contains(SUMMARY_PREFIX), let(raw, parse))


def verdicts_in(summary: Column) -> Column:
    """``(key, verdict)`` of the question keys, verdict in upper case without outer space."""
    return F.transform(
        F.filter(F.map_entries(summary), lambda e: F.lower(e["key"]).startswith("q")),
        lambda e: F.struct(e["key"].alias("key"), F.upper(strip(e["value"])).alias("verdict")),
    )


def _tally(items: Column, is_pass, is_fail, is_na) -> Column:
    return F.struct(
        F.size(F.filter(items, is_pass)).alias("pass"),
        F.size(F.filter(items, is_fail)).alias("fail"),
        F.size(F.filter(items, is_na)).alias("na"),
    )


def _is_na_line(line: Column) -> Column:
    return line.contains(NA_MARK) & line.contains("N/A")


def line_verdict(line: Column) -> Column:
    return (
        F.when(_is_na_line(line), F.lit("N/A"))
        .when(line.contains(PASS_MARK) & line.contains("PASS"), F.lit("PASS"))
        .when(line.contains(FAIL_MARK) & line.contains("FAIL"), F.lit("FAIL"))
    )


def audit_summary(report: Column) -> Column:
    """Verdict counts and compliance, from the summary line or else from the status lines."""
    return let(parse_json_summary(report), lambda m: _summary(report, m))


def summary_and_failed(report: Column) -> Column:
    """``(summary, failed)``: ``audit_summary`` and ``failed_questions`` of a report that is parsed once."""
    return let(
        parse_json_summary(report),
        lambda m: F.struct(_summary(report, m).alias("summary"), _failed(m).alias("failed")),
    )


def _summary(report: Column, m: Column) -> Column:

    def from_json(summary):
        return let(
            verdicts_in(summary),
            lambda v: _tally(
                v,
                lambda e: e["verdict"] == "PASS",
                lambda e: e["verdict"] == "FAIL",
                lambda e: e["verdict"].isin("N/A", "NA"),
            ),
        )

    def may_be_na(line):
        marked = F.lit(False)
        for mark in NA_QUESTION_MARKS:
            marked = marked | line.contains(mark)
        return (line_verdict(line) == "N/A") & marked

    def from_lines():
        return let(
            F.split(report, "\n", -1),
            lambda lines: _tally(
                lines,
                lambda line: line_verdict(line) == "PASS",
                lambda line: line_verdict(line) == "FAIL",
                may_be_na,
            ),
        )

    def finish(tally, used):
        answered = tally["pass"] + tally["fail"]
        return F.struct(
            tally["pass"].alias("pass_count"),
            tally["fail"].alias("fail_count"),
            answered.alias("total_answered"),
            F.lit(TOTAL_QUESTIONS).alias("total_questions"),
            F.lit(SCOREABLE_QUESTIONS).alias("scoreable_questions"),
            (F.lit(SCOREABLE_QUESTIONS) - tally["na"]).alias("applicable_questions"),
            tally["na"].alias("na_responses"),
            F.when(answered > 0, tally["pass"] / answered * 100).alias("compliance_percentage"),
            used.alias("json_summary_used"),
        )

    return F.when(
        F.size(m) > 0, let(from_json(m), lambda tally: finish(tally, F.lit(True)))
    ).otherwise(let(from_lines(), lambda tally: finish(tally, F.lit(False))))


def failed_questions(report: Column) -> Column:
    """Sorted upper-case question keys with verdict FAIL in the summary line."""
    return let(parse_json_summary(report), _failed)


def _failed(m: Column) -> Column:
    keys = F.transform(F.filter(verdicts_in(m), lambda e: e["verdict"] == "FAIL"), lambda e: F.upper(e["key"]))
    return F.when(F.size(m) > 0, F.array_sort(keys)).otherwise(F.array().cast("array<string>"))


# --- score --------------------------------------------------------------------------------


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to the even neighbour; exact up to 2^53, beyond it as a double is."""
    share = F.bround(part.cast("double") / whole.cast("double") * 100)
    return F.coalesce(share.try_cast("long").cast("string"), F.format_string("%.0f", share))


def _last_hit(text: Column, pattern: str) -> Column:
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), last)


def _ratio(hit: Column, pattern: str, on_zero: Column | None) -> Column:
    """Numbers of any length are kept as digits without leading zeros."""
    n, d = F.regexp_extract(hit, pattern, 1), F.regexp_extract(hit, pattern, 2)
    num, den = (F.regexp_replace(x, r"^0+(?=[0-9])", "") for x in (n, d))
    bare = F.concat(n, F.lit("/"), d) if on_zero is None else on_zero
    full = F.concat(num, F.lit("/"), den, F.lit(" ("), percent(num, den), F.lit("%)"))
    return F.when(den == "0", bare).otherwise(full)


def audit_score(report: Column) -> Column:
    """Passes over passes and fails; without any, the last score written in the text."""

    def most(patterns, mark):
        counts = F.greatest(*(F.regexp_count(report, F.lit(f"(?isu){p}")) for p in patterns))
        return F.when(report.isNull(), F.lit(None)).when(report.contains(mark), counts).otherwise(F.lit(0))

    def with_percent(pattern):
        parts = [F.lit("/"), F.lit(" ("), F.lit("%)")]
        return let(
            _last_hit(report, pattern),
            lambda hit: F.concat(
                *(x for g in (1, 2, 3) for x in (F.regexp_extract(hit, pattern, g), parts[g - 1]))
            ),
        )

    def with_fraction(pattern):
        return let(
            _last_hit(report, pattern),
            lambda hit: F.when(hit.isNotNull(), _ratio(hit, pattern, None)),
        )

    def written():
        return F.coalesce(
            with_percent(f"(?iud){SCORE_WITH_PERCENT}"),
            *(with_fraction(f"(?iud){p}") for p in SCORE_PATTERNS),
            F.lit(NO_SCORE),
        )

    def counted(s):
        total = s["p"] + s["f"]
        share = F.concat(
            s["p"].cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
            percent(s["p"], total), F.lit("%)"),
        )
        partial = F.concat(F.lit(" ("), total.cast("string"), F.lit(f"/{SCOREABLE_QUESTIONS})"))
        return F.when(total == SCOREABLE_QUESTIONS, share).otherwise(F.concat(share, partial))

    counts = F.struct(most(PASS_PATTERNS, PASS_MARK).alias("p"), most(FAIL_PATTERNS, FAIL_MARK).alias("f"))
    return let(counts, lambda s: F.when(s["p"] + s["f"] > 0, counted(s)).otherwise(written()))


def simple_score(report: Column) -> Column:
    """Last ``n/d`` of a report, else its last percentage."""
    fraction, share = r"([0-9]+)/([0-9]+)", r"[0-9]+%"
    return F.coalesce(
        let(
            _last_hit(report, fraction),
            lambda hit: F.when(hit.isNotNull(), _ratio(hit, fraction, F.lit(NO_SCORE))),
        ),
        _last_hit(report, share),
        F.lit(NO_SCORE),
    )


# --- questions and findings ----------------------------------------------------------------


def question_verdicts(report: Column) -> Column:
    """``array<(q, title, verdict)>`` from the summary line, else from the question blocks."""
    titles = F.create_map(
        *(x for i, t in enumerate(QUESTION_TITLES, 1) for x in (F.lit(f"Q{i}"), F.lit(t)))
    )
    head = r"^\*\*QUESTION\s+([0-9]+):\s*([^\n*]*)"

    def from_json(m):
        return F.transform(
            verdicts_in(m),
            lambda e: F.struct(
                F.upper(e["key"]).alias("q"),
                F.try_element_at(titles, F.upper(e["key"])).alias("title"),
                e["verdict"].alias("verdict"),
            ),
        )

    def from_blocks():
        blocks = F.filter(
            F.split(report, r"(?=\*\*QUESTION\s+[0-9]+:)", -1), lambda b: b.rlike(head)
        )
        return F.transform(
            blocks,
            lambda b: F.struct(
                F.concat(F.lit("Q"), F.regexp_extract(b, head, 1)).alias("q"),
                strip(F.regexp_extract(b, head, 2)).alias("title"),
                F.get(
                    F.filter(F.transform(F.split(b, "\n", -1), line_verdict), lambda v: v.isNotNull()),
                    F.lit(0),
                ).alias("verdict"),
            ),
        )

    return let(
        parse_json_summary(report),
        lambda m: F.when(F.size(m) > 0, from_json(m)).otherwise(from_blocks()),
    )


def _without(text: Column, *parts: str) -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return strip(text)


def key_findings(report: Column, k: int = 3) -> Column:
    """First ``k`` different findings, with the question title before and the reason after."""

    def title_before(rows, i, reach):
        heads = F.filter(
            F.slice(rows, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))),
            lambda r: r["line"].startswith(QUESTION_HEAD),
        )
        title = _without(F.get(heads, F.lit(0))["line"], QUESTION_HEAD, "**")
        return F.coalesce(title, F.lit(""))

    def reason_after(rows, i):
        def missed(r):
            return r["line"].contains("WHAT YOU MISSED") & r["next"].isNotNull()

        def denied(r):
            return r["line"].contains("ANALYSIS") & F.lower(r["line"]).contains("not")

        hit = F.get(F.filter(F.slice(rows, i + 1, 10), lambda r: missed(r) | denied(r)), F.lit(0))
        reason = let(
            hit,
            lambda r: F.when(missed(r), strip(r["next"])).when(
                denied(r), _without(r["line"], "**ANALYSIS**:", "ANALYSIS:")
            ),
        )
        return F.coalesce(reason, F.lit(""))

    def bold(title, rest):
        return F.concat(F.lit("**"), _without(title, "*", ":"), F.lit("**: "), rest)

    def for_failure(rows, i):
        return let(
            F.struct(title_before(rows, i, 5).alias("title"), reason_after(rows, i).alias("reason")),
            lambda x: F.when(
                (x["title"] != "") & (x["reason"] != ""),
                bold(x["title"], _without(x["reason"], "*")),
            )
            .when(x["title"] != "", bold(x["title"], F.lit("Failed compliance check")))
            .when(x["reason"] != "", _without(x["reason"], "*")),
        )

    def for_denial(rows, i):
        return let(
            title_before(rows, i, 10),
            lambda title: F.when(title != "", bold(title, F.lit("Answer was No"))),
        )

    def finding(rows):
        def at(r, i):
            failed = r["raw"].contains(f"{FAIL_MARK} FAIL")
            denied = r["raw"].contains("**ANSWER:** No") | r["raw"].contains("**ANSWER: No")
            return F.when(
                F.length(r["line"]) > 10,
                F.when(failed, for_failure(rows, i)).when(
                    denied & ~r["raw"].contains(FAIL_MARK), for_denial(rows, i)
                ),
            )

        return at

    def rows_of(lines):
        return F.transform(
            lines,
            lambda line, i: F.struct(
                line.alias("raw"), strip(line).alias("line"), F.get(lines, i + 1).alias("next")
            ),
        )

    def all_findings():
        return let(
            let(F.split(report, "\n", -1), rows_of),
            lambda rows: F.filter(F.transform(rows, finding(rows)), lambda f: f.isNotNull()),
        )

    marked = report.contains(f"{FAIL_MARK} FAIL") | report.contains("**ANSWER")
    return F.when(marked, F.slice(F.array_distinct(all_findings()), 1, k)).otherwise(
        F.array().cast("array<string>")
    )


def strip_summary_line(report: Column) -> Column:
    """Drop the last line when it is the summary line."""
    return F.when(
        report.contains(SUMMARY_PREFIX),
        let(
            line_array(F.rtrim(report, F.lit(SPACES))),
            lambda a: F.when(
                last(a).startswith(SUMMARY_PREFIX),
                F.array_join(F.slice(a, 1, F.size(a) - 1), "\n"),
            ).otherwise(report),
        ),
    ).otherwise(report)
