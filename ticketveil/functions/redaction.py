"""Redaction stages as column expressions.

A conditional replacement needs the text between matches as well as the matches. Splitting
on a pattern gives one piece more than there are matches, so the result is the pieces with each
match, or its placeholder, put back in between. A match that is kept is consumed whole, which
a negative look-around would not do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .lines import break_labels
from .text import contains_any, let, may_match

MAX_TERMS = 100_000


@dataclass(frozen=True)
class PreserveTerms:
    """Words and two-word phrases (lower case) that are not names of people."""

    words: tuple[str, ...] = field(default=(*P.PRESERVE_WORDS, *P.PRESERVE_NAMES))
    phrases: tuple[str, ...] = field(default=P.PRESERVE_PHRASES)

    def __post_init__(self):
        if len(self.words) + len(self.phrases) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms: keep them in a table and use redact_with_table")

    def plus(self, words: Iterable[str] = (), phrases: Iterable[str] = ()) -> PreserveTerms:
        return PreserveTerms(
            tuple(dict.fromkeys([*self.words, *(w.lower() for w in words)])),
            tuple(dict.fromkeys([*self.phrases, *(p.lower() for p in phrases)])),
        )


DEFAULT_TERMS = PreserveTerms()


def find_all(text: Column, pattern: str, hint: str | P.Part | None = None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint is None:
        return hits
    return F.when(may_match(text, hint), hits).otherwise(F.array().cast("array<string>"))


def find_emails(text: Column) -> Column:
    """A match and what is looked at around it never reach over a line feed, so lines without the sign are left out."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.contains("@"))
    hits = find_all(F.array_join(lines, "\n"), P.EMAIL)
    return F.when(may_match(text, "@"), hits).otherwise(F.array().cast("array<string>"))


def find_phones(text: Column) -> Column:
    return find_all(text, P.PHONE, P.PHONE_PART)


def split_at(text: Column, pattern: str, has_mark: Column | None = None) -> Column:
    """Pieces and matches in turn, a piece first and last, with one search: matches are put between marks, and the text
    is cut at the marks. A text that holds the mark itself is searched twice; ``has_mark`` tells if it may."""
    marked = F.regexp_replace(text, pattern, f"{P.MARK}$0{P.MARK}")
    twice = F.flatten(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.array(p, h))
    )
    searched_twice = let(twice, lambda turns: F.slice(turns, F.lit(1), F.size(turns) - 1))
    return F.when(_has_mark(text, has_mark), searched_twice).otherwise(F.split(marked, P.MARK, -1))


def _has_mark(text: Column, known: Column | None) -> Column:
    return text.contains(P.MARK) if known is None else known


def matches_of(turns: Column) -> Column:
    """The matches of ``split_at``."""
    return F.filter(turns, lambda x, i: i % 2 == 1)


def fold_replace(turns: Column, decide: Callable[[Column, Column], Column]) -> Column:
    """Pieces and matches put together with ``decide(match, place)`` for each match; linear in the length of the text."""
    return F.array_join(F.transform(turns, lambda x, i: F.when(i % 2 == 1, decide(x, i)).otherwise(x)), "")


# --- decisions on single matches -------------------------------------------------------


def is_private_ip(hit: Column) -> Column:
    return hit.rlike(P.PRIVATE_IP)


def is_counted_ip(hit: Column) -> Column:
    """The address count leaves out every address that starts with one of three prefixes."""
    counted = F.lit(True)
    for prefix in P.IP_UNCOUNTED_PREFIXES:
        counted = counted & ~hit.startswith(prefix)
    return counted


def text_before(turns: Column, i: Column, n: int = P.PHONE_CONTEXT_CHARS) -> Column:
    """Last ``n`` characters before the match at place ``i``. A phone match has ten characters or more, so two
    matches back always reach far enough. Of each piece only its last bytes are read, as a character has four at most."""
    empty = F.lit("")
    last = lambda piece: F.substring(piece.cast("binary"), -4 * n, 4 * n).cast("string")
    before = (last(F.coalesce(F.get(turns, i - k), empty)) for k in (4, 3, 2))
    return F.right(F.concat(*before, last(F.get(turns, i - 1))), F.lit(n))


def is_reference_number(hit: Column, before: Column) -> Column:
    return let(
        before, lambda b: (b.endswith(P.CASE_PREFIX) & hit.rlike(P.TEN_DIGITS)) | b.contains(P.CASE_MARK)
    )


def first_word(name: Column) -> Column:
    return F.regexp_extract(name, "^[A-Z][a-z]+", 0)


def second_word(name: Column) -> Column:
    return F.regexp_extract(name, r"[A-Z][a-z]+\z", 0)


def preserve_term(name: Column, terms: PreserveTerms = DEFAULT_TERMS) -> Column:
    """True where a capitalised pair is a business or technical term.

    Both words are a capital and small letters, so terms are compared in that form; only the
    marks, which may lie anywhere, need a search without case.
    """
    words = tuple(dict.fromkeys(w.capitalize() for w in terms.words))
    phrases = tuple(dict.fromkeys(" ".join(map(str.capitalize, p.split(" "))) for p in terms.phrases))
    return (
        first_word(name).isin(*words)
        | second_word(name).isin(*words)
        | name.isin(*phrases)
        | let(F.lower(name), lambda low: contains_any(low, P.TECHNICAL_MARKS))
        | reduce(lambda a, b: a | b, (name.endswith(end) for end in P.BUSINESS_ENDINGS))
    )


def short_name(name: Column) -> Column:
    return F.concat(first_word(name), F.lit(" "), F.substring(second_word(name), 1, 1), F.lit("."))


# --- stages: text in, struct(text, n) out --------------------------------------------------


def _stage(text: Column, n: Column, **more: Column) -> Column:
    return F.struct(
        text.alias("text"), n.alias("n"), *(c.alias(name) for name, c in more.items())
    )


def ip_stage(t: Column, has_mark: Column | None = None) -> Column:
    def shown(hit: Column, _: Column) -> Column:
        return F.when(is_private_ip(hit), hit).otherwise(F.lit(P.IP_PLACEHOLDER))

    def spliced(turns: Column) -> Column:
        hits = matches_of(turns)
        return _stage(
            fold_replace(turns, shown),
            F.size(F.filter(hits, is_counted_ip)),
            redacted=F.size(F.filter(hits, lambda hit: ~is_private_ip(hit))),
        )

    return let(
        split_at(t, P.IP_ADDRESS, has_mark),
        lambda turns: F.when(F.size(turns) == 1, _stage(t, F.lit(0), redacted=F.lit(0))).otherwise(spliced(turns)),
    )


def phone_stage(t: Column, has_mark: Column | None = None) -> Column:
    def spliced(turns: Column) -> Column:
        keep = F.transform(
            turns, lambda x, i: F.when(i % 2 == 1, is_reference_number(x, text_before(turns, i))).otherwise(True)
        )
        return let(
            keep,
            lambda k: _stage(
                fold_replace(turns, lambda hit, i: F.when(F.get(k, i), hit).otherwise(F.lit(P.PHONE_PLACEHOLDER))),
                F.size(F.filter(k, lambda kept: ~kept)),
            ),
        )

    return F.when(
        may_match(t, P.PHONE_PART),
        let(
            split_at(t, P.PHONE, has_mark),
            lambda turns: F.when(F.size(turns) == 1, _stage(t, F.lit(0))).otherwise(spliced(turns)),
        ),
    ).otherwise(_stage(t, F.lit(0)))


def name_stage(
    t: Column, terms: PreserveTerms = DEFAULT_TERMS, kept: Column | None = None, has_mark: Column | None = None
) -> Column:
    """``kept`` is an array of further pairs that stay."""

    def stays(hit):
        own = preserve_term(hit, terms)
        return own if kept is None else own | F.coalesce(F.array_contains(kept, hit), F.lit(False))

    def spliced(turns):
        shown = F.transform(
            turns, lambda x, i: F.when((i % 2 == 0) | stays(x), x).otherwise(short_name(x))
        )
        # A shortened name ends with a full stop, a name itself cannot.
        return let(
            shown,
            lambda new: _stage(
                F.array_join(new, ""),
                F.size(F.filter(new, lambda x, i: (i % 2 == 1) & x.endswith("."))),
            ),
        )

    return let(
        split_at(t, P.NAME, has_mark),
        lambda turns: F.when(F.size(turns) == 1, _stage(t, F.lit(0))).otherwise(spliced(turns)),
    )


def _pieces(t: Column, kind: str, pattern: str, has_mark: Column | None) -> Column:
    """The text around the matches, cut at marks in their place; ``split`` would compile the pattern for each text. Emails
    are looked for by lines, as in ``find_emails``. A text that holds the mark itself is cut at the matches."""
    marked = F.regexp_replace(t, pattern, P.MARK)
    if kind == "email_addresses":
        with_mark = F.transform(
            F.split(t, "\n", -1), lambda line: F.when(line.contains("@"), F.regexp_replace(line, pattern, P.MARK)).otherwise(line)
        )
        marked = F.array_join(with_mark, "\n")
    return F.when(_has_mark(t, has_mark), F.split(t, pattern, -1)).otherwise(F.split(marked, P.MARK, -1))


def plain_stage(t: Column, kind: str, has_mark: Column | None = None) -> Column:
    """Every match is replaced. With a fixed replacement one split gives text and count."""
    pattern, replacement, hint = P.PLAIN_RULES[kind]
    if "$" in replacement:
        return let(
            F.when(may_match(t, hint), F.regexp_count(t, F.lit(pattern))).otherwise(0),
            lambda n: _stage(
                F.when(n > 0, F.regexp_replace(t, pattern, replacement)).otherwise(t), n
            ),
        )
    return let(
        F.when(may_match(t, hint), _pieces(t, kind, pattern, has_mark)),
        lambda pieces: F.when(pieces.isNull(), _stage(t, F.lit(0))).otherwise(
            _stage(F.array_join(pieces, replacement), F.size(pieces) - 1)
        ),
    )


def run_stage(
    t: Column, kind: str, terms: PreserveTerms, kept: Column | None = None, has_mark: Column | None = None
) -> Column:
    """``has_mark`` tells of a text whether it, or one that it was made of by stages, holds the mark: no stage adds it."""
    if kind == "ip_addresses":
        return ip_stage(t, has_mark)
    if kind == "phone_numbers":
        return phone_stage(t, has_mark)
    if kind == "names_truncated":
        return name_stage(t, terms, kept, has_mark)
    return plain_stage(t, kind, has_mark)


def names_seen(text: Column) -> Column:
    """The distinct capitalised pairs that the name stage of ``redact`` finds."""

    def chain(t: Column, kinds: tuple[str, ...]) -> Column:
        if kinds[0] == "names_truncated":
            return F.array_distinct(find_all(t, P.NAME))
        return let(run_stage(t, kinds[0], DEFAULT_TERMS), lambda s: chain(s["text"], kinds[1:]))

    return let(break_labels(text), lambda t: chain(t, P.KINDS))


def redact(
    text: Column,
    terms: PreserveTerms = DEFAULT_TERMS,
    kept: Column | None = None,
    open_value: Column | None = None,
) -> Column:
    """Label breaks and all ten stages, each on the result of the one before.

    Returns ``struct(redacted_text, stats)``. The chain is one expression in which each
    intermediate text is a lambda variable. As a chain of projections it would be rewritten by
    filter pushdown, which copies the definition of a column into every place that uses it.
    """

    def chain(t: Column, kinds: tuple[str, ...], counts: dict[str, Column], has_mark: Column) -> Column:
        if not kinds:
            total = sum((counts[k] for k in P.KINDS[1:]), counts[P.KINDS[0]])
            stats = {k: counts[k] for k in P.KINDS}
            stats |= {"total_redactions": total, "ip_redacted": counts["ip_redacted"]}
            return F.struct(
                t.alias("redacted_text"),
                F.struct(*(c.alias(k) for k, c in stats.items())).alias("stats"),
            )
        kind, rest = kinds[0], kinds[1:]

        def then(s: Column) -> Column:
            found = {kind: s["n"]}
            if kind == "ip_addresses":
                found["ip_redacted"] = s["redacted"]
            return chain(s["text"], rest, counts | found, has_mark)

        return let(run_stage(t, kind, terms, kept, has_mark), then)

    broken = break_labels(text, open_value)
    return let(broken, lambda t: let(t.contains(P.MARK), lambda has_mark: chain(t, P.KINDS, {}, has_mark)))


# --- single stages: text in, text out ----------------------------------------------------


def redact_one(text: Column, kind: str, terms: PreserveTerms = DEFAULT_TERMS) -> Column:
    return let(text, lambda t: run_stage(t, kind, terms)["text"])


def redact_ip(text: Column) -> Column:
    return redact_one(text, "ip_addresses")


def redact_mac(text: Column) -> Column:
    return redact_one(text, "mac_addresses")


def redact_phone(text: Column) -> Column:
    return redact_one(text, "phone_numbers")


def redact_email(text: Column) -> Column:
    return redact_one(text, "email_addresses")


def redact_employee_id(text: Column) -> Column:
    return redact_one(text, "employee_ids")


def redact_imei(text: Column) -> Column:
    return redact_one(text, "imei_numbers")


def redact_account(text: Column) -> Column:
    return redact_one(text, "account_numbers")


def redact_url(text: Column) -> Column:
    return redact_one(text, "urls")


def redact_run_by(text: Column) -> Column:
    return redact_one(text, "run_by_fields")


def truncate_names(text: Column, terms: PreserveTerms = DEFAULT_TERMS) -> Column:
    return redact_one(text, "names_truncated", terms)
