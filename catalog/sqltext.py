"""Pieces of SQL for the checks.

The checking engine's regular expressions have no look-around and judge ``\\b`` by ASCII. So every
letter or digit outside ASCII is first replaced by ``_`` one for one. Matches are found in that
copy, where an ASCII boundary is a Unicode boundary, and cut out of the text by position.
"""

from __future__ import annotations

from catalog import expected as X
from ticketveil.functions import patterns as P

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SPACE_SET = SPACE[1:-1]
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
NOT_ASCII_WORD = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{M}\p{C}]"

IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
PHONE = (
    rf"(?:\+?1[-.{SPACE_SET}]?)?\(?[0-9]{{3}}\)?[-.{SPACE_SET}]?[0-9]{{3}}[-.{SPACE_SET}]?[0-9]{{4}}\b"
)
EMAIL = r"\b[A-Za-z0-9.%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
NAME = rf"\b[A-Z][a-z]+{SPACE}+[A-Z][a-z]+\b"
PLAIN = {
    "mac_addresses": (r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", "[REDACTED MAC]"),
    "employee_ids": (r"EVE\p{Nd}{8}", "[REDACTED EMPLOYEE ID]"),
    "imei_numbers": (rf"IMEI[#{SPACE_SET}]*\p{{Nd}}+", "IMEI#[REDACTED]"),
    "account_numbers": (rf"Account{SPACE}+\p{{Nd}}{{8,}}(-\p{{Nd}}+)?", "Account [REDACTED]"),
    "urls": (rf"https?://{NOT_SPACE}+", "[REDACTED URL]"),
    "run_by_fields": (rf"(Run [Bb]y{SPACE}*:{SPACE}*)[^\n]+", r"\1[REDACTED]"),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(P.SPACES)})"


def mask(x: str) -> str:
    return f"regexp_replace({x}, '{NOT_ASCII_WORD}', '_', 'g')"


def email_mask(x: str) -> str:
    """As ``mask``, with ``_`` only where a letter outside ASCII was."""
    return mask(f"replace({x}, '_', 'x')")


def total(lists: str, upto: str) -> str:
    return f"coalesce(list_sum(list_transform({lists}[1:{upto}], lambda s: length(s))), 0)::BIGINT"


def piece_start(i: str) -> str:
    return f"(1 + {total('pc', f'{i} - 1')} + {total('h', f'{i} - 1')})"


def hit_start(i: str) -> str:
    return f"(1 + {total('pc', i)} + {total('h', f'{i} - 1')})"


REBUILT = (
    f"array_to_string(list_transform(range(1, len(pc) + 1), lambda i: "
    f"substr(t, {piece_start('i')}, length(pc[i])) || coalesce(w[i], '')), '')"
)


def splice_stage(
    prev: str, name: str, pattern: str, shown: str, counts: dict[str, str], masked=mask
) -> list[str]:
    """Common table expressions ``name`` from ``prev``: text ``t`` with hits replaced by what
    ``shown`` (a list expression over ``h``) says, and count columns over ``h`` and ``w``."""
    extra = "".join(f", {e} AS {n}" for n, e in counts.items())
    return [
        f"{name}_m AS (SELECT *, {masked('t')} AS m FROM {prev})",
        f"{name}_h AS (SELECT *, regexp_extract_all(m, '{pattern}') AS h, "
        f"string_split_regex(m, '{pattern}') AS pc FROM {name}_m)",
        f"{name}_w AS (SELECT *, {shown} AS w FROM {name}_h)",
        f"{name} AS (SELECT * EXCLUDE (t, m, h, pc, w), {REBUILT} AS t{extra} FROM {name}_w)",
    ]


PRIVATE = (
    r"regexp_matches(x, '^(0?10\.|172\.0?(1[6-9]|2[0-9]|3[01])\.|192\.168\.)')"
)


def ip_stage(prev: str, name: str) -> list[str]:
    return splice_stage(
        prev,
        name,
        IP,
        f"list_transform(h, lambda x: CASE WHEN {PRIVATE} THEN x ELSE '[REDACTED IP]' END)",
        {
            "ip_addresses": "len(list_filter(h, lambda x: NOT (starts_with(x, '10.') OR "
            "starts_with(x, '172.') OR starts_with(x, '192.168.'))))::INTEGER",
            "ip_redacted": f"len(list_filter(h, lambda x: NOT {PRIVATE}))::INTEGER",
        },
    )


def phone_kept(i: str = "i") -> str:
    start = hit_start(i)
    before = f"lower(substr(t, greatest(1, {start} - 15), least(15, {start} - 1)))"
    return (
        f"(contains({before}, '#') OR (ends_with({before}, '6-') AND "
        f"regexp_full_match(h[{i}], '[0-9]{{10}}')))"
    )


def phone_stage(prev: str, name: str) -> list[str]:
    return splice_stage(
        prev,
        name,
        PHONE,
        f"list_transform(range(1, len(h) + 1), lambda i: CASE WHEN {phone_kept()} THEN h[i] "
        f"ELSE '[REDACTED PHONE]' END)",
        {"phone_numbers": "len(list_filter(w, lambda x: x = '[REDACTED PHONE]'))::INTEGER"},
    )


def email_stage(prev: str, name: str) -> list[str]:
    return splice_stage(
        prev,
        name,
        EMAIL,
        "list_transform(h, lambda x: '[REDACTED EMAIL]')",
        {"email_addresses": "len(h)::INTEGER"},
        masked=email_mask,
    )


def name_kept(x: str = "x") -> str:
    first = f"lower(regexp_extract({x}, '^[A-Z][a-z]+'))"
    second = f"lower(regexp_extract({x}, '[A-Z][a-z]+$'))"
    words = in_list([*X.WORDS, *X.NAMES])
    return (
        f"({first} IN {words} OR {second} IN {words} OR lower({x}) IN {in_list(X.PHRASES)} "
        f"OR regexp_matches(lower({x}), '{'|'.join(X.TECHNICAL_MARKS)}') "
        f"OR regexp_matches({x}, '({'|'.join(X.BUSINESS_ENDINGS)})$'))"
    )


def name_stage(prev: str, name: str) -> list[str]:
    short = (
        "regexp_extract(x, '^[A-Z][a-z]+') || ' ' || "
        "substr(regexp_extract(x, '[A-Z][a-z]+$'), 1, 1) || '.'"
    )
    return splice_stage(
        prev,
        name,
        NAME,
        f"list_transform(h, lambda x: CASE WHEN {name_kept()} THEN x ELSE {short} END)",
        {"names_truncated": "len(list_filter(w, lambda x: ends_with(x, '.')))::INTEGER"},
    )


def plain_stage(prev: str, name: str, kind: str) -> list[str]:
    pattern, replacement = PLAIN[kind]
    return [
        f"{name} AS (SELECT * EXCLUDE (t), regexp_replace(t, '{pattern}', '{replacement}', 'g') AS t, "
        f"len(regexp_extract_all(t, '{pattern}'))::INTEGER AS {kind} FROM {prev})"
    ]


def stage(prev: str, name: str, kind: str) -> list[str]:
    own = {
        "ip_addresses": ip_stage,
        "phone_numbers": phone_stage,
        "email_addresses": email_stage,
        "names_truncated": name_stage,
    }
    return own[kind](prev, name) if kind in own else plain_stage(prev, name, kind)


def break_before_labels(x: str) -> str:
    pattern = (
        rf"(^|[^\p{{L}}\p{{N}}_])((?i:{P.any_of(P.BREAK_WORDS)})){SPACE}+({P.any_of(P.FIELD_LABELS)})"
    )
    return f"regexp_replace({x}, {q(pattern)}, '\\1\\2\n\\3', 'g')"


def break_value_label(x: str) -> str:
    for value, label in X.VALUE_LABELS:
        value = value.replace(r"\s", SPACE)
        x = f"regexp_replace({x}, {q(rf'({value}){SPACE}+({P.any_of([label])})')}, '\\1\n\\2', 'g')"
    return x


def redaction_ctes(source: str) -> list[str]:
    """From a table with ``t`` to ``done`` with the redacted ``t`` and all counts."""
    ctes = [
        f"labelled AS (SELECT * EXCLUDE (t), {break_value_label(break_before_labels('t'))} AS t FROM {source})"
    ]
    prev = "labelled"
    for kind in P.KINDS:
        name = f"after_{kind}"
        ctes += stage(prev, name, kind)
        prev = name
    return [*ctes, f"done AS (SELECT *, {' + '.join(P.KINDS)} AS total_redactions FROM {prev})"]


LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1c-\x1e\x85\x{2028}\x{2029}]"
LABEL = r"^([A-Za-z0-9 \-/()\[\]#>]+:|\p{Nd}+\.|[•*\-]|\[code\])"
TABLE_ROW = (
    rf"^(\p{{Nd}}+{SPACE}+(Minute|Hour|Day)s?|\p{{Nd}}+{SPACE}+[\p{{L}}\p{{N}}_]+{SPACE}+\p{{Nd}}{{4}}"
    rf"|\p{{Nd}}+{SPACE}*-{SPACE}*[\p{{L}}\p{{N}}_]+|[A-Z][a-z]+{SPACE}+[A-Z][a-z]+{SPACE}+\p{{Nd}}{{2,4}}"
    rf"|\p{{Nd}}+\.|[A-Z][a-z]+:)"
)


def line_ctes(source: str, key: str) -> list[str]:
    """``ln``: one row per line of ``t`` with its classes."""
    return [
        f"parts AS (SELECT {key}, string_split_regex(t, '{LINE_BREAK}') AS a FROM {source})",
        f"trimmed AS (SELECT {key}, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM parts)",
        f"raw AS (SELECT {key}, unnest(range(0, len(a)))::INTEGER AS line_no, unnest(a) AS line FROM trimmed)",
        f"bodies AS (SELECT *, {strip('line')} AS body FROM raw)",
        f"ln AS (SELECT *, body = '' AS blank, (body = '' OR regexp_matches(body, '{LABEL}')) AS label, "
        f"regexp_matches(body, '{TABLE_ROW}') AS table_row FROM bodies)",
    ]


def joined_ctes(source: str, key: str) -> list[str]:
    """``joined``: ``t`` with continuation lines appended, by window functions."""
    over = f"OVER (PARTITION BY {key} ORDER BY line_no)"
    return [
        *line_ctes(source, key),
        f"prior AS (SELECT *, lag(blank) {over} AS before_blank FROM ln)",
        f"glued AS (SELECT {key}, line_no, CASE WHEN line_no = 0 THEN line "
        f"WHEN label OR before_blank THEN (CASE WHEN label AND NOT blank AND table_row AND NOT before_blank "
        f"THEN '\n\n' ELSE '\n' END) || line ELSE ' ' || body END AS piece FROM prior)",
        f"agg AS (SELECT {key}, string_agg(piece, '' ORDER BY line_no) AS t FROM glued GROUP BY {key})",
        f"joined AS (SELECT s.{key}, coalesce(agg.t, '') AS t FROM {source} s LEFT JOIN agg USING ({key}))",
    ]


def group_break_ctes(source: str, key: str) -> list[str]:
    """``broken``: an empty line after listed labels, by window functions over lines."""
    over = f"OVER (PARTITION BY {key} ORDER BY no)"
    starts = rf"^({P.any_of(P.BREAK_AFTER_LABELS)})"
    return [
        f"gsplit AS (SELECT {key}, string_split(t, '\n') AS a FROM {source})",
        f"graw AS (SELECT {key}, unnest(range(0, len(a))) AS no, unnest(a) AS line FROM gsplit)",
        f"gnext AS (SELECT *, lead({strip('line')} = '') {over} AS next_blank FROM graw)",
        f"gout AS (SELECT {key}, no, CASE WHEN regexp_matches({strip('line')}, {q(starts)}) "
        f"AND NOT coalesce(next_blank, false) THEN line || '\n' ELSE line END AS line FROM gnext)",
        f"broken AS (SELECT {key}, string_agg(line, '\n' ORDER BY no) AS t FROM gout GROUP BY {key})",
    ]


def clean_markup(x: str) -> str:
    x = rf"regexp_replace({x}, '\[/?code\]', '', 'g')"
    x = f"regexp_replace({x}, '<b>|</b>', '', 'g')"
    return f"regexp_replace({x}, '(?i)<br{SPACE}*/?>', '\n', 'g')"


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
