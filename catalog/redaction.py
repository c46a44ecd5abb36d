"""Line, markup and redaction queries on documents, tickets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketveil.functions import patterns as P
from ticketveil.functions import redaction as R
from ticketveil.functions.text import let
from ticketveil.operators import lines as L
from ticketveil.operators import parts as T
from ticketveil.operators import redaction as O
from ticketveil.operators.assemble import joined_in_order
from ticketveil.operators.documents import assemble_pages
from ticketveil.plans import redact_page_parts, redact_pages, stored
from ticketveil.sources import keep_groups, kept_groups, write_redacted

from . import derived as D
from . import sqltext as S

BASE = f"corpus AS (SELECT doc_id, kind, text AS t FROM {D.CORPUS_SQL})"
KIND_OF = {
    "r1_redact_ip": "ip_addresses",
    "r2_redact_mac": "mac_addresses",
    "r3_redact_phone": "phone_numbers",
    "r4_redact_email": "email_addresses",
    "r5_redact_employee_id": "employee_ids",
    "r6_redact_imei": "imei_numbers",
    "r7_redact_account": "account_numbers",
    "r8_redact_url": "urls",
    "r9_redact_run_by": "run_by_fields",
    "r10_truncate_names": "names_truncated",
}
QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


def _single(name, kind):
    fn = getattr(R, name.split("_", 1)[1])

    def query(spark, d):
        return D.corpus(spark, d).select("doc_id", fn(F.col("text")).alias("text"))

    add(
        name,
        query,
        S.with_([BASE, *S.stage("corpus", "one", kind)], "SELECT doc_id, t AS text FROM one"),
    )


for _name, _kind in KIND_OF.items():
    _single(_name, _kind)


# --- lines and markup ---------------------------------------------------------------------

add(
    "l1_split_lines",
    lambda spark, d: L.split_lines(D.corpus(spark, d)),
    S.with_([BASE, *S.line_ctes("corpus", "doc_id")], "SELECT doc_id, line_no, line FROM ln"),
)
add(
    "l2_classify_lines",
    lambda spark, d: L.classify_lines(L.split_lines(D.corpus(spark, d))).drop("line"),
    S.with_(
        [BASE, *S.line_ctes("corpus", "doc_id")],
        "SELECT doc_id, line_no, blank, label, table_row FROM ln",
    ),
)
add(
    "l3_l4_join_wrapped_lines",
    lambda spark, d: L.join_wrapped_lines(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE, *S.joined_ctes("corpus", "doc_id")], "SELECT doc_id, t AS text FROM joined"),
)
add(
    "l5_field_group_breaks",
    lambda spark, d: L.field_group_breaks(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE, *S.group_break_ctes("corpus", "doc_id")], "SELECT doc_id, t AS text FROM broken"),
)
add(
    "l6_clean_markup",
    lambda spark, d: L.clean_markup(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE], f"SELECT doc_id, {S.clean_markup('t')} AS text FROM corpus"),
)
add(
    "l7_break_before_labels",
    lambda spark, d: L.break_before_labels(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE], f"SELECT doc_id, {S.break_before_labels('t')} AS text FROM corpus"),
)
add(
    "l8_break_value_label",
    lambda spark, d: L.break_value_label(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE], f"SELECT doc_id, {S.break_value_label('t')} AS text FROM corpus"),
)
NORMALIZED = [
    *S.joined_ctes("corpus", "doc_id"),
    *S.group_break_ctes("joined", "doc_id"),
    f"normal AS (SELECT doc_id, kind, {S.clean_markup('broken.t')} AS t "
    "FROM broken JOIN (SELECT doc_id, kind FROM corpus) USING (doc_id))",
]
add(
    "l9_normalize_document",
    lambda spark, d: L.normalize_document(D.corpus(spark, d)).select("doc_id", "text"),
    S.with_([BASE, *NORMALIZED], "SELECT doc_id, t AS text FROM normal"),
)


# --- redaction as a whole -----------------------------------------------------------------

ALL_COUNTS = ", ".join((*P.KINDS, "total_redactions", "ip_redacted"))


def redact_documents(spark, d):
    return O.redact_documents(D.corpus(spark, d)).select("doc_id", "redacted_text", "stats.*")


add(
    "r13_redact_documents",
    redact_documents,
    S.with_(
        [BASE, *S.redaction_ctes("corpus")],
        f"SELECT doc_id, t AS redacted_text, {ALL_COUNTS} FROM done",
    ),
)
add(
    "e1_corpus_to_redacted_text",
    lambda spark, d: O.redact_documents(D.corpus(spark, d), normalize=True).select(
        "doc_id", "redacted_text", "stats.*"
    ),
    S.with_(
        [BASE, *NORMALIZED, *S.redaction_ctes("normal")],
        f"SELECT doc_id, t AS redacted_text, {ALL_COUNTS} FROM done",
    ),
)


def redacted_pages(spark, d):
    turns = D.derive(spark, d, "conversations", {"doc_id": "conv_id", "page_no": "turn", "text": "text"})
    return redact_pages(turns).select("doc_id", "redacted_text", "stats.*")


PAGES_BASE = (
    "corpus AS (SELECT conv_id AS doc_id, 'page' AS kind, coalesce(string_agg(text, '\n' ORDER BY turn) "
    "FILTER (text <> ''), '') AS t FROM conversations GROUP BY conv_id)"
)
add(
    "e1_pages_to_redacted_text",
    redacted_pages,
    S.with_(
        [PAGES_BASE, *NORMALIZED, *S.redaction_ctes("normal")],
        f"SELECT doc_id, t AS redacted_text, {ALL_COUNTS} FROM done",
    ),
)


# --- documents in parts -------------------------------------------------------------------

PIECE_CHARS = 700
PART_SIZES = (1, 2, 7)


def whole(parts, text):
    """The parts of each document one after the other."""
    return joined_in_order(parts, "doc_id", "part", text, "").drop("n")


def _store(spark, name):
    return lambda df: stored(df, name, D.new_folder(spark, name))


def normalized_parts(spark, d):
    """The corpus cut into pieces at any character."""
    pieces = _store(spark, "pieces")(T.cut_text(D.corpus(spark, d), PIECE_CHARS))
    return whole(T.normalize_parts(pieces, store=_store(spark, "joined")), "text")


add(
    "l9_normalize_parts",
    normalized_parts,
    S.with_([BASE, *NORMALIZED], "SELECT doc_id, t AS text FROM normal"),
)


def normalized_page_parts(spark, d):
    """Documents of pages in parts of one, two and seven pages."""
    pages = D.derive(spark, d, "conversations", {"doc_id": "conv_id", "page_no": "turn", "text": "text"})
    found = None
    for size in PART_SIZES:
        parts = T.normalize_parts(assemble_pages(pages, pages_per_part=size), sep="\n")
        one = whole(parts, "text").withColumn("pages_per_part", F.lit(size))
        found = one if found is None else found.unionByName(one)
    return found


add(
    "l9_normalize_page_parts",
    normalized_page_parts,
    S.with_(
        [PAGES_BASE, *NORMALIZED],
        f"SELECT doc_id, t AS text, unnest({list(PART_SIZES)})::INTEGER AS pages_per_part FROM normal",
    ),
)


def _whole_with_counts(parts):
    return whole(parts, "redacted_text").join(T.part_stats(parts), "doc_id")


def redacted_parts(spark, d):
    """The corpus cut into pieces at any character, redacted piece by piece."""
    pieces = _store(spark, "pieces")(T.cut_text(D.corpus(spark, d), PIECE_CHARS))
    return _whole_with_counts(_store(spark, "parts")(T.redact_parts(pieces)))


add(
    "r13_redact_parts",
    redacted_parts,
    S.with_([BASE, *S.redaction_ctes("corpus")], f"SELECT doc_id, t AS redacted_text, {ALL_COUNTS} FROM done"),
)


def redacted_page_parts(spark, d):
    turns = D.derive(spark, d, "conversations", {"doc_id": "conv_id", "page_no": "turn", "text": "text"})
    parts = redact_page_parts(turns, pages_per_part=2, store=_store(spark, "parts"))
    return _whole_with_counts(_store(spark, "parts")(parts))


add("e1_page_parts_to_redacted_text", redacted_page_parts, ORACLES["e1_pages_to_redacted_text"])
add(
    "r12_redaction_stats",
    lambda spark, d: O.redaction_stats(D.spread_table(spark, d, "documents")),
    S.with_(
        ["docs AS (SELECT doc_id, text AS t FROM documents)", *S.redaction_ctes("docs")],
        f"SELECT doc_id, {ALL_COUNTS} FROM done",
    ),
)


def redaction_rollup(spark, d):
    docs = D.spread_table(spark, d, "documents")
    return O.redaction_rollup(O.redaction_stats(docs, keep=("lang", "source")), "lang", "source")


_SUMS = ", ".join(f"sum({k})::BIGINT AS {k}" for k in (*P.KINDS, "total_redactions", "ip_redacted"))
add(
    "r15_redaction_rollup",
    redaction_rollup,
    S.with_(
        ["docs AS (SELECT doc_id, lang, source, text AS t FROM documents)", *S.redaction_ctes("docs")],
        f"SELECT lang, source, count(*) AS documents, {_SUMS}, "
        "sum(mac_addresses + employee_ids + account_numbers + imei_numbers)::BIGINT AS other_redactions, "
        "count(*) FILTER (total_redactions = 0) AS clean_documents, "
        "count(*) FILTER (total_redactions = 0) / count(*) AS clean_share "
        "FROM done GROUP BY ROLLUP (lang, source)",
    ),
)


def kept_rollup(spark, d):
    """Totals of three runs, the second one made twice, from the groups that each has left."""
    stats, path = O.redaction_stats(D.spread_table(spark, d, "documents"), keep=("lang", "source")), D.new_folder(spark, "totals")
    third = F.pmod("doc_id", F.lit(3))
    for run in (0, 1, 1, 2):
        keep_groups(O.redaction_groups(stats.filter(third == run), "lang", "source"), path, f"run-{run}")
    return O.rollup_redaction_groups(kept_groups(spark, path), "lang", "source")


add("r15_kept_rollup", kept_rollup, ORACLES["r15_redaction_rollup"])


def rollup_by_kind(spark, d):
    stats = O.redaction_stats(D.corpus(spark, d), keep=("kind",))
    return O.redaction_rollup(stats, "kind")


add(
    "r15_redaction_rollup_by_kind",
    rollup_by_kind,
    S.with_(
        [BASE, *S.redaction_ctes("corpus")],
        f"SELECT kind, count(*) AS documents, {_SUMS}, "
        "sum(mac_addresses + employee_ids + account_numbers + imei_numbers)::BIGINT AS other_redactions, "
        "count(*) FILTER (total_redactions = 0) AS clean_documents, "
        "count(*) FILTER (total_redactions = 0) / count(*) AS clean_share "
        "FROM done GROUP BY ROLLUP (kind)",
    ),
)


def _mentions_sql() -> str:
    ctes = [BASE, f"masked AS (SELECT doc_id, t, {S.mask('t')} AS m, {S.email_mask('t')} AS e FROM corpus)"]
    selects = [
        f"SELECT doc_id, 'ip_addresses' AS kind, x AS match, {S.PRIVATE} AS kept "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(m, '{S.IP}')) AS x FROM masked)",
        f"SELECT doc_id, 'names_truncated', x, {S.name_kept()} "
        f"FROM (SELECT doc_id, unnest(regexp_extract_all(m, '{S.NAME}')) AS x FROM masked)",
        # the text has one character per character of the copy, so cut it out by length there
        "SELECT doc_id, 'phone_numbers', h[i], kept FROM phones",
        "SELECT doc_id, 'email_addresses', x, false FROM emails",
    ]
    ctes += [
        f"ph AS (SELECT doc_id, t, regexp_extract_all(m, '{S.PHONE}') AS h, "
        f"string_split_regex(m, '{S.PHONE}') AS pc FROM masked)",
        "phi AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM ph)",
        f"phones AS (SELECT doc_id, h, i, {S.phone_kept()} AS kept FROM phi)",
        f"em AS (SELECT doc_id, t, regexp_extract_all(e, '{S.EMAIL}') AS h, "
        f"string_split_regex(e, '{S.EMAIL}') AS pc FROM masked)",
        "emi AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM em)",
        f"emails AS (SELECT doc_id, substr(t, {S.hit_start('i')}, length(h[i])) AS x FROM emi)",
    ]
    for kind, (pattern, _) in S.PLAIN.items():
        selects.append(
            f"SELECT doc_id, '{kind}', unnest(regexp_extract_all(t, '{pattern}')), false FROM corpus"
        )
    return S.with_(ctes, " UNION ALL ".join(selects))


add("r14_find_pii", lambda spark, d: O.find_pii(D.corpus(spark, d)), _mentions_sql())


def preserve_term(spark, d):
    names = O.find_pii(D.corpus(spark, d)).filter("kind = 'names_truncated'")
    return names.groupBy(F.col("match").alias("name"), "kept").agg(F.count(F.lit(1)).alias("mentions"))


add(
    "r11_preserve_term",
    preserve_term,
    S.with_(
        [
            BASE,
            f"names AS (SELECT unnest(regexp_extract_all({S.mask('t')}, '{S.NAME}')) AS x FROM corpus)",
        ],
        f"SELECT x AS name, {S.name_kept()} AS kept, count(*) AS mentions FROM names GROUP BY x",
    ),
)


WORDS_OF = {"term": D.pick("Smith,johnson,FRANKLIN,Other", D.K), "kind": "'word'"}
PHRASES_OF = {"term": f"'Caleb ' || {D.pick('Wilson,stone,Field', D.K)}", "kind": "'phrase'"}
TERMS_SQL = f"terms AS (SELECT lower(term) AS term, kind FROM ({D.more_sql('orders', WORDS_OF, PHRASES_OF)}))"


def names_in_table(spark, d):
    """Names of the corpus that a vocabulary kept as a table holds."""
    vocabulary = D.derive_more(spark, d, "orders", WORDS_OF, PHRASES_OF)
    return O.in_vocabulary(preserve_term(spark, d), vocabulary)


add(
    "r11_names_in_table",
    names_in_table,
    S.with_(
        [
            BASE,
            TERMS_SQL,
            f"names AS (SELECT DISTINCT x AS name FROM (SELECT unnest(regexp_extract_all({S.mask('t')}, '{S.NAME}')) AS x FROM corpus))",
        ],
        "SELECT name FROM names WHERE lower(name) IN (SELECT term FROM terms WHERE kind = 'phrase') "
        "OR lower(regexp_extract(name, '^[A-Z][a-z]+')) IN (SELECT term FROM terms WHERE kind = 'word') "
        "OR lower(regexp_extract(name, '[A-Z][a-z]+$')) IN (SELECT term FROM terms WHERE kind = 'word')",
    ),
)


def fold_replace(spark, d):
    """Numbers of more than three digits become their position, others stay."""
    pattern = "[0-9]+"
    text = let(
        R.split_at(F.col("text"), pattern),
        lambda turns: R.fold_replace(
            turns,
            lambda hit, i: F.when(
                F.length(hit) > 3, F.concat(F.lit("<"), F.floor(i / 2).cast("string"), F.lit(">"))
            ).otherwise(hit),
        ),
    )
    return D.corpus(spark, d).select("doc_id", text.alias("text"))


add(
    "x1_fold_replace",
    fold_replace,
    S.with_(
        [
            BASE,
            *S.splice_stage(
                "corpus",
                "one",
                "[0-9]+",
                "list_transform(range(1, len(h) + 1), lambda i: CASE WHEN length(h[i]) > 3 "
                "THEN '<' || (i - 1)::VARCHAR || '>' ELSE h[i] END)",
                {},
                masked=lambda x: x,
            ),
        ],
        "SELECT doc_id, t AS text FROM one",
    ),
)


def redacted_round_trip(spark, d):
    """Redacted documents written by language and read again."""
    path = D.new_folder(spark, "redacted")
    write_redacted(O.redact_documents(D.corpus(spark, d), keep=("kind",)), path, partition_by=("kind",))
    return spark.read.parquet(path).select("doc_id", "kind", "redacted_text", *O.STATS)


add(
    "s3_redacted_round_trip",
    redacted_round_trip,
    S.with_([BASE, *S.redaction_ctes("corpus")], f"SELECT doc_id, kind, t AS redacted_text, {ALL_COUNTS} FROM done"),
)
