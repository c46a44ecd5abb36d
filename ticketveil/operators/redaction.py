"""Redaction of a table of documents, with counts.

All stages are row expressions: a table of any size is redacted in one pass over its
partitions without a shuffle, and the same code runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.lines import normalize_text
from ..functions.redaction import (
    DEFAULT_TERMS,
    MAX_TERMS,
    PreserveTerms,
    find_all,
    find_emails,
    first_word,
    is_private_ip,
    is_reference_number,
    matches_of,
    names_seen,
    preserve_term,
    redact,
    second_word,
    split_at,
    text_before,
)
from ..functions.text import let, may_match
from .rows import inline_rows


def load_terms(spark: SparkSession, path: str, base: PreserveTerms = DEFAULT_TERMS) -> PreserveTerms:
    """Add a site's own vocabulary from a table ``(term, kind)``, kind ``word`` or ``phrase``.

    The table becomes a literal list, so its size is checked before it reaches the driver.
    """
    rows = spark.read.parquet(path).select("term", "kind").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"{path} holds more than {MAX_TERMS} terms: use redact_with_table")
    return base.plus(
        (r.term for r in rows if r.kind == "word"), (r.term for r in rows if r.kind == "phrase")
    )


STATS = (*P.KINDS, "total_redactions", "ip_redacted")


def redact_documents(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    terms: PreserveTerms = DEFAULT_TERMS,
    normalize: bool = False,
) -> DataFrame:
    """``(id, *keep, redacted_text, stats)``; with ``normalize`` lines and markup are put in
    order first, as for text taken from pages."""
    body = normalize_text(F.col(text)) if normalize else F.col(text)
    return df.select(id, *keep, redact(body, terms).alias("redacted")).select(
        id, *keep, "redacted.redacted_text", "redacted.stats"
    )


def in_vocabulary(names: DataFrame, vocabulary: DataFrame, name: str = "name") -> DataFrame:
    """The distinct ``name`` (capitalised pairs) that ``vocabulary (term, kind)``, a table of any size, holds: one of
    the words of kind ``word``, or the pair as kind ``phrase``. Terms count without regard to case."""
    n = F.col(name)
    distinct = names.select(name).filter(n.isNotNull()).distinct()
    keys = F.array(
        *(F.struct(F.lower(c).alias("term"), F.lit(kind).alias("kind"))
          for c, kind in ((first_word(n), "word"), (second_word(n), "word"), (n, "phrase")))
    )
    terms = vocabulary.select(F.lower("term").alias("term"), "kind").distinct()
    return distinct.select(name, F.inline(keys)).join(terms, ["term", "kind"], "left_semi").select(name).distinct()


def redact_with_table(
    df: DataFrame,
    vocabulary: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    terms: PreserveTerms = DEFAULT_TERMS,
    normalize: bool = False,
) -> DataFrame:
    """As ``redact_documents`` with the terms of ``vocabulary (term, kind)`` as well, a table of any size.

    Distinct pairs are joined with the terms, and the pairs that stay with their documents. Documents are known by 128
    bits of hash of id and text. Other than with a short vocabulary, texts take part in one shuffle, so
    use ``load_terms`` for one that fits.
    """
    body = normalize_text(F.col(text)) if normalize else F.col(text)
    parts = (F.col(id).cast("string"), F.col(text))
    row = (F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts))
    docs = df.select(id, *keep, row[0].alias("__h"), row[1].alias("__g"), body.alias("__body"))
    pairs = docs.select("__h", "__g", F.explode_outer(names_seen(F.col("__body"))).alias("__name"))
    pairs = pairs.filter("__name is not null")
    kept = (
        pairs.join(in_vocabulary(pairs, vocabulary, "__name"), "__name", "left_semi")
        .groupBy("__h", "__g")
        .agg(F.collect_set("__name").alias("__kept"))
    )
    joined = docs.join(kept, ["__h", "__g"], "left")
    return joined.select(id, *keep, redact(F.col("__body"), terms, F.col("__kept")).alias("redacted")).select(
        id, *keep, "redacted.redacted_text", "redacted.stats"
    )


def redaction_stats(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    terms: PreserveTerms = DEFAULT_TERMS,
    normalize: bool = False,
) -> DataFrame:
    """Counts only, one column per kind."""
    return redact_documents(df, id, text, keep, terms, normalize).select(id, *keep, "stats.*")


def find_pii(
    df: DataFrame, id: str = "doc_id", text: str = "text", terms: PreserveTerms = DEFAULT_TERMS
) -> DataFrame:
    """Every match of every rule on the text as it is: ``(id, kind, match, kept)``.

    One pass over the documents: the matches of all kinds go into one array that is exploded.
    """
    t = F.col(text)

    def mentions(kind, hits, kept):
        return F.transform(
            hits,
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"), hit.alias("match"), kept(hit, i).alias("kept")
            ),
        )

    def phones(turns):
        found = F.transform(
            turns,
            lambda hit, i: F.when(
                i % 2 == 1,
                F.struct(
                    F.lit("phone_numbers").alias("kind"),
                    hit.alias("match"),
                    is_reference_number(hit, text_before(turns, i)).alias("kept"),
                ),
            ),
        )
        return matches_of(found)

    per_kind = [
        mentions("ip_addresses", find_all(t, P.IP_ADDRESS), lambda hit, i: is_private_ip(hit)),
        F.when(may_match(t, P.PHONE_PART), let(split_at(t, P.PHONE), phones)).otherwise(F.array()),
        mentions("names_truncated", find_all(t, P.NAME), lambda hit, i: preserve_term(hit, terms)),
    ]
    for kind, (pattern, _, hint) in P.PLAIN_RULES.items():
        hits = find_emails(t) if kind == "email_addresses" else find_all(t, pattern, hint)
        per_kind.append(mentions(kind, hits, lambda hit, i: F.lit(False)))
    return inline_rows(df, [id], F.concat(*per_kind), "kind")


def redaction_groups(stats: DataFrame, *by: str) -> DataFrame:
    """One row of sums per group. Groups of several runs are groups again, so they can be kept (``sources.keep_groups``)
    and added to."""
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("total_redactions") == 0).alias("clean_documents"),
        *(F.sum(k).alias(k) for k in STATS),
    )


def redaction_rollup(stats: DataFrame, *by: str) -> DataFrame:
    """Sums per kind, documents without a hit and their share, for every prefix of ``by``.

    Documents are summed up to one row per group first and subtotals are made from those rows:
    a rollup over documents would handle each of them once per subtotal. Only partial sums are
    shuffled, so a source that holds most of the documents costs no more than a small one.
    """
    return rollup_redaction_groups(redaction_groups(stats, *by), *by)


def rollup_redaction_groups(groups: DataFrame, *by: str) -> DataFrame:
    """``redaction_rollup`` from ``redaction_groups``, of one run or of many."""
    total = {k: F.sum(k) for k in ("documents", *STATS, "clean_documents")}
    other = sum((total[k] for k in P.OTHER_KINDS[1:]), total[P.OTHER_KINDS[0]])
    return groups.rollup(*by).agg(
        *(c.alias(k) for k, c in total.items()),
        other.alias("other_redactions"),
        (total["clean_documents"] / total["documents"]).alias("clean_share"),
    )
