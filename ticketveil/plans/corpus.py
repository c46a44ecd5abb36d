"""Pages to redacted documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.redaction import DEFAULT_TERMS, PreserveTerms
from ..operators.documents import assemble_pages
from ..operators.parts import normalize_parts, redact_parts
from ..operators.redaction import redact_documents


def redact_pages(
    pages: DataFrame, max_pages: int | None = None, terms: PreserveTerms = DEFAULT_TERMS
) -> DataFrame:
    """``(doc_id, page_no, text)`` to ``(doc_id, redacted_text, stats)``.

    The only shuffle brings the pages of a document together; lines, markup and redaction are
    row expressions on its result.
    """
    return redact_documents(assemble_pages(pages, max_pages=max_pages), terms=terms, normalize=True)


def redact_page_parts(
    pages: DataFrame,
    pages_per_part: int,
    max_pages: int | None = None,
    terms: PreserveTerms = DEFAULT_TERMS,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(doc_id, part, redacted_text, stats)``: as ``redact_pages`` for documents of any length. The texts of a document's
    parts, one after the other, are its redacted text, and their counts add up to its counts.

    No group holds a document: pages are put together to parts, parts are cut anew where no rule reaches over.
    ``store`` writes a result that several steps read (``plans.stored`` with its folder)."""
    parts = assemble_pages(pages, max_pages=max_pages, pages_per_part=pages_per_part)
    parts = store(parts) if store else parts
    normal = normalize_parts(parts, sep="\n", store=store)
    return redact_parts(store(normal) if store else normal, terms=terms)
