"""The operators put together: from pages to redacted text, from text and reports to a batch."""

from .batch import batch_files, prompt_table
from .corpus import redact_page_parts, redact_pages
from .stored import stored

__all__ = ["batch_files", "prompt_table", "redact_page_parts", "redact_pages", "stored"]
