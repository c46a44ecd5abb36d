"""Reading and writing the tables of the engine."""

from .cache import expire_cache, merge_cache, read_cache
from .tables import (
    append_history,
    keep_groups,
    kept_groups,
    read_documents,
    read_history,
    spread,
    spread_rows,
    write_bundle,
    write_ordered,
    write_redacted,
)

__all__ = [
    "append_history",
    "expire_cache",
    "keep_groups",
    "kept_groups",
    "merge_cache",
    "read_cache",
    "read_documents",
    "read_history",
    "spread",
    "spread_rows",
    "write_bundle",
    "write_ordered",
    "write_redacted",
]
