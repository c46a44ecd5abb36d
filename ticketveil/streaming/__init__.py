"""Redaction of a stream of documents, reuse of responses over streams."""

from .redact import redact_stream, start_redaction
from .reuse import start_cache, start_first_requests

__all__ = ["redact_stream", "start_cache", "start_first_requests", "start_redaction"]
