"""Redaction, audit-report analytics and ticket checks for large text collections on Spark."""
