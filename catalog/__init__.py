"""Queries on the test tables, each with the same result written in SQL."""
