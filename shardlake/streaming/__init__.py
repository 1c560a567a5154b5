"""Lazy, chunked reading of query results."""
