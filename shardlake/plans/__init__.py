"""Immutable queries over sharded tables and the context they run in."""
