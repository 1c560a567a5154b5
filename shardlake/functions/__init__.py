"""Routing expressions and shard-aware UUIDs."""
