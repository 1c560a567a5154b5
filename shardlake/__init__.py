"""Sharded tables as single Spark DataFrames: routing, pruning, scatter queries, relationships and paging."""
