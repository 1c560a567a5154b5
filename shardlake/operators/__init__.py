"""Relationships, paging, health, metrics, jobs and migrations."""
