"""Queries and the SQL that they equal."""

from . import conversations, queries, streams  # noqa: F401  the modules register their queries
