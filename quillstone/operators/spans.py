"""Spans over many rows: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running_max, running_sum


def merged_intervals(rows: DataFrame, group: str, start: str, end: str, gap: int = 30, **how) -> DataFrame:
    """group, start, end of intervals merged where one begins at most `gap` after the furthest end so far.

    Intervals of one start are the longest of them, so no group has more rows than starts. The furthest end before a start
    and the number of islands up to it are scans over cells of starts."""
    longest = rows.groupBy(group, start).agg(F.max(end).alias(end))
    reached = running_max(longest, F.col(end), [start], [group], "__reach", before=True, **how)
    fresh = (F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap)).cast("int")
    islands = running_sum(reached, fresh, [start], [group], "__island", **how)
    return islands.groupBy(group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
