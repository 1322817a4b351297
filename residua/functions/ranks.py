"""Rank columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(value: Column | str, *parts: Column | str) -> Column:
    """1-based rank within parts in which ties share their mean rank."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*parts).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*parts, value)) - 1) / F.lit(2.0)


def percentile(value: Column | str, *parts: Column | str) -> Column:
    """average_rank as a share of the rows."""
    return average_rank(value, *parts) / F.count(F.lit(1)).over(Window.partitionBy(*parts))
