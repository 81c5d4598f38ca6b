"""Helpers for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most so many rows may be broadcast.
BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has few rows; otherwise Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if is_small(df, rows) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for joins that shuffle: Spark's estimate leaves out what explode() adds, and so may broadcast a table of any size."""
    return df.hint("merge")
