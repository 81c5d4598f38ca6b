"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import shuffled
from ..staging import checkpoint_dir, drop, drop_staged, stage

__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "WORD", "checkpoint_dir", "drop", "drop_staged", "n_words", "running", "shuffled", "small_batches", "stage", "within_bound"]

#: A word, in Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast; its rows must be of a fixed size (numbers and short keys).
BROADCAST_ROWS = 50_000

#: Rows of a range that running() sums up.
RANGE_ROWS = 100_000

#: Rows a batch that Python workers get.  Texts are a few kB, so a batch is a few MB.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that are sent to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def within_bound(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; otherwise for joins that shuffle.

    Counts df, so stage it before.  Shuffled joins leave hot keys to AQE, which splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def running(df: DataFrame, order: Sequence[Column | str], amount: Column, name: str = "before", rows: int = RANGE_ROWS) -> DataFrame:
    """df with the sum of amount over all rows before, in this order (which should leave no ties); no task sees all rows.

    df is sorted into ranges of about so many rows, the ranges are summed up, and then the rows of each.
    """
    n = max(1, -(-df.count() // rows))
    ranged = stage(df.withColumn("__amount", amount).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    # one row a range
    earlier = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    bases = ranged.groupBy("__range").agg(F.sum("__amount").alias("n")).select("__range", F.coalesce(earlier, F.lit(0)).alias("__base"))
    own = F.sum("__amount").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__amount")
    summed = ranged.withColumn("__own", own).join(within_bound(stage(bases, "bases")), "__range")
    return summed.withColumn(name, F.col("__base") + F.col("__own")).drop("__amount", "__range", "__base", "__own")


def n_words(text: Column) -> Column:
    """The number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
