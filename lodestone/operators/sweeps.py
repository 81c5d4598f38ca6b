"""What comes before a row in its group: sums, maxima, first and last values, over groups of any size.

Rows are sorted into ranges by group and order, so a large group lies in several ranges; each range is summed up by itself, and one row a
range tells what the ranges before come to.  No task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


@dataclass(frozen=True)
class Running:
    """A kind of running value, over a column whose nulls don't count."""

    kind: str
    column: Column

    def over(self, window) -> Column:
        """The value over a window's rows."""
        known = {"total": F.sum, "highest": F.max, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
        return known[self.kind](self.column).over(window)

    def of_part(self, row: str) -> Column:
        """The value over a group's rows of one range, whose order is row."""
        at = F.when(self.column.isNotNull(), F.col(row))
        known = {"total": lambda: F.sum(self.column), "highest": lambda: F.max(self.column), "first": lambda: F.min_by(self.column, at), "last": lambda: F.max_by(self.column, at)}
        return known[self.kind]()

    def joined(self, earlier: Column, own: Column) -> Column:
        """What two values come to, of which earlier is of rows before."""
        known = {"total": lambda: F.coalesce(earlier + own, earlier, own), "highest": lambda: F.greatest(earlier, own), "first": lambda: F.coalesce(earlier, own), "last": lambda: F.coalesce(own, earlier)}
        return known[self.kind]()


def total(column: Column | int) -> Running:
    return Running("total", F.lit(column) if isinstance(column, int) else column)


def highest(column: Column) -> Running:
    return Running("highest", column)


def first(column: Column) -> Running:
    return Running("first", column)


def last(column: Column) -> Running:
    return Running("last", column)


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df in sorted ranges, with __row, which numbers rows in that order, and __part, the range; rows of equal order are split as well."""
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    by = [*group, *order, "__salt"]
    rows = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("__salt").withColumn("__row", F.monotonically_increasing_id())
    return stage(rows.withColumn("__part", F.shiftright("__row", 33)), "ranged")


def running(rows: DataFrame, group: Sequence[str], **columns: Running) -> DataFrame:
    """rows of ranged() with a value of the earlier rows of the same group for each of columns; null where there are none.

    Ranges are sorted by group, so at most one group goes on from a range into the next: the carried rows, which are
    broadcast, are at most as many as ranges.
    """
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "__part").agg(*[r.of_part("__row").alias(name) for name, r in columns.items()])
    carried = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), *[Running(r.kind, F.col(name)).over(over).alias(f"__{name}") for name, r in columns.items()])
    carried = carried.where(" or ".join(f"`__{name}` is not null" for name in columns))
    own = Window.partitionBy("__part", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({name: r.over(own) for name, r in columns.items()})
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    met = rows.join(F.broadcast(carried), same, "left")
    met = met.withColumns({name: r.joined(F.col(f"__{name}"), F.col(name)) for name, r in columns.items()})
    return met.drop("__p", *[f"__g{i}" for i in range(len(group))], *[f"__{name}" for name in columns])


def before(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], split: bool = True, **columns: Running) -> DataFrame:
    """df with a value of the earlier rows of the same group for each of columns; null where there are none.

    Nulls of the group's columns are a group.  Rows of equal order come one after the other, in any order.  split=False is for
    groups known to be small: one task then holds a group, and nothing is stored.
    """
    if split:
        return running(ranged(df, group, order), group, **columns).drop("__row", "__part")
    own = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: r.over(own) for name, r in columns.items()})
