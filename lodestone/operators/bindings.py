"""Position-aware lookup: which binding of a name does a use see?

Uses and events of a name stand in one sorted stream, so each use reads how many events came before, and the first of them, from
running values: rows are in proportion to the input, however many uses and events a name has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sweeps import before, first, total


def _stream(uses: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool) -> DataFrame:
    """The rows of uses (keys, order, __use) with n, the number of events (keys, order, __event) before them, and __first, the first of those.

    An event at the very place of a use is not before it.  Nulls in keys or order match nothing.
    """
    known = " and ".join(f"`{c}` is not null" for c in [*keys, *order])
    both = uses.where(known).withColumn("__side", F.lit(0)).unionByName(events.where(known).withColumn("__side", F.lit(1)), allowMissingColumns=True)
    seen = before(both, keys, [*order, "__side"], split, n=total(F.col("__side")), __first=first(F.col("__event")))
    return seen.where("__side = 0").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def visible(uses: DataFrame, events: DataFrame, use: Sequence[str], keys: Sequence[str], payload: Sequence[str], scopes: str = "scopes", scope: str = "scope", split: bool = True) -> DataFrame:
    """For each use that any scope has an event for: the columns use, n, and the event's scope, position and payload.

    uses has the columns use, keys, at_line, at_column and scopes, from the innermost on; events has keys, scope, line,
    column and payload.  Of the scopes that have an event before the use, the innermost decides; n tells how many it has, and the
    event is the first of them.  A use is resolved only if n is 1.  split=False if no name has many uses and events, as in one file.
    """
    looked = uses.select(*keys, F.col("at_line").alias("line"), F.col("at_column").alias("column"), F.struct(*use).alias("__use"), F.posexplode(scopes).alias("__depth", "__scope"))
    known = events.select(*keys, F.col(scope).alias("__scope"), "line", "column", F.struct(F.col(scope).alias("scope"), "line", "column", *payload).alias("__event"))
    seen = _stream(looked, known, [*keys, "__scope"], ["line", "column"], split).where("n > 0")
    inner = seen.groupBy("__use").agg(F.min_by(F.struct("n", "__first"), "__depth").alias("__found"))
    return inner.select("__use.*", "__found.n", "__found.__first.*")


def latest_unique(uses: DataFrame, events: DataFrame, use: str, keys: Sequence[str], at: str, when: str, value: str, split: bool = True) -> DataFrame:
    """(use, n, value): the one earlier event with the same keys; null if there is none or more than one."""
    told = uses.select(use, *keys, F.col(at).alias("__at"))
    known = events.select(*keys, F.col(when).alias("__at"), F.struct(F.col(value).alias("value")).alias("__event"))
    seen = _stream(told.withColumn("__use", F.struct(use)).drop(*[c for c in [use] if c not in keys]), known, keys, ["__at"], split)
    found = seen.select(f"__use.{use}", "n", F.when(F.col("n") == 1, F.col("__first.value")).alias(value))
    # what no event can be compared with
    odd = told.where(" or ".join(f"`{c}` is null" for c in [*keys, "__at"]))
    return found.unionByName(odd.select(use, F.lit(0).cast("long").alias("n"), F.lit(None).cast(events.schema[value].dataType).alias(value)))
