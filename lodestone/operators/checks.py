"""Set comparisons and contracts.  A check returns the rows that break it; an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .sweeps import before, highest, last, ranged, running, total


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The different keys of left that right lacks (stale ids, unknown headings); nulls match nulls."""
    a, b = left.select(*keys).distinct().alias("a"), right.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def shared(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The different keys that both have (contamination)."""
    return left.select(*keys).intersect(right.select(*keys))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    side = F.when(F.col("__r").isNull(), F.lit("left_only")).when(F.col("__l").isNull(), F.lit("right_only"))
    return both.select(key, side.alias("side")).where("side is not null")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def occurrence(df: DataFrame, identity: Sequence[str], order: Sequence[str], name: str = "identity_occurrence") -> DataFrame:
    """df with the number of earlier rows of the same identity."""
    return before(df, identity, order, **{name: total(1)}).withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def running_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, budget: int, split: bool = True) -> DataFrame:
    """df with the running total of amount in its group, and whether the budget still holds.  For split see sweeps.before()."""
    upto = F.coalesce(F.col("running_total") + F.col(amount), F.col("running_total"), F.col(amount))
    out = before(df, group, order, split, running_total=total(F.col(amount))).withColumn("running_total", upto)
    return out.withColumn("within_budget", F.col("running_total") <= budget)


def first_violation(checked: DataFrame, group: Sequence[str], order: Sequence[str], error: str = "error_type") -> DataFrame:
    """(group, error): of each group the first row's error that has one."""
    return checked.where(F.col(error).isNotNull()).groupBy(*group).agg(F.min_by(error, F.struct(*order)).alias(error))


def not_increasing(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The rows whose value isn't above the one before."""
    # a struct is there even where its value is null, so it is the row before that counts
    return before(df, group, order, __before=last(F.struct(F.col(value).alias("v")))).where(F.col(value) <= F.col("__before.v")).drop("__before")


def require_empty(df: DataFrame, message: str) -> None:
    """Raises if df has a row."""
    if df.limit(1).count():
        raise ValueError(message)


def conditions(df: DataFrame, **rules: Column) -> DataFrame:
    """df with violations, the names of the rules that a row breaks; a rule that is null is broken."""
    found = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("violations", F.array_compact(found))


def markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """df with violations of raw Markdown: there is text, it has no NUL, isn't HTML, and a line begins with #."""
    t = F.col(text)
    return conditions(
        df, there=t != "", no_nul=~t.rlike(r"\x00"), no_html=~t.rlike(r"(?iU)^[\s\x1c-\x1f]*<(!doctype html|html)"),
        heading=t.rlike(r"(^|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])#"),
    )


def mit_licence(df: DataFrame, text: str = "text") -> DataFrame:
    """df with violations of the MIT licence's text: there is text, with its name and its grant."""
    t = F.col(text)
    return conditions(df, there=t != "", name=t.contains("MIT License"), grant=t.contains("Permission is hereby granted"))


def covered(inner: DataFrame, outer: DataFrame, group: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows of inner whose span lies in one span of outer.

    Both are swept together by their starts: a span lies in another if the spans that begin before or with it reach its end.  Rows
    with a null in the group or the span lie in none.
    """
    known = " and ".join(f"`{c}` is not null" for c in [*group, start, end])
    a = outer.where(known).select(*group, F.col(start).alias("__start"), F.lit(0).alias("__side"), F.col(end).alias("__end"))
    b = inner.where(known).select(*group, F.col(start).alias("__start"), F.lit(1).alias("__side"), F.struct(*inner.columns).alias("__inner"))
    swept = before(a.unionByName(b, allowMissingColumns=True), group, ["__start", "__side"], __reach=highest(F.col("__end")))
    return swept.where((F.col("__side") == 1) & (F.col("__reach") >= F.col(f"__inner.{end}"))).select("__inner.*")


def merged_spans(df: DataFrame, group: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(group, start, end): the spans of each group, those that meet or overlap as one.

    Ranges of spans are merged by themselves; what reaches from one into the next is told by one row a range.
    """
    reached = running(ranged(df.select(*group, start, end), group, [start, end]), group, __reach=highest(F.col(end)))
    new = (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("int")
    marked = stage(reached.withColumn("__new", new).drop("__reach"), "spans")
    numbered = running(marked, group, __run=total(F.col("__new"))).withColumn("__run", F.coalesce("__run", F.lit(0)) + F.col("__new"))
    return numbered.groupBy(*group, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")
