"""Mixing sources to target weights by hash-threshold histograms, on Spark's own functions only.

Every document has a place on a line: the hash of its id and text, and where rows repeat, of which of them it is.  A source's budget is met by taking the documents below a
threshold on that line.  The threshold comes from histograms, never from a sort: sizes are summed by source and
hash bucket, the bucket in which the budget runs out is found, and only that bucket is cut again.  Below the thresholds,
smaller budgets take subsets of what larger ones take; reruns take the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sweeps import before, total
from .common import n_words, running, stage, within_bound

#: Bits of the hash that each histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 3
SEED = 20_240_917


def _bits(level: int) -> Column:
    """The hash bits that this level's histogram counts by."""
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def targets(totals: DataFrame, weights: Sequence[int], cap: float, share: float) -> DataFrame:
    """Adds target to (source, source_size): one row a source.

    Sources in code-point order, null last, get the weights in turn.  A target stops at cap times the source's size and
    the rest is shared again by weight.  That is one level for all sources below their caps, target = level * weight,
    and each round below finds it for the sources known to be capped so far; one row a round reaches the driver.
    """
    ranked = running(stage(totals, "totals"), [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    totals = stage(ranked.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))), "sources")
    whole = float(totals.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        n, held, free = totals.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not free:
            break
        capped, level = n, (whole - (held or 0.0)) / free
    full = F.col("most") <= F.lit(level) * F.col("w")
    return totals.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def _placed(rows: DataFrame, text: Column) -> DataFrame:
    """rows (doc_id, source) with __h, each one's place on the line.

    Rows of one source, doc_id and text have places of their own, by their number among them, so a budget can end between them; who
    has which number is of no matter to what is taken.  No task holds all rows that repeat.
    """
    rows = rows.withColumn("__h", F.xxhash64("doc_id", text, F.lit(SEED)))
    again = rows.groupBy(F.col("source").alias("__source"), F.col("__h").alias("__same")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    again = stage(again, "repeated")
    if not again.limit(1).count():
        return rows
    met = rows.join(within_bound(again), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__h") == F.col("__same")), "left").drop("__source")
    numbered = before(met.where("__same is not null"), ["source", "__h"], [F.xxhash64(*rows.columns)], __nth=total(1))
    numbered = numbered.withColumn("__h", F.when(F.col("__nth") > 0, F.xxhash64("__h", "__nth")).otherwise(F.col("__h")))
    return met.where("__same is null").drop("__same").unionByName(numbered.drop("__same", "__nth"))


def thresholds(sized: DataFrame, weights: Sequence[int], cap: float, share: float) -> DataFrame:
    """One row a source: source_size, target, whole (copies of all its documents), edge and last.

    Documents whose hash begins below edge are taken once more, and so is the one whose hash is last.  sized has source, size and h.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = stage(goal.withColumn("edge", F.lit(0).cast("long")), "budgets")
    edge, own = goal, F.col("s.source").eqNullSafe(F.col("e.source"))
    for level in range(LEVELS):
        inside = own
        if level:
            inside &= F.shiftrightunsigned("s.h", 64 - BITS * level) == F.col("e.edge")
        counts = sized.alias("s").join(within_bound(edge.select("source", "edge")).alias("e"), inside).select("s.source", "size", _bits(level).alias("b")).groupBy("source", "b").agg(F.sum("size").alias("n"))
        # at most 2**BITS rows a source meet in this window
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        counts = counts.withColumn("upto", upto).alias("c").join(edge.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")))
        found = counts.where(F.col("upto") > F.col("left")).groupBy("e.source").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("below")), "b").alias("cut"))
        edge = stage(edge.alias("e").join(found.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source"))).select(
            "e.source", "source_size", "target", "whole",
            (F.col("left") - F.col("cut.below")).alias("left"),
            (F.shiftleft(F.col("edge"), BITS) + F.col("cut.b")).alias("edge"),
        ), "budgets")
    # sources whose budget ends nowhere (no words, or all of it in whole copies) have no edge and take no more
    edge = stage(goal.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select(
        "g.source", "g.source_size", "g.target", "g.whole", "e.edge", "e.left",
    ), "thresholds")
    # what is left below the threshold goes to the one document whose size comes nearest to it
    miss = F.abs(F.col("size") - F.col("left"))
    rest = sized.alias("s").join(within_bound(edge).alias("e"), own).where((F.shiftrightunsigned("h", 64 - BITS * LEVELS) >= F.col("edge")) & (miss < F.col("left")))
    last = rest.groupBy("s.source").agg(F.min_by("h", F.struct(miss, "h")).alias("last"))
    edge = edge.alias("g").join(last.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
    return stage(edge.select("g.source", "source_size", "target", "whole", "edge", "last"), "thresholds")


def _copies(place: Column) -> Column:
    """How often a document is taken, by the row of thresholds() that e names."""
    below = F.shiftrightunsigned(place, 64 - BITS * LEVELS) < F.col("e.edge")
    return F.col("e.whole") + F.coalesce(below.cast("long"), F.lit(0)) + F.coalesce((place == F.col("e.last")).cast("long"), F.lit(0))


def _sized(docs: DataFrame) -> DataFrame:
    rows = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("told")), "sized")
    placed = _placed(rows, F.col("told")).withColumnRenamed("__h", "h").drop("told")
    return stage(placed, "placed")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies, source.

    docs needs doc_id, text and source; other columns are ignored.  size counts words (null text: 0).  A document is
    taken copies times: as often as the target holds its whole source, plus once more below the source's threshold.
    One document more is taken where that brings the source nearer to its target.
    Null sources are one source, the last.  Of rows that repeat each may be taken or not.  A source without
    words has target 0 and copies 0.  An empty table gives no rows.
    """
    sized = _sized(docs)
    edge = within_bound(thresholds(sized, weights, cap, share))
    out = sized.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source"))).withColumn("copies", _copies(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "s.source")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """docs as the mix takes them: rows not taken go, rows taken more than once repeat.  Columns as in docs.

    Sources are few, so their thresholds go to the documents; texts aren't shuffled, but for those of rows that repeat.  For the
    cases see mix().
    """
    edge = within_bound(thresholds(_sized(docs), weights, cap, share))
    placed = _placed(docs, F.xxhash64("text"))
    out = placed.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")))
    taken = out.select("d.*", _copies(F.col("__h")).cast("int").alias("__copies")).where("__copies > 0")
    return taken.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(docs.columns)
