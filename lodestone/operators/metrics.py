"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question_scores(gold: DataFrame, hits: DataFrame, key: str = "heading_path", keys: tuple[str, ...] = ("system", "query_id")) -> DataFrame:
    """One row for each question and system: first_gold_rank, recall_at_1, recall_at_3, reciprocal_rank_at_5, returned_count.

    gold has the columns keys and key, hits those and rank.  A question without hits scores zero.
    """
    want = gold.select(*keys, F.col(key).alias("__gold"))
    met = want.join(hits.select(*keys, "rank", F.col(key).alias("__key")), list(keys), "left")
    first = met.groupBy(*keys).agg(F.min(F.when(F.col("__key") == F.col("__gold"), F.col("rank"))).alias("first_gold_rank"), F.count("rank").alias("returned_count"))
    at = F.col("first_gold_rank")
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return first.select(
        *keys, "first_gold_rank", yes(at == 1).alias("recall_at_1"), yes(at <= 3).alias("recall_at_3"),
        reciprocal_rank(at).alias("reciprocal_rank_at_5"), "returned_count",
    )


def reciprocal_rank(rank: Column, within: int = 5) -> Column:
    return F.when(rank <= within, 1.0 / rank).otherwise(F.lit(0.0))


def aggregates(scores: DataFrame, key: str = "system") -> DataFrame:
    """One row a system: question_count, recall_at_1, recall_at_3, mrr_at_5; plain means."""
    return scores.groupBy(key).agg(
        F.count("*").alias("question_count"), F.avg("recall_at_1").alias("recall_at_1"), F.avg("recall_at_3").alias("recall_at_3"), F.avg("reciprocal_rank_at_5").alias("mrr_at_5")
    )


def rank_gaps(hits: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The keys whose ranks aren't 1, 2, 3, ..."""
    per = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks"))
    return per.where("low <> 1 or high <> n or ranks <> n").select(*keys)
