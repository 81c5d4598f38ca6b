"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CANDIDATES, FINAL = 60, 8, 3


def check_rrf_k(rrf_k: int) -> None:
    if isinstance(rrf_k, bool) or not isinstance(rrf_k, int) or not 1 <= rrf_k <= 1000:
        raise ValueError("rrf_k must be a whole number from 1 to 1000")


def ranking_errors(hits: DataFrame) -> DataFrame:
    """(query_id, error): queries whose hits are too many, repeat a document, or have ranks with gaps."""
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("ranks")
    )
    gap = (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n"))
    error = F.when(F.col("n") > CANDIDATES, "too_many").when(F.col("ids") != F.col("n"), "duplicate").when(gap, "rank_gap")
    return per.select("query_id", error.alias("error")).where("error is not null")


def fuse(bm25: DataFrame, dense: DataFrame, rrf_k: int = RRF_K, provenance: Sequence[str] = ()) -> DataFrame:
    """One row for each query and document of either ranking, ranked by the sum of 1 / (rrf_k + rank).

    Ties: better single rank, smaller sum of ranks (a missing one counts 9), doc_id.  A document that both have must
    agree in the provenance columns; a difference fails the query's job.
    """
    check_rrf_k(rrf_k)
    side = lambda df, name: df.select(
        "query_id", "doc_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"), *[F.col(c).alias(f"{name}_{c}") for c in provenance]
    )
    both = side(bm25, "bm25").join(side(dense, "dense"), ["query_id", "doc_id"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", share("bm25_rank") + share("dense_rank"))
    for c in provenance:
        agree = F.col("bm25_rank").isNull() | F.col("dense_rank").isNull() | F.col(f"bm25_{c}").eqNullSafe(F.col(f"dense_{c}"))
        value = F.when(F.col("bm25_rank").isNull(), F.col(f"dense_{c}")).otherwise(F.col(f"bm25_{c}"))
        both = both.withColumn(c, F.when(agree, value).otherwise(F.raise_error(F.lit(f"{c} differs between the rankings")).cast(bm25.schema[c].dataType)))
    missing = F.lit(CANDIDATES + 1)
    by = Window.partitionBy("query_id").orderBy(
        F.desc("rrf_score"), F.least("bm25_rank", "dense_rank"), F.coalesce("bm25_rank", missing) + F.coalesce("dense_rank", missing), "doc_id"
    )
    ranked = both.withColumn("rank", F.row_number().over(by).cast("long"))
    return ranked.select("query_id", "rank", "doc_id", "rrf_score", "bm25_rank", "dense_rank", "bm25_score", "dense_score", *provenance)


def top(fused: DataFrame, n: int = FINAL) -> DataFrame:
    """The first n of each query."""
    return fused.where(F.col("rank") <= n)
