"""Exact search by cosine over unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.tables import BROADCAST_ROWS, is_small
from ..functions.vectors import dot
from .bm25 import DIGITS, MAX_TOP_K, check_parameters

#: Points of a part and queries of a block on average; each block meets each part in a group of its own.
PART, BLOCK = 20_000, 4_000
#: Queries of a block that are compared at once, and the largest number in a vector whose products are bounded in advance.
TILE, LARGEST = 250, 1e15


def of_model(points: DataFrame, model: tuple[str, str]) -> DataFrame:
    """points, whose vectors can only be read of the model (name, revision); one of another fails the job that reads it."""
    same = F.col("embedding_model").eqNullSafe(F.lit(model[0])) & F.col("embedding_revision").eqNullSafe(F.lit(model[1]))
    refused = F.raise_error(F.concat(F.lit("a point is of another model: "), F.coalesce("embedding_model", F.lit("none"))))
    return points.withColumn("embedding", F.when(same, F.col("embedding")).otherwise(refused.cast(points.schema["embedding"].dataType)))


def _nearest(top_k: int, asked: pa.Table, told: pa.Table) -> pa.Table:
    """(query_id, doc_id, score): a superset of the top_k of told for each of asked, whose vectors are finite and of one size.

    A matrix product, whose sums may differ from dot()'s in their last digits, finds all that can be among the top by more than that; their
    scores are then added from the first element on, as dot() does.  Of equal vectors the first top_k by doc_id are enough.
    """
    rows = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    found = [np.zeros((3, 0))]
    if told.num_rows and asked.num_rows:
        told = told.take(pc.sort_indices(told, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        _, kind = np.unique(rows(told, "embedding"), axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        runs = kind.ravel()[order]
        nth = np.arange(len(runs)) - np.searchsorted(runs, runs)
        told = told.take(pa.array(np.sort(order[nth < top_k])))
        e, q = rows(told, "embedding"), rows(asked, "asked")
        slack = 1e-9 + 8 * e.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * max(1.0, np.linalg.norm(e, axis=1).max(initial=0.0))
        for at in range(0, len(q), TILE):
            part = q[at : at + TILE] @ e.T
            bar = np.partition(part, -top_k, axis=1)[:, -top_k] if top_k < len(e) else np.full(len(part), -np.inf)
            u, v = np.nonzero(part >= (bar - 2 * slack[at : at + TILE])[:, None])
            score = np.zeros(len(u))
            for k in range(e.shape[1]):
                score += e[v, k] * q[at + u, k]
            found.append(np.stack([at + u, v, score]))
    u, v, score = np.concatenate(found, axis=1)
    ids = [asked.column("query_id").take(pa.array(u.astype(np.int64))), told.column("doc_id").take(pa.array(v.astype(np.int64)))]
    return pa.table([*ids, pa.array(score)], names=["query_id", "doc_id", "score"])


def _candidates(told: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """_nearest() of blocks of the queries and parts of the points, each pair of which is a group."""
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((told, PART), (asked, BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = told.withColumn("part", deal("doc_id", parts)).withColumn("block", every(blocks)).withColumn("size", F.size("embedding"))
    asked = asked.withColumn("block", deal("query_id", blocks)).withColumn("part", every(parts)).withColumn("size", F.size("asked"))
    keys, schema = ["block", "part", "size"], StructType([asked.schema["query_id"], told.schema["doc_id"], StructField("score", DoubleType())])
    return asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(top_k, a, b), schema)


def search(points: DataFrame, queries: DataFrame, top_k: int = MAX_TOP_K, most: int = BROADCAST_ROWS, model: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the top_k points of each query; ties by doc_id.

    points has doc_id and embedding, queries query_id and embedding.  Exact search compares every query with every point, in blocks
    of both, and a group keeps what can be among the top_k of a query before the shuffle.  Vectors with a null, a NaN or a number beyond LARGEST
    are few and are compared row by row; their queries, most at most, are broadcast.

    model is the name and revision of the model that the queries were embedded with; points then need embedding_model and
    embedding_revision, and a point of another model, which no score could be compared with, fails the search.
    """
    check_parameters(top_k)
    points = of_model(points, model) if model else points
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    told = points.select("doc_id", "embedding")
    plain = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False))), F.lit(False))
    odd, strange = told.where(~plain("embedding")), asked.where(~plain("asked"))
    scored = _candidates(told.where(plain("embedding")), asked.where(plain("asked")), top_k)
    same = F.size("embedding") == F.size("asked")
    for some, of in ((odd, asked), (told.where(plain("embedding")), strange)):
        if not some.limit(1).count() or not of.limit(1).count():
            continue
        side = F.broadcast(of) if is_small(of, most) else of
        scored = scored.unionByName(some.join(side, same).select("query_id", "doc_id", dot(F.col("embedding"), F.col("asked")).alias("score")))
    scored = scored.withColumn("score", F.round("score", DIGITS))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
