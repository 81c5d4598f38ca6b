"""A BM25 index that is built once and searched often.

Postings are stored by term in buckets, a row for each term and block of documents, with the largest weight that the term has in the
block.  A search reads the buckets of its own terms only.  It first adds up, from these rows' heads, the most that any document of a
block can score; scores the most promising blocks of each query exactly; and then only those others that can still reach
the top.  The result is that of the full scan, bm25.search().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import if_small, is_small, shuffled
from ..functions.text import tokens
from ..staging import stage
from .bm25 import DIGITS, MAX_TOP_K, B, K1, check_parameters, counted, idf, query_terms, weight

#: Buckets of terms, documents of a block on average, and blocks of each query that are scored first.
BUCKETS, BLOCK, SEEDS = 64, 64, 16
#: Blocks of a bucket that may be in one file, and whose documents' terms a task of the build gets at most on average.
PART, TASK = 512, 32
#: Sums in another order differ by less.
SLACK = 1e-6
VERSION = 1
#: The fields of an entry.
ENTRY = ("doc_id", "at", "dl", "tf")


@dataclass(frozen=True)
class Index:
    """An index at path, opened."""

    spark: SparkSession
    path: str
    version: str
    n_docs: int
    avgdl: float
    k1: float
    b: float
    buckets: int
    blocks: int
    schema: str

    def read(self, table: str) -> DataFrame:
        """terms (bucket, term, df) or postings (bucket, term, block, most, entries)."""
        schema = StructType.fromJson(json.loads(self.schema)) if table == "postings" else _TERMS
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.version}/{table}")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, k1: float = K1, b: float = B, order: str = "doc_id", buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Indexes docs (doc_id, text, and the column order, by which a search breaks ties) at path.

    An earlier index at path is read until this one is whole: the row of statistics, which opens an index, is written last.
    Documents without tokens count for the mean length.
    """
    check_parameters(1, k1, b)
    spark, version = docs.sparkSession, uuid.uuid4().hex
    keys = list(dict.fromkeys(["doc_id", order]))
    read = docs.select(*keys, tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    n_docs, avgdl = read.agg(F.count("*"), F.avg("dl")).first()
    blocks = max(1, -(-n_docs // block))
    own = weight(F.col("tf"), F.col("dl"), F.lit(float(avgdl or 0.0)), float(k1), float(b))
    entry = F.struct(F.col("doc_id"), F.col(order).alias("at"), "dl", "tf")
    rows = counted(read, keys, "dl").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("bucket", _bucket(F.col("term"), buckets))
    # the only shuffle: a task gets some buckets' terms of some blocks, so that a term of all documents is no one task's, and a bucket has few files
    parts, tasks = -(-blocks // PART), max(spark.sparkContext.defaultParallelism, -(-blocks // TASK))
    rows = rows.withColumn("part", F.col("block") % parts).repartition(tasks, "bucket", "part")
    rows = rows.groupBy("bucket", "part", "term", "block").agg(F.max(own).alias("most"), F.count("*").alias("n"), F.collect_list(entry).alias("entries")).drop("part")
    rows = rows.select("term", "block", "most", "n", "entries", "bucket")
    rows.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/{version}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/{version}/postings")
    df = postings.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/{version}/terms")
    stats = (VERSION, version, n_docs, float(avgdl or 0.0), float(k1), float(b), buckets, blocks)
    spark.createDataFrame([(*stats, rows.schema.json())], _STATS).withColumn("built", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/indexes")
    return opened(spark, path)


_STATS = "schema_version int, version string, n_docs long, avgdl double, k1 double, b double, buckets int, blocks int, schema string"
_TERMS = "term string, df long, bucket int"


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was built last at path."""
    row = spark.read.schema(f"{_STATS}, built timestamp").parquet(f"{path}/indexes").orderBy(F.desc("built")).first()
    if row is None or row.schema_version != VERSION:
        raise ValueError(f"no index of version {VERSION} at {path}")
    return Index(spark, path, row.version, row.n_docs, row.avgdl, row.k1, row.b, row.buckets, row.blocks, row.schema)


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, bucket, term, idf): the terms of the queries that the index has; as many numbers as buckets reach the driver."""
    asked = stage(query_terms(queries).select("query_id", "term").withColumn("bucket", _bucket(F.col("term"), index.buckets)), "asked")
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]
    known = index.read("terms").where(F.col("bucket").isin(wanted)).join(if_small(asked), ["bucket", "term"])
    return stage(known.select("query_id", "bucket", "term", idf(F.lit(index.n_docs), F.col("df")).alias("idf")), "terms")


def _wanted(index: Index, terms: DataFrame, columns: list[str]) -> DataFrame:
    """The postings of terms, these columns of them; other buckets' files aren't read."""
    wanted = [r.bucket for r in terms.select("bucket").distinct().collect()]
    return index.read("postings").where(F.col("bucket").isin(wanted)).select("bucket", "term", "block", *columns).join(if_small(terms), ["bucket", "term"])


def bounds(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, block, bound): the most that a document of the block can score; of postings only the heads are read."""
    return _wanted(index, terms, ["most"]).groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))


def scored(index: Index, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, doc_id, at, score): the exact scores of the documents of each query's blocks (query_id, block)."""
    some = blocks.select("query_id", "block")
    if is_small(some):
        met = _wanted(index, terms, ["entries"]).join(F.broadcast(some), ["query_id", "block"])
    else:
        # postings are shuffled once, not once a query, as arrays of numbers; a document is in one block, whose task sums up its scores for all queries
        flat = [F.col(f"entries.{c}").alias(f"{c}s") for c in ENTRY]
        found = _wanted(index, terms.select("bucket", "term").distinct(), ["entries"]).select("bucket", "term", "block", *flat)
        asking = some.groupBy("block").agg(F.collect_list("query_id").alias("queries"))
        met = found.join(shuffled(asking), "block").join(if_small(terms), ["bucket", "term"]).where(F.array_contains("queries", F.col("query_id")))
        met = met.withColumn("entries", F.arrays_zip(*[F.col(f"{c}s").alias(c) for c in ENTRY]))
    each = met.select("block", "query_id", "idf", F.inline("entries").alias(*ENTRY))
    part = F.col("idf") * weight(F.col("tf"), F.col("dl"), F.lit(index.avgdl), index.k1, index.b)
    return each.groupBy("block", "query_id", "doc_id", "at").agg(F.round(F.sum(part), DIGITS).alias("score")).drop("block")


def plan_blocks(index: Index, terms: DataFrame, top_k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search scores: the first blocks' documents, the other blocks that can still reach the top, and all blocks with their bounds."""
    found = stage(bounds(index, terms), "bounds")
    by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    chosen = stage(found.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= seeds).select("query_id", "block"), "seeds")
    first = stage(scored(index, terms, chosen), "scored")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = first.withColumn("nth", F.row_number().over(by)).where(F.col("nth") == top_k).select("query_id", F.col("score").alias("least"))
    rest = found.join(chosen, ["query_id", "block"], "left_anti").join(if_small(least), "query_id", "left")
    # a query of fewer hits so far has no bar yet
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "block")
    return first, stage(rest, "rest"), found


def search(index: Index, queries: DataFrame, top_k: int = MAX_TOP_K, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, doc_id, score): as bm25.search() over the documents of the index, with its parameters and order.

    A query's rows are its blocks and the postings of those that can reach the top, not the documents that have its terms.
    """
    check_parameters(top_k, index.k1, index.b)
    terms = asked_terms(index, queries)
    first, rest, _ = plan_blocks(index, terms, top_k, seeds)
    ranked = first.unionByName(scored(index, terms, rest))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "at", "doc_id")
    top = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
