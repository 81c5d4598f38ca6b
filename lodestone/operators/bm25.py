"""BM25 over a corpus, for many queries in one plan.

A document's length is known where it is read, so only the occurrences of query terms are exploded and shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import is_small
from ..functions.text import query_error, tokens

K1, B, MAX_TOP_K, DIGITS = 1.5, 0.75, 8, 9


def check_parameters(top_k: int, k1: float = K1, b: float = B) -> None:
    """Refuses what the search isn't defined for."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be a whole number from 1 to {MAX_TOP_K}")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in (k1, b)) or not (0 < k1 < float("inf") and 0 <= b <= 1):
        raise ValueError("k1 must be above 0 and b from 0 to 1")


def counted(read: DataFrame, ids: list[str], *more: str) -> DataFrame:
    """(ids, more, term, tf) of read (ids, more, tokens): how often those of equal ids and more have each term.

    A row whose ids no other row has is counted where it is read, without a shuffle: its tokens are sorted, so that equal ones stand
    together.  Tokens are shuffled of rows that share their ids only.
    """
    columns = [*ids, *more]

    def alone(df: DataFrame) -> DataFrame:
        own = df.select(*columns, F.sort_array("tokens").alias("tokens"))
        # how many tokens there are up to the last of each term; get() finds null outside
        last = F.transform("tokens", lambda t, i: F.when(~t.eqNullSafe(F.get("tokens", i + 1)), i + 1))
        own = own.select(*columns, "tokens", F.array_compact(last).alias("ends"))
        one = lambda end, i: F.struct(F.get("tokens", end - 1).alias("term"), (end - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("long").alias("tf"))
        return own.select(*columns, F.inline_outer(F.transform("ends", one))).where("term is not null")

    def together(df: DataFrame) -> DataFrame:
        terms = df.select(*columns, F.explode_outer("tokens").alias("term")).where("term is not null")
        return terms.groupBy(*columns, "term").agg(F.count("*").alias("tf"))

    # of the rows only the ids are read and shuffled
    shared = read.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"shared_{c}") for c in ids])
    if shared.isEmpty():
        return alone(read)
    if not is_small(shared):
        return together(read)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"shared_{c}")) for c in ids])  # null ids are one id
    pick = lambda how: read.join(F.broadcast(shared), same, how)
    return alone(pick("left_anti")).unionByName(together(pick("left_semi")))


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): how often each document has each term."""
    return counted(docs.select(key, tokens(F.col(text)).alias("tokens")), [key])


def document_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df): how many documents have each term."""
    terms = docs.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, total_tokens, avgdl; documents without tokens count."""
    length = F.size(tokens(F.col(text)))
    return docs.agg(F.count("*").alias("n_docs"), F.sum(length).alias("total_tokens"), F.avg(length).alias("avgdl"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term, pos): the different terms of each valid query, by first occurrence."""
    valid = queries.where(query_error(F.col(text)).isNull())
    return valid.select(query, F.posexplode(F.array_distinct(tokens(F.col(text)))).alias("pos", "term"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """A term's weight in a document; without any token in the corpus lengths don't count."""
    share = F.when(average > 0, F.lit(1.0 - b) + F.lit(b) * length / average).otherwise(F.lit(1.0))
    return tf * (k1 + 1) / (tf + F.lit(k1) * share)


def search(docs: DataFrame, queries: DataFrame, top_k: int = MAX_TOP_K, k1: float = K1, b: float = B, order: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the top_k documents of each query with a positive score.

    docs has doc_id, text and the column order, by which ties of the score (to nine digits) are broken, then doc_id.
    queries has query_id and text; blank and prefixed ones, and those without a token, have no rows.
    """
    check_parameters(top_k, k1, b)
    asked = query_terms(queries).select("query_id", "term")
    # one count of the queries' terms decides for all that has a row for each of them at most
    keyed = F.broadcast if is_small(asked) else (lambda df: df)
    # no token is empty, so an empty one can stand for the document itself: lengths come with the same shuffle
    vocabulary = asked.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    keys = list(dict.fromkeys(["doc_id", order]))
    read = docs.select(*keys, tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    # a document's tokens go to one task, as they are, so that its terms and its scores for all queries are summed up there without another shuffle
    read = read.repartition(*keys)
    # explode_outer, as a filter on explode's input would find the tokens twice
    hits = read.select(*keys, "dl", F.explode_outer(F.concat(F.array(F.lit("")), "tokens")).alias("term")).join(keyed(vocabulary), "term")
    tf = hits.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    # all three need the counts, and share the shuffle of the tokens
    own = (F.col("term") == "") & (F.col("tf") > 0)
    stats = tf.agg(F.count_if(own).alias("n_docs"), F.avg(F.when(own, F.col("dl"))).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    scored = tf.join(keyed(df), "term").join(F.broadcast(stats)).join(keyed(asked), "term")  # stats is one row
    scored = scored.withColumn("part", idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    # the order of the parts moves a sum by about 1e-14, which rounding takes away
    ranked = scored.groupBy("query_id", *keys).agg(F.round(F.sum("part"), DIGITS).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys[::-1])
    top = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_k)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
